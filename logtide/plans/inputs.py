"""Logs, raw records, alerts and metric samples read from the driver tables.

Every row derives from a row of ``events``. The column rules are plain SQL text that Spark and the checking
engine both read; what the operators do with the rows is written separately on each side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logtide.operators import alerts as alerting
from logtide.operators import dedup
from logtide.operators.normalise import normalise_logs
from logtide.schemas import RAW_LOG
from logtide.session import materialise

AS_OF = "2024-01-29 12:00:00"
END = "2024-01-31 00:00:00"
RESET = "2024-01-16 00:00:00"
LATENCY_EDGES = [100, 500, 1000, 2500]

LEVEL_RULE = """
CASE event_type
  WHEN 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'err' ELSE 'ERROR' END
  WHEN 'purchase' THEN ' Warning '
  WHEN 'signup' THEN 'info'
  WHEN 'view' THEN CASE WHEN event_id % 7 = 0 THEN 'bogus' ELSE 'INFO' END
  ELSE CASE WHEN event_id % 11 = 0 THEN 'fatal' ELSE 'trace' END
END"""
CODE_RULE = """
CASE WHEN event_type = 'error' THEN 500 WHEN k < 60 THEN 200 WHEN k < 70 THEN 302
     WHEN k < 85 THEN 404 WHEN k < 95 THEN 503 END"""
MESSAGE_RULE = "event_type || ' by user ' || user_id || ' k ' || k"

# One clean log per event.
LOG_RULES = {
    "event_id": "event_id",
    "event_type": "event_type",
    "log_id": "'log-' || event_id",
    "service": "'svc-' || (user_id % 10)",
    "level": LEVEL_RULE,
    "message": MESSAGE_RULE,
    "host": "'pod-svc-' || (user_id % 10) || '-' || (user_id % 5)",
    "response_time_ms": "value * 20",
    "error_code": CODE_RULE,
    "metadata": "props",
    "user_id": "user_id",
    "k": "k",
}

# One raw record per event, with faults a client could send.
SECOND = "left(CAST(ts AS STRING), 19)"
RAW_RULES = {
    "event_id": "event_id",
    "log_id": "CASE WHEN event_id % 11 = 0 THEN '  ' WHEN event_id % 83 = 0 THEN NULL"
    " ELSE ' log-' || event_id END",
    "service": "CASE WHEN event_id % 13 = 0 THEN '   ' WHEN event_id % 17 = 0 THEN NULL"
    " WHEN event_id % 19 = 0 THEN repeat('s', 129) WHEN event_id % 3 = 0 THEN '  SVC-' || (user_id % 10) || ' '"
    " ELSE 'svc-' || (user_id % 10) END",
    "level": f"CASE WHEN event_id % 97 = 0 THEN NULL ELSE {LEVEL_RULE} END",
    "message": "CASE WHEN event_id % 23 = 0 THEN '  ' WHEN event_id % 29 = 0 THEN NULL"
    f" WHEN event_id % 31 = 0 THEN repeat('m', 5000) ELSE ' ' || {MESSAGE_RULE} END",
    "host": "CASE WHEN event_id % 37 = 0 THEN repeat('h', 254) WHEN event_id % 5 = 0 THEN NULL"
    " ELSE ' pod-' || (user_id % 5) END",
    "response_time_ms": "CASE WHEN event_id % 41 = 0 THEN 'abc' WHEN event_id % 43 = 0 THEN '-5'"
    " WHEN event_id % 47 = 0 THEN '400000' WHEN event_id % 7 = 0 THEN NULL"
    " ELSE CAST(CAST(round(value * 20) AS BIGINT) AS STRING) END",
    "error_code": "CASE WHEN event_id % 53 = 0 THEN '5.7' WHEN event_id % 59 = 0 THEN '-1'"
    f" WHEN event_id % 61 = 0 THEN '100000' ELSE ' ' || CAST(({CODE_RULE}) AS STRING) END",
    "timestamp": f"""
CASE event_id % 9
  WHEN 0 THEN replace({SECOND}, ' ', 'T') || 'Z'
  WHEN 1 THEN {SECOND}
  WHEN 2 THEN substr({SECOND}, 9, 2) || '/Jan/2024:' || substr({SECOND}, 12, 8) || ' +0100'
  WHEN 3 THEN left({SECOND}, 10)
  WHEN 5 THEN 'garbage'
  WHEN 6 THEN ''
  WHEN 7 THEN replace(replace(replace({SECOND}, '-', ''), ':', ''), ' ', 'T')
  WHEN 8 THEN replace({SECOND}, ' ', 'T') || '+05:00'
END""",
    "ingested_at": f"CASE WHEN event_id % 5 = 0 THEN NULL ELSE replace({SECOND}, ' ', 'T') || 'Z' END",
    "metadata": "props",
}


def rules_sql(rules: dict[str, str]) -> str:
    return ",\n".join(f"{expr} AS {name}" for name, expr in rules.items())


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("k", F.get_json_object("props", "$.k").cast("int"))


def logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean logs with a readable ``timestamp``."""
    rules = [f"{expr} AS {name}" for name, expr in LOG_RULES.items()]
    return events(spark, sf_dir).selectExpr(*rules, "CAST(ts AS TIMESTAMP) AS timestamp")


def raw_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw records as text, with faults."""
    rules = [f"{expr} AS {name}" for name, expr in RAW_RULES.items()]
    epoch = "CASE WHEN event_id % 9 = 4 THEN CAST(unix_seconds(CAST(ts AS TIMESTAMP)) AS DOUBLE) END"
    return events(spark, sf_dir).selectExpr(*rules, f"{epoch} AS epoch_seconds")


def raw_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The raw records as JSON text as they arrive on a topic, some of them broken."""
    raw = raw_logs(spark, sf_dir)
    fields = [F.col(f.name) for f in RAW_LOG.fields if f.name not in ("timestamp", "epoch_seconds", "metadata")]
    stamped = F.when(
        F.col("epoch_seconds").isNotNull(),
        F.to_json(F.struct(*fields, F.col("epoch_seconds").cast("bigint").alias("timestamp"), _metadata())),
    ).otherwise(F.to_json(F.struct(*fields, "timestamp", _metadata())))
    broken = (
        F.when(F.col("event_id") % 71 == 0, F.lit('{"service": "svc'))
        .when(F.col("event_id") % 73 == 0, F.lit('["not", "an object"]'))
        .otherwise(stamped)
    )
    return raw.select("event_id", "service", broken.alias("value"))


def _metadata():
    return F.from_json("metadata", "struct<k:int>").alias("metadata")


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean logs in normalised form. Every event has a time, so ``event_time`` is that column itself, as in a
    stored table, and time filters reach the scan."""
    rows = logs(spark, sf_dir).withColumn("_time", F.col("timestamp"))
    done = normalise_logs(rows, processed_at=F.lit(END).cast("timestamp"), repeatable_ids=["event_id"])
    return done.withColumn("event_time", F.col("_time")).drop("_time")


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processed logs with a score that falls with latency, so the checks do not wait for a model."""
    score = F.bround(F.lit(0.2) - F.col("response_time_ms") / 10000.0, 6)
    return processed(spark, sf_dir).withColumns(
        {
            "anomaly_score": score,
            "prediction": F.when(score < 0, -1).otherwise(1),
            "is_anomaly": score < 0,
        }
    )


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = alerting.detect_anomalies(scored(spark, sf_dir))
    return rows.withColumns(
        {
            "alert_id": F.concat(F.lit("al-"), "event_id"),
            "detected_at": F.col("event_time") + F.make_dt_interval(secs=F.lit(5)),
        }
    )


def stored_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts as the stored table that deduplication reads several times."""
    return materialise(dedup.with_dedup_key(alerts(spark, sf_dir)), "alerts")


def flagged_alerts(spark: SparkSession, sf_dir: str, ttl_seconds: int = 86_400) -> DataFrame:
    return dedup.dedup_alerts(stored_alerts(spark, sf_dir), ttl_seconds)


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts with duplicate flag and channels, in the history shape."""
    marked = alerting.mark_notified(flagged_alerts(spark, sf_dir), ["slack", "email"])
    return alerting.history_rows(marked, F.lit(END).cast("timestamp"), require_uuid=False)


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).withColumn("true_label", F.when(F.col("event_type") == "error", -1).otherwise(1))


def samples(spark: SparkSession, sf_dir: str, metric: str) -> DataFrame:
    """Scraped samples of one metric: counters and gauges per minute in which something happened.

    Events are counted per series and minute first; the running totals then go over minutes, not events.
    """
    rows = events(spark, sf_dir).selectExpr(
        "CAST(date_trunc('MINUTE', ts) AS TIMESTAMP) + INTERVAL 1 MINUTE AS ts",
        f"ts >= TIMESTAMP_NTZ '{RESET}' AS after_reset",
        "'svc-' || (user_id % 10) AS service",
        f"COALESCE(CAST(({CODE_RULE}) AS STRING), '0') AS status_code",
        "event_type",
        "value * 20 AS ms",
        "k",
        "user_id",
    )

    def running(per_minute: DataFrame, keys: list[str], value: str):
        w = Window.partitionBy(*keys).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
        return per_minute.withColumn("value", F.sum(value).over(w).cast("double"))

    def shaped(df: DataFrame, **labels: str) -> DataFrame:
        pairs = [x for name, expr in labels.items() for x in (F.lit(name), F.expr(expr))]
        return df.select("ts", F.lit(metric).alias("metric"), F.create_map(*pairs).alias("labels"), "value")

    if metric == "logs_total":
        n = rows.groupBy("ts", "after_reset", "service").agg(F.count(F.lit(1)).alias("n"))
        return shaped(running(n, ["service", "after_reset"], "n"), service="service", job="service")
    if metric == "http_requests_total":
        n = rows.groupBy("ts", "service", "status_code").agg(F.count(F.lit(1)).alias("n"))
        return shaped(
            running(n, ["service", "status_code"], "n"), job="service", status_code="status_code"
        )
    if metric == "http_request_duration_bucket":
        counts = [F.count_if(F.col("ms") <= e).alias(f"le_{e}") for e in LATENCY_EDGES]
        n = rows.groupBy("ts").agg(*counts, F.count(F.lit(1)).alias("le_inf"))
        pairs = [F.struct(F.lit(str(e)).alias("le"), F.col(f"le_{e}").alias("n")) for e in LATENCY_EDGES]
        pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("le_inf").alias("n")))
        n = n.select("ts", F.explode(F.array(*pairs)).alias("x")).select("ts", "x.*")
        return shaped(running(n, ["le"], "n"), le="le", job="'api'")
    if metric == "up":
        n = rows.groupBy("ts", "service").agg(F.min(F.expr("IF(event_type = 'error', 0.0D, 1.0D)")).alias("value"))
        return shaped(n, job="service")
    if metric == "consumer_lag":
        n = rows.groupBy("ts", "service").agg((F.sum("k") * 200).cast("double").alias("value"))
        return shaped(n, job="service")
    if metric == "node_cpu_seconds_total":
        keyed = rows.withColumn("instance", F.expr("'node-' || (user_id % 3)"))
        n = keyed.groupBy("ts", "instance").agg(F.expr("60 - LEAST(60, SUM(k))").alias("n"))
        return shaped(running(n, ["instance"], "n"), instance="instance", mode="'idle'", job="instance")
    if metric in ("node_filesystem_avail_bytes", "node_filesystem_size_bytes"):
        keyed = rows.withColumn("instance", F.expr("'node-' || (user_id % 3)")).withColumn(
            "fstype", F.expr("IF(user_id % 4 = 0, 'tmpfs', 'ext4')")
        )
        value = F.min("k") if "avail" in metric else F.lit(100)
        n = keyed.groupBy("ts", "instance", "fstype").agg(value.cast("double").alias("value"))
        return shaped(n, instance="instance", fstype="fstype", job="instance")
    raise ValueError(metric)
