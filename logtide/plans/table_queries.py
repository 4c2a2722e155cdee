"""Maintained tables over the driver tables: minute roll-ups kept by a stream, upserted log and alert tables."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.operators import alerts as alerting
from logtide.operators import rollups
from logtide.plans import inputs
from logtide.plans.alert_queries import SHAPED
from logtide.plans.common import at, stamped, the_end
from logtide.plans.inputs import AS_OF, END
from logtide.plans.registry import query
from logtide.plans.search_queries import BOUNDS_SQL, STATS_SQL
from logtide.plans.sqltext import ALERTS, KEYED, PROC, flagged, iso
from logtide.plans.stream_queries import CUTS, in_parts, stream_parts
from logtide.schemas import PROCESSED_LOG, conform
from logtide.session import materialise, scratch_path
from logtide.sources import snapshots
from logtide.sources.snapshots import SnapshotTable
from logtide.sources.text_index import TextIndex
from logtide.streaming import jobs

_kept: dict = {}


def kept_once(make):
    """A table that is maintained once per application and folder; later queries find it as a service would."""

    @functools.wraps(make)
    def get(spark: SparkSession, sf_dir: str):
        key = (make.__name__, spark.sparkContext.applicationId, sf_dir)
        if key not in _kept:
            _kept[key] = make(spark, sf_dir)
        return _kept[key]

    return get


@kept_once
def log_rollups(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    """Roll-ups of all logs, taken up by a stream in three parts and compacted before the last."""
    table = rollups.log_rollup_table(spark, scratch_path(spark, "log-rollups"))
    rows = inputs.processed(spark, sf_dir).select("service", "level", "event_time", "response_time_ms")
    job, checkpoint = jobs.RollUps(table, compact_every=2), scratch_path(spark, "checkpoint")
    stream_parts(rows, "event_time", lambda s: job.start(s, checkpoint))
    return table


@kept_once
def alert_rollups(spark: SparkSession, sf_dir: str) -> SnapshotTable:
    table = rollups.alert_rollup_table(spark, scratch_path(spark, "alert-rollups"))
    rows = inputs.flagged_alerts(spark, sf_dir).select("service", "detected_at", "deduplicated")
    job, checkpoint = jobs.RollUps(table, rollups.alert_rollup, "alert_rollups", compact_every=3), scratch_path(spark, "checkpoint")
    stream_parts(rows, "detected_at", lambda s: job.start(s, checkpoint))
    return table


@query("system_stats_rollup", f"WITH {ALERTS}, {STATS_SQL.format(as_of=AS_OF, minutes=1440, alerts='alerts')}")
def system_stats_rollup(spark, sf_dir):
    """The stats row from the maintained roll-ups alone."""
    logs, alerts = log_rollups(spark, sf_dir).parts(), alert_rollups(spark, sf_dir).parts()
    return rollups.system_stats(logs, alerts, at(), 1440)


EDGE = "2024-01-15 12:34:56.789"


@query(
    "system_stats_unique_rollup",
    f"WITH RECURSIVE {KEYED}, {flagged(86_400)}, u AS (SELECT * FROM flagged WHERE NOT deduplicated),"
    f"{STATS_SQL.format(as_of=EDGE, minutes=90, alerts='u')}",
)
def system_stats_unique_rollup(spark, sf_dir):
    """Between two minutes, of notified alerts only: the rest of the first minute comes from the rows."""
    logs, alerts = log_rollups(spark, sf_dir).parts(), alert_rollups(spark, sf_dir).parts()
    rows = inputs.processed(spark, sf_dir), inputs.flagged_alerts(spark, sf_dir)
    return rollups.system_stats(logs, alerts, at(EDGE), 90, True, *rows)


@query(
    "latency_histogram_rollup",
    f"""WITH {PROC}, b AS (SELECT * FROM (VALUES {BOUNDS_SQL}) t(i, bound, le)),
  s AS (SELECT DISTINCT service FROM proc)
  SELECT s.service, b.le, count(*) FILTER (p.response_time_ms <= b.bound) AS n, count(*) AS count,
    round(sum(p.response_time_ms), 3) AS sum
  FROM s, b, proc p WHERE p.service = s.service GROUP BY 1, 2""",
)
def latency_histogram_rollup(spark, sf_dir):
    rows = rollups.latency_histogram(log_rollups(spark, sf_dir).parts(), ["service"])
    return rows.withColumn("sum", F.round("sum", 3))


@query(
    "logs_per_minute_rollup",
    f"""WITH {PROC}, c AS (SELECT date_trunc('minute', event_time) AS b, service, count(*) AS n FROM proc GROUP BY 1, 2)
  SELECT {iso("b")} AS bucket, service, n FROM c""",
)
def logs_per_minute_rollup(spark, sf_dir):
    return stamped(rollups.per_minute(log_rollups(spark, sf_dir).parts(), ["service"]), "bucket")


POINTS = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@query(
    "latency_quantiles_rollup",
    f"""WITH {PROC}, n AS (SELECT service, count(*) AS n FROM proc WHERE response_time_ms IS NOT NULL GROUP BY 1)
  SELECT service, n, point, true AS within FROM n, (VALUES {", ".join(f"('{p}')" for p in POINTS)}) t(point)""",
)
def latency_quantiles_rollup(spark, sf_dir):
    """Whether the true ranks of the sketches' quantiles lie within 2.5 % of those asked for."""
    found = rollups.latency_quantiles(log_rollups(spark, sf_dir).parts(), POINTS, ["service"])
    rows = inputs.processed(spark, sf_dir).where("response_time_ms IS NOT NULL").select("service", "response_time_ms")
    ranks = [F.count_if(F.col("response_time_ms") <= F.col(p)).alias(p) for p in POINTS]
    true = rows.join(found, "service").groupBy("service", "n").agg(*ranks)
    near = [F.struct(F.lit(p).alias("point"), (F.abs(F.col(p) / F.col("n") - q) <= 0.025).alias("within")) for p, q in POINTS.items()]
    return true.select("service", "n", F.inline(F.array(*near)))


def _copies(spark, sf_dir) -> DataFrame:
    """All logs, and older versions of some of them."""
    rows = materialise(inputs.processed(spark, sf_dir), "processed")  # read by every upsert
    older = rows.filter("user_id % 2 = 0").withColumns(
        {"level": F.lit("DEBUG"), "processed_at": F.col("processed_at") - F.expr("INTERVAL 1 MINUTE")}
    )
    both = rows.unionByName(older)
    return conform(both, PROCESSED_LOG).withColumn("log_date", F.to_date("event_time"))


COPIES = f"""WITH {PROC}, copies AS (
    SELECT log_id, event_time, level, 1 AS version FROM proc
    UNION ALL SELECT log_id, event_time, 'DEBUG', 0 FROM proc WHERE user_id % 2 = 0)"""


@query(
    "index_logs_upsert",
    f"""{COPIES} SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS log_date, log_id, level FROM copies
  QUALIFY row_number() OVER (PARTITION BY CAST(event_time AS DATE), log_id ORDER BY version DESC) = 1""",
)
def index_logs_upsert(spark, sf_dir):
    """The daily table after four upserts, the last over all days, with a compaction between them."""
    table = snapshots.log_table(spark, scratch_path(spark, "daily"), PROCESSED_LOG)
    rows = _copies(spark, sf_dir)
    for number, part in enumerate(in_parts(rows.where("level <> 'DEBUG'"), "event_time", stored=True)):
        table.upsert(part, ("load", number))
        if number == 1:
            table.compact()
    table.upsert(rows.where("level = 'DEBUG'"), ("load", 3))
    return table.read().select(F.col("log_date").cast("string").alias("log_date"), "log_id", "level")


@query(
    "bulk_index_counts",
    f"""WITH {PROC}, b AS (SELECT CASE WHEN event_time < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN event_time < TIMESTAMP '{CUTS[1]}' THEN 1
    ELSE 2 END AS batch, event_id % 13 = 0 AS bad FROM proc)
  SELECT batch, count(*) FILTER (NOT bad) AS stored, count(*) FILTER (bad) AS failed FROM b GROUP BY 1""",
)
def bulk_index_counts(spark, sf_dir):
    """(stored, failed) of each bulk write; rows without id fail. The second batch is sent twice."""
    table = snapshots.log_table(spark, scratch_path(spark, "daily"), PROCESSED_LOG)
    rows = inputs.processed(spark, sf_dir)
    rows = rows.withColumn("log_id", F.when(F.col("event_id") % 13 != 0, F.col("log_id")))
    rows = conform(rows, PROCESSED_LOG).withColumn("log_date", F.to_date("event_time"))
    counts = []
    for number, part in enumerate(in_parts(rows, "event_time")):
        found = table.upsert(part, ("load", number))
        if number == 1:
            found = table.upsert(part, ("load", number))
        counts.append((number, *found))
    return spark.createDataFrame(counts, "batch int, stored long, failed long")


@query(
    "expire_daily",
    f"""WITH {PROC} SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS log_date, count(*) AS n FROM proc
  WHERE event_time >= TIMESTAMP '{CUTS[1]}' GROUP BY 1""",
)
def expire_daily(spark, sf_dir):
    """The days that are left after the older ones have expired and their files are deleted."""
    table = snapshots.log_table(spark, scratch_path(spark, "daily"), PROCESSED_LOG)
    rows = conform(inputs.processed(spark, sf_dir), PROCESSED_LOG).withColumn("log_date", F.to_date("event_time"))
    for part in in_parts(rows, "event_time"):
        table.upsert(part)
    table.expire(lambda day: day >= CUTS[1])
    table.compact()
    table.vacuum(keep_snapshots=1, older_than_seconds=0)
    return table.read().groupBy(F.col("log_date").cast("string").alias("log_date")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "alert_history_upsert",
    f"""WITH RECURSIVE {ALERTS}, ch AS (
    SELECT *, 0 AS seq, message AS m, false AS dup FROM alerts
    UNION ALL SELECT *, 1, 'later ' || message, true FROM alerts WHERE user_id % 3 = 0)
  SELECT {SHAPED.format(h="md5(alert_id)")} AS alert_id, arg_min(left(m, 255), seq) AS message,
    arg_max(NOT dup, seq) AS slack_sent, arg_max(dup, seq) AS deduplicated, min(anomaly_score) AS anomaly_score,
    '{END.replace(" ", "T")}.000000' AS created_at
  FROM ch GROUP BY alert_id""",
)
def alert_history_upsert(spark, sf_dir):
    """The history from an upserted table, as ``alerts_upsert`` gives it from the whole change log."""
    rows = inputs.alerts(spark, sf_dir).withColumn("alert_id", alerting.shaped_uuid(F.md5("alert_id")))
    first = rows.withColumns({"seq": F.lit(0), "deduplicated": F.lit(False)})
    later = rows.filter("user_id % 3 = 0").withColumns(
        {"seq": F.lit(1), "deduplicated": F.lit(True), "message": F.concat(F.lit("later "), "message")}
    )
    table = snapshots.alert_table(spark, scratch_path(spark, "alert-history"))
    for number, part in enumerate((first, later)):
        changes = alerting.history_rows(alerting.mark_notified(part, ["slack", "email"]), the_end())
        table.upsert(snapshots.alert_changes(changes), ("changes", number))
    now = stamped(table.read(), "created_at")
    return now.select("alert_id", "message", "slack_sent", "deduplicated", "anomaly_score", "created_at")


@query(
    "search_logs_indexed",
    f"""WITH {PROC} SELECT log_id, message FROM proc WHERE list_has_any(
    list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda w: w <> ''), ['purchase', '42'])""",
)
def search_logs_indexed(spark, sf_dir):
    """Words found through the index of the daily table; the last days were written after the index."""
    table = snapshots.log_table(spark, scratch_path(spark, "daily"), PROCESSED_LOG)
    index = TextIndex(table, scratch_path(spark, "words"))
    rows = conform(inputs.processed(spark, sf_dir), PROCESSED_LOG).withColumn("log_date", F.to_date("event_time"))
    first, second, last = in_parts(rows, "event_time")
    table.upsert(first.unionByName(second))
    table.compact()
    index.update()
    table.upsert(last)
    return index.search("Purchase! 42").select("log_id", "message")
