"""Streaming jobs over the driver tables, checked against the SQL of their batch twins.

The rows land as files in three time ranges, each taken up by a run of the query, and the written result is
returned.
"""

from __future__ import annotations

import contextlib
import os
from collections.abc import Iterator
from urllib.parse import urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.operators import dedup, iforest
from logtide.plans import inputs, model_queries
from logtide.plans.alert_queries import SEVERITY_SQL
from logtide.plans.common import stamped
from logtide.plans.registry import query
from logtide.plans.sqltext import KEYED, PROC, flagged, iso
from logtide.session import materialise, scratch_path
from logtide.sources import tables, topics
from logtide.sources.tail import tail_files
from logtide.streaming import jobs, keyed

CUTS = ["2024-01-11", "2024-01-21"]


def in_parts(rows: DataFrame, time: str, stored: bool = False) -> list[DataFrame]:
    """All rows in three time ranges, in order: before, between and from the cuts on; rows without a time come last.

    Rows are stored first unless they are ``stored`` already, so that they are computed once and not for each range.
    """
    rows = rows if stored else materialise(rows, "all-parts")
    first, second = (F.lit(c).cast("timestamp") for c in CUTS)
    at = F.col(time)
    return [rows.filter(at < first), rows.filter((at >= first) & (at < second)), rows.filter((at >= second) | at.isNull())]


def stream_parts(rows: DataFrame, time: str, start, stored: bool = False) -> None:
    """Land one time range after the other; each run of the query takes up the files that are new."""
    landed = scratch_path(rows.sparkSession, "landed")
    for part in in_parts(rows, time, stored):
        part.write.mode("append").parquet(landed)
        start(rows.sparkSession.readStream.schema(rows.schema).parquet(landed)).awaitTermination()


def process(spark, sf_dir, window_seconds: int = 60) -> str:
    out, checkpoint, landed = (scratch_path(spark, n) for n in ("stream-logs", "checkpoint", "landed"))
    job = jobs.ProcessLogs(spark, out, window_seconds)
    logs = inputs.logs(spark, sf_dir)
    fields = ["log_id", "service", "level", "message", "host", "response_time_ms", "error_code", "timestamp"]
    value = topics.json_value(logs, fields)
    for part in in_parts(logs, "timestamp"):
        part.select(value.alias("value")).write.mode("append").text(landed)
        job.start(topics.read_json_lines(spark, landed), checkpoint).awaitTermination()
    return out


@query(
    "stream_process_logs",
    f"""WITH {model_queries.FEATURES} SELECT log_id, hour_of_day, response_time_ms, error_code, log_level_encoded,
  request_count_last_60s, service_id_encoded FROM feats""",
)
def stream_process_logs(spark, sf_dir):
    return spark.read.parquet(f"{process(spark, sf_dir)}/logs").select("log_id", "features.*")


@query("stream_rolling_count", f"WITH {PROC} {model_queries.rolling_sql(21_600)}")
def stream_rolling_count(spark, sf_dir):
    rows = spark.read.parquet(f"{process(spark, sf_dir, 21_600)}/logs")
    return rows.select("log_id", "features.request_count_last_60s")


def handle(spark, sf_dir, ttl_seconds: int) -> str:
    out, checkpoint = scratch_path(spark, "stream-alerts"), scratch_path(spark, "checkpoint")
    job = jobs.HandleAlerts(spark, out, ttl_seconds, require_uuid=False)
    stream_parts(inputs.alerts(spark, sf_dir), "detected_at", lambda s: job.start(s, checkpoint))
    return out


@query(
    "stream_dedup",
    f"WITH RECURSIVE {KEYED}, {flagged(86_400 * 3)} SELECT alert_id, dedup_key, deduplicated FROM flagged",
)
def stream_dedup(spark, sf_dir):
    rows = spark.read.parquet(f"{handle(spark, sf_dir, 86_400 * 3)}/flagged")
    return rows.select("alert_id", "dedup_key", "deduplicated")


@query(
    "stream_alerts",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)} SELECT alert_id, channel, {SEVERITY_SQL} AS severity
  FROM flagged, (VALUES ('slack'), ('email')) c(channel) WHERE NOT deduplicated""",
)
def stream_alerts(spark, sf_dir):
    rows = spark.read.parquet(f"{handle(spark, sf_dir, 86_400)}/outbox")
    return rows.select("alert_id", "channel", "severity")


@query(
    "stream_logs_per_minute",
    f"""WITH {PROC}, c AS (SELECT date_trunc('minute', event_time) AS b, service, count(*) AS n FROM proc GROUP BY 1, 2)
  SELECT {iso("b")} AS bucket, service, n FROM c""",
)
def stream_logs_per_minute(spark, sf_dir):
    """All minutes, the open ones at the end with their count so far."""
    rows = inputs.processed(spark, sf_dir).select("service", "event_time")
    out, checkpoint = scratch_path(spark, "minutes"), scratch_path(spark, "checkpoint")
    stream_parts(rows, "event_time", lambda s: jobs.logs_per_minute(s, out, checkpoint))
    return stamped(jobs.minutes_so_far(spark, out), "bucket")


def _stored_model(spark, sf_dir, trees: int = 20):
    rows = model_queries._stored_features(spark, sf_dir)
    model = iforest.fit_iforest(rows.select("log_id", "features"), "log_id", trees=trees)
    root = scratch_path(spark, "models")
    tables.save_model(model, root, "v0001")
    return rows, model, root


def _processed(spark, sf_dir):
    return model_queries._stored_features(spark, sf_dir).select(
        "log_id", "service", "level", "message", "host", "event_time", "response_time_ms", "error_code", "features"
    )


@query(
    "stream_detect_fixed",
    f"""WITH {model_queries.FIXED} SELECT log_id, service, anomaly_score, 'v0001' AS model_version FROM fixed
  WHERE d < 0""",
)
def stream_detect_fixed(spark, sf_dir):
    """Alerts of the streaming detector with three given trees."""
    root, out, checkpoint = (scratch_path(spark, n) for n in ("models", "stream-detect", "checkpoint"))
    tables.save_model(model_queries.small_forest(spark), root, "v0001")
    job = jobs.DetectAnomalies(spark, root, out)
    stream_parts(_processed(spark, sf_dir), "event_time", lambda s: job.start(s, checkpoint), stored=True)
    return spark.read.parquet(f"{out}/alerts").select("log_id", "service", "anomaly_score", "model_version")


@query(
    "stream_model_swap_fixed",
    f"""WITH {model_queries.FIXED} SELECT log_id, CASE WHEN event_time < TIMESTAMP '{CUTS[0]}' THEN 'v9' ELSE 'v10' END
    AS model_version FROM fixed WHERE CASE WHEN event_time < TIMESTAMP '{CUTS[0]}' THEN d < 0 ELSE d + 0.02 < 0 END""",
)
def stream_model_swap_fixed(spark, sf_dir):
    """Alerts with the model version that found them, when a newer version appears between two runs of the query."""
    root, out, checkpoint, landed = (scratch_path(spark, n) for n in ("models", "stream-swap", "checkpoint", "landed"))
    stored = _processed(spark, sf_dir)
    model = model_queries.small_forest(spark)
    job = jobs.DetectAnomalies(spark, root, out)
    early = F.coalesce(F.col("event_time") < F.lit(CUTS[0]).cast("timestamp"), F.lit(False))
    for version, part in (("v9", stored.filter(early)), ("v10", stored.filter(~early))):
        tables.save_model(model, root, version)
        part.write.mode("append").parquet(landed)
        job.start(spark.readStream.schema(stored.schema).parquet(landed), checkpoint).awaitTermination()
        model.meta["offset"] -= 0.02
    return spark.read.parquet(f"{out}/alerts").select("log_id", "model_version")


@query("stream_detect")
def stream_detect(spark, sf_dir):
    """Alerts of the streaming detector."""
    rows, _, root = _stored_model(spark, sf_dir)
    stored = rows.select("log_id", "service", "level", "message", "host", "event_time", "response_time_ms",
                         "error_code", "features")
    out, checkpoint = scratch_path(spark, "stream-detect"), scratch_path(spark, "checkpoint")
    job = jobs.DetectAnomalies(spark, root, out)
    stream_parts(stored, "event_time", lambda s: job.start(s, checkpoint), stored=True)
    return spark.read.parquet(f"{out}/alerts").select("alert_id", "log_id", "anomaly_score", "model_version")


@query("stream_model_swap")
def stream_model_swap(spark, sf_dir):
    """Alerts per model version when a new version appears between two runs of the same query."""
    rows, model, root = _stored_model(spark, sf_dir)
    stored = rows.select("log_id", "service", "level", "message", "host", "event_time", "response_time_ms",
                         "error_code", "features")
    landed = scratch_path(spark, "processed")
    out, checkpoint = scratch_path(spark, "stream-swap"), scratch_path(spark, "checkpoint")
    early = F.coalesce(F.col("event_time") < F.lit(CUTS[0]).cast("timestamp"), F.lit(False))
    job = jobs.DetectAnomalies(spark, root, out)
    for part in (stored.filter(early), stored.filter(~early)):
        part.write.mode("append").parquet(landed)
        stream = spark.readStream.schema(stored.schema).parquet(landed)
        job.start(stream, checkpoint).awaitTermination()
        model.meta["offset"] -= 0.02
        tables.save_model(model, root, "v0002")
    found = spark.read.parquet(f"{out}/alerts")
    return found.groupBy("model_version").agg(F.count(F.lit(1)).alias("alerts"))


def grow_files(lines: DataFrame, folder: str, part: int) -> None:
    """Append the lines of a part to their files; rows are (file, part, place, value), parts before it are there already.

    A task cuts its file to what the earlier parts have left before it writes, so it may run twice.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes: dict[str, int] = {}
        with contextlib.ExitStack() as closing:
            files: dict = {}
            for batch in batches:
                for name, of, value in zip(*(batch.column(c).to_pylist() for c in ("file", "part", "value")), strict=True):
                    line = value.encode() + b"\n"
                    if of == part:
                        if name not in files:
                            files[name] = closing.enter_context(open(f"{folder}/{name}", "ab"))
                            files[name].truncate(sizes.get(name, 0))
                        files[name].write(line)
                    sizes[name] = sizes.get(name, 0) + len(line)
        yield pa.RecordBatch.from_arrays([pa.array([len(sizes)])], ["files"])

    dealt = lines.where(F.col("part") <= part).repartition("file").sortWithinPartitions("file", "part", "place")
    dealt.select("file", "part", "value").mapInArrow(write, "files bigint").agg(F.sum("files")).collect()


@query(
    "stream_tail_files",
    f"""WITH l AS (SELECT event_id, 'svc-' || (user_id % 10) AS container_name,
    CASE WHEN ts < TIMESTAMP '{CUTS[0]}' THEN 0 WHEN ts < TIMESTAMP '{CUTS[1]}' THEN 1 ELSE 2 END AS part,
    user_id % 10 % 3 = 0 AND ts >= TIMESTAMP '{CUTS[1]}' AS renewed,
    '{{"event_id":' || event_id || ',"message":"' || event_type || '"}}' AS value FROM events)
  SELECT container_name, value, coalesce(sum(length(value) + 1) OVER (PARTITION BY container_name, renewed ORDER BY part, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM l""",
)
def stream_tail_files(spark, sf_dir):
    """Lines of container files that grow between three runs of a query; before the last run some files are rotated."""
    rows = inputs.events(spark, sf_dir)
    first, second = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    part = F.when(F.col("ts") < first, 0).when(F.col("ts") < second, 1).otherwise(2)
    service = F.col("user_id") % 10
    name = F.concat(F.lit("svc-"), service, F.when((service % 3 == 0) & (part == 2), ".new").otherwise(""), F.lit(".log"))
    value = F.to_json(F.struct("event_id", F.col("event_type").alias("message")))
    lines = rows.select(name.alias("file"), part.alias("part"), F.col("event_id").alias("place"), value.alias("value"))
    folder, out, checkpoint = (urlparse(scratch_path(spark, n)).path for n in ("containers", "tailed", "checkpoint"))
    os.makedirs(folder)
    for number in range(3):
        grow_files(lines, folder, number)
        for renewed in [f for f in os.listdir(folder) if f.endswith(".new.log")]:
            old = renewed.replace(".new.log", ".log")
            os.rename(f"{folder}/{old}", f"{folder}/{old}.1")
            os.rename(f"{folder}/{renewed}", f"{folder}/{old}")
        tailed = tail_files(spark, f"{folder}/*.log", f"{folder}/*.log.*", partitionBytes=10_000)
        query = tailed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True)
        query.start(out).awaitTermination()
    container = F.regexp_extract("file", r"([^/]+)\.log[^/]*$", 1)
    return spark.read.parquet(out).select(container.alias("container_name"), "value", "position")


def _kept(stream_of, rows: DataFrame, time: str) -> DataFrame:
    """What a stateful stream has written after three runs from one checkpoint."""
    spark = rows.sparkSession
    out, checkpoint = scratch_path(spark, "keyed"), scratch_path(spark, "checkpoint")

    def start(stream: DataFrame):
        writer = stream_of(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        return writer.trigger(availableNow=True).start(out)

    stream_parts(rows, time, start)
    return spark.read.parquet(out)


@query(
    "stream_keyed_dedup",
    f"WITH RECURSIVE {KEYED}, {flagged(86_400 * 3)} SELECT alert_id, dedup_key, deduplicated FROM flagged",
)
def stream_keyed_dedup(spark, sf_dir):
    """Duplicate flags with the suppressions kept in the state store."""
    rows = dedup.with_dedup_key(inputs.alerts(spark, sf_dir)).select("alert_id", "dedup_key", "detected_at")
    found = _kept(lambda s: keyed.dedup_stream(s, 86_400 * 3), rows, "detected_at")
    return found.select("alert_id", "dedup_key", "deduplicated")


@query("stream_keyed_rolling", f"WITH {PROC} {model_queries.rolling_sql(21_600)}")
def stream_keyed_rolling(spark, sf_dir):
    """Rolling counts with the times of each service kept in the state store."""
    rows = inputs.processed(spark, sf_dir).select("log_id", "service", "event_time")
    found = _kept(lambda s: keyed.rolling_count_stream(s, 21_600), rows, "event_time")
    return found.select("log_id", "request_count_last_60s")


@query("stream_once_delivered", """SELECT user_id % 4 AS "partition", event_id AS "offset", event_type AS value FROM events""")
def stream_once_delivered(spark, sf_dir):
    """Topic records of which every fifth is delivered again, in the same run of the query or the next."""
    rows = inputs.events(spark, sf_dir).select(
        F.lit("raw").alias("topic"), (F.col("user_id") % 4).alias("partition"), F.col("event_id").alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("value"),
    )
    again = rows.where("offset % 5 = 0")
    arrives = F.when(F.col("offset") % 10 == 0, F.col("timestamp")).otherwise(F.col("timestamp") + F.expr("INTERVAL 10 DAYS"))
    both = rows.withColumn("arrives", F.col("timestamp")).unionByName(again.withColumn("arrives", arrives))
    found = _kept(lambda s: keyed.once_delivered(s.drop("arrives"), within="40 days"), both, "arrives")
    return found.select("partition", "offset", "value")
