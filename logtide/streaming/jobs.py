"""Streaming jobs built from the batch operators.

A stateful job runs the batch operator on each micro-batch together with a small state table carried from the
micro-batch before. State lives in the shared folder in two alternating versions: batch N reads version N-1 and
writes version N, so a batch that is run again after a failure sees the same state and leaves the same result. All
outputs are written under their batch id, so a second run replaces the first. Because the state is a table and not
per-key memory, a busy service or key is spread over tasks just as in batch.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from logtide.operators import alerts as alerting
from logtide.operators import dedup, features, iforest, rollups, validate
from logtide.operators.normalise import normalise_logs
from logtide.schemas import PROCESSED_LOG, conform
from logtide.sources import snapshots, tables, topics
from logtide.sources.snapshots import SnapshotTable
from logtide.streaming import keyed

log = logging.getLogger(__name__)

LATE_SECONDS = 600
MICROS = 1_000_000


@dataclass
class StateTable:
    """A table carried from micro-batch to micro-batch."""

    spark: SparkSession
    path: str
    schema: str

    def before(self, batch_id: int) -> DataFrame:
        if batch_id == 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{(batch_id - 1) % 2}")

    def after(self, batch_id: int, rows: DataFrame) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/v{batch_id % 2}")


def put(rows: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None) -> None:
    """Write the rows of a micro-batch under its id, replacing what an earlier try left there."""
    writer = rows.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(f"{path}/batch_id={batch_id}")


def put_json(rows: DataFrame, path: str, batch_id: int) -> None:
    """Topic records as JSON lines, for a job that reads landed files."""
    rows.select("value").write.mode("overwrite").text(f"{path}/batch_id={batch_id}")


def batch_time(spark: SparkSession, path: str, batch_id: int) -> Column:
    """The time of a micro-batch: taken when it first runs and stored, so that a second run uses the same."""
    own = f"{path}/batch_id={batch_id}"
    try:
        taken = spark.read.schema("at timestamp").parquet(own).first()
    except AnalysisException:  # not there yet
        taken = None
    if taken is None:
        spark.range(1).select(F.current_timestamp().alias("at")).coalesce(1).write.mode("overwrite").parquet(own)
        taken = spark.read.schema("at timestamp").parquet(own).first()
    return F.lit(taken["at"])


def send_batch(rows: DataFrame, write: Callable[[DataFrame], None]) -> tuple[int, int]:
    """(sent, failed) of one batch: all rows or none, as a Spark write either commits or fails."""
    seen = Observation()
    watched = rows.observe(seen, F.count(F.lit(1)).alias("n"))
    try:
        write(watched)
    except Exception:  # noqa: BLE001
        log.exception("batch not sent")
        return 0, rows.count()
    return seen.get["n"], 0


def into_table(table: SnapshotTable, name: str) -> Callable[[DataFrame, int], None]:
    """A store of micro-batches in a snapshot table; each batch is stored once, however often it is run."""
    return lambda rows, batch_id: table.upsert(rows, (writer_name(rows.sparkSession, name), batch_id)) and None


def writer_name(spark: SparkSession, name: str) -> str:
    """The name with the id of the running query, as a query with a new checkpoint counts its batches from 0 again."""
    query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
    return f"{name}:{query}" if query else name


def forget(spark: SparkSession, paths: list[str], batch_id: int, keep: int) -> None:
    """Delete the folders of batches before the last ``keep``, which no run of a batch can need any more."""
    for path in paths:
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        for status in fs.listStatus(root) if fs.exists(root) else []:
            name = status.getPath().getName()
            if name.startswith("batch_id=") and int(name.split("=")[1]) <= batch_id - keep:
                fs.delete(status.getPath(), True)


def _run(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, name: str, once: bool):
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).queryName(name)
    return writer.trigger(availableNow=True).start() if once else writer.start()


@dataclass
class ProcessLogs:
    """Raw records to processed logs with features; unusable records to quarantine."""

    spark: SparkSession
    out: str
    window_seconds: int = 60
    late_seconds: int = LATE_SECONDS
    store: Callable[[DataFrame, int], None] | None = None
    publish: Callable[[DataFrame, int], None] | None = None
    keep_batches: int | None = None
    store_errors: list[int] = field(default_factory=list)
    unstored: str = field(init=False)

    def __post_init__(self) -> None:
        self.counts = StateTable(self.spark, f"{self.out}/state/counts", "service string, _us bigint, _n bigint")
        self.labels = StateTable(self.spark, f"{self.out}/state/labels", "service string, service_id int")
        self.unstored = f"{self.out}/unstored"
        self.store = self.store or (lambda rows, b: put(rows, f"{self.out}/logs", b, ["log_date"]))
        self.publish = self.publish or (
            lambda rows, b: put_json(topics.to_topic_records(rows), f"{self.out}/topic", b)
        )

    def each(self, batch: DataFrame, batch_id: int) -> None:
        # parsed once per batch: a filter on parsed fields would parse the text again for each field it looks at
        checked = topics.parse_raw_logs(batch).withColumn(
            "reason", F.when(~F.col("decodable"), "undecodable").otherwise(validate.malformed_reason())
        )
        put(checked.drop("decodable"), f"{self.out}/parsed", batch_id)
        checked = self.spark.read.schema(checked.drop("decodable").schema).parquet(f"{self.out}/parsed/batch_id={batch_id}")
        put(checked.where("reason IS NOT NULL").select("value", "reason"), f"{self.out}/quarantine", batch_id)
        usable = checked.where("reason IS NULL").drop("reason")
        # written once per batch, then read by every later step
        path = f"{self.out}/normalised"
        now = batch_time(self.spark, f"{self.out}/times", batch_id)
        # equal lines are records of their own: the place in the batch goes into their id
        placed = usable.withColumns({"_batch": F.lit(batch_id), "_place": F.monotonically_increasing_id()})
        rows = normalise_logs(placed, now, now, repeatable_ids=["value", "_batch", "_place"]).withColumn(
            "ingested_at", F.col("ingested_at").try_cast("timestamp")
        ).drop("_batch", "_place")
        put(rows.drop("value"), path, batch_id)
        rows = self.spark.read.schema(rows.drop("value").schema).parquet(f"{path}/batch_id={batch_id}")

        known = self.labels.before(batch_id)
        carried = self.counts.before(batch_id)
        self.labels.after(batch_id, features.service_labels(rows, known))
        labels = self.labels.before(batch_id + 1)
        processed = conform(features.extract_features(rows, labels, self.window_seconds, carried=carried), PROCESSED_LOG)
        self._keep_counts(rows, carried, batch_id, now)
        dated = processed.withColumn("log_date", F.to_date("event_time"))
        try:
            self.store(dated, batch_id)
        except Exception:  # noqa: BLE001
            log.exception("logs of batch %s not stored, publishing goes on", batch_id)
            self.store_errors.append(batch_id)
            put(dated, self.unstored, batch_id)
        self.publish(processed, batch_id)
        if self.keep_batches:
            forget(self.spark, [f"{self.out}/parsed", path, f"{self.out}/times"], batch_id, max(self.keep_batches, 2))

    def store_again(self) -> list[int]:
        """Store the batches whose store failed, from the rows kept for that; returns those done.

        A batch that was stored is marked by a file of its own; the rows are kept until the folder expires.
        """
        try:
            kept = self.spark.read.parquet(self.unstored)
        except AnalysisException:  # no store has failed
            return []
        waiting = sorted(r["batch_id"] for r in kept.select("batch_id").distinct().collect())  # a row per failed batch
        done = []
        for batch_id in waiting:
            mark = f"{self.out}/stored_again/batch_id={batch_id}"
            try:
                self.spark.read.schema("batch_id bigint").parquet(mark).first()
                continue
            except AnalysisException:
                pass
            self.store(self.spark.read.parquet(f"{self.unstored}/batch_id={batch_id}"), batch_id)
            self.spark.range(1).write.mode("overwrite").parquet(mark)
            done.append(batch_id)
        return done

    def _keep_counts(self, rows: DataFrame, carried: DataFrame, batch_id: int, now: Column) -> None:
        """Counts that later rows may need. Rows dated after the batch's own time don't tell how far time has come."""
        seen = features.counts_per_micro(rows).unionByName(carried).groupBy("service", "_us").agg(
            F.sum("_n").alias("_n")
        )
        keep = (2 * self.window_seconds + self.late_seconds) * MICROS
        believed = F.when(F.col("event_time") <= now, F.unix_micros("event_time"))
        horizon = rows.agg(F.max(believed) - keep).scalar()
        self.counts.after(batch_id, seen.filter(F.coalesce(F.col("_us") > horizon, F.lit(True))))

    def start(self, raw: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _run(raw, self.each, checkpoint, "process_logs", once)

    def start_from_topic(self, servers: str, checkpoint: str, topic: str = topics.RAW_TOPIC, once: bool = False) -> StreamingQuery:
        """Process a raw topic; a record that is delivered again within an hour is dropped by its place in the topic."""
        return self.start(keyed.once_delivered(topics.read_topic(self.spark, servers, topic)), checkpoint, once)


@dataclass
class DetectAnomalies:
    """Processed logs to alerts. The newest model version is looked up for every micro-batch."""

    spark: SparkSession
    models: str
    out: str
    threshold: float = 0.0
    model: iforest.ForestModel | None = None

    def current_model(self) -> iforest.ForestModel:
        """The newest version; its nodes stay on the executors until another takes over."""
        version = tables.newest_version(self.spark, self.models)
        if self.model is None or self.model.meta["version"] != version:
            if self.model is not None:
                self.model.release()
            self.model = tables.load_model(self.spark, f"{self.models.rstrip('/')}/{version}")
        return self.model

    def each(self, batch: DataFrame, batch_id: int) -> None:
        model = self.current_model()
        rows = validate.score_inputs(batch)
        checked = validate.validate_features(rows)
        put(checked.filter("reason IS NOT NULL"), f"{self.out}/rejected", batch_id)
        scored = iforest.score(checked.filter("reason IS NULL"), model, self.threshold)
        alerts = alerting.build_alerts(
            scored.filter("is_anomaly"),
            batch_time(self.spark, f"{self.out}/times", batch_id),
            alerting.repeatable_alert_id("log_id", "event_time"),
            threshold=None,
        )
        put(alerts.withColumn("model_version", F.lit(model.meta["version"])), f"{self.out}/alerts", batch_id)

    def start(self, processed: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _run(processed, self.each, checkpoint, "detect_anomalies", once)


@dataclass
class HandleAlerts:
    """Alerts to duplicate flags, notification outbox and history changes."""

    spark: SparkSession
    out: str
    ttl_seconds: int = dedup.DEFAULT_TTL
    channels: tuple[str, ...] = ("slack", "email")
    time: str = "detected_at"
    late_seconds: int = LATE_SECONDS
    require_uuid: bool = True
    history: SnapshotTable | None = None
    keep_batches: int | None = None

    def __post_init__(self) -> None:
        self.open = StateTable(self.spark, f"{self.out}/state/open", "dedup_key string, free bigint")

    def each(self, batch: DataFrame, batch_id: int) -> None:
        carried = self.open.before(batch_id)
        # written once per batch: deduplication reads the alerts several times, the source only once
        put(dedup.with_dedup_key(batch), f"{self.out}/alerts", batch_id)
        alerts = self.spark.read.parquet(f"{self.out}/alerts/batch_id={batch_id}")
        put(dedup.dedup_alerts(alerts, self.ttl_seconds, time=self.time, carried=carried), f"{self.out}/flagged", batch_id)
        flagged = self.spark.read.parquet(f"{self.out}/flagged/batch_id={batch_id}")
        now = batch_time(self.spark, f"{self.out}/times", batch_id)
        self.open.after(
            batch_id,
            dedup.open_suppressions(flagged, self.ttl_seconds, carried, self.late_seconds, time=self.time, now=now),
        )
        put(alerting.notification_outbox(flagged, list(self.channels)), f"{self.out}/outbox", batch_id)
        marked = alerting.mark_notified(flagged, list(self.channels)).withColumn("seq", F.lit(batch_id))
        changes = alerting.history_rows(marked, now, require_uuid=self.require_uuid)
        if self.history is None:
            put(changes, f"{self.out}/changes", batch_id)
        else:
            self.history.upsert(snapshots.alert_changes(changes), (writer_name(batch.sparkSession, "handle_alerts"), batch_id))
        if self.keep_batches:
            forget(self.spark, [f"{self.out}/{n}" for n in ("alerts", "times")], batch_id, max(self.keep_batches, 2))

    def start(self, alerts: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _run(alerts, self.each, checkpoint, "handle_alerts", once)


@dataclass
class RollUps:
    """Minute roll-ups kept up to date: those of each micro-batch are added to the table, which is compacted now and then."""

    table: SnapshotTable
    rollup: Callable[[DataFrame], DataFrame] = rollups.minute_rollup
    name: str = "rollups"
    compact_every: int = 50

    def each(self, batch: DataFrame, batch_id: int) -> None:
        self.table.upsert(self.rollup(batch), (writer_name(batch.sparkSession, self.name), batch_id))
        if batch_id % self.compact_every == self.compact_every - 1:
            self.table.compact()
            self.table.vacuum()

    def start(self, rows: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
        return _run(rows, self.each, checkpoint, self.name, once)


def logs_per_minute(logs: DataFrame, out: str, checkpoint: str, late: str = "10 minutes", once: bool = True):
    """Tumbling counts per service. A minute is written whenever its count has changed, also while it is open;
    ``minutes_so_far`` reads the newest count of each. Rows behind the watermark are dropped and counted by the
    query's state metrics.
    """
    counts = (
        logs.withWatermark("event_time", late)
        .groupBy(F.window("event_time", "1 minute"), "service")
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("bucket"), "service", "n")
    )
    writer = (
        counts.writeStream.foreachBatch(lambda rows, batch_id: put(rows, out, batch_id))
        .outputMode("update")
        .option("checkpointLocation", checkpoint)
        .queryName("logs_per_minute")
    )
    return writer.trigger(availableNow=True).start() if once else writer.start()


def minutes_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(bucket, service, n): the newest count of every minute. Counts only grow, so the newest is the largest."""
    rows = spark.read.parquet(out)
    return rows.groupBy("bucket", "service").agg(F.max("n").alias("n"))


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came after the watermark."""
    ops = [op for p in query.recentProgress for op in p["stateOperators"]]
    return sum(op["numRowsDroppedByWatermark"] for op in ops)


def processed_from_topic(records: DataFrame) -> DataFrame:
    """Processed logs from their JSON topic records."""
    parsed = F.from_json(F.col("value").cast("string"), PROCESSED_LOG)
    return records.select(parsed.alias("r")).select("r.*")


