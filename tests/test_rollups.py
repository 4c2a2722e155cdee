"""Roll-ups against scans, over streams that run again, and the jobs that write snapshot tables."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import rollups, stats
from logtide.plans import inputs
from logtide.schemas import PROCESSED_LOG, conform
from logtide.session import scratch_path
from logtide.sources import snapshots
from logtide.streaming import jobs

BASE = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def logs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(4_000):
        at = BASE + dt.timedelta(seconds=rng.randrange(7_200), microseconds=rng.choice([0, 0, 1, 999_999]))
        service = "hot" if i % 3 else rng.choice(["a", "b", None])
        rows.append((f"l{i}", service, rng.choice(["INFO", "ERROR", None]), rng.choice([None, -1.0, 1.0, 5.0, 5.1, 1e9, rng.random() * 3000]), at if i % 50 else None))
    return spark.createDataFrame(rows, "log_id string, service string, level string, response_time_ms double, event_time timestamp")


@pytest.fixture(scope="module")
def table(spark, logs):
    made = rollups.log_rollup_table(spark, scratch_path(spark, "rollups"))
    for i in range(4):
        made.upsert(rollups.minute_rollup(logs.where(F.pmod(F.hash("log_id"), F.lit(4)) == i)), ("r", i))
        if i == 1:
            made.compact()
    return made


def test_stats_at_any_time(spark, logs, table):
    alerts = logs.where("level = 'ERROR' AND event_time IS NOT NULL").withColumns({"detected_at": F.col("event_time"), "deduplicated": F.col("service") == "hot"}).fillna({"deduplicated": False})
    kept = rollups.alert_rollup_table(spark, scratch_path(spark, "alerts"))
    kept.upsert(rollups.alert_rollup(alerts))
    for seconds, window, unique in ((7_200, 60, False), (3_661.5, 1, True), (5_000, 90, False), (60, 5, True), (0, 1440, False)):
        as_of = F.lit(BASE + dt.timedelta(seconds=seconds))
        want = stats.system_stats(logs, alerts, as_of, window, unique).first().asDict()
        got = rollups.system_stats(table.read(), kept.read(), as_of, window, unique, logs, alerts).first().asDict()
        assert got == want
    empty = rollups.system_stats(table.read().limit(0), kept.read().limit(0), F.lit(BASE), 60).first()
    assert empty["total_anomalies"] == 0 == empty["logs_last_hour"]
    with pytest.raises(ValueError):
        rollups.system_stats(table.read(), kept.read(), F.lit(BASE), 0)


def test_histogram_and_counts(logs, table):
    key = lambda r: (r["service"], r["le"])
    named = logs.where("event_time IS NOT NULL").fillna({"service": ""})
    want = {key(r): (r["n"], r["count"], pytest.approx(r["sum"])) for r in stats.histogram(named, "response_time_ms", by=["service"]).collect()}
    got = {key(r): (r["n"], r["count"], r["sum"]) for r in rollups.latency_histogram(table.read(), ["service"]).collect()}
    assert got == want and len(got) == 15 * 4
    minutes = {(r["bucket"], r["service"]): r["n"] for r in stats.per_bucket(named, by=["service"]).collect()}
    assert {(r["bucket"], r["service"]): r["n"] for r in rollups.per_minute(table.read(), ["service"]).collect()} == minutes


def test_sketch_error(logs, table):
    """Ranks of merged sketches against the values themselves; measured below 1.5 % here."""
    values = sorted(r[0] for r in logs.where("event_time IS NOT NULL AND response_time_ms IS NOT NULL").select("response_time_ms").collect())
    points = {f"p{p}": p / 100 for p in (1, 10, 25, 50, 75, 90, 99)}
    found = rollups.latency_quantiles(table.read(), points).first()
    assert found["n"] == len(values)
    for name, p in points.items():
        below, upto = sum(v < found[name] for v in values) / len(values), sum(v <= found[name] for v in values) / len(values)
        assert below - 0.025 <= p <= upto + 0.025


def test_only_recent_days_are_read(spark, table):
    as_of = F.lit(dt.datetime(2024, 1, 5))
    plan = rollups.counts_since(table.read(), {"n": as_of - F.expr("INTERVAL 1 HOUR")})._jdf.queryExecution().toString()
    assert "log_date" in plan.split("PartitionFilters:")[1].split("]")[0]


def test_stream_keeps_roll_ups_over_restarts(spark, logs):
    made = rollups.log_rollup_table(spark, scratch_path(spark, "rollups"))
    landed, checkpoint = scratch_path(spark, "landed"), scratch_path(spark, "checkpoint")
    for i in range(3):
        logs.where(F.pmod(F.hash("log_id"), F.lit(3)) == i).coalesce(1).write.mode("append").parquet(landed)
        jobs.RollUps(made, compact_every=2).start(spark.readStream.schema(logs.schema).parquet(landed), checkpoint).awaitTermination()
    whole = logs.where("event_time IS NOT NULL").count()
    assert made.read().agg(F.sum("n")).first()[0] == whole
    # a query with a checkpoint of its own is another writer, whose first batch is not taken for one that is stored
    jobs.RollUps(made).start(spark.readStream.schema(logs.schema).parquet(landed), scratch_path(spark, "checkpoint")).awaitTermination()
    assert made.read().agg(F.sum("n")).first()[0] == 2 * whole


def test_processed_logs_in_a_table_of_bounded_folders(spark, small_dir):
    """Twelve batches into one snapshot table; folders of single batches are forgotten."""
    table = snapshots.log_table(spark, scratch_path(spark, "logs"), PROCESSED_LOG)
    out = scratch_path(spark, "out")
    job = jobs.ProcessLogs(spark, out, store=jobs.into_table(table, "logs"), keep_batches=3)
    rows = inputs.raw_json(spark, small_dir).select("event_id", "value").where("event_id % 10 = 0")
    for batch in range(12):
        part = rows.where(F.col("event_id") / 10 % 12 == batch).select("value")
        job.each(part, batch)
        if batch == 5:
            job.each(part, batch)
            table.compact()
    fs = spark._jvm.org.apache.hadoop.fs.Path(out).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in ("normalised", "times"):
        folders = [s.getPath().getName() for s in fs.listStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{out}/{name}"))]
        assert sorted(folders) == ["batch_id=10", "batch_id=11", "batch_id=9"]
    parts = snapshots.log_table(spark, scratch_path(spark, "logs"), PROCESSED_LOG)
    other = jobs.ProcessLogs(spark, scratch_path(spark, "out"), store=jobs.into_table(parts, "logs"))
    other.each(rows.select("value"), 0)
    assert table.read().count() == parts.read().count() > 0
    assert conform(table.read(), PROCESSED_LOG).schema == PROCESSED_LOG
