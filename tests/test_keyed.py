"""Keyed state against the batch operators and a literal walk, over queries that end and start again."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import dedup, features
from logtide.session import scratch_path
from logtide.streaming import keyed

BASE = dt.datetime(2024, 1, 1)


def run(spark, parts, make):
    """Each part lands as a file and is taken up by a query that is started anew; returns what was written."""
    landed, out, checkpoint = (scratch_path(spark, n) for n in ("landed", "out", "checkpoint"))
    for part in parts:
        part.coalesce(2).write.mode("append").parquet(landed)
        query = make(spark.readStream.schema(part.schema).parquet(landed)).writeStream.format("parquet").option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.parquet(out), query


@pytest.fixture(scope="module")
def alerts(spark):
    rng = random.Random(5)
    rows = []
    for i in range(600):
        key = rng.choice(["hot", "hot", "a", "b", f"k{rng.randrange(30)}", None])
        rows.append((f"al{i:04d}", key, BASE + dt.timedelta(seconds=rng.choice([0, 1, 2]) + 20 * (i // 2))))
    rows.append(("none", "a", None))
    return spark.createDataFrame(rows, "alert_id string, dedup_key string, detected_at timestamp")


def in_order(df, time, cuts):
    at = F.coalesce(F.unix_micros(time) - int(BASE.replace(tzinfo=dt.UTC).timestamp()) * 10**6, F.lit(0)) / 1e6
    edges = [-1, *cuts, 1e12]
    return [df.where((at > low) & (at <= high)) for low, high in zip(edges, edges[1:], strict=False)]


def test_dedup(spark, alerts):
    found, _ = run(spark, in_order(alerts, "detected_at", [1500, 1501, 4000]), lambda s: keyed.dedup_stream(s, 300))
    free, want = {}, {}
    for at, i, key in sorted(((r[2] or BASE, r[0], r[1]) for r in alerts.collect())):
        known = key is not None and i != "none"
        want[i] = known and at < free.get(key, BASE - dt.timedelta(days=1))
        if known and not want[i]:
            free[key] = at + dt.timedelta(seconds=300)
    assert {r["alert_id"]: r["deduplicated"] for r in found.collect()} == want
    batch = dedup.dedup_alerts(alerts.where("detected_at IS NOT NULL"), 300)
    assert {r["alert_id"]: r["deduplicated"] for r in batch.collect()} == {i: d for i, d in want.items() if i != "none"}


def test_state_ends_with_its_time(spark, alerts):
    """Of 33 keys only those that may still suppress an alert are left behind."""
    later = spark.createDataFrame([(f"z{i}", "late", BASE + dt.timedelta(days=i)) for i in range(1, 3)], alerts.schema)
    parts = [alerts.where("detected_at IS NOT NULL"), *in_order(later, "detected_at", [90_000])]
    found, _ = run(spark, parts, lambda s: keyed.dedup_stream(s, 300))
    assert found.where("alert_id like 'z%' AND NOT deduplicated").count() == 2


def test_rolling_count(spark):
    rng = random.Random(8)
    rows = [(f"l{i}", rng.choice(["hot", "hot", "a", None]), BASE + dt.timedelta(seconds=i // 3, microseconds=rng.choice([0, 0, 1]))) for i in range(900)]
    logs = spark.createDataFrame([*rows, ("x", "a", None)], "log_id string, service string, event_time timestamp")
    found, _ = run(spark, in_order(logs, "event_time", [60, 100, 250]), lambda s: keyed.rolling_count_stream(s, 60))
    got = {r["log_id"]: r["request_count_last_60s"] for r in found.collect()}
    usable = logs.where("service IS NOT NULL AND event_time IS NOT NULL")
    want = {r["log_id"]: r["request_count_last_60s"] for r in features.rolling_count(usable).collect()}
    assert {i: n for i, n in got.items() if n is not None} == want and len(got) == 901


def test_a_busy_service_is_dealt_by_slices(spark, monkeypatch):
    """All rows are of one service: no group holds them all, and counts across slices and runs are those of the batch."""
    rows = [(f"l{i}", "hot", BASE + dt.timedelta(seconds=20 * i, microseconds=i % 2)) for i in range(1080)]
    logs = spark.createDataFrame(rows, "log_id string, service string, event_time timestamp")
    parts = in_order(logs, "event_time", [3590, 9000])
    found, _ = run(spark, parts, lambda s: keyed.rolling_count_stream(s, 90))
    got = sorted((r["log_id"], r["request_count_last_60s"]) for r in found.collect())
    assert got == sorted((r["log_id"], r["request_count_last_60s"]) for r in features.rolling_count(logs, 90).collect())

    class Sizes(keyed.RollingCount):
        def handleInputRows(self, key, rows, timerValues):
            held = list(rows)
            for counted in super().handleInputRows(key, iter(held), timerValues):
                yield counted.assign(**{self.out: sum(map(len, held))})

    monkeypatch.setattr(keyed, "RollingCount", Sizes)
    found, _ = run(spark, [logs], lambda s: keyed.rolling_count_stream(s, 90))
    assert found.count() == 1080 and found.agg(F.max("request_count_last_60s")).first()[0] <= 3600 // 20 + 90 // 20 + 1


def test_redelivered_records_come_once(spark):
    """Again in the same batch, in the next one, after a restart; equal values at other places stay."""
    schema = "topic string, partition int, offset long, timestamp timestamp, value string"
    rows = [("raw", p, o, BASE + dt.timedelta(seconds=o), "same") for p in (0, 1) for o in range(20)]
    first, second = spark.createDataFrame(rows[:30] + rows[5:10], schema), spark.createDataFrame(rows[20:] + rows[25:35], schema)
    found, _ = run(spark, [first, second], keyed.once_delivered)
    assert sorted((r["partition"], r["offset"]) for r in found.collect()) == sorted((p, o) for _, p, o, *_ in rows)


def test_late_records_are_counted(spark):
    schema = "topic string, partition int, offset long, timestamp timestamp, value string"
    made = [spark.createDataFrame([("raw", 0, i, BASE + dt.timedelta(hours=h), "v")], schema) for i, h in enumerate((0, 5, 5, 1))]
    landed, out, checkpoint = (scratch_path(spark, n) for n in ("landed", "out", "checkpoint"))
    dropped = 0
    for part in made:
        part.write.mode("append").parquet(landed)
        stream = keyed.once_delivered(spark.readStream.schema(part.schema).parquet(landed))
        query = stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
        query.awaitTermination()
        dropped += sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    assert spark.read.parquet(out).count() == 3 and dropped == 1
