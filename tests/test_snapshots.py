"""Snapshot tables: merged reads, whole snapshots, batches that run twice, compaction, expiry, vacuum."""

import datetime as dt
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators import alerts as alerting
from logtide.session import scratch_path
from logtide.sources import snapshots

SCHEMA = T.StructType(
    [
        T.StructField("log_id", T.StringType()),
        T.StructField("level", T.StringType()),
        T.StructField("processed_at", T.IntegerType()),
        T.StructField("note", T.MapType(T.StringType(), T.StringType())),
    ]
)


@pytest.fixture
def table(spark):
    return snapshots.log_table(spark, scratch_path(spark, "table"), SCHEMA)


def rows(spark, *values):
    made = [(i, level, at, {"k": level}, dt.date(2024, 1, day) if day else None) for i, level, at, day in values]
    return spark.createDataFrame(made, "log_id string, level string, processed_at int, note map<string,string>, log_date date")


def state(table, **how):
    return sorted((r["log_date"].day, r["log_id"], r["level"]) for r in table.read(**how).collect())


def test_upserts_are_merged_when_read(spark, table):
    assert state(table) == []
    assert table.upsert(rows(spark, ("a", "1", 1, 1), ("b", "1", 1, 1), ("c", "1", 1, 2), (None, "x", 1, 1), ("d", "x", 1, None))) == (3, 2)
    assert table.upsert(rows(spark, ("a", "2", 2, 1), ("b", "0", 0, 1), ("a", "9", 9, 3))) == (3, 0)
    want = [(1, "a", "2"), (1, "b", "1"), (2, "c", "1"), (3, "a", "9")]
    assert state(table) == want
    assert table.compact() == 3 and state(table) == want and table.files() == 3
    assert table.compact() == 0
    table.upsert(rows(spark, ("c", "3", 3, 2), ("e", "3", 3, 2)))
    want[2:3] = [(2, "c", "3"), (2, "e", "3")]
    assert state(table) == want
    assert table.compact() == 1 and state(table) == want


def test_clean_partitions_are_not_merged(spark, table):
    table.upsert(rows(spark, *[(f"i{i}", "1", 1, i % 5 + 1) for i in range(50)]))
    table.compact()
    table.upsert(rows(spark, ("i0", "2", 2, 1)))
    plan = table.read().where("log_date = '2024-01-03'")._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert table.read(only=lambda d: d == "2024-01-03").count() == 10
    assert "Join" not in table.read(only=lambda d: d == "2024-01-03")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(log_date" in physical


def test_many_delta_rows_are_merged_in_one_pass(spark):
    """Few delta rows let the base pass by a broadcast; many are dealt with the base once, without a join. Both give the same rows."""
    base = [(f"i{i}", f"b{i}", i % 4 or None, i % 3 + 1) for i in range(60)]
    deltas = [(f"i{i}", f"d{i}-{n}", n * i % 5 or None, i % 3 + 1) for i in range(0, 90, 2) for n in range(3)]
    best = {}
    for i, _, at, day in base + deltas:
        best[i] = max(best.get(i, (-1, day)), (-1 if at is None else at, day))
    found = []
    for few, joins in ((0, 0), (10_000, 2)):
        merge = snapshots.last_by(["log_date", "log_id"], ["processed_at"], few)
        merged = merge(rows(spark, *base), rows(spark, *deltas))
        found.append({(r["log_id"], r["level"], r["processed_at"], r["log_date"].day) for r in merged.collect()})
        assert merged.count() == len(best)
        plan = merged._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Join ") == plan.count("strategy=broadcast") == joins and plan.count("Window [") == 1
    assert found[0] == found[1] <= set(base + deltas)  # ties fall the same way
    assert {i: (-1 if at is None else at, day) for i, _, at, day in found[0]} == best


def test_readers_keep_their_snapshot(spark, table):
    table.upsert(rows(spark, ("a", "1", 1, 1)))
    before = table.read()
    old = table.snapshot().version
    table.upsert(rows(spark, ("a", "2", 2, 1), ("b", "2", 2, 2)))
    table.compact()
    table.vacuum(keep_snapshots=3, older_than_seconds=0)
    assert [r["level"] for r in before.collect()] == ["1"]
    assert state(table, version=old) == [(1, "a", "1")]
    assert state(table) == [(1, "a", "2"), (2, "b", "2")]
    with pytest.raises(ValueError, match="no snapshot 77"):
        table.read(version=77)


def test_a_batch_that_runs_twice_is_stored_once(spark, table):
    batch = rows(spark, ("a", "1", 1, 1), (None, "1", 1, 1))
    assert table.upsert(batch, ("job", 0)) == (1, 1) == table.upsert(batch, ("job", 0))
    assert len(table.snapshot().deltas) == 1
    table.upsert(rows(spark, ("b", "1", 1, 1)), ("job", 1))
    assert table.upsert(batch, ("job", 0)) == (0, 0)
    table.upsert(batch, ("other", 0))
    assert len(table.snapshot().deltas) == 3 and state(table) == [(1, "a", "1"), (1, "b", "1")]


def test_a_hundred_batches_stay_a_bounded_number_of_folders(spark):
    """Each reader during the compactions sees every row once."""
    table = snapshots.log_table(spark, scratch_path(spark, "table"), SCHEMA)
    for batch in range(100):
        made = spark.range(2).select(
            F.concat(F.lit(f"{batch}-"), "id").alias("log_id"), F.lit("x").alias("level"), F.lit(batch).alias("processed_at"),
            F.lit(None).cast("map<string,string>").alias("note"), F.date_add(F.lit("2024-01-01").cast("date"), batch // 25).alias("log_date"),
        ).coalesce(1)
        table.upsert(made, ("job", batch))
        if batch % 20 == 19:
            open_reader = table.read()
            table.compact()
            table.vacuum(older_than_seconds=0)
            assert open_reader.count() == table.read().count() == 2 * (batch + 1)
    assert table.files() == 4 and len(table.versions()) <= 2
    assert len(table._names("data")) < 50  # the folders of two snapshots
    table.vacuum(keep_snapshots=1, older_than_seconds=0)
    assert len(table._names("data")) <= 4


def test_writers_at_once(spark, table):
    """Eight writers and a compaction: no commit is lost."""
    made = [rows(spark, (f"w{i}", "1", 1, 1)) for i in range(8)]
    table.upsert(rows(spark, ("z", "1", 1, 1)))
    jobs = [threading.Thread(target=table.upsert, args=(m,)) for m in made] + [threading.Thread(target=table.compact)]
    for j in jobs:
        j.start()
    for j in jobs:
        j.join()
    assert [i for _, i, _ in state(table)] == sorted([f"w{i}" for i in range(8)] + ["z"])


def test_expiry(spark, table):
    table.upsert(rows(spark, *[(f"i{d}", "1", 1, d) for d in range(1, 6)]))
    table.compact()
    table.upsert(rows(spark, ("j", "1", 1, 1), ("k", "1", 1, 5)))
    assert table.expire(lambda day: day >= "2024-01-04") == 3
    assert state(table) == [(4, "i4", "1"), (5, "i5", "1"), (5, "k", "1")]
    assert table.vacuum(keep_snapshots=1, older_than_seconds=0) == 9  # the first delta, three days of the base, a new row
    assert state(table) == [(4, "i4", "1"), (5, "i5", "1"), (5, "k", "1")]
    assert table.vacuum(keep_snapshots=1, older_than_seconds=0) == 0


def test_alert_history(spark):
    """As the change log read whole, over three batches with a compaction between them."""
    table = snapshots.alert_table(spark, scratch_path(spark, "alerts"))
    now = F.lit(dt.datetime(2024, 1, 1))
    every = None
    for seq in range(3):
        made = spark.range(40).where(F.col("id") % (seq + 1) == 0).select(
            F.concat(F.lit("a"), "id").alias("alert_id"), F.lit("l").alias("log_id"), F.lit("s").alias("service"), F.lit("ERROR").alias("level"),
            F.lit(f"message {seq}").alias("message"), F.lit(-0.1).alias("anomaly_score"), F.lit("h").alias("host"), F.lit(1.0).alias("response_time_ms"),
            F.lit(500).alias("error_code"), now.alias("detected_at"), F.array(F.lit("slack" if seq % 2 else "email")).alias("notification_channels"),
            F.lit(seq).alias("seq"),
        )
        changes = alerting.history_rows(made, now, require_uuid=False)
        assert table.upsert(snapshots.alert_changes(changes), ("alerts", seq)) == (changes.count(), 0)
        every = changes if every is None else every.unionByName(changes)
        if seq == 1:
            table.compact()
    want = alerting.alerts_upsert(every)
    got = table.read().select(*want.columns)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
