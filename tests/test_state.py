"""Rolling counts and TTL deduplication against brute force, with one key holding most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import dedup, features
from logtide.session import materialise

BASE = dt.datetime(2024, 1, 1)
S = 1_000_000


def frame(spark, rows, schema="id string, service string, us bigint"):
    return spark.createDataFrame(rows, schema).withColumn("event_time", F.timestamp_micros(F.col("us") + 1704067200 * S))


def brute_count(rows, window):
    out = {}
    for i, s, t in rows:
        out[i] = sum(1 for _, s2, t2 in rows if s2 == s and t - window * S < t2 <= t)
    return out


def brute_dedup(rows, ttl, carried=None):
    """rows: (id, key, us); the literal walk in time order."""
    free, out = dict(carried or {}), {}
    for t, i, k in sorted((t, i, k) for i, k, t in rows):
        out[i] = t < free.get(k, -(2**62))
        if not out[i]:
            free[k] = t + ttl * S
    return out


def counts(df, **kw):
    return {r["id"]: r["request_count_last_60s"] for r in features.rolling_count(df, **kw).collect()}


def test_rolling_edges(spark):
    seconds = [0, 30, 60, 60, 119.999999, 120]
    rows = [(str(i), "a", int(s * S)) for i, s in enumerate(seconds)]
    df = frame(spark, rows)
    assert [counts(df)[str(i)] for i in range(6)] == [1, 2, 3, 3, 3, 2]
    assert [counts(df, distinct_micros=True)[str(i)] for i in range(6)] == [1, 2, 2, 2, 2, 2]


@pytest.mark.parametrize("slice_seconds", [None, 60, 61, 600])
def test_rolling_busy_service(spark, slice_seconds):
    rng = random.Random(7)
    rows = []
    for i in range(900):
        service = "hot" if i % 3 else f"s{rng.randrange(5)}"
        rows.append((str(i), service, rng.randrange(0, 1200) * S + rng.choice([0, 0, 1, 500_000])))
    df = frame(spark, rows).repartition(5)
    assert counts(df, slice_seconds=slice_seconds) == brute_count(rows, 60)


def test_rolling_copies_and_carried(spark):
    rows = [(str(i), "a", 100 * S) for i in range(50)]
    assert set(counts(frame(spark, rows)).values()) == {50}
    carried = spark.createDataFrame([("a", (1704067200 + 41) * S, 4), ("a", (1704067200 + 40) * S, 9)],
                                    "service string, _us bigint, _n bigint")
    assert set(counts(frame(spark, rows), carried=carried).values()) == {54}


def alerts(spark, rows):
    return frame(spark, rows, "alert_id string, dedup_key string, us bigint").withColumnRenamed("event_time", "detected_at")


def flags(df, ttl, **kw):
    return {r["alert_id"]: r["deduplicated"] for r in dedup.dedup_alerts(df, ttl, **kw).collect()}


def test_dedup_edges(spark):
    rows = [(f"a{i}", "k", t * S) for i, t in enumerate([0, 10, 3599, 3600, 3700, 7199, 7200])]
    assert [flags(alerts(spark, rows), 3600)[f"a{i}"] for i in range(7)] == [False, True, True, False, True, True, False]


def test_dedup_ties_and_missing_key(spark):
    rows = [("b", "k", 0), ("a", "k", 0), ("c", None, 0), ("d", None, 1)]
    assert flags(alerts(spark, rows), 60) == {"a": False, "b": True, "c": False, "d": False}


@pytest.mark.parametrize("seed,span,ttl", [(1, 4000, 60), (2, 100_000, 60), (3, 20_000, 600), (4, 300, 7)])
def test_dedup_busy_key(spark, seed, span, ttl):
    """Dense and sparse chains over many chunks; one key holds a third of the rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randrange(40)}"
        rows.append((f"a{i:05d}", key, rng.randrange(0, span * 4) * (S // 4)))
    assert flags(alerts(spark, rows).repartition(7), ttl) == brute_dedup(rows, ttl)


@pytest.mark.parametrize("chunk", [3, 30, 90, 1000])
def test_anchor_chunks(spark, chunk):
    """The chain does not depend on where chunks are cut, not even inside one TTL."""
    rng = random.Random(chunk)
    times = sorted({rng.randrange(0, 5000 * 10) * (S // 10) for _ in range(2000)})
    df = spark.createDataFrame([("k", t) for t in times], "key string, us bigint")
    got = sorted(r["us"] for r in dedup.anchor_times(df, ["key"], 60 * S, chunk_rows=chunk).collect())
    want = [t for t, d in zip(times, [brute_dedup([(str(t), "k", t) for t in times], 60)[str(t)] for t in times]) if not d]
    assert got == want


@pytest.mark.parametrize(("step", "ttl"), [(1, 3600), (1, 7), (5, 12)])
def test_even_alerts_of_one_key_stay_bounded(spark, monkeypatch, step, ttl):
    """Chains of evenly spaced alerts never merge; still no array is longer than a chunk or the alerts of one TTL."""
    longest = []

    def stored(df, name):
        found = materialise(df, name)
        for c, kind in found.dtypes:
            if kind.startswith("array"):
                longest.append(found.agg(F.max(F.size(c))).first()[0])
        return found

    monkeypatch.setattr(dedup, "materialise", stored)
    times = [i * step * S for i in range(6000)]
    df = spark.createDataFrame([("k", t) for t in times], "key string, us bigint")
    got = sorted(r["us"] for r in dedup.anchor_times(df, ["key"], ttl * S, chunk_rows=20).collect())
    flagged = brute_dedup([(f"{t:020d}", "k", t) for t in times], ttl)
    assert got == [t for t in times if not flagged[f"{t:020d}"]]
    assert len(longest) >= 5 and max(longest) <= max(20, ttl // step + 2)


def test_dedup_carried(spark):
    offset = 1704067200 * S
    rows = [("a", "k", 0), ("b", "k", 50 * S), ("c", "k", 90 * S), ("d", "j", 0)]
    carried = spark.createDataFrame([("k", offset + 40 * S)], "dedup_key string, free bigint")
    df = alerts(spark, rows)
    assert flags(df, 60, carried=carried) == {"a": True, "b": False, "c": True, "d": False}
    flagged = dedup.dedup_alerts(df, 60, carried=carried)
    left = {r["dedup_key"]: r["free"] - offset for r in dedup.open_suppressions(flagged, 60, carried).collect()}
    assert left == {"k": 110 * S, "j": 60 * S}


def test_dedup_clear(spark):
    rows = [("a", "k", 0), ("b", "k", 10 * S), ("c", "k", 30 * S), ("d", "k", 40 * S)]
    clears = spark.createDataFrame([("k", BASE + dt.timedelta(seconds=20))], "dedup_key string, cleared_at timestamp")
    assert flags(alerts(spark, rows), 3600, clears=clears) == {"a": False, "b": True, "c": False, "d": True}


def test_ttl_remaining(spark):
    df = dedup.dedup_alerts(alerts(spark, [("a", "k", 0), ("b", "k", 100 * S), ("c", "j", 0)]), 3600)
    at = F.lit(BASE + dt.timedelta(seconds=3000))
    assert {r[0]: r[1] for r in dedup.dedup_ttl_remaining(df, at, 3600).collect()} == {"k": 600, "j": 600}
    late = F.lit(BASE + dt.timedelta(seconds=3600))
    assert {r[1] for r in dedup.dedup_ttl_remaining(df, late, 3600).collect()} == {-1}


def test_empty_input(spark):
    assert counts(frame(spark, [])) == {}
    assert flags(alerts(spark, []), 60) == {}
