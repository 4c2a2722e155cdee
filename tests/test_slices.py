"""Scans in slices of time against the same scan in one slice, and plans that leave the large side where it is."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from logtide.operators import features, metrics, rules, search
from logtide.operators.quantiles import numbered

BASE = dt.datetime(2024, 1, 1)
ONE = 10**9


@pytest.fixture(scope="module")
def samples(spark):
    rng = random.Random(4)
    rows, value = [], 0.0
    for i in range(900):
        value = 0.0 if rng.random() < 0.05 else value + rng.randrange(5)
        rows.append((BASE + dt.timedelta(seconds=15 * i + rng.randrange(15)), "m", {"job": "hot" if i % 3 else "b"}, value))
    return spark.createDataFrame(rows, "ts timestamp, metric string, labels map<string,string>, value double")


@pytest.mark.parametrize(("window", "width"), [(300, 300), (300, 301), (60, 3_600), (7_200, 60)])
def test_rates(samples, window, width):
    key = lambda df: sorted((r["ts"], r["labels"]["job"], r["increase"], r["rate"]) for r in df.collect())
    assert key(metrics.counter_rate(samples, window, width)) == key(metrics.counter_rate(samples, window, ONE))


def test_a_long_series_is_not_one_task(samples):
    plan = metrics.counter_rate(samples, 300)._jdf.queryExecution().toString()
    assert "_slice" in plan.split("Window [")[1]


@pytest.mark.parametrize("width", [10, 47, 600])
def test_firing(spark, width):
    """Runs within a slice, over borders, over whole slices and gaps, with unknown states between."""
    rng = random.Random(width)
    rows = []
    for job in ("hot", "b", None):
        state = False
        for i in range(300):
            state = state if rng.random() < 0.9 else rng.choice([True, False, None])
            if rng.random() < 0.9:
                rows.append(("A", "critical", 30, job, BASE + dt.timedelta(seconds=7 * i), state))
    df = spark.createDataFrame(rows, "alertname string, severity string, hold_seconds int, job string, ts timestamp, active boolean").repartition(5)
    key = lambda df: sorted(map(str, df.select("job", "ts", "active", "since", "state").collect()))
    got = key(rules.rule_firing(df, width))
    assert got == key(rules.rule_firing(df, ONE)) and len(got) == len(rows)
    want, opened = {}, {}
    for _, _, _, job, ts, active in sorted(rows, key=lambda r: (str(r[3]), r[4])):
        opened[job] = (opened.get(job) or ts) if active else None
        want[job, ts] = opened[job]
    assert {(r["job"], r["ts"]): r["since"] for r in rules.rule_firing(df, width).collect()} == want


def test_numbers_by_ranges(spark):
    names = [f"s{i:05d}" for i in range(3_000)]
    df = spark.createDataFrame([(n, BASE if i % 2 else BASE + dt.timedelta(seconds=i)) for i, n in enumerate(names)], "service string, event_time timestamp")
    got = {r["service"]: r["service_id"] for r in features.service_labels(df.repartition(7)).collect()}
    order = sorted((r["event_time"], r["service"]) for r in df.collect())
    assert got == {s: i for i, (_, s) in enumerate(order, 1)}
    more = features.service_labels(df.unionByName(df.limit(1).withColumn("service", F.lit("new"))), spark.createDataFrame(list(got.items()), "service string, service_id int"))
    assert more.where("service = 'new'").first()["service_id"] == 3_001
    assert numbered(df.limit(0), ["service"]).count() == 0


def test_logs_are_not_shuffled_to_be_flagged(spark, tmp_path):
    spark.range(5_000).select(F.concat(F.lit("l"), "id").alias("log_id"), F.lit("INFO").alias("level")).write.parquet(str(tmp_path / "logs"))
    logs = spark.read.parquet(str(tmp_path / "logs"))
    alerts = logs.where("log_id like '%7'").union(logs.limit(20))
    few = search.flag_anomalous_logs(logs, alerts)
    few.collect()
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        many = search.flag_anomalous_logs(logs, alerts, most_broadcast=10)
        assert "SortMergeJoin" in many._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, many.collect())) == sorted(map(tuple, few.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
