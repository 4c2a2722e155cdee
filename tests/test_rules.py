"""Rates, quantiles and rule states on small series."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide.operators import metrics, rules

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def series(spark, *rows):
    return spark.createDataFrame([(at(s), m, labels, float(v)) for s, m, labels, v in rows],
                                 "ts timestamp, metric string, labels map<string,string>, value double")


def test_rate_and_reset(spark):
    rows = [(15 * i, "c", {"job": "a"}, v) for i, v in enumerate([0, 10, 20, 5, 15])]
    found = metrics.counter_rate(series(spark, *rows), 60).orderBy("ts").collect()
    assert [r["increase"] for r in found] == [0, 10, 20, 25, 25]
    assert found[3]["rate"] == pytest.approx(25 / 60)


def test_series_do_not_mix(spark):
    rows = [(0, "c", {"a": "1", "b": "2"}, 1), (15, "c", {"b": "2", "a": "1"}, 4), (15, "c", {"a": "2"}, 100)]
    found = metrics.counter_rate(series(spark, *rows), 60).filter("value = 4").first()
    assert found["increase"] == 3


def test_selectors(spark):
    rows = [(0, "up", {"job": "api"}, 1), (0, "up", {"job": "api-2"}, 1), (0, "up", {}, 0), (0, "x", {"job": "api"}, 1)]
    df = series(spark, *rows)
    assert metrics.select_series(df, "up", match={"job": "api|web"}).count() == 1
    assert metrics.select_series(df, "up", not_equal={"job": "api"}).count() == 2


def test_histogram_quantile(spark):
    rows = [(0, "b", {"le": le}, v) for le, v in [("0.1", 10), ("0.5", 30), ("1", 40), ("+Inf", 50)]]
    row = metrics.histogram_quantiles(series(spark, *rows), {"p50": 0.5, "p95": 0.95, "p10": 0.1}, "value").first()
    assert row["p50"] == pytest.approx(0.1 + 0.4 * (25 - 10) / 20)
    assert row["p95"] == 1.0
    assert row["p10"] == pytest.approx(0.05)


def test_empty_histogram(spark):
    rows = [(0, "b", {"le": le}, 0) for le in ("0.1", "+Inf")]
    assert metrics.histogram_quantiles(series(spark, *rows), {"p50": 0.5}, "value").first()["p50"] is None


def evaluated(spark, name, severity, values, hold=60, step=30, job="a"):
    vector = spark.createDataFrame([(at(step * i), job, float(v)) for i, v in enumerate(values)],
                                   "ts timestamp, job string, value double")
    return rules.apply_rule(vector, rules.Rule(name, ">", 5, hold, severity, "{job} is bad"))


def test_hold_time(spark):
    states = rules.rule_firing(evaluated(spark, "r", "warning", [1, 9, 9, 9, 1, 9, 9])).orderBy("ts").collect()
    assert [r["state"] for r in states] == [
        "inactive", "pending", "pending", "firing", "inactive", "pending", "pending",
    ]
    assert states[0]["summary"] == "a is bad"


def test_intervals(spark):
    states = rules.rule_firing(evaluated(spark, "r", "warning", [9, 9, 9, 9, 1, 1]))
    row = rules.alert_intervals(states).first()
    assert (row["since"], row["fired_at"], row["last_at"]) == (at(0), at(60), at(90))
    assert row["resolved_at"] == at(390)


def test_inhibition_and_routes(spark):
    both = evaluated(spark, "r", "warning", [9, 9], 0).unionByName(evaluated(spark, "r", "critical", [9, 1], 0))
    firing = both.filter("active")
    left = sorted((r["severity"], r["ts"]) for r in rules.inhibit_alerts(firing).collect())
    assert left == [("critical", at(0)), ("warning", at(30))]
    routed = sorted((r["severity"], r["receiver"]) for r in rules.route_alerts(firing).collect())
    assert routed == [("critical", "slack-critical"), ("warning", "slack-notifications"), ("warning", "slack-notifications")]


def test_group_notices(spark):
    """One long alert repeats every three hours; a second one joining is told at the next tick."""
    rows = [
        ("r", "a", at(0), at(8 * 3600)),
        ("r", "b", at(0), at(4 * 3600)),
        ("r", "b", at(3600 + 100), at(3600 + 800)),
    ]
    df = spark.createDataFrame(rows, "alertname string, job string, fired_at timestamp, resolved_at timestamp")
    found = rules.group_notifications(df).orderBy("notify_at").collect()
    a = [int((r["notify_at"] - T0).total_seconds()) for r in found if r["job"] == "a"]
    assert a == [30, 30 + 10800, 30 + 2 * 10800, 30 + 96 * 300]
    b = [int((r["notify_at"] - T0).total_seconds()) for r in found if r["job"] == "b"]
    assert b == [30, 3930, 4530, 14430 + 300 - 300]


def test_health(spark):
    rows = [(0, "up", {"job": "a"}, 1), (15, "up", {"job": "a"}, 0), (0, "up", {"job": "b"}, 1)]
    row = metrics.health_summary(series(spark, *rows)).first()
    assert (row["up"], row["known"], row["down"], row["summary"]) == (1, 2, "a", "1/2 up")


def test_null_value_is_not_active(spark):
    vector = spark.createDataFrame([(at(0), "a", None)], "ts timestamp, job string, value double")
    assert rules.apply_rule(vector, rules.ERROR_RATE).first()["active"] is False


def test_ratio_needs_both(spark):
    rows = [
        (0, "avail", {"instance": "a", "fstype": "ext4"}, 10),
        (0, "size", {"instance": "a", "fstype": "ext4"}, 80),
        (0, "avail", {"instance": "b", "fstype": "ext4"}, 10),
        (0, "avail", {"instance": "c", "fstype": "tmpfs"}, 1),
        (0, "size", {"instance": "c", "fstype": "tmpfs"}, 2),
    ]
    found = metrics.ratio_percent(series(spark, *rows), "avail", "size", ["instance"], {"fstype": "tmpfs"})
    assert [(r["instance"], r["value"]) for r in found.select("instance", F.col("value")).collect()] == [("a", 12.5)]


def test_texts_name_the_labels_of_the_series(spark):
    made = [(dt.datetime(2024, 1, 1), "j", "g", "t", "i", 12345.678), (dt.datetime(2024, 1, 1), "j", None, "t", "i", None)]
    vector = spark.createDataFrame(made, "ts timestamp, job string, group string, topic string, instance string, value double")
    told = lambda rule, v=vector: [(r["summary"], r["description"]) for r in rules.apply_rule(v, rule).collect()]
    assert told(rules.CONSUMER_LAG) == [
        ("High Kafka consumer lag", "Consumer group g has lag 12345.67 on topic t"),
        ("High Kafka consumer lag", "Consumer group  has lag NaN on topic t"),
    ]
    assert told(rules.LOW_DISK)[0] == ("Low disk space on i", "Available disk space is 12345.67%")
    assert told(rules.CPU_BUSY, vector.drop("instance"))[0][0] == "High CPU usage on j"
    share = vector.withColumn("value", F.lit(0.0625))
    assert told(rules.ERROR_RATE, share)[0][1] == "Error rate is 6.25% (threshold: 5%)"
    assert told(rules.SLOW_RESPONSE, share)[0][1] == "95th percentile response time is 0.06s"
