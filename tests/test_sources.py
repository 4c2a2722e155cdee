"""Files, topics and stored tables."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logtide.operators import alerts as alerting
from logtide.operators import stats
from logtide.operators.search import page_of, search_logs
from logtide.schemas import FEATURE_COLUMNS, PROCESSED_LOG, conform
from logtide.session import scratch_path
from logtide.sources import collect, tables, topics

DAY = dt.datetime(2024, 1, 15, 10)


def parse(spark, *values):
    df = spark.createDataFrame([(v,) for v in values], "value string")
    return topics.parse_raw_logs(df).collect()


def test_topic_values(spark):
    rows = parse(
        spark,
        json.dumps({"service": "a", "message": 5, "timestamp": 1705288934.5, "metadata": {"t": 1}}),
        json.dumps({"service": "a", "timestamp": "1705288934", "metadata": "text"}),
        "{broken",
        "[1]",
        "",
        None,
    )
    assert [r["decodable"] for r in rows] == [True, True, False, False, False, False]
    assert rows[0]["message"] == "5" and rows[0]["epoch_seconds"] == 1705288934.5 and rows[0]["timestamp"] is None
    assert json.loads(rows[0]["metadata"]) == {"t": 1}
    assert rows[1]["timestamp"] == "1705288934" and rows[1]["epoch_seconds"] is None and rows[1]["metadata"] is None


def test_topic_records(spark):
    df = spark.createDataFrame([("a", DAY, None)], "service string, event_time timestamp, host string")
    row = topics.to_topic_records(df, "t", headers={"k": "v"}).first()
    assert (row["key"], row["topic"]) == ("a", "t") and bytes(row["headers"][0]["value"]) == b"v"
    assert json.loads(row["value"]) == {"service": "a", "event_time": "2024-01-15T10:00:00.000000+00:00", "host": None}


def test_container_files(spark, tmp_path):
    nested = json.dumps({"message": "boom", "level": "ERROR", "error_code": 500})
    lines = [json.dumps({"log": nested, "time": "2024-01-15T10:00:00Z"}), json.dumps({"log": "plain", "severity": "warn"}), "x"]
    (tmp_path / "auth-service-7f9d.log").write_text("\n".join(lines))
    read = collect.read_container_logs(spark, str(tmp_path), stream=False)
    rows = collect.collect_container_logs(read, F.lit(DAY), "node").orderBy("level").collect()
    assert [(r["service"], r["level"], r["message"], r["error_code"]) for r in rows] == [
        ("auth-service", "ERROR", "boom", "500"),
        ("auth-service", "warn", "plain", None),
    ]
    assert rows[0]["log"] == nested and rows[0]["host"] == "node"


def test_syslog(spark):
    lines = ["<34>Oct  1 22:14:15 web1 su[77]: 'su root' failed", "<13>Jan 15 03:22:14 web2 cron: ok", "junk"]
    df = spark.createDataFrame([(x,) for x in lines], "value string")
    rows = collect.collect_syslog(df, F.lit(2024), F.lit(DAY)).collect()
    assert [(r["level"], r["facility"], r["host"], r["service"], r["pid"]) for r in rows] == [
        ("crit", 4, "web1", "su", 77),
        ("notice", 1, "web2", "cron", None),
    ]
    assert rows[0]["event_time"] == dt.datetime(2024, 10, 1, 22, 14, 15)


def logs(spark, *rows):
    full = [(i, day, m, day + dt.timedelta(seconds=v)) for i, day, m, v in rows]
    return spark.createDataFrame(full, "log_id string, event_time timestamp, message string, processed_at timestamp")


def test_daily_table_is_idempotent(spark):
    path = scratch_path(spark, "daily")
    first = logs(spark, ("a", DAY, "one", 0), ("b", DAY + dt.timedelta(days=1), "two", 0))
    tables.write_daily(first, path)
    again = logs(spark, ("a", DAY, "one again", 5), ("c", DAY, "three", 0))
    for _ in range(2):
        tables.write_daily(again, path, existing=spark.read.parquet(path))
    found = {r["log_id"]: r["message"] for r in spark.read.parquet(path).collect()}
    assert found == {"a": "one again", "b": "two", "c": "three"}


def test_search_prunes_days(spark):
    path = scratch_path(spark, "daily")
    tables.write_daily(logs(spark, *[(str(i), DAY + dt.timedelta(days=i), "m", 0) for i in range(5)]), path)
    found = search_logs(spark.read.parquet(path), start="2024-01-16T12:00:00Z", end="2024-01-18T00:00:00Z")
    assert {r["log_id"] for r in found.collect()} == {"2"}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "log_date" in plan.split("PartitionFilters:")[1].split("]")[0]
    kept = stats.retain_recent(spark.read.parquet(path), F.lit(DAY + dt.timedelta(days=4)), 86_400)
    assert {r["log_id"] for r in kept.collect()} == {"3", "4"}


def test_eval_csv(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text(",".join([*FEATURE_COLUMNS, "true_label"]) + "\n1,2.5,3,4,5,6,-1\n")
    assert tables.read_eval_csv(spark, str(good)).first()["true_label"] == -1
    for drop in ("true_label", "hour_of_day"):
        bad = tmp_path / f"{drop}.csv"
        bad.write_text(",".join(c for c in [*FEATURE_COLUMNS, "true_label"] if c != drop) + "\n1,2,3,4,5,6\n")
        with pytest.raises(ValueError, match=drop):
            tables.read_eval_csv(spark, str(bad))


def test_conform(spark):
    df = spark.createDataFrame([("x", "abc", "5", "m" * 600, 9)],
                               "log_id string, response_time_ms string, error_code string, message string, other int")
    row = conform(df, PROCESSED_LOG, text_key_limit=512).first()
    assert row["response_time_ms"] is None and row["error_code"] == 5 and row["message_keyword"] is None
    assert "other" not in row.asDict() and row["host"] is None


def test_history_rules(spark):
    good, other = "6f9619ff-8b86-d011-b42d-00c04fc964ff", "7f9619ff-8b86-d011-b42d-00c04fc964ff"
    rows = [
        (good, other, "x" * 300, None, 0, False, ["slack"]),
        (good, other, "second", DAY, 1, True, []),
        ("bad id", "bad log", " ", DAY, 0, False, ["email"]),
    ]
    df = spark.createDataFrame(rows, "alert_id string, log_id string, message string, detected_at timestamp, seq int,"
                               "deduplicated boolean, notification_channels array<string>")  # fmt: skip
    df = df.withColumns({c: F.lit(None).cast("string") for c in ("service", "level", "host")}).withColumns(
        {"anomaly_score": F.lit(-0.1), "response_time_ms": F.lit(1.0), "error_code": F.lit(1)}
    )
    found = {r["message"]: r for r in alerting.alerts_upsert(alerting.history_rows(df, F.lit(DAY))).collect()}
    first = found["x" * 255]
    assert (first["alert_id"], first["log_id"], first["slack_sent"], first["deduplicated"]) == (good, other, False, True)
    assert first["detected_at"] == DAY and first["notification_channels"] is None
    bad = found[None]
    assert bad["log_id"] is None and bad["email_sent"] and len(bad["alert_id"]) == 36


def test_page_arguments(spark):
    df = spark.range(5).withColumnRenamed("id", "log_id")
    for page, size in ((0, 10), (1, 0), (1, 101)):
        with pytest.raises(ValueError):
            page_of(df, page, size, sort="log_id")
    assert [r["log_id"] for r in page_of(df, 2, 2, sort="log_id").collect()] == [2, 1]


def test_stats_golden(spark):
    as_of = dt.datetime(2024, 1, 31)
    logs = spark.createDataFrame([(as_of - dt.timedelta(seconds=5),)] * 12, "event_time timestamp")
    alerts = spark.createDataFrame([(as_of,)], "detected_at timestamp")
    row = stats.system_stats(logs, alerts, F.lit(as_of)).first()
    assert (row["log_rate_per_second"], row["anomaly_rate_percent"]) == (0.2, 8.33)
    three = spark.createDataFrame([(as_of,)] * 3, "detected_at timestamp")
    none = stats.system_stats(logs.filter("false"), three, F.lit(as_of)).first()
    assert none["anomaly_rate_percent"] == 300.0


def test_topic_source_options():
    options = topics.source_options("a:1,b:2", "raw-logs", per_trigger=500)
    assert options == {
        "kafka.bootstrap.servers": "a:1,b:2",
        "subscribe": "raw-logs",
        "startingOffsets": "earliest",
        "kafka.isolation.level": "read_committed",
        "maxOffsetsPerTrigger": "500",
    }
    assert topics.source_options("a:1", "t", earliest=False)["startingOffsets"] == "latest"
    assert "maxOffsetsPerTrigger" not in topics.source_options("a:1", "t")


def test_topic_source_needs_the_connector(spark):
    with pytest.raises(Exception, match="(?i)kafka"):
        topics.read_topic(spark, "localhost:1", "raw-logs")


def test_members_keep_their_types(spark):
    """Numbers, booleans, nulls, objects and arrays; the nested record wins; lines that are no object are left out."""
    lines = [
        json.dumps({"log": json.dumps({"n": 5, "f": 1.5, "b": True, "o": {"x": [1, {"y": "z"}]}, "same": "inner", "nil": None, "error_code": "7"}), "same": 1, "own": "s"}),
        json.dumps({"message": 12, "severity": "warn", "response_time_ms": 3}),
        json.dumps({"log": "plain"}),
        "no",
        None,
    ]
    df = spark.createDataFrame([(v, "a-b-1") for v in lines], "value string, container_name string")
    rows = collect.collect_typed_logs(df, F.lit(DAY))
    value = lambda n, k, p="$": collect.value_of("values", n, k, p).alias(f"{n}{p}")
    first, second, third = rows.select(
        "service", "level", "message", "response_time_ms", "error_code", value("n", "int"), value("f", "double"), value("b", "boolean"),
        value("o", "string", "$.x[1].y"), value("same", "string"), value("own", "string"), value("n", "timestamp", "$.x"),
        F.map_contains_key("values", "nil").alias("nil"), F.schema_of_variant(F.try_element_at("values", F.lit("o"))).alias("kind"),
    ).collect()
    assert tuple(first) == ("a-b", "INFO", lines and json.loads(lines[0])["log"], None, 7, 5, 1.5, True, "z", "inner", "s", None, True, first["kind"])
    assert first["kind"].startswith("OBJECT<x: ARRAY<")
    assert (second["level"], second["message"], second["response_time_ms"]) == ("warn", "12", 3.0)
    assert (third["level"], third["message"], third["nil"]) == ("INFO", "plain", False)
