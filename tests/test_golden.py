"""Rows that follow from the rules themselves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from logtide.functions import alerting as A
from logtide.functions import features as E
from logtide.functions import normalise as N
from logtide.functions.text import canonical_uuid, clean_text, strip, tokens
from logtide.operators.ingest import batch_ingest_summary
from logtide.operators.normalise import normalise_logs
from logtide.operators.validate import malformed_reason, validate_features, validate_log_entries
from logtide.schemas import RAW_LOG

NOW = dt.datetime(2024, 2, 1)


def apply(spark, values, kind, fn):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def raw(spark, *records):
    base = {f.name: None for f in RAW_LOG.fields}
    rows = [{**base, "service": "svc", "level": "INFO", "message": "m", **r} for r in records]
    return spark.createDataFrame([tuple(r[f.name] for f in RAW_LOG.fields) for r in rows], RAW_LOG)


def test_levels(spark):
    spellings = {
        "DEBUG": ["trace", "debug"],
        "INFO": ["info", "information", "bogus", None, ""],
        "WARN": ["warn", "warning"],
        "ERROR": ["error", "err", " Err "],
        "CRITICAL": ["critical", "crit", "fatal", "emergency", "alert"],
    }
    for level, names in spellings.items():
        assert apply(spark, names, "string", N.normalise_level) == [level] * len(names)


def test_level_codes(spark):
    names = ["DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL", "other", None]
    assert apply(spark, names, "string", E.encode_level) == [0, 1, 2, 2, 3, 4, 4, 1, 1]


def test_error_buckets(spark):
    codes = [None, 0, 200, 299, 302, 404, 503, 599, 600, 100, 1]
    assert apply(spark, codes, "int", E.encode_error_code) == [0, 0, 1, 1, 2, 3, 4, 4, 5, 5, 5]
    keep = apply(spark, [1, 3, 100, 404, None], "int", lambda c: E.encode_error_code(c, keep_buckets=True))
    assert keep == [1, 3, 5, 3, 0]


@pytest.mark.parametrize(
    "text,want",
    [
        ("2024-01-15T03:22:14.512Z", "2024-01-15 03:22:14.512"),
        ("2024-01-15 03:22:14", "2024-01-15 03:22:14"),
        ("2024-01-15T03:22:14", "2024-01-15 03:22:14"),
        (" 2024-01-15T03:22:14 ", "2024-01-15 03:22:14"),
        ("2024-01-15T23:22:14+05:00", "2024-01-15 18:22:14"),
        ("15/Jan/2024:03:22:14 +0100", "2024-01-15 02:22:14"),
        ("2024-01-15", "2024-01-15"),
        ("20240115T032214", "2024-01-15 03:22:14"),
        ("garbage", "2024-02-01"),
        ("", "2024-02-01"),
        ("03:22:14", "2024-02-01"),
        ("1705288934", "2024-02-01"),
        ("2024-13-45T99:99:99Z", "2024-02-01"),
        ("99/Foo/2024:03:22:14 +0100", "2024-02-01"),
        (None, "2024-02-01"),
    ],
)
def test_timestamps(spark, text, want):
    rows = normalise_logs(raw(spark, {"timestamp": text}), as_of=F.lit(NOW))
    assert rows.first()["event_time"] == dt.datetime.fromisoformat(want)


def test_numeric_epoch(spark):
    rows = normalise_logs(raw(spark, {"epoch_seconds": 1705288934.0}, {"epoch_seconds": 1e300}), as_of=F.lit(NOW))
    assert sorted(r["event_time"] for r in rows.collect()) == [dt.datetime(2024, 1, 15, 3, 22, 14), NOW]


def test_source_hour(spark):
    hour = apply(
        spark,
        ["2024-01-15T23:22:14+05:00", "garbage"],
        "string",
        lambda c: N.source_hour(c, F.lit(dt.datetime(2024, 1, 15, 18))),
    )
    assert hour == [23, 18]


def test_numbers(spark):
    rows = normalise_logs(
        raw(
            spark,
            {"log_id": "a", "response_time_ms": "abc", "error_code": "503"},
            {"log_id": "b", "response_time_ms": "-5", "error_code": "5.7"},
            {"log_id": "c", "response_time_ms": " 12.5 ", "error_code": "-1"},
            {"log_id": "d", "response_time_ms": "1.5d", "error_code": " 7 "},
        ),
        as_of=F.lit(NOW),
    )
    found = {r["log_id"]: (r["response_time_ms"], r["error_code"]) for r in rows.collect()}
    assert found == {"a": (0.0, 503), "b": (0.0, None), "c": (12.5, None), "d": (0.0, 7)}


def test_strip_covers_unicode_blanks(spark):
    assert apply(spark, ["  a b  \t", "\x1c　"], "string", strip) == ["a b", ""]
    assert apply(spark, ["   ", "abc", None], "string", lambda c: clean_text(c, 2)) == [None, "ab", None]


def test_tokens(spark):
    assert apply(spark, ["Payment FAILED: id=42, été"], "string", tokens) == [["payment", "failed", "id", "42", "été"]]


@pytest.mark.parametrize(
    "score,level,want",
    [
        (-0.31, "ERROR", "CRITICAL"),
        (-0.31, "CRITICAL", "CRITICAL"),
        (-0.31, "WARN", "HIGH"),
        (-0.30, "CRITICAL", "HIGH"),
        (-0.05, "ERROR", "HIGH"),
        (-0.20, "INFO", "MEDIUM"),
        (-0.10, "INFO", "LOW"),
        (-0.05, "CRITICAL", "LOW"),
        (None, None, "LOW"),
    ],
)
def test_severity(spark, score, level, want):
    df = spark.createDataFrame([(score, level)], "s double, l string")
    assert df.select(A.severity(F.col("s"), F.col("l"))).first()[0] == want


def test_dedup_keys(spark):
    rows = [
        (1, "Svc ", "error", None, -0.31),
        (2, "svc", "ERROR", 0, -0.32),
        (3, "svc", "ERROR", 0, -0.36),
        (4, "other", "ERROR", 0, -0.31),
        (5, None, None, 500, None),
    ]
    df = spark.createDataFrame(rows, "i int, s string, l string, c int, a double")
    keys = {r[0]: r[1] for r in df.select("i", A.dedup_key(*[F.col(c) for c in "slca"])).collect()}
    assert keys[1] == keys[2] and len({keys[1], keys[3], keys[4], keys[5]}) == 4
    assert all(len(k.split(":")[-1]) == 16 for k in keys.values())


def test_ingest_rules(spark):
    cases = [
        ({}, []),
        ({"level": "error"}, []),
        ({"level": "TRACE"}, ["level:unknown"]),
        ({"level": " ERROR "}, ["level:unknown"]),
        ({"service": None}, ["service:missing"]),
        ({"service": "s" * 128}, []),
        ({"service": "s" * 129}, ["service:too_long"]),
        ({"message": " \t"}, ["message:blank"]),
        ({"message": "m" * 4097}, ["message:too_long"]),
        ({"host": "h" * 254}, ["host:too_long"]),
        ({"response_time_ms": "-1"}, ["response_time_ms:out_of_range"]),
        ({"response_time_ms": "300000"}, []),
        ({"response_time_ms": "x"}, ["response_time_ms:not_a_number"]),
        ({"error_code": "100000"}, ["error_code:out_of_range"]),
        ({"timestamp": "15/Jan/2024:03:22:14 +0100"}, ["timestamp:not_iso"]),
        ({"timestamp": "2024-01-15T03:22:14.512Z"}, []),
    ]
    df = raw(spark, *[{**c, "log_id": str(i)} for i, (c, _) in enumerate(cases)])
    for r in validate_log_entries(df).collect():
        assert [f"{e['field']}:{e['rule']}" for e in r["errors"]] == cases[int(r["log_id"])][1]


def test_batch_sizes(spark):
    entry = tuple({**{f.name: None for f in RAW_LOG.fields}, "service": "s", "level": "INFO", "message": "m"}.values())
    schema = f"request_id int, logs array<{RAW_LOG.simpleString()}>"
    df = spark.createDataFrame([(n, [entry] * n) for n in (0, 1, 100, 101)], schema)
    found = {r["request_id"]: r for r in batch_ingest_summary(df).collect()}
    assert [found[n]["batch_ok"] for n in (0, 1, 100, 101)] == [False, True, True, False]
    assert [found[n]["accepted"] for n in (0, 1, 100, 101)] == [0, 1, 100, 0]
    assert found[101]["rejected"] == 101
    assert found[1]["message"] == "Batch processed: 1 accepted, 0 rejected."


def test_malformed(spark):
    df = raw(spark, {"service": " "}, {"message": None}, {"message": " "}, {"service": None}, {})
    assert [r[0] for r in df.select(malformed_reason()).collect()] == [
        "service",
        "message_missing",
        "message_empty",
        "service",
        None,
    ]


def test_feature_domain(spark):
    schema = "features struct<hour_of_day:int,response_time_ms:double,error_code:int,log_level_encoded:int," \
        "request_count_last_60s:bigint,service_id_encoded:int>"
    rows = [((10, 120.0, 1, 1, 150, 0),), ((24, 1.0, 1, 1, 1, 0),), ((1, 1.0, 500, 1, 1, 0),), (None,)]
    df = spark.createDataFrame(rows, schema)
    assert [r["reason"] for r in validate_features(df).collect()] == [None, "hour_of_day", "error_code", "features"]


def test_service_ids(spark):
    assert apply(spark, ["gateway", None], "string", E.charsum_service) == [4, 4]
    ids = apply(spark, ["a", "a", "b"], "string", E.hash_service)
    assert ids[0] == ids[1] and all(0 <= i < 10_000 for i in ids)


def test_uuid(spark):
    good = "6F9619FF-8B86-D011-B42D-00C04FC964FF"
    values = [good, good.replace("-", ""), "{" + good + "}", "nope", None]
    assert apply(spark, values, "string", canonical_uuid) == [good.lower()] * 3 + [None, None]


def test_ui_classes(spark):
    levels = ["CRITICAL", "err", "Warning", "info", None]
    assert apply(spark, levels, "string", A.ui_severity) == ["error", "error", "warn", "info", "error"]
    assert apply(spark, levels, "string", A.ui_level_class) == ["critical", "info", "warn", "info", "info"]
