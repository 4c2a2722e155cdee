"""Cases that earlier lost rows or gave wrong values."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from logtide.operators import alerts, dedup, features, iforest, scaler, search, validate
from logtide.plans import stream_queries
from logtide.session import scratch_path
from logtide.sources import collect, tables, topics
from logtide.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def test_stream_parts_hold_every_row(spark):
    times = [None, dt.datetime(1999, 1, 1), T0, dt.datetime(2024, 1, 11), dt.datetime(2024, 1, 21), dt.datetime(2031, 5, 5)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "i int, t timestamp")
    parts = [sorted(r["i"] for r in p.collect()) for p in stream_queries.in_parts(rows, "t")]
    assert parts == [[1, 2], [3], [0, 4, 5]]


def test_trees_draw_from_all_rows(spark):
    rows = spark.range(60_000).select("id", F.col("id").cast("double").alias("x"))
    picked = iforest.tree_samples(rows, ["x"], "id", 200, 256, 60_000, 7)
    assert picked.count() == 200 * 256
    assert picked.select("x").distinct().count() > 30_000


def test_training_scores_are_used_again(spark):
    rows = spark.range(2_000).select("id", (F.rand(3) * 9).alias("x"), F.rand(4).alias("y"))
    model = iforest.fit_iforest(rows, "id", columns=["x", "y"], struct=None, trees=20)
    columns = ["id", "anomaly_score", "prediction", "is_anomaly"]
    again = iforest.score_training_rows(rows, model, "id").select(columns)
    assert sorted(again.collect()) == sorted(iforest.score(rows, model, struct=None).select(columns).collect())
    model.release()
    assert model.arrays is None


def test_forest_size_is_an_argument(spark):
    rows = spark.range(100).select("id", F.col("id").cast("double").alias("x"))
    model = iforest.fit_iforest(rows, "id", columns=["x"], struct=None, trees=3)
    model.release()
    with pytest.raises(ValueError, match="max_nodes"):
        iforest.raw_score(model, [F.col("x")], max_nodes=2)


def test_container_lines_without_log_are_kept(spark):
    values = [
        '{"message":"boom","level":"error"}',
        '{"log":"{\\"message\\":\\"in\\",\\"trace_id\\":\\"t\\",\\"n\\":{\\"a\\":1}}","trace_id":"outer","host":"h"}',
        "plain",
        "[1]",
        "7",
        None,
        "{}",
    ]
    lines = spark.createDataFrame([(v, "svc-a-1") for v in values], "value string, container_name string")
    rows = collect.collect_container_logs(lines, F.lit(T0)).collect()
    assert sorted((r["message"] or "", r["level"]) for r in rows) == [("", "INFO"), ("boom", "error"), ("in", "INFO")]
    inner = next(r for r in rows if r["message"] == "in")
    assert inner["members"]["trace_id"] == "t" and json.loads(inner["members"]["n"]) == {"a": 1} and inner["host"] == "h"
    _, bad = collect.split_container_lines(lines)
    assert sorted(str(r["value"]) for r in bad.collect()) == ["7", "None", "[1]", "plain"]
    _, bad = collect.split_syslog_lines(lines)
    assert bad.count() == len(values)


def run_logs(spark, job, checkpoint, landed, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").write.mode("append").text(landed)
    job.start(topics.read_json_lines(spark, landed), checkpoint).awaitTermination()


def line(second, **more):
    at = (T0 + dt.timedelta(seconds=second)).isoformat() + "Z"
    return json.dumps({"service": "a", "level": "INFO", "message": "m", "timestamp": at} | more)


def test_equal_lines_and_a_future_date(spark):
    out, checkpoint, landed = (scratch_path(spark, n) for n in ("out", "cp", "landed"))
    job = jobs.ProcessLogs(spark, out)
    run_logs(spark, job, checkpoint, landed, [line(1), line(1), line(1), line(0, timestamp="2931-01-01T00:00:00Z")])
    run_logs(spark, job, checkpoint, landed, [line(10)])
    rows = spark.read.parquet(f"{out}/logs")
    assert rows.count() == 5 and rows.select("log_id").distinct().count() == 5
    last = rows.where("second(event_time) = 10").first()
    assert last["features"]["request_count_last_60s"] == 4  # the counts carried over did not end in 2931


def test_a_failed_store_is_made_good(spark):
    out, checkpoint, landed = (scratch_path(spark, n) for n in ("out", "cp", "landed"))
    broken = [True]

    def store(rows, batch_id):
        if broken[0]:
            raise OSError("store is down")
        jobs.put(rows, f"{out}/logs", batch_id)

    job = jobs.ProcessLogs(spark, out, store=store)
    assert job.store_again() == []
    run_logs(spark, job, checkpoint, landed, [line(1), line(2)])
    assert job.store_errors == [0]
    broken[0] = False
    later = jobs.ProcessLogs(spark, out, store=store)  # another driver
    assert later.store_again() == [0] and later.store_again() == []
    assert spark.read.parquet(f"{out}/logs").count() == 2


def test_batch_time_is_taken_once(spark):
    path = scratch_path(spark, "times")
    first, again, other = (spark.range(1).select(jobs.batch_time(spark, path, b)).first()[0] for b in (3, 3, 4))
    assert first == again < other


def test_a_future_alert_ends_no_suppression(spark):
    rows = [("k", T0, False), ("x", dt.datetime(2931, 1, 1), False)]
    flagged = spark.createDataFrame(rows, "dedup_key string, detected_at timestamp, deduplicated boolean")
    now = F.lit(T0 + dt.timedelta(days=1))
    kept = dedup.open_suppressions(flagged, 60, now=now).collect()
    assert {r["dedup_key"] for r in kept} == {"k", "x"}


def test_alert_texts_without_values(spark):
    schema = "alert_id string, service string, level string, message string, anomaly_score double, response_time_ms double, error_code int, host string, detected_at timestamp"
    rows = [("a", None, None, None, -0.0005, None, None, None, T0), ("b", "s", "ERROR", "m", None, 1.0, 5, "h", T0)]
    found = alerts.notification_outbox(spark.createDataFrame(rows, schema), ["slack", "email"]).collect()
    assert all(r["title"] and r["body"] for r in found)
    by = {(r["alert_id"], r["channel"]): r for r in found}
    assert "`unknown`" in by["a", "slack"]["title"]
    fields = {f["title"]: f["value"] for f in json.loads(by["a", "slack"]["body"])["attachments"][0]["fields"]}
    assert fields["Anomaly Score"] == "-0.0005" and fields["Level"] == "UNKNOWN"
    assert "Anomaly Score: 0.0" in by["b", "email"]["body"]


def test_missing_values_sort_last(spark):
    rows = [(i, v) for i, v in enumerate([None, 3, 1, None, 2, 1])]
    df = spark.createDataFrame(rows, "log_id int, v int")
    for down, want in ((False, [2, 5, 4, 1, 0, 3]), (True, [1, 4, 2, 5, 0, 3])):
        page = search.page_of(df, size=6, sort="v", descending=down)
        assert [r["log_id"] for r in page.collect()] == want
        seen, last = [], None
        while part := search.page_after(df, last, 2, "v", descending=down).collect():
            seen += [r["log_id"] for r in part]
            last = (part[-1]["v"], part[-1]["log_id"])
        assert seen == want


def test_newest_version_counts(spark):
    rows = spark.range(50).select("id", F.col("id").cast("double").alias("x"))
    model = iforest.fit_iforest(rows, "id", columns=["x"], struct=None, trees=2)
    root = scratch_path(spark, "models")
    for v in ("v9", "v10", "v2"):
        tables.save_model(model, root, v)
    assert tables.newest_version(spark, root) == "v10"


def test_no_shuffle_by_label_or_service(spark):
    rows = spark.range(500).select(
        "id", (F.col("id") % 2).alias("y"), F.concat(F.lit("s"), F.col("id") % 5).alias("service")
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        split = scaler.stratified_split(rows, "y", "id")
        labels = spark.createDataFrame([(f"s{i}", i) for i in range(4)], "service string, service_id int")
        named = features.encode_services(rows, labels)
        for df in (split, named):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" not in plan and "hashpartitioning(service" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert split.groupBy("y").agg(F.sum(F.col("is_test").cast("int"))).collect() is not None


def test_iso_forms(spark):
    from datetime import datetime, timezone

    from logtide.functions import normalise

    texts = [
        "20240115", "20240115T032214Z", "20240115T0322", "2024-W03-1", "2024W031", "2024-W03", "2024W03", "2020-W53-7",
        "2024-01-15x03", "2024-01-15T0322", "20240115 03:22:14.5+0530", "2024-01-15T03:22:14,123456789-05", "20240115T24",
        "2024-W54-1", "2021-W53-1", "2024-W03-8", "20241315", "2024-1-5", "2024-01-15T", "20240115T032", "2024-01-15T03:22:14.512Z",
        "2024-01-15", "0001-W01-1", "2024-02-30", "x", "", "2024-01-15T03:22:14+01:30",
    ]

    def want(text):
        try:
            at = datetime.fromisoformat(text.replace("Z", "+00:00"))
        except ValueError:
            return None
        return at.replace(tzinfo=at.tzinfo or timezone.utc).timestamp()

    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = rows.select("t", F.unix_micros(normalise.parse_iso(F.col("t"))).alias("us")).collect()
    got = {r["t"]: None if r["us"] is None else r["us"] / 1e6 for r in found}
    assert got == {t: want(t) for t in texts}


def test_words_as_an_index_breaks_them(spark):
    from logtide.functions.text import tokens

    rows = spark.createDataFrame(
        [("Can't reach user_id 3.14 at 10.0.0.5, e.g. port 1,000; a.b:c (x-y) — it’s \u00e9t\u00e9. 5.", 1), (None, 2), (" .. ", 3)],
        "t string, i int",
    )
    found = [r[0] for r in rows.orderBy("i").select(tokens(F.col("t"))).collect()]
    assert found[0] == [
        "can't", "reach", "user_id", "3.14", "at", "10.0.0.5", "e.g", "port", "1,000", "a.b:c", "x", "y", "it’s", "été", "5",
    ]
    assert found[1:] == [None, []]


def test_days_are_balanced(spark, tmp_path):
    rows = spark.range(3_000).select(
        F.concat(F.lit("l"), "id").alias("log_id"),
        F.timestamp_seconds(F.lit(1_704_067_200) + (F.col("id") % 5) * 86_400).alias("event_time"),
        F.lit("m").alias("message"),
        F.current_timestamp().alias("processed_at"),
    )
    path = str(tmp_path / "logs")
    tables.write_daily(rows.repartition(16), path)
    assert spark.read.parquet(path).count() == 3_000
    files = list((tmp_path / "logs").glob("log_date=*/*.parquet"))
    assert len(files) <= 10


def test_topic_publisher_options():
    options = topics.topic_options("h:1", "t")
    assert options["topic"] == "t" and options["kafka.acks"] == "all"


def test_parts_compute_the_rows_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    rows = spark.sql("SELECT id AS i, TIMESTAMP '2024-01-01' + make_dt_interval(id) AS t FROM range(31)")
    parts = stream_queries.in_parts(rows.mapInArrow(count, "i bigint, t timestamp"), "t")
    assert sorted(r["i"] for p in parts for r in p.collect()) == list(range(31))
    assert seen.value == 31


def test_usable_records_work_out_a_field_once(spark):
    """The filter, moved below what makes a field, has it once; usable and unusable records are still all records."""
    texts = [None, "{}", '{"s": "a"}', '{"s": " ", "m": "x"}', '{"s": "a", "m": "\\u00a0"}', '{"s": "a", "m": "x"}']
    raw = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").repartition(2)
    rows = raw.selectExpr("i", "get_json_object(t, '$.s') AS service", "get_json_object(t, '$.m') AS message")
    usable, bad = validate.quarantine_malformed(rows)
    plan = usable._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("get_json_object") == 4  # each field once for its column and once in the filter
    assert [r["i"] for r in usable.collect()] == [5]
    reasons = {r["i"]: r["reason"] for r in bad.collect()}
    assert reasons == {0: "service", 1: "service", 2: "message_missing", 3: "service", 4: "message_empty"}
