"""Streaming jobs: broken records, failures, second runs of a batch, late rows."""

import datetime as dt
import json

from pyspark.sql import functions as F

from logtide.session import scratch_path
from logtide.sources import topics
from logtide.streaming import jobs

T0 = dt.datetime(2024, 1, 1)


def line(i, seconds, service="svc", **more):
    when = (T0 + dt.timedelta(seconds=seconds)).isoformat()
    return json.dumps({"log_id": f"l{i}", "service": service, "level": "info", "message": "m", "timestamp": when, **more})


def land(spark, path, lines):
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(path)


def run(job, spark, path, checkpoint):
    job.start(topics.read_json_lines(spark, path, per_trigger=1), checkpoint).awaitTermination()


def counted(spark, out):
    rows = spark.read.parquet(f"{out}/logs").select("log_id", "features.request_count_last_60s", "features.service_id_encoded")
    return {r[0]: (r[1], r[2]) for r in rows.collect()}


def test_process_over_batches(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    land(spark, path, [line(0, 0), line(1, 30), "{broken", line(2, 31, service=" "), "[]"])
    job = jobs.ProcessLogs(spark, out)
    run(job, spark, path, checkpoint)
    land(spark, path, [line(3, 60), line(4, 60, service="other"), line(5, 95)])
    run(jobs.ProcessLogs(spark, out), spark, path, checkpoint)
    assert counted(spark, out) == {"l0": (1, 1), "l1": (2, 1), "l3": (2, 1), "l4": (1, 2), "l5": (2, 1)}
    reasons = [r[0] for r in spark.read.parquet(f"{out}/quarantine").select("reason").collect()]
    assert sorted(reasons) == ["service", "undecodable", "undecodable"]
    again = spark.read.text(f"{out}/topic").select("value")
    assert jobs.processed_from_topic(again).filter("features.hour_of_day = 0").count() == 5


def test_second_run_of_a_batch(spark):
    """A batch that is tried again after a failure gives the same state and the same rows."""
    out = scratch_path(spark, "out")
    job = jobs.ProcessLogs(spark, out)
    batches = [[line(0, 0), line(1, 10)], [line(2, 20), line(3, 80)], [line(4, 85)]]
    frames = [spark.createDataFrame([(x,) for x in b], "value string") for b in batches]
    for i in (0, 1, 1, 2, 2):
        job.each(frames[i], i)
    assert counted(spark, out) == {"l0": (1, 1), "l1": (2, 1), "l2": (3, 1), "l3": (1, 1), "l4": (2, 1)}


def test_store_failure_does_not_stop_publish(spark):
    def broken(rows, batch_id):
        raise OSError("store is down")

    out = scratch_path(spark, "out")
    job = jobs.ProcessLogs(spark, out, store=broken)
    job.each(spark.createDataFrame([(line(0, 0),)], "value string"), 0)
    assert job.store_errors == [0]
    assert spark.read.text(f"{out}/topic").count() == 1


def alert_frame(spark, rows):
    df = spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s)) for i, s in rows], "alert_id string, detected_at timestamp")
    cols = {"service": "svc", "level": "ERROR", "message": "m", "host": "h", "log_id": "l"}
    return df.withColumns({k: F.lit(v) for k, v in cols.items()}).withColumns(
        {"anomaly_score": F.lit(-0.25), "error_code": F.lit(500), "response_time_ms": F.lit(1.0)}
    )


def test_dedup_state_and_late_alert(spark):
    out = scratch_path(spark, "out")
    job = jobs.HandleAlerts(spark, out, ttl_seconds=60, require_uuid=False)
    batches = [[("a", 0), ("b", 59)], [("c", 60), ("late", 5)], [("d", 119), ("e", 120)]]
    for i, rows in enumerate(batches):
        for _ in range(2):
            job.each(alert_frame(spark, rows), i)
    flagged = {r[0]: r[1] for r in spark.read.parquet(f"{out}/flagged").select("alert_id", "deduplicated").collect()}
    # the late alert falls into the suppression still open at its time
    assert flagged == {"a": False, "b": True, "c": False, "late": True, "d": True, "e": False}
    assert spark.read.parquet(f"{out}/outbox").count() == 2 * sum(not v for v in flagged.values())
    assert spark.read.parquet(f"{out}/changes").count() == 6


def test_late_rows_are_counted(spark):
    path, out, checkpoint = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    schema = "service string, event_time timestamp"

    def put(*seconds):
        rows = [("a", T0 + dt.timedelta(seconds=s)) for s in seconds]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)

    def go():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
        query = jobs.logs_per_minute(stream, out, checkpoint)
        query.awaitTermination()
        return query

    put(0, 10, 70)
    go()
    put(2000)
    go()
    put(5, 2005)
    query = go()
    assert jobs.late_rows(query) == 1
    found = {r["bucket"]: r["n"] for r in jobs.minutes_so_far(spark, out).collect()}
    # the last minute is still open and is there with its rows so far
    assert found == {T0: 2, T0 + dt.timedelta(seconds=60): 1, T0 + dt.timedelta(seconds=1980): 2}


def test_send_batch(spark):
    def fail(rows):
        raise OSError("no broker")

    rows = spark.range(7)
    path = scratch_path(spark, "sent")
    assert jobs.send_batch(rows, lambda r: r.write.parquet(path)) == (7, 0)
    assert jobs.send_batch(rows, fail) == (0, 7)


def test_records_of_a_batch_are_read_once(spark):
    """Quarantine and normalisation work on the parsed records, so that no text is read or parsed again for them."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = [line(0, 0), line(1, 30), "{broken", line(2, 31, service=" "), "[]", line(3, 60)]
    batch = spark.createDataFrame([(x,) for x in texts], "value string").mapInArrow(count, "value string")
    out = scratch_path(spark, "out")
    jobs.ProcessLogs(spark, out).each(batch, 0)
    assert seen.value == len(texts)
    bad = {(r["value"], r["reason"]) for r in spark.read.parquet(f"{out}/quarantine/batch_id=0").collect()}
    assert bad == {("{broken", "undecodable"), ("[]", "undecodable"), (texts[3], "service")}
