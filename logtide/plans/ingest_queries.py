"""Queries over raw records: reading, validation, normalisation, storage."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.functions import features as E
from logtide.functions import normalise as N
from logtide.functions.text import clean_text, strip
from logtide.operators import ingest, stats, validate
from logtide.operators.normalise import normalise_logs
from logtide.plans import inputs
from logtide.plans.common import at, stamp, stamped, the_end
from logtide.plans.registry import query
from logtide.plans.sqltext import AS_OF, END, LEVEL_SQL, LOGS, PROC, RAW, iso
from logtide.schemas import PROCESSED_LOG, conform
from logtide.session import scratch_path
from logtide.sources import collect, tables, topics

# ---------------------------------------------------------------- topics

BROKEN = "event_id % 71 = 0 OR event_id % 73 = 0"


@query(
    "read_raw_logs",
    f"""WITH {RAW} SELECT event_id, log_id, service, level, message, host, response_time_ms, error_code,
  timestamp AS time_text, CAST(epoch_seconds AS DOUBLE) AS epoch_seconds, ingested_at
  FROM raw WHERE NOT ({BROKEN})""",
)
def read_raw_logs(spark, sf_dir):
    good, _ = topics.quarantine_undecodable(topics.parse_raw_logs(inputs.raw_json(spark, sf_dir)))
    return good.withColumnRenamed("timestamp", "time_text").drop("metadata", "value")


@query(
    "quarantine_bad_json",
    f"""SELECT event_id, CASE WHEN event_id % 71 = 0 THEN '{{"service": "svc' ELSE '["not", "an object"]' END AS value
  FROM events WHERE {BROKEN}""",
)
def quarantine_bad_json(spark, sf_dir):
    _, bad = topics.quarantine_undecodable(topics.parse_raw_logs(inputs.raw_json(spark, sf_dir)))
    return bad.select("event_id", "value")


@query(
    "to_topic_records",
    f"""WITH {PROC} SELECT service AS key, 'processed-logs' AS topic,
  json_object('log_id', log_id, 'service', service, 'level', level, 'message', message, 'host', host,
    'error_code', error_code, 'event_time', {iso("event_time")} || '+00:00') AS value
  FROM proc""",
)
def to_topic_records(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select(
        "log_id", "service", "level", "message", "host", "error_code", "event_time"
    )
    return topics.to_topic_records(rows, topics.PROCESSED_TOPIC)


# ---------------------------------------------------------------- validation

LATENCY = "TRY_CAST(response_time_ms AS DOUBLE)"
CODE = "TRY_CAST(CASE WHEN regexp_full_match(trim(error_code), '[+-]?[0-9]+') THEN trim(error_code) END AS INTEGER)"
ERROR_LIST = f"""list_filter([
  CASE WHEN length(service) > 128 THEN 'service:too_long' END,
  CASE WHEN service IS NULL THEN 'service:missing' END,
  CASE WHEN trim(service) = '' THEN 'service:blank' END,
  CASE WHEN level IS NULL THEN 'level:missing' END,
  CASE WHEN upper(level) NOT IN ('DEBUG', 'INFO', 'WARN', 'WARNING', 'ERROR', 'CRITICAL', 'FATAL')
    THEN 'level:unknown' END,
  CASE WHEN length(message) > 4096 THEN 'message:too_long' END,
  CASE WHEN message IS NULL THEN 'message:missing' END,
  CASE WHEN trim(message) = '' THEN 'message:blank' END,
  CASE WHEN length(host) > 253 THEN 'host:too_long' END,
  CASE WHEN response_time_ms IS NOT NULL AND {LATENCY} IS NULL THEN 'response_time_ms:not_a_number' END,
  CASE WHEN {LATENCY} < 0 OR {LATENCY} > 300000 THEN 'response_time_ms:out_of_range' END,
  CASE WHEN error_code IS NOT NULL AND {CODE} IS NULL THEN 'error_code:not_a_number' END,
  CASE WHEN {CODE} < 0 OR {CODE} > 99999 THEN 'error_code:out_of_range' END,
  CASE WHEN event_id % 9 IN (2, 5, 6) THEN 'timestamp:not_iso' END
], lambda x: x IS NOT NULL)"""


def _error_text(col="errors"):
    return F.array_join(F.transform(col, lambda e: F.concat_ws(":", e["field"], e["rule"])), ",")


@query(
    "validate_logs",
    f"""WITH {RAW}, v AS (SELECT event_id, {ERROR_LIST} AS e FROM raw)
  SELECT event_id, len(e) = 0 AS accepted, array_to_string(e, ',') AS errors FROM v""",
)
def validate_logs(spark, sf_dir):
    checked = validate.validate_log_entries(inputs.raw_logs(spark, sf_dir))
    return checked.select("event_id", (F.size("errors") == 0).alias("accepted"), _error_text().alias("errors"))


@query(
    "accepted_logs",
    f"""WITH {RAW}, v AS (SELECT *, {ERROR_LIST} AS e FROM raw)
  SELECT event_id, lower(trim(service)) AS service, upper(level) AS level, trim(message) AS message
  FROM v WHERE len(e) = 0""",
)
def accepted_logs(spark, sf_dir):
    checked = validate.validate_log_entries(inputs.raw_logs(spark, sf_dir))
    return validate.accept_entries(checked).select("event_id", "service", "level", "message")


@query(
    "rejected_by_rule",
    f"""WITH {RAW}, v AS (SELECT unnest({ERROR_LIST}) AS e FROM raw)
  SELECT split_part(e, ':', 1) AS field, split_part(e, ':', 2) AS rule, count(*) AS n FROM v GROUP BY 1, 2""",
)
def rejected_by_rule(spark, sf_dir):
    checked = validate.validate_log_entries(inputs.raw_logs(spark, sf_dir))
    return (
        checked.select(F.explode("errors").alias("e"))
        .groupBy("e.field", "e.rule")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "batch_ingest_summary",
    f"""WITH {RAW}, b AS (SELECT CASE WHEN (event_id // 120) % 3 = 0 THEN 'big-' || (event_id // 120)
    ELSE 'req-' || (event_id // 40) END AS request_id, event_id, {ERROR_LIST} AS e FROM raw),
  p AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY event_id) - 1 AS pos,
    count(*) OVER (PARTITION BY request_id) AS size FROM b),
  q AS (SELECT *, CASE WHEN size NOT BETWEEN 1 AND 100 THEN 'batch_size' WHEN len(e) > 0
    THEN array_to_string(e, ',') END AS reason FROM p)
  SELECT request_id, max(size) BETWEEN 1 AND 100 AS batch_ok,
    CAST(count(*) FILTER (reason IS NULL) AS INTEGER) AS accepted,
    CAST(count(*) FILTER (reason IS NOT NULL) AS INTEGER) AS rejected,
    coalesce(string_agg(pos || '=' || reason, ';' ORDER BY pos) FILTER (reason IS NOT NULL), '') AS details,
    'Batch processed: ' || count(*) FILTER (reason IS NULL) || ' accepted, '
      || count(*) FILTER (reason IS NOT NULL) || ' rejected.' AS message
  FROM q GROUP BY request_id""",
)
def batch_ingest_summary(spark, sf_dir):
    raw = inputs.raw_logs(spark, sf_dir)
    entry = F.struct("event_id", *[c for c in raw.columns if c != "event_id"])
    # a request is 40 events in a row, or 120, which is more than a batch may have
    requests = (
        raw.groupBy(
            F.expr(
                "CASE WHEN (event_id DIV 120) % 3 = 0 THEN 'big-' || (event_id DIV 120)"
                " ELSE 'req-' || (event_id DIV 40) END"
            ).alias("request_id")
        )
        .agg(F.array_sort(F.collect_list(entry)).alias("logs"))
    )
    details = F.array_join(
        F.transform("rejected_details", lambda r: F.concat_ws("=", r["index"].cast("string"), r["reason"])), ";"
    )
    summary = ingest.batch_ingest_summary(requests)
    return summary.withColumn("details", details).drop("rejected_details")


@query(
    "malformed_logs",
    f"""WITH {RAW} SELECT event_id, CASE WHEN service IS NULL OR trim(service) = '' THEN 'service'
  WHEN message IS NULL THEN 'message_missing' ELSE 'message_empty' END AS reason
  FROM raw WHERE service IS NULL OR trim(service) = '' OR message IS NULL OR trim(message) = ''""",
)
def malformed_logs(spark, sf_dir):
    _, bad = validate.quarantine_malformed(inputs.raw_logs(spark, sf_dir))
    return bad.select("event_id", "reason")


# ---------------------------------------------------------------- normalisation


@query(
    "normalise_level",
    f"""WITH {RAW} SELECT event_id, level AS raw_level, {LEVEL_SQL} AS level FROM raw""",
)
def normalise_level(spark, sf_dir):
    return inputs.raw_logs(spark, sf_dir).select(
        "event_id", F.col("level").alias("raw_level"), N.normalise_level(F.col("level")).alias("level")
    )


TIME_SQL = f"""CASE event_id % 9
  WHEN 0 THEN date_trunc('second', ts) WHEN 1 THEN date_trunc('second', ts)
  WHEN 2 THEN date_trunc('second', ts) - INTERVAL 1 HOUR WHEN 3 THEN date_trunc('day', ts)
  WHEN 4 THEN date_trunc('second', ts) WHEN 7 THEN date_trunc('second', ts)
  WHEN 8 THEN date_trunc('second', ts) - INTERVAL 5 HOUR
  ELSE CASE WHEN event_id % 5 = 0 THEN TIMESTAMP '{AS_OF}' ELSE date_trunc('second', ts) END END"""


@query("normalise_timestamp", f"WITH {RAW} SELECT event_id, {iso(TIME_SQL)} AS event_time FROM raw")
def normalise_timestamp(spark, sf_dir):
    raw = inputs.raw_logs(spark, sf_dir)
    default = F.coalesce(N.parse_iso(F.col("ingested_at")), at())
    when = N.normalise_timestamp(strip(F.col("timestamp")), F.col("epoch_seconds"), default)
    return raw.select("event_id", when.alias("event_time")).select("event_id", stamp("event_time"))


@query(
    "safe_casts",
    f"""WITH {RAW} SELECT event_id, coalesce({LATENCY}, 0.0) AS latency, {CODE} AS code,
  left(nullif(trim(host), ''), 20) AS host FROM raw""",
)
def safe_casts(spark, sf_dir):
    return inputs.raw_logs(spark, sf_dir).select(
        "event_id",
        N.safe_double(F.col("response_time_ms"), 0.0).alias("latency"),
        N.safe_int(F.col("error_code")).alias("code"),
        clean_text(F.col("host"), 20).alias("host"),
    )


HEX = """sha256(concat_ws('|', event_id, coalesce(service, ''), coalesce(message, '')))"""
UUID_SQL = f"""left({HEX}, 8) || '-' || substr({HEX}, 9, 4) || '-' || substr({HEX}, 13, 4) || '-' ||
  substr({HEX}, 17, 4) || '-' || substr({HEX}, 21, 12)"""


@query(
    "normalise_logs",
    f"""WITH {RAW} SELECT event_id, coalesce(nullif(trim(log_id), ''), {UUID_SQL}) AS log_id,
  lower(trim(service)) AS service, {LEVEL_SQL} AS level, trim(message) AS message,
  left(nullif(trim(host), ''), 253) AS host, greatest(0.0, coalesce({LATENCY}, 0.0)) AS response_time_ms,
  CASE WHEN {CODE} >= 0 THEN {CODE} END AS error_code, {iso(TIME_SQL)} AS event_time
  FROM raw WHERE trim(service) <> '' AND trim(message) <> ''""",
)
def normalise_logs_query(spark, sf_dir):
    rows = normalise_logs(
        inputs.raw_logs(spark, sf_dir), as_of=at(), repeatable_ids=["event_id", "service", "message"]
    )
    return stamped(rows, "event_time").drop("ingested_at", "processed_at", "metadata")


@query(
    "assign_log_ids",
    f"""WITH {RAW} SELECT event_id, coalesce(nullif(trim(log_id), ''), {UUID_SQL}) AS log_id FROM raw""",
)
def assign_log_ids(spark, sf_dir):
    rows = ingest.assign_log_ids(inputs.raw_logs(spark, sf_dir), ["event_id", "service", "message"])
    return rows.select("event_id", "log_id")


STAMPED = """left({h}, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' ||
  substr({h}, 21, 12)""".format(h="sha256(event_id::VARCHAR)")


@query(
    "stamp_ingest",
    f"""SELECT event_id, CASE WHEN event_id % 11 = 0 THEN {STAMPED} ELSE 'log-' || event_id END AS log_id,
  '{END.replace(" ", "T")}.000000' AS ingested_at,
  CASE WHEN event_id % 9 = 5 THEN '{END.replace(" ", "T")}.000000' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END AS event_time
  FROM events""",
)
def stamp_ingest(spark, sf_dir):
    """Entries as the server stores them: ids and times filled in where the client sent none."""
    rows = inputs.logs(spark, sf_dir).withColumns(
        {
            "log_id": F.when(F.col("event_id") % 11 != 0, F.col("log_id")).otherwise("  "),
            "event_time": F.when(F.col("event_id") % 9 != 5, F.col("timestamp")),
        }
    )
    stamped_rows = ingest.stamp_ingest(rows, the_end(), ["event_id"])
    return stamped(stamped_rows.select("event_id", "log_id", "ingested_at", "event_time"), "ingested_at", "event_time")


# ---------------------------------------------------------------- scalar features


@query("feature_hour", f"WITH {PROC} SELECT event_id, CAST(hour(event_time) AS INTEGER) AS hour_of_day FROM proc")
def feature_hour(spark, sf_dir):
    return inputs.processed(spark, sf_dir).select("event_id", F.hour("event_time").alias("hour_of_day"))


@query(
    "feature_hour_source",
    f"""WITH {RAW} SELECT event_id, CAST(CASE WHEN event_id % 9 IN (0, 1, 8) THEN hour(ts) ELSE hour({TIME_SQL}) END
  AS INTEGER) AS hour_of_day FROM raw""",
)
def feature_hour_source(spark, sf_dir):
    raw = inputs.raw_logs(spark, sf_dir)
    default = F.coalesce(N.parse_iso(F.col("ingested_at")), at())
    when = N.normalise_timestamp(strip(F.col("timestamp")), F.col("epoch_seconds"), default)
    hour = N.source_hour(F.col("timestamp"), F.col("event_time"))
    return raw.withColumn("event_time", when).select("event_id", hour.alias("hour_of_day"))


BUCKET_SQL = """CASE WHEN error_code IS NULL OR error_code = 0 THEN 0 WHEN error_code BETWEEN 200 AND 299 THEN 1
  WHEN error_code BETWEEN 300 AND 399 THEN 2 WHEN error_code BETWEEN 400 AND 499 THEN 3
  WHEN error_code BETWEEN 500 AND 599 THEN 4 {more} ELSE 5 END"""


@query(
    "feature_error_bucket",
    f"WITH {LOGS} SELECT event_id, {BUCKET_SQL.format(more='')} AS bucket FROM logs",
)
def feature_error_bucket(spark, sf_dir):
    return inputs.logs(spark, sf_dir).select("event_id", E.encode_error_code(F.col("error_code")).alias("bucket"))


@query(
    "feature_error_bucket_eval",
    f"""WITH {LOGS}, small AS (SELECT event_id, CAST(user_id % 8 AS INTEGER) AS error_code FROM logs)
  SELECT event_id, {BUCKET_SQL.format(more='WHEN error_code BETWEEN 1 AND 5 THEN error_code')} AS bucket FROM small""",
)
def feature_error_bucket_eval(spark, sf_dir):
    code = (F.col("user_id") % 8).cast("int")
    return inputs.logs(spark, sf_dir).select("event_id", E.encode_error_code(code, keep_buckets=True).alias("bucket"))


@query(
    "feature_level",
    f"""WITH {LOGS} SELECT event_id, CASE upper(trim(level)) WHEN 'DEBUG' THEN 0 WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2
  WHEN 'WARNING' THEN 2 WHEN 'ERROR' THEN 3 WHEN 'CRITICAL' THEN 4 WHEN 'FATAL' THEN 4 ELSE 1 END AS code FROM logs""",
)
def feature_level(spark, sf_dir):
    return inputs.logs(spark, sf_dir).select("event_id", E.encode_level(F.col("level")).alias("code"))


@query(
    "feature_service_hash",
    f"""WITH {LOGS} SELECT event_id, CAST(CAST('0x' || left(sha256(service), 8) AS BIGINT) % 10000 AS INTEGER) AS id
  FROM logs""",
)
def feature_service_hash(spark, sf_dir):
    return inputs.logs(spark, sf_dir).select("event_id", E.hash_service(F.col("service")).alias("id"))


@query(
    "feature_service_charsum",
    f"""WITH {LOGS} SELECT event_id, CAST(list_sum(list_transform(string_split(host, ''), lambda c: ascii(c))) % 10
  AS INTEGER) AS id FROM logs""",
)
def feature_service_charsum(spark, sf_dir):
    return inputs.logs(spark, sf_dir).select("event_id", E.charsum_service(F.col("host")).alias("id"))


@query(
    "feature_service_eval",
    """WITH named AS (SELECT event_id, CASE user_id % 7 WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service'
    WHEN 2 THEN 'user-service' WHEN 3 THEN 'order-service' WHEN 4 THEN 'api-gateway' ELSE 'other' END AS service
  FROM events)
  SELECT event_id, CASE service WHEN 'auth-service' THEN 0 WHEN 'payment-service' THEN 1 WHEN 'user-service' THEN 2
    WHEN 'order-service' THEN 3 WHEN 'api-gateway' THEN 4 ELSE 5 END AS id FROM named""",
)
def feature_service_eval(spark, sf_dir):
    named = inputs.events(spark, sf_dir).selectExpr(
        "event_id",
        """CASE user_id % 7 WHEN 0 THEN 'auth-service' WHEN 1 THEN 'payment-service' WHEN 2 THEN 'user-service'
        WHEN 3 THEN 'order-service' WHEN 4 THEN 'api-gateway' ELSE 'other' END AS service""",
    )
    return named.select("event_id", E.encode_eval_service(F.col("service")).alias("id"))


@query(
    "metadata_fields",
    """SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k,
  json_extract_string(props, '$.trace_id') AS trace_id FROM events""",
)
def metadata_fields(spark, sf_dir):
    v = F.try_parse_json("metadata")
    return inputs.logs(spark, sf_dir).select(
        "event_id",
        F.try_variant_get(v, "$.k", "int").alias("k"),
        F.try_variant_get(v, "$.trace_id", "string").alias("trace_id"),
    )


# ---------------------------------------------------------------- collector

CONTAINER = """SELECT event_id, 'svc-' || (user_id % 10) || '-' || event_id || '-x' AS container_name,
  event_type, user_id FROM events"""


def _container_lines(spark, sf_dir):
    rows = inputs.events(spark, sf_dir)
    name = F.concat(F.lit("svc-"), F.col("user_id") % 10, F.lit("-"), "event_id", F.lit("-x"))
    nested = F.to_json(F.struct(F.col("event_type").alias("message"), F.lit("ERROR").alias("level")))
    log = F.when(F.col("event_id") % 2 == 0, nested).otherwise(F.concat(F.lit("plain "), "event_type"))
    level = F.when(F.col("event_id") % 3 == 0, "warn")
    line = F.to_json(F.struct(log.alias("log"), F.lit("stdout").alias("stream"), level.alias("severity")))
    # other programs write records of their own, without a log member
    own = F.to_json(
        F.struct(
            F.col("event_type").alias("message"),
            F.lit("error").alias("level"),
            F.concat(F.lit("t-"), "event_id").alias("trace_id"),
            F.struct(F.col("user_id").alias("user")).alias("metadata"),
        )
    )
    value = F.when(F.col("event_id") % 101 == 0, "not json").when(F.col("event_id") % 7 == 3, own).otherwise(line)
    return rows.select("event_id", value.alias("value"), name.alias("container_name"))


@query(
    "collect_container_logs",
    f"""WITH c AS ({CONTAINER})
  SELECT 'docker' AS source, container_name, 'svc-' || (user_id % 10) AS service,
    CASE WHEN event_id % 7 = 3 THEN 'error' WHEN event_id % 2 = 0 THEN 'ERROR'
      WHEN event_id % 3 = 0 THEN 'warn' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 7 = 3 OR event_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS message,
    CASE WHEN event_id % 7 = 3 THEN 't-' || event_id END AS trace_id,
    CASE WHEN event_id % 7 = 3 THEN '{{"user":' || user_id || '}}' END AS metadata
  FROM c WHERE event_id % 101 <> 0""",
)
def collect_container_logs(spark, sf_dir):
    rows = collect.collect_container_logs(_container_lines(spark, sf_dir), the_end())
    more = [F.try_element_at("members", F.lit(m)).alias(m) for m in ("trace_id", "metadata")]
    return rows.select("source", "container_name", "service", "level", "message", *more)


@query(
    "collect_typed_logs",
    """SELECT event_id, 'svc-' || (user_id % 10) AS service, event_type AS message, value * 20 AS response_time_ms,
    CASE WHEN event_id % 2 = 0 THEN CAST(user_id AS INTEGER) END AS error_code,
    CASE WHEN event_id % 3 = 0 THEN 'OBJECT<k: BIGINT, on: BOOLEAN>' ELSE 'ARRAY<BIGINT>' END AS kind,
    CASE WHEN event_id % 3 = 0 THEN event_id ELSE user_id END AS inside
    FROM events""",
)
def collect_typed_logs(spark, sf_dir):
    """Numbers, objects and arrays of nested records, read back with their types."""
    rows = inputs.events(spark, sf_dir)
    nested = F.to_json(F.struct(
        F.col("event_type").alias("message"), (F.col("value") * 20).alias("response_time_ms"),
        F.when(F.col("event_id") % 2 == 0, F.col("user_id")).alias("error_code"),
        F.when(F.col("event_id") % 3 == 0, F.struct(F.col("event_id").alias("k"), F.lit(True).alias("on"))).alias("object"),
        F.when(F.col("event_id") % 3 != 0, F.array("user_id", F.lit(7).cast("long"))).alias("array"),
    ))
    line = F.to_json(F.struct(nested.alias("log"), F.lit("outer").alias("message"), F.col("event_id").alias("event_id")))
    name = F.concat(F.lit("svc-"), F.col("user_id") % 10, F.lit("-x"))
    found = collect.collect_typed_logs(rows.select(line.alias("value"), name.alias("container_name")), the_end())
    member = lambda n, p, k: collect.value_of("values", n, k, p)
    whole = F.coalesce(F.try_element_at("values", F.lit("object")), F.try_element_at("values", F.lit("array")))
    return found.select(
        member("event_id", "$", "long").alias("event_id"), "service", "message", "response_time_ms", "error_code",
        F.schema_of_variant(whole).alias("kind"),
        F.coalesce(member("object", "$.k", "long"), member("array", "$[0]", "long")).alias("inside"),
    )


@query(
    "collect_quarantine",
    """SELECT event_id, 'not json' AS value, 'no JSON object' AS reason FROM events WHERE event_id % 101 = 0
  UNION ALL SELECT event_id, 'no syslog', 'no syslog line' FROM events WHERE event_id % 103 = 0""",
)
def collect_quarantine(spark, sf_dir):
    """Lines that no collector can read."""
    container = collect.split_container_lines(_container_lines(spark, sf_dir))[1].drop("container_name")
    return container.unionByName(collect.split_syslog_lines(_syslog_lines(spark, sf_dir))[1])


@query(
    "parse_nested_json",
    f"""WITH c AS ({CONTAINER})
  SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'ERROR' END AS level,
    CASE WHEN event_id % 2 = 0 THEN event_type ELSE 'plain ' || event_type END AS message
  FROM c WHERE event_id % 101 <> 0 AND event_id % 7 <> 3""",
)
def parse_nested_json(spark, sf_dir):
    lines = _container_lines(spark, sf_dir).withColumn("log", F.get_json_object("value", "$.log"))
    rows = collect.parse_nested_json(lines.filter(F.col("log").isNotNull()))
    return rows.select("event_id", "level", "message")


@query(
    "service_from_container",
    f"""WITH c AS ({CONTAINER}) SELECT container_name, 'svc-' || (user_id % 10) AS service FROM c""",
)
def service_from_container(spark, sf_dir):
    return _container_lines(spark, sf_dir).select(
        "container_name", collect.service_from_container(F.col("container_name")).alias("service")
    )


def _syslog_lines(spark, sf_dir):
    when = F.date_format("ts", "MMM d HH:mm:ss")
    pri = F.concat(F.lit("<"), F.col("user_id") % 192, F.lit(">"))
    tag = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("sshd["), "event_id", F.lit("]"))).otherwise("cron")
    host = F.concat(F.lit(" host-"), F.col("user_id") % 5, F.lit(" "))
    line = F.concat(pri, when, host, tag, F.lit(": "), "event_type")
    value = F.when(F.col("event_id") % 103 == 0, "no syslog").otherwise(line)
    return inputs.events(spark, sf_dir).select("event_id", value.alias("value"))


@query(
    "collect_syslog",
    f"""SELECT 'syslog' AS source, CAST((user_id % 192) // 8 AS INTEGER) AS facility,
  ['emerg', 'alert', 'crit', 'err', 'warn', 'notice', 'info', 'debug'][(user_id % 192) % 8 + 1] AS level,
  {iso("date_trunc('second', ts)")} AS event_time, 'host-' || (user_id % 5) AS host,
  CASE WHEN event_id % 2 = 0 THEN 'sshd' ELSE 'cron' END AS service,
  CAST(CASE WHEN event_id % 2 = 0 THEN event_id END AS INTEGER) AS pid, event_type AS message
  FROM events WHERE event_id % 103 <> 0""",
)
def collect_syslog(spark, sf_dir):
    rows = collect.collect_syslog(_syslog_lines(spark, sf_dir), F.lit(2024), the_end())
    return stamped(rows, "event_time").drop("collected_at", "severity")


@query(
    "collect_all",
    """SELECT 'docker' AS source, count(*) AS n FROM events WHERE event_id % 101 <> 0
  UNION ALL SELECT 'syslog', count(*) FROM events WHERE event_id % 103 <> 0
  UNION ALL SELECT 'http', count(*) FROM events""",
)
def collect_all(spark, sf_dir):
    merged = collect.collect_all(
        collect.collect_container_logs(_container_lines(spark, sf_dir), the_end()),
        collect.collect_syslog(_syslog_lines(spark, sf_dir), F.lit(2024), the_end()),
        collect.collect_pushed(inputs.raw_logs(spark, sf_dir).drop("timestamp")),
    )
    return merged.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- storage


@query(
    "index_logs_daily",
    f"""WITH {PROC}, copies AS (
    SELECT log_id, service, level, message, event_time, 1 AS version FROM proc
    UNION ALL SELECT log_id, service, 'DEBUG', message, event_time, 0 FROM proc WHERE user_id % 2 = 0)
  SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS log_date, 'logs-' || strftime(event_time, '%Y.%m.%d') AS index,
    log_id, level FROM copies QUALIFY row_number() OVER (
      PARTITION BY CAST(event_time AS DATE), log_id ORDER BY version DESC) = 1""",
)
def index_logs_daily(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir)
    older = rows.filter("user_id % 2 = 0").withColumns(
        {"level": F.lit("DEBUG"), "processed_at": F.col("processed_at") - F.expr("INTERVAL 1 MINUTE")}
    )
    daily = tables.index_logs_daily(rows.unionByName(older))
    return daily.select(
        F.col("log_date").cast("string").alias("log_date"),
        tables.index_name(F.col("event_time")).alias("index"),
        "log_id",
        "level",
    )


@query(
    "write_read_daily",
    f"""WITH {PROC} SELECT CAST(CAST(event_time AS DATE) AS VARCHAR) AS log_date, count(*) AS n,
  count(DISTINCT log_id) AS ids FROM proc WHERE event_time >= TIMESTAMP '2024-01-20 06:00:00' GROUP BY 1""",
)
def write_read_daily(spark, sf_dir):
    path = scratch_path(spark, "daily")
    tables.write_daily(inputs.processed(spark, sf_dir).drop("user_id", "k", "event_type"), path)
    from logtide.operators.search import search_logs

    found = search_logs(spark.read.parquet(path), start="2024-01-20T06:00:00Z")
    return found.groupBy(F.col("log_date").cast("string").alias("log_date")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("log_id").alias("ids")
    )


@query(
    "conform_schema",
    f"""WITH {RAW} SELECT event_id, TRY_CAST(response_time_ms AS FLOAT) AS response_time_ms,
  CASE WHEN length(message) <= 512 THEN message END AS message_keyword FROM raw""",
)
def conform_schema(spark, sf_dir):
    raw = inputs.raw_logs(spark, sf_dir).withColumn("log_id", F.col("event_id").cast("string"))
    rows = conform(raw, PROCESSED_LOG, text_key_limit=512)
    return rows.select(
        F.col("log_id").cast("bigint").alias("event_id"),
        F.col("response_time_ms").cast("float").alias("response_time_ms"),
        "message_keyword",
    )


@query(
    "export_ndjson",
    f"""WITH {PROC} SELECT log_id, service, level, message FROM proc WHERE contains(lower(message), 'error by')""",
)
def export_ndjson(spark, sf_dir):
    from logtide.operators.search import filter_logs

    found = filter_logs(inputs.processed(spark, sf_dir), "Error BY ").select("log_id", "service", "level", "message")
    path = scratch_path(spark, "ndjson")
    tables.export_ndjson(found, path)
    return spark.read.schema(found.schema).json(path)


@query(
    "retain_recent",
    f"""WITH {PROC} SELECT log_id, {iso("event_time")} AS event_time FROM proc
  WHERE event_time >= TIMESTAMP '{END}' - INTERVAL 7 DAY""",
)
def retain_recent(spark, sf_dir):
    kept = stats.retain_recent(inputs.processed(spark, sf_dir), the_end(), 7 * 86_400)
    return kept.select("log_id", stamp("event_time"))


@query("level_spellings", f"WITH {LOGS} SELECT level AS raw, {LEVEL_SQL} AS level, count(*) AS n FROM logs GROUP BY 1, 2")
def level_spellings(spark, sf_dir):
    rows = inputs.logs(spark, sf_dir)
    return rows.groupBy(F.col("level").alias("raw"), N.normalise_level(F.col("level")).alias("level")).agg(
        F.count(F.lit(1)).alias("n")
    )
