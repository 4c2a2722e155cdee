"""Queries behind the dashboard: search, listings, counts, rates, shares."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.operators import search, stats
from logtide.plans import inputs
from logtide.plans.common import at, stamp, stamped
from logtide.plans.registry import query
from logtide.plans.sqltext import ALERTS, AS_OF, HISTORY, KEYED, LOGS, PROC, SCORED, flagged, iso

LOG_COLUMNS = ["log_id", "service", "level", "message", "event_time"]
LOG_SQL = f"log_id, service, level, message, {iso('event_time')} AS event_time"

# ---------------------------------------------------------------- search


@query(
    "search_logs",
    f"""WITH {PROC} SELECT {LOG_SQL} FROM proc WHERE level = 'ERROR' AND service = 'svc-3'
  AND event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'""",
)
def search_logs(spark, sf_dir):
    found = search.search_logs(
        inputs.processed(spark, sf_dir), "error", "SVC-3", "2024-01-05T00:00:00Z", "2024-01-20T00:00:00Z"
    )
    return stamped(found.select(*LOG_COLUMNS), "event_time")


@query(
    "search_logs_page",
    f"""WITH {PROC}, found AS (SELECT * FROM proc WHERE level = 'ERROR'
    AND event_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25')
  SELECT {LOG_SQL}, (SELECT count(*) FROM found) AS total FROM
    (SELECT * FROM found ORDER BY event_time DESC, log_id LIMIT 20 OFFSET 40)""",
)
def search_logs_page(spark, sf_dir):
    found = search.search_logs(
        inputs.processed(spark, sf_dir), "ERROR", start="2024-01-05T00:00:00Z", end="2024-01-25T00:00:00Z"
    ).select(*LOG_COLUMNS)
    return stamped(search.page_of(found, page=3, size=20, with_total=True), "event_time")


@query(
    "search_sort_latency",
    f"""WITH {PROC} SELECT log_id, response_time_ms FROM proc ORDER BY response_time_ms, log_id LIMIT 100 OFFSET 100""",
)
def search_sort_latency(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir).select("log_id", "response_time_ms")
    return search.page_of(rows, page=2, size=100, sort="response_time_ms", descending=False)


@query(
    "search_logs_text",
    f"""WITH {PROC} SELECT log_id, message FROM proc WHERE list_has_any(
    list_filter(regexp_split_to_array(lower(message), '[^a-z0-9]+'), lambda w: w <> ''), ['purchase', '42'])""",
)
def search_logs_text(spark, sf_dir):
    return search.search_logs(inputs.processed(spark, sf_dir), q="Purchase! 42").select("log_id", "message")


@query(
    "search_documents_text",
    r"""SELECT doc_id, lang FROM documents WHERE list_has_any(
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''),
    ['license', 'password', 'threa', 'queaux'])""",
)
def search_documents_text(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return docs.filter(search.matches_text(F.col("text"), "license, PASSWORD threa queaux")).select("doc_id", "lang")


@query(
    "search_conversations_text",
    r"""SELECT conv_id, turn FROM conversations WHERE role = 'user' AND list_has_any(
    list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda w: w <> ''), ['dans', 'the', 'und'])""",
)
def search_conversations_text(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    found = turns.filter(search.matches_text(F.col("text"), "dans the und") & (F.col("role") == "user"))
    return found.select("conv_id", "turn")


@query(
    "filter_logs_substring",
    f"""WITH {SCORED} SELECT log_id, message FROM scored WHERE is_anomaly AND service = 'svc-1'
  AND contains(lower(service || ' ' || level || ' ' || message), 'error error by')""",
)
def filter_logs_substring(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn("anomaly", F.col("is_anomaly"))
    return search.filter_logs(rows, "  ERROR error by", "svc-1", only_anomalies=True).select("log_id", "message")


@query(
    "filter_console_lines",
    f"""WITH {PROC} SELECT log_id FROM proc WHERE contains(lower(level || ' ' || service || ' ' || message), 'warn svc-4')""",
)
def filter_console_lines(spark, sf_dir):
    rows = inputs.processed(spark, sf_dir)
    return search.filter_logs(rows, "Warn SVC-4", order=("level", "service", "message")).select("log_id")


@query(
    "flag_anomalous_logs",
    f"""WITH {ALERTS} SELECT log_id, service, level,
  level = 'CRITICAL' OR log_id IN (SELECT log_id FROM alerts) AS anomaly FROM proc""",
)
def flag_anomalous_logs(spark, sf_dir):
    logs = inputs.processed(spark, sf_dir).select("log_id", "service", "level")
    return search.flag_anomalous_logs(logs, inputs.alerts(spark, sf_dir))


@query(
    "latest_logs",
    f"WITH {PROC} SELECT {LOG_SQL} FROM proc ORDER BY event_time DESC, log_id LIMIT 15",
)
def latest_logs(spark, sf_dir):
    return stamped(search.latest(inputs.processed(spark, sf_dir).select(*LOG_COLUMNS), 15), "event_time")


@query(
    "known_services",
    f"""WITH {ALERTS} SELECT 'all' AS service, 0 AS pos
  UNION ALL SELECT DISTINCT service, 1 FROM (SELECT service FROM proc UNION ALL SELECT service FROM alerts)""",
)
def known_services(spark, sf_dir):
    return search.known_services(inputs.processed(spark, sf_dir), inputs.alerts(spark, sf_dir))


# ---------------------------------------------------------------- alert listings

ALERT_COLUMNS = ["alert_id", "log_id", "service", "level", "anomaly_score", "detected_at"]
ALERT_SQL = f"alert_id, log_id, service, level, anomaly_score, {iso('detected_at')} AS detected_at"


@query(
    "recent_alerts",
    f"WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts ORDER BY alerts.detected_at DESC, alert_id LIMIT 50 OFFSET 50",
)
def recent_alerts(spark, sf_dir):
    rows = inputs.alerts(spark, sf_dir).select(*ALERT_COLUMNS)
    return stamped(search.page_of(rows, 2, 50, "detected_at", "alert_id"), "detected_at")


@query(
    "alerts_by_service",
    f"""WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts WHERE service = 'svc-2'
  ORDER BY alerts.detected_at DESC, alert_id LIMIT 20""",
)
def alerts_by_service(spark, sf_dir):
    rows = search.alerts_by_service(inputs.alerts(spark, sf_dir), "svc-2").select(*ALERT_COLUMNS)
    return stamped(search.page_of(rows, 1, 20, "detected_at", "alert_id"), "detected_at")


@query(
    "alerts_by_time",
    f"""WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts
  WHERE detected_at BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-12'""",
)
def alerts_by_time(spark, sf_dir):
    rows = search.between(inputs.alerts(spark, sf_dir), "detected_at", "2024-01-10T00:00:00Z", "2024-01-12T00:00:00Z")
    return stamped(rows.select(*ALERT_COLUMNS), "detected_at")


@query(
    "alert_by_id",
    f"""WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts
  WHERE alert_id = 'al-' || (SELECT max(event_id) FROM alerts)""",
)
def alert_by_id(spark, sf_dir):
    rows = inputs.alerts(spark, sf_dir)
    wanted = rows.agg(F.concat(F.lit("al-"), F.max("event_id"))).scalar()
    return stamped(rows.filter(F.col("alert_id") == wanted).select(*ALERT_COLUMNS), "detected_at")


@query(
    "list_anomalies",
    f"""WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts
  WHERE service = 'svc-5' AND detected_at >= TIMESTAMP '2024-01-15'""",
)
def list_anomalies(spark, sf_dir):
    rows = search.list_anomalies(inputs.alerts(spark, sf_dir), "svc-5", start="2024-01-15T00:00:00Z")
    return stamped(rows.select(*ALERT_COLUMNS), "detected_at")


@query(
    "list_anomalies_time_wins",
    f"WITH {ALERTS} SELECT {ALERT_SQL} FROM alerts WHERE detected_at >= TIMESTAMP '2024-01-15'",
)
def list_anomalies_time_wins(spark, sf_dir):
    rows = search.list_anomalies(
        inputs.alerts(spark, sf_dir), "svc-5", start="2024-01-15T00:00:00Z", combine_filters=False
    )
    return stamped(rows.select(*ALERT_COLUMNS), "detected_at")


# ---------------------------------------------------------------- counts and rates


@query("count_logs", f"WITH {PROC} SELECT count(*) AS n FROM proc WHERE level = 'WARN'")
def count_logs(spark, sf_dir):
    return stats.count_logs(inputs.processed(spark, sf_dir), F.col("level") == "WARN")


STATS_SQL = """
  l AS (SELECT count(*) FILTER (event_time >= TIMESTAMP '{as_of}' - INTERVAL 1 MINUTE) AS logs_last_minute,
    count(*) FILTER (event_time >= TIMESTAMP '{as_of}' - INTERVAL 1 HOUR) AS logs_last_hour,
    count(*) FILTER (event_time >= TIMESTAMP '{as_of}' - INTERVAL {minutes} MINUTE) AS logs_last_window FROM proc),
  a AS (SELECT count(*) FILTER (detected_at >= TIMESTAMP '{as_of}' - INTERVAL 1 HOUR) AS anomalies_last_hour,
    count(*) AS total_anomalies FROM {alerts})
  SELECT *, {minutes} AS window_minutes, round_even(logs_last_minute / 60, 2) AS log_rate_per_second,
    round_even(anomalies_last_hour / greatest(logs_last_hour, 1) * 100, 2) AS anomaly_rate_percent FROM l, a"""


@query("system_stats", f"WITH {ALERTS}, {STATS_SQL.format(as_of=AS_OF, minutes=1440, alerts='alerts')}")
def system_stats(spark, sf_dir):
    return stats.system_stats(inputs.processed(spark, sf_dir), inputs.alerts(spark, sf_dir), at(), 1440)


@query(
    "system_stats_unique",
    f"WITH RECURSIVE {KEYED}, {flagged(86_400)}, u AS (SELECT * FROM flagged WHERE NOT deduplicated),"
    f"{STATS_SQL.format(as_of='2024-01-15 12:00:00', minutes=60, alerts='u')}",
)
def system_stats_unique(spark, sf_dir):
    return stats.system_stats(
        inputs.processed(spark, sf_dir),
        inputs.flagged_alerts(spark, sf_dir),
        at("2024-01-15 12:00:00"),
        60,
        unique_only=True,
    )


@query(
    "count_unique_alerts",
    f"""WITH RECURSIVE {HISTORY} SELECT count(*) FILTER (NOT deduplicated) AS total,
  count(*) FILTER (NOT deduplicated AND detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS last_hour
  FROM history""",
)
def count_unique_alerts(spark, sf_dir):
    return stats.count_alerts(inputs.history(spark, sf_dir), at(), unique_only=True)


@query(
    "count_all_alerts",
    f"""WITH {ALERTS} SELECT count(*) AS total,
  count(*) FILTER (detected_at >= TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR) AS last_hour FROM alerts""",
)
def count_all_alerts(spark, sf_dir):
    return stats.count_alerts(inputs.alerts(spark, sf_dir), at(), unique_only=False)


@query("count_by_level", f"WITH {PROC} SELECT level, count(*) AS n FROM proc GROUP BY 1")
def count_by_level(spark, sf_dir):
    return stats.count_by(inputs.processed(spark, sf_dir), "level")


@query("count_by_service", f"WITH {PROC} SELECT service, count(*) AS n FROM proc GROUP BY 1")
def count_by_service(spark, sf_dir):
    return stats.count_by(inputs.processed(spark, sf_dir), "service")


@query(
    "count_by_host_missing",
    "SELECT CASE WHEN user_id % 4 = 0 THEN 'unknown' ELSE 'h' || (user_id % 4) END AS host, count(*) AS n"
    " FROM events GROUP BY 1",
)
def count_by_host_missing(spark, sf_dir):
    host = F.when(F.col("user_id") % 4 != 0, F.concat(F.lit("h"), F.col("user_id") % 4))
    return stats.count_by(inputs.events(spark, sf_dir).select(host.alias("host")), "host")


@query(
    "top_services", f"WITH {PROC} SELECT service, count(*) AS n FROM proc GROUP BY 1 ORDER BY n DESC, service LIMIT 6"
)
def top_services(spark, sf_dir):
    return stats.top_groups(inputs.processed(spark, sf_dir), "service")


@query(
    "service_bars",
    f"""WITH {PROC}, t AS (SELECT service, count(*) AS n FROM proc GROUP BY 1 ORDER BY n DESC, service LIMIT 6)
  SELECT service, n, round(n / (SELECT max(n) FROM t) * 100, 6) AS width_pct FROM t""",
)
def service_bars(spark, sf_dir):
    return stats.group_bars(inputs.processed(spark, sf_dir)).withColumn("width_pct", F.round("width_pct", 6))


@query(
    "level_breakdown",
    f"""WITH {PROC}, d AS (SELECT unnest(['DEBUG', 'INFO', 'WARN', 'ERROR', 'CRITICAL']) AS level)
  SELECT d.level, count(p.log_id) AS n,
    CAST(floor(count(p.log_id) * 100 / (SELECT count(*) FROM proc) + 0.5) AS BIGINT) AS pct
  FROM d LEFT JOIN proc p ON p.level = d.level GROUP BY 1""",
)
def level_breakdown(spark, sf_dir):
    return stats.level_breakdown(inputs.processed(spark, sf_dir))


@query(
    "pipeline_counters",
    f"""WITH {ALERTS} SELECT 'logs_ingested_total' AS counter, service, level, count(*) AS value FROM proc GROUP BY ALL
  UNION ALL SELECT 'anomalies_detected_total', service, level, count(*) FROM alerts GROUP BY ALL""",
)
def pipeline_counters(spark, sf_dir):
    labels = ["service", "level"]
    return stats.pipeline_counters(inputs.processed(spark, sf_dir), labels, "logs_ingested_total").unionByName(
        stats.pipeline_counters(inputs.alerts(spark, sf_dir), labels, "anomalies_detected_total")
    )


BOUNDS_SQL = ", ".join(f"({i}, {b}, '{b}')" for i, b in enumerate(stats.LATENCY_BOUNDS_MS)) + (
    ", (99, 'Infinity'::DOUBLE, '+Inf')"
)


@query(
    "latency_histogram",
    f"""WITH {PROC}, b AS (SELECT * FROM (VALUES {BOUNDS_SQL}) t(i, bound, le)),
  s AS (SELECT DISTINCT service FROM proc)
  SELECT s.service, b.le, count(*) FILTER (p.response_time_ms <= b.bound) AS n, count(*) AS count,
    round(sum(p.response_time_ms), 3) AS sum
  FROM s, b, proc p WHERE p.service = s.service GROUP BY 1, 2""",
)
def latency_histogram(spark, sf_dir):
    rows = stats.histogram(inputs.processed(spark, sf_dir), "response_time_ms", by=["service"])
    return rows.withColumn("sum", F.round("sum", 3))


@query(
    "batch_size_histogram",
    """WITH r AS (SELECT user_id, CAST(ts AS DATE) AS d, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1, 2),
  b AS (SELECT * FROM (VALUES (1.0, '1.0'), (5.0, '5.0'), (10.0, '10.0'), (20.0, '20.0'), (50.0, '50.0'),
    (75.0, '75.0'), (100.0, '100.0'), ('Infinity'::DOUBLE, '+Inf')) t(bound, le))
  SELECT le, count(*) FILTER (n <= bound) AS n, count(*) AS count, sum(n) AS sum FROM r, b GROUP BY 1""",
)
def batch_size_histogram(spark, sf_dir):
    sizes = inputs.events(spark, sf_dir).groupBy("user_id", F.to_date("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("size")
    )
    return stats.histogram(sizes, "size", [1.0, 5.0, 10.0, 20.0, 50.0, 75.0, 100.0])


# ---------------------------------------------------------------- over time


@query(
    "logs_per_minute",
    f"""WITH {PROC} SELECT {iso("date_trunc('minute', event_time)")} AS bucket, service, count(*) AS n
  FROM proc GROUP BY 1, 2""",
)
def logs_per_minute(spark, sf_dir):
    return stamped(stats.per_bucket(inputs.processed(spark, sf_dir), by=["service"]), "bucket")


@query(
    "anomalies_per_minute",
    f"WITH {ALERTS} SELECT {iso("date_trunc('minute', detected_at)")} AS bucket, count(*) AS n FROM alerts GROUP BY 1",
)
def anomalies_per_minute(spark, sf_dir):
    return stamped(stats.per_bucket(inputs.alerts(spark, sf_dir), time="detected_at"), "bucket")


@query(
    "alert_history",
    f"""WITH {ALERTS}, s AS (SELECT *, CASE WHEN anomaly_score < -0.3 AND level IN ('CRITICAL', 'ERROR') THEN 'CRITICAL'
    WHEN anomaly_score < -0.2 OR level = 'ERROR' THEN 'HIGH' WHEN anomaly_score < -0.1 THEN 'MEDIUM' ELSE 'LOW' END
    AS severity FROM alerts)
  SELECT severity, service, count(*) AS n FROM s GROUP BY ROLLUP (severity, service)""",
)
def alert_history(spark, sf_dir):
    from logtide.operators.alerts import with_severity

    return stats.alert_history_totals(with_severity(inputs.alerts(spark, sf_dir)))


@query(
    "sent_by_channel",
    f"""WITH RECURSIVE {HISTORY} SELECT channel, count(*) AS sent FROM history, (VALUES ('slack'), ('email')) c(channel)
  WHERE NOT deduplicated GROUP BY 1""",
)
def sent_by_channel(spark, sf_dir):
    return stats.sent_by_channel(inputs.history(spark, sf_dir))


@query(
    "top_anomalous_services",
    f"WITH {ALERTS} SELECT service, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, service LIMIT 5",
)
def top_anomalous_services(spark, sf_dir):
    return stats.top_groups(inputs.alerts(spark, sf_dir), "service", 5)


@query(
    "detection_latency",
    f"""WITH {ALERTS}, d AS (SELECT (epoch_us(detected_at) - epoch_us(event_time)) / 1e6
    + CASE WHEN user_id % 10 = 0 THEN k ELSE 0 END AS seconds FROM alerts)
  SELECT count(*) AS n, round(quantile_cont(seconds, 0.5), 6) AS p50, round(quantile_cont(seconds, 0.95), 6) AS p95,
    round(quantile_cont(seconds, 0.99), 6) AS p99, round(avg(CASE WHEN seconds < 30 THEN 1.0 ELSE 0.0 END), 6)
    AS within_goal FROM d""",
)
def detection_latency(spark, sf_dir):
    from logtide.operators.quantiles import percentiles

    late = F.when(F.col("user_id") % 10 == 0, F.col("k")).otherwise(0)
    seconds = (F.unix_micros("detected_at") - F.unix_micros("event_time")) / 1e6 + late
    rows = inputs.alerts(spark, sf_dir).select(seconds.alias("seconds"))
    marks = percentiles(rows, "seconds", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, band_width=1.0)
    goal = rows.agg(F.round(F.avg(F.when(F.col("seconds") < 30, 1.0).otherwise(0.0)), 6)).scalar()
    return marks.select("n", *[F.round(c, 6).alias(c) for c in ("p50", "p95", "p99")], goal.alias("within_goal"))


@query(
    "anomaly_rate_minute",
    f"""WITH {SCORED} SELECT count(*) AS n, round(coalesce(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END), 0.0), 6)
  AS anomaly_rate FROM scored WHERE event_time BETWEEN TIMESTAMP '{AS_OF}' - INTERVAL 6 HOUR AND TIMESTAMP '{AS_OF}'""",
)
def anomaly_rate_minute(spark, sf_dir):
    return stats.anomaly_fraction(inputs.scored(spark, sf_dir), at(), 6 * 3600)


@query(
    "suppression_rate",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)} SELECT {iso("date_trunc('day', detected_at)")} AS bucket,
  count(*) AS alerts, round(avg(CASE WHEN deduplicated THEN 1.0 ELSE 0.0 END), 6) AS suppressed
  FROM flagged GROUP BY 1""",
)
def suppression_rate(spark, sf_dir):
    return stamped(stats.suppression_rate(inputs.flagged_alerts(spark, sf_dir)), "bucket")


TRACE = "'tr-' || (user_id % 50) || '-' || strftime(event_time, '%Y%m%d')"


def _trace_id():
    return F.concat(F.lit("tr-"), F.col("user_id") % 50, F.lit("-"), F.date_format("event_time", "yyyyMMdd"))


@query(
    "trace_timeline",
    f"""WITH {PROC} SELECT {TRACE} AS trace_id, {iso("min(event_time)")} AS started, {iso("max(event_time)")} AS ended,
  count(*) AS records, count(*) FILTER (level IN ('ERROR', 'CRITICAL')) AS errors,
  array_to_string(list_sort(list(DISTINCT service)), ',') AS services FROM proc GROUP BY 1""",
)
def trace_timeline(spark, sf_dir):
    rows = stats.trace_timeline(inputs.processed(spark, sf_dir), _trace_id())
    return stamped(rows.withColumn("services", F.array_join("services", ",")), "started", "ended")


@query(
    "trace_records",
    f"""WITH {PROC} SELECT log_id, service, level, {iso("event_time")} AS event_time FROM proc
  WHERE {TRACE} = 'tr-7-20240110'""",
)
def trace_records(spark, sf_dir):
    rows = stats.find_trace(inputs.processed(spark, sf_dir), _trace_id(), "tr-7-20240110")
    return rows.select("log_id", "service", "level", stamp("event_time"))


@query("raw_level_classes", f"""WITH {LOGS} SELECT CASE WHEN contains(lower(level), 'critical') THEN 'critical'
  WHEN contains(lower(level), 'error') THEN 'error' WHEN contains(lower(level), 'warn') THEN 'warn' ELSE 'info' END
  AS class, count(*) AS n FROM logs GROUP BY 1""")
def raw_level_classes(spark, sf_dir):
    from logtide.functions.alerting import ui_level_class

    rows = inputs.logs(spark, sf_dir).select(ui_level_class(F.col("level")).alias("class"))
    return rows.groupBy("class").agg(F.count(F.lit(1)).alias("n"))


