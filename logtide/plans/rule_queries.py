"""Queries over metric samples: rates, quantiles, rules, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.operators import metrics, rules
from logtide.plans import inputs
from logtide.plans.common import stamped
from logtide.plans.registry import query
from logtide.plans.sqltext import SAMPLE_BASE, counter, iso, rates

SAMPLES = f"{SAMPLE_BASE}, {counter('service, after_reset')}"
TS = f"{iso('ts')} AS ts"


@query(
    "counter_rate",
    f"""WITH {SAMPLES}, {rates("service", 3600)}
  SELECT service, {TS}, value, increase, round(rate, 9) AS rate FROM rates""",
)
def counter_rate(spark, sf_dir):
    rows = metrics.counter_rate(inputs.samples(spark, sf_dir, "logs_total"), 3600)
    rows = rows.select(
        metrics.label("service").alias("service"), "ts", "value", "increase", F.round("rate", 9).alias("rate")
    )
    return stamped(rows, "ts")


@query(
    "ingest_rate",
    f"WITH {SAMPLES}, {rates('service', 3600)} SELECT {TS}, round(sum(rate), 9) AS value FROM rates GROUP BY rates.ts",
)
def ingest_rate(spark, sf_dir):
    vector = metrics.counter_rate(inputs.samples(spark, sf_dir, "logs_total"), 3600)
    return stamped(metrics.sum_by(vector).withColumn("value", F.round("value", 9)), "ts")


CPU = f"""{SAMPLE_BASE}, cpu AS (SELECT ts, 'node-' || (user_id % 3) AS instance, k FROM base),
  {counter("instance", "60 - least(60, sum(k))", source="cpu")}, {rates("instance", 300)}"""


@query(
    "cpu_busy",
    f"WITH {CPU} SELECT {TS}, instance, round(100 - rate * 100, 6) AS value FROM rates",
)
def cpu_busy(spark, sf_dir):
    rows = metrics.cpu_busy(inputs.samples(spark, sf_dir, "node_cpu_seconds_total"))
    return stamped(rows.withColumn("value", F.round("value", 6)), "ts")


UP = f"""{SAMPLE_BASE}, up AS (SELECT ts, service AS job, min(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END)
  AS value FROM base GROUP BY 1, 2)"""


@query(
    "services_up",
    f"""WITH {UP} SELECT {TS}, count(*) FILTER (value = 1) AS value FROM up WHERE job IN ('svc-1', 'svc-2', 'svc-3')
  GROUP BY up.ts""",
)
def services_up(spark, sf_dir):
    return stamped(metrics.services_up(inputs.samples(spark, sf_dir, "up"), "svc-1|svc-2|svc-3"), "ts")


REQUESTS = f"{SAMPLE_BASE}, {counter('service, status_code')}, {rates('service, status_code', 21600)}"
RATIO = f"""{REQUESTS}, ratio AS (SELECT ts, service AS job, sum(CASE WHEN status_code LIKE '5__' THEN rate ELSE 0.0 END)
  / nullif(sum(rate), 0) AS value FROM rates GROUP BY 1, 2)"""


@query("error_ratio", f"WITH {RATIO} SELECT {TS}, job, round(value, 6) AS value FROM ratio")
def error_ratio(spark, sf_dir):
    rows = metrics.error_ratio(inputs.samples(spark, sf_dir, "http_requests_total"), window_seconds=21_600, by=["job"])
    return stamped(rows.withColumn("value", F.round("value", 6)), "ts")


EDGES = [*inputs.LATENCY_EDGES, None]


def _bucket_sql() -> str:
    parts = []
    for edge in EDGES:
        cond = "true" if edge is None else f"ms <= {edge}"
        bound = "'Infinity'::DOUBLE" if edge is None else f"{edge}::DOUBLE"
        parts.append(f"SELECT ts, {bound} AS le, count(*) FILTER ({cond}) AS n FROM base GROUP BY 1, 2")
    return " UNION ALL ".join(parts)


def _quantile_sql(q: float) -> str:
    return f"""(SELECT CASE WHEN total = 0 THEN NULL WHEN le = 'Infinity' THEN lo
      ELSE lo + (le - lo) * ({q} * total - below) / (n - below) END
    FROM cum c WHERE c.ts = t.ts AND n >= {q} * total ORDER BY le LIMIT 1)"""


@query(
    "latency_quantiles",
    f"""WITH {SAMPLE_BASE}, per_minute AS ({_bucket_sql()}),
  samples AS (SELECT *, CAST(sum(n) OVER (PARTITION BY le ORDER BY ts) AS DOUBLE) AS value FROM per_minute),
  {rates("le", 21600)},
  cum AS (SELECT ts, le, rate AS n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(rate) OVER w, 0) AS below,
    max(rate) OVER (PARTITION BY ts) AS total FROM rates WINDOW w AS (PARTITION BY ts ORDER BY le)),
  t AS (SELECT DISTINCT ts FROM cum)
  SELECT {TS}, round({_quantile_sql(0.5)}, 6) AS p50, round({_quantile_sql(0.95)}, 6) AS p95,
    round({_quantile_sql(0.99)}, 6) AS p99 FROM t""",
)
def latency_quantiles(spark, sf_dir):
    vector = metrics.counter_rate(inputs.samples(spark, sf_dir, "http_request_duration_bucket"), 21_600)
    rows = metrics.histogram_quantiles(vector, {"p50": 0.5, "p95": 0.95, "p99": 0.99})
    return stamped(rows.withColumns({c: F.round(c, 6) for c in ("p50", "p95", "p99")}), "ts")


DISK = f"""{SAMPLE_BASE}, disk AS (SELECT ts, 'node-' || (user_id % 3) AS instance, CAST(min(k) AS DOUBLE) AS value
  FROM base WHERE user_id % 4 <> 0 GROUP BY 1, 2)"""


@query("disk_free", f"WITH {DISK} SELECT {TS}, instance, value / 100.0 * 100 AS value FROM disk")
def disk_free(spark, sf_dir):
    return stamped(_disk(spark, sf_dir).drop("job"), "ts")


def _disk(spark, sf_dir):
    both = inputs.samples(spark, sf_dir, "node_filesystem_avail_bytes").unionByName(
        inputs.samples(spark, sf_dir, "node_filesystem_size_bytes")
    )
    return metrics.ratio_percent(
        both,
        "node_filesystem_avail_bytes",
        "node_filesystem_size_bytes",
        ["instance"],
        not_equal={"fstype": "tmpfs"},
    )


LAG = f"{SAMPLE_BASE}, lag_samples AS (SELECT ts, service AS job, CAST(sum(k) * 200 AS DOUBLE) AS value FROM base GROUP BY 1, 2)"


def _evaluated(spark, sf_dir):
    """Rules over their vectors, as one evaluated table."""
    gauge = lambda m: inputs.samples(spark, sf_dir, m).select("ts", metrics.label("job").alias("job"), "value")
    disk = _disk(spark, sf_dir).select("ts", F.col("instance").alias("job"), "value")
    ratio = metrics.error_ratio(inputs.samples(spark, sf_dir, "http_requests_total"), window_seconds=21_600, by=["job"])
    parts = [
        rules.apply_rule(gauge("up"), rules.SERVICE_DOWN),
        rules.apply_rule(gauge("consumer_lag"), rules.CONSUMER_LAG),
        rules.apply_rule(disk, rules.LOW_DISK),
        rules.apply_rule(ratio, rules.ERROR_RATE),
    ]
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged


EVALUATED = f"""{RATIO}, upv AS (SELECT ts, service AS job, min(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END)
    AS value FROM base GROUP BY 1, 2),
  lagv AS (SELECT ts, service AS job, CAST(sum(k) * 200 AS DOUBLE) AS value FROM base GROUP BY 1, 2),
  diskv AS (SELECT ts, 'node-' || (user_id % 3) AS job, CAST(min(k) AS DOUBLE) AS value FROM base
    WHERE user_id % 4 <> 0 GROUP BY 1, 2),
  evaluated AS (
    SELECT 'ServiceDown' AS alertname, 'critical' AS severity, 60 AS hold, job, ts, value, value = 0 AS active,
      'Service ' || job || ' is down' AS summary FROM upv
    UNION ALL SELECT 'KafkaConsumerLag', 'warning', 300, job, ts, value, value > 10000, 'High Kafka consumer lag' FROM lagv
    UNION ALL SELECT 'LowDiskSpace', 'critical', 300, job, ts, value, value < 15, 'Low disk space on ' || job FROM diskv
    UNION ALL SELECT 'HighIngestionErrorRate', 'warning', 120, job, ts, value, coalesce(value > 0.05, false),
      'High error rate on log-ingestion-api' FROM ratio)"""


@query(
    "threshold_rules",
    f"""WITH {EVALUATED} SELECT alertname, severity, job, {TS}, round(value, 6) AS value, summary FROM evaluated
  WHERE active""",
)
def threshold_rules(spark, sf_dir):
    rows = _evaluated(spark, sf_dir).filter("active")
    rows = rows.select("alertname", "severity", "job", "ts", F.round("value", 6).alias("value"), "summary")
    return stamped(rows, "ts")


FIRING = f"""{EVALUATED}, marked AS (SELECT *, active AND NOT coalesce(lag(active) OVER w, false) AS starts FROM evaluated
    WINDOW w AS (PARTITION BY alertname, job ORDER BY ts)),
  runs AS (SELECT *, sum(CASE WHEN starts THEN 1 ELSE 0 END) OVER (PARTITION BY alertname, job ORDER BY ts) AS run
    FROM marked),
  states AS (SELECT *, min(CASE WHEN active THEN ts END) OVER (PARTITION BY alertname, job, run) AS began FROM runs),
  fired AS (SELECT *, CASE WHEN NOT active THEN 'inactive' WHEN epoch_us(ts) - epoch_us(began) >= hold * 1000000
    THEN 'firing' ELSE 'pending' END AS state FROM states)"""


@query(
    "rule_firing",
    f"""WITH {FIRING} SELECT alertname, job, {TS}, state FROM fired""",
)
def rule_firing(spark, sf_dir):
    rows = rules.rule_firing(_evaluated(spark, sf_dir)).select("alertname", "job", "ts", "state")
    return stamped(rows, "ts")


INTERVALS = f"""{FIRING}, intervals AS (SELECT alertname, severity, job, began, min(ts) AS fired_at, max(ts) AS last_at,
  max(ts) + INTERVAL 5 MINUTE AS resolved_at FROM fired WHERE state = 'firing' GROUP BY 1, 2, 3, 4)"""


@query(
    "alert_intervals",
    f"""WITH {INTERVALS} SELECT alertname, severity, job, {iso("began")} AS since, {iso("fired_at")} AS fired_at,
  {iso("last_at")} AS last_at, {iso("resolved_at")} AS resolved_at FROM intervals""",
)
def alert_intervals(spark, sf_dir):
    rows = rules.alert_intervals(rules.rule_firing(_evaluated(spark, sf_dir)))
    return stamped(rows, "since", "fired_at", "last_at", "resolved_at")


def _severe_lag(spark, sf_dir):
    """Lag rule at two limits under one name, so a critical alert can mute its warning."""
    lag = inputs.samples(spark, sf_dir, "consumer_lag").select("ts", metrics.label("job").alias("job"), "value")
    warn = rules.Rule("KafkaConsumerLag", ">", 8_000, 0, "warning")
    worse = rules.Rule("KafkaConsumerLag", ">", 15_000, 0, "critical")
    both = rules.apply_rule(lag, warn).unionByName(rules.apply_rule(lag, worse))
    return both.filter("active")


def _told(rows):
    """What a rule says about each sample, with the time and value that the SQL twins give."""
    rows = rows.select("alertname", "job", "ts", F.round("value", 6).alias("value"), "active", "summary", "description")
    return stamped(rows, "ts")


def _told_sql(name: str, active: str, summary: str, description: str, source: str) -> str:
    return f"""SELECT '{name}' AS alertname, job, {TS}, round(value, 6) AS value, coalesce({active}, false) AS active,
    {summary} AS summary, {description} AS description FROM {source}"""


@query(
    "rule_cpu_busy",
    f"""WITH {CPU}, v AS (SELECT ts, instance AS job, 100 - rate * 100 AS value FROM rates)
  {_told_sql("HighCPUUsage", "value > 85", "'High CPU usage on ' || job",
             "'CPU usage is ' || printf('%.2f', floor(value * 100) / 100) || '%'", "v")}""",
)
def rule_cpu_busy(spark, sf_dir):
    busy = metrics.cpu_busy(inputs.samples(spark, sf_dir, "node_cpu_seconds_total"))
    return _told(rules.apply_rule(busy.withColumn("job", F.col("instance")), rules.CPU_BUSY))


@query(
    "rule_consumer_lag",
    f"""WITH {LAG}, v AS (SELECT ts, job, value FROM lag_samples)
  {_told_sql("KafkaConsumerLag", "value > 10000", "'High Kafka consumer lag'",
             "'Consumer group readers of ' || job || ' has lag ' || printf('%.2f', value) || ' on topic raw-logs'", "v")}""",
)
def rule_consumer_lag(spark, sf_dir):
    """The text names the group and the topic of the series."""
    lag = inputs.samples(spark, sf_dir, "consumer_lag").select("ts", metrics.label("job").alias("job"), "value")
    named = lag.withColumns({"group": F.concat(F.lit("readers of "), "job"), "topic": F.lit("raw-logs")})
    return _told(rules.apply_rule(named, rules.CONSUMER_LAG))


@query(
    "rule_anomaly_rate",
    f"""WITH {SAMPLES}, {rates("service", 3600)}, v AS (SELECT ts, service AS job, rate * 100 AS value FROM rates)
  {_told_sql("HighAnomalyRate", "value > 0.5", "'High anomaly rate detected'",
             "'Anomaly rate is ' || printf('%.2f', floor(value * 100) / 100) || ' per second (threshold: 0.5/s)'", "v")}""",
)
def rule_anomaly_rate(spark, sf_dir):
    """The rule over a counter's rate, a hundred times that of the log lines here."""
    rate = metrics.counter_rate(inputs.samples(spark, sf_dir, "logs_total"), 3600)
    vector = rate.select("ts", metrics.label("service").alias("job"), (F.col("rate") * 100).alias("value"))
    return _told(rules.apply_rule(vector, rules.ANOMALY_RATE))


@query(
    "rule_cluster_red",
    f"""WITH {UP}, v AS (SELECT ts, 'search' AS job, 1 - min(value) AS value FROM up GROUP BY 1)
  {_told_sql("ElasticsearchClusterUnhealthy", "value = 1", "'Elasticsearch cluster is RED'",
             "'Elasticsearch cluster health is RED \u2014 data may be unavailable'", "v")}""",
)
def rule_cluster_red(spark, sf_dir):
    """The rule over a health gauge, which is red here when any service is down."""
    up = inputs.samples(spark, sf_dir, "up").groupBy("ts").agg((1 - F.min("value")).alias("value"))
    return _told(rules.apply_rule(up.withColumn("job", F.lit("search")), rules.CLUSTER_RED))


@query(
    "rule_slow_response",
    f"""WITH {SAMPLE_BASE}, per_minute AS ({_bucket_sql()}),
  samples AS (SELECT *, CAST(sum(n) OVER (PARTITION BY le ORDER BY ts) AS DOUBLE) AS value FROM per_minute),
  {rates("le", 21600)},
  cum AS (SELECT ts, le, rate AS n, coalesce(lag(le) OVER w, 0) AS lo, coalesce(lag(rate) OVER w, 0) AS below,
    max(rate) OVER (PARTITION BY ts) AS total FROM rates WINDOW w AS (PARTITION BY ts ORDER BY le)),
  t AS (SELECT DISTINCT ts FROM cum), v AS (SELECT ts, 'api' AS job, {_quantile_sql(0.95)} / 1000 AS value FROM t)
  SELECT * EXCLUDE (description) FROM ({_told_sql("SlowAPIResponse", "value > 2", "'Slow API response times'",
             "'95th percentile response time is ' || coalesce(printf('%.2f', floor(value * 100) / 100), 'NaN') || 's'", "v")})""",
)
def rule_slow_response(spark, sf_dir):
    """The rule over a histogram quantile, brought from milliseconds to seconds."""
    buckets = metrics.counter_rate(inputs.samples(spark, sf_dir, "http_request_duration_bucket"), 21_600)
    p95 = metrics.histogram_quantiles(buckets, {"value": 0.95}).withColumn("value", F.col("value") / 1000)
    # interpolated values differ in their last bit between engines, which cut digits would show
    return _told(rules.apply_rule(p95.withColumn("job", F.lit("api")), rules.SLOW_RESPONSE)).drop("description")


@query(
    "inhibit_alerts",
    f"""WITH {LAG} SELECT job, {TS}, 'critical' AS severity FROM lag_samples WHERE value > 15000
  UNION ALL SELECT job, {TS}, 'warning' FROM lag_samples WHERE value > 8000 AND NOT value > 15000""",
)
def inhibit_alerts(spark, sf_dir):
    return stamped(rules.inhibit_alerts(_severe_lag(spark, sf_dir)).select("job", "ts", "severity"), "ts")


@query(
    "route_alerts",
    f"""WITH {LAG} SELECT job, {TS}, 'slack-critical' AS receiver FROM lag_samples WHERE value > 15000
  UNION ALL SELECT job, {TS}, 'slack-notifications' FROM lag_samples WHERE value > 8000""",
)
def route_alerts(spark, sf_dir):
    return stamped(rules.route_alerts(_severe_lag(spark, sf_dir)).select("job", "ts", "receiver"), "ts")


@query(
    "group_notifications",
    f"""WITH {INTERVALS}, o AS (SELECT alertname, job, epoch_us(fired_at) AS s, epoch_us(resolved_at) AS e FROM intervals),
  m AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY alertname, job ORDER BY s, e
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS opens FROM o),
  g AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY alertname, job ORDER BY s, e) AS ep FROM m),
  ep AS (SELECT alertname, job, ep, min(s) AS opened, max(e) AS closed FROM g GROUP BY 1, 2, 3),
  c AS (SELECT DISTINCT g.alertname, g.job, opened, closed, opened + 30000000
      + CAST(ceil(greatest(x - opened - 30000000, 0) / 300000000) AS BIGINT) * 300000000 AS tick
    FROM (SELECT alertname, job, ep, unnest([s, e]) AS x FROM g) g JOIN ep USING (alertname, job, ep)),
  n AS (SELECT *, least(coalesce(lead(tick) OVER (PARTITION BY alertname, job, opened ORDER BY tick), closed), closed) AS til
    FROM c)
  SELECT alertname, job, {iso("make_timestamp(opened)")} AS opened,
    {iso("make_timestamp(unnest(range(tick, greatest(til, tick + 1), 10800000000)))")} AS notify_at FROM n""",
)
def group_notifications(spark, sf_dir):
    rows = rules.group_notifications(rules.alert_intervals(rules.rule_firing(_evaluated(spark, sf_dir))))
    return stamped(rows, "opened", "notify_at")


@query(
    "health_summary",
    f"""WITH {UP}, l AS (SELECT job, arg_max(value, ts) AS v FROM up GROUP BY 1)
  SELECT count(*) FILTER (v = 1) AS up, count(*) AS known,
    coalesce(string_agg(job, ', ' ORDER BY job) FILTER (v <> 1), '') AS down,
    count(*) FILTER (v = 1) || '/' || count(*) || ' up' AS summary FROM l""",
)
def health_summary(spark, sf_dir):
    return metrics.health_summary(inputs.samples(spark, sf_dir, "up"))


@query("latest_samples", f"""WITH {UP} SELECT 'up' AS metric, job, arg_max(value, ts) AS value,
  {iso("max(ts)")} AS ts FROM up GROUP BY job""")
def latest_samples(spark, sf_dir):
    return stamped(metrics.latest_values(inputs.samples(spark, sf_dir, "up"), ["job"]), "ts")
