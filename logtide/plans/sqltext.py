"""Building blocks of the checking SQL: the inputs as common table expressions."""

from __future__ import annotations

from logtide.plans.inputs import AS_OF, CODE_RULE, END, LOG_RULES, RAW_RULES, RESET, rules_sql


def iso(expr: str) -> str:
    return f"strftime({expr}, '%Y-%m-%dT%H:%M:%S.%f')"


LEVEL_SQL = """
CASE WHEN upper(trim(level)) IN ('DEBUG', 'TRACE') THEN 'DEBUG'
     WHEN upper(trim(level)) IN ('WARN', 'WARNING') THEN 'WARN'
     WHEN upper(trim(level)) IN ('ERROR', 'ERR') THEN 'ERROR'
     WHEN upper(trim(level)) IN ('CRITICAL', 'CRIT', 'FATAL', 'EMERGENCY', 'ALERT') THEN 'CRITICAL'
     ELSE 'INFO' END"""

EV = "ev AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
LOGS = f"{EV}, logs AS (SELECT {rules_sql(LOG_RULES)}, ts AS timestamp FROM ev)"
RAW = f"""{EV}, raw AS (SELECT {rules_sql(RAW_RULES)}, ts,
  CASE WHEN event_id % 9 = 4 THEN floor(epoch(ts)) END AS epoch_seconds FROM ev)"""
PROC = f"""{LOGS}, proc AS (
  SELECT event_id, event_type, log_id, service, {LEVEL_SQL} AS level, message, host, response_time_ms, error_code,
         metadata, user_id, k, timestamp AS event_time
  FROM logs)"""
SCORED = f"""{PROC}, scored AS (
  SELECT *, round_even(0.2 - response_time_ms / 10000.0, 6) AS anomaly_score,
         CASE WHEN round_even(0.2 - response_time_ms / 10000.0, 6) < 0 THEN -1 ELSE 1 END AS prediction,
         round_even(0.2 - response_time_ms / 10000.0, 6) < 0 AS is_anomaly
  FROM proc)"""
ALERTS = f"""{SCORED}, alerts AS (
  SELECT *, 'al-' || event_id AS alert_id, event_time + INTERVAL 5 SECOND AS detected_at
  FROM scored WHERE is_anomaly)"""
KEYED = f"""{ALERTS}, keyed AS (
  SELECT *, epoch_us(detected_at) AS us,
         'alert:dedup:' || left(sha256(lower(service) || ':' || upper(level) || ':' || coalesce(error_code, 0)
           || ':' || CAST(round_even(anomaly_score, 1) + 0.0 AS DOUBLE)), 16) AS dedup_key
  FROM alerts)"""


def flagged(ttl_seconds: int, keys: str = "dedup_key", source: str = "keyed") -> str:
    """CTEs ending in ``flagged``: the chain of notifying alerts by recursion."""
    ttl = ttl_seconds * 1_000_000
    join = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    ck = " AND ".join(f"c.{k} = n.{k}" for k in keys.split(", "))
    nk = ", ".join(f"n.{k}" for k in keys.split(", "))
    fk = " AND ".join(f"f.{k} = r.{k}" for k in keys.split(", "))
    return f"""
times AS (SELECT {keys}, us, min(alert_id) AS first_id FROM {source} GROUP BY {keys}, us),
nexts AS (SELECT {ak}, a.us, min(b.us) AS next_us FROM times a JOIN times b ON {join} AND b.us >= a.us + {ttl}
  GROUP BY {ak}, a.us),
chain AS (
  SELECT {keys}, min(us) AS us FROM times GROUP BY {keys}
  UNION ALL
  SELECT {nk}, n.next_us FROM chain c JOIN nexts n ON {ck} AND c.us = n.us),
anchors AS (SELECT f.* FROM times f JOIN chain r ON {fk} AND f.us = r.us),
flagged AS (SELECT r.*, f.first_id IS NULL AS deduplicated FROM {source} r LEFT JOIN anchors f
  ON {fk} AND f.us = r.us AND f.first_id = r.alert_id)"""


HISTORY = f"""{KEYED}, {flagged(86_400)}, history AS (
  SELECT *, NOT deduplicated AS slack_sent, NOT deduplicated AS email_sent FROM flagged)"""
LABELLED = f"""{SCORED}, labelled AS (
  SELECT *, CASE WHEN event_type = 'error' THEN -1 ELSE 1 END AS true_label FROM scored)"""

SAMPLE_BASE = f"""{EV}, base AS (
  SELECT date_trunc('minute', ts) + INTERVAL 1 MINUTE AS ts, ts >= TIMESTAMP '{RESET}' AS after_reset,
         'svc-' || (user_id % 10) AS service, coalesce(CAST(({CODE_RULE}) AS VARCHAR), '0') AS status_code,
         event_type, value * 20 AS ms, k, user_id
  FROM ev)"""


def counter(keys: str, value: str = "count(*)", where: str = "true", source: str = "base") -> str:
    """CTE ``samples``: running totals per series over minutes."""
    return f"""
per_minute AS (SELECT ts, {keys}, {value} AS n FROM {source} WHERE {where} GROUP BY ts, {keys}),
samples AS (SELECT *, CAST(sum(n) OVER (PARTITION BY {keys} ORDER BY ts) AS DOUBLE) AS value FROM per_minute)"""


def rates(keys: str, seconds: int) -> str:
    """CTE ``rates``: increase and rate per sample, by comparing each pair of samples inside the window."""
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    ak = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""
steps AS (SELECT *, CASE WHEN value < lag(value) OVER w THEN value ELSE value - lag(value) OVER w END AS step,
    lag(ts) OVER w AS before_ts
  FROM samples WINDOW w AS (PARTITION BY {keys} ORDER BY ts)),
rates AS (SELECT {ak}, a.ts, a.value, coalesce(sum(b.step) FILTER (WHERE b.before_ts > a.ts - INTERVAL {seconds}
    SECOND), 0.0) AS increase, coalesce(sum(b.step) FILTER (WHERE b.before_ts > a.ts - INTERVAL {seconds} SECOND),
    0.0) / {seconds} AS rate
  FROM steps a JOIN steps b ON {on} AND b.ts <= a.ts AND b.ts > a.ts - INTERVAL {seconds} SECOND
  GROUP BY {ak}, a.ts, a.value)"""


