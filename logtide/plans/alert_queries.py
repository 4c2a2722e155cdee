"""Queries over alerts: detection, severity, deduplication, history, notifications."""

from __future__ import annotations

from pyspark.sql import functions as F

from logtide.functions import alerting as A
from logtide.functions.text import shaped_uuid
from logtide.operators import alerts as alerting
from logtide.operators import dedup
from logtide.plans import inputs
from logtide.plans.common import at, stamp, stamped, the_end
from logtide.plans.registry import query
from logtide.plans.sqltext import ALERTS, AS_OF, END, HISTORY, KEYED, SCORED, flagged, iso

SEVERITY_SQL = """CASE WHEN anomaly_score < -0.3 AND level IN ('CRITICAL', 'ERROR') THEN 'CRITICAL'
  WHEN anomaly_score < -0.2 OR level = 'ERROR' THEN 'HIGH' WHEN anomaly_score < -0.1 THEN 'MEDIUM' ELSE 'LOW' END"""


@query("detect_anomalies", f"WITH {SCORED} SELECT log_id, anomaly_score FROM scored WHERE anomaly_score < -0.1")
def detect_anomalies(spark, sf_dir):
    rows = alerting.detect_anomalies(inputs.scored(spark, sf_dir), threshold=-0.1)
    return rows.select("log_id", "anomaly_score")


ID_SQL = "sha256(log_id || '|' || CAST(epoch_us(event_time) AS VARCHAR))"
SHAPED = """left({h}, 8) || '-' || substr({h}, 9, 4) || '-' || substr({h}, 13, 4) || '-' || substr({h}, 17, 4) || '-' ||
  substr({h}, 21, 12)"""


@query(
    "build_alerts",
    f"""WITH {SCORED} SELECT {SHAPED.format(h=ID_SQL)} AS alert_id, log_id, service, level, message, host,
  response_time_ms, error_code, anomaly_score, prediction, is_anomaly,
  {iso("event_time + INTERVAL 5 SECOND")} AS detected_at FROM scored WHERE is_anomaly""",
)
def build_alerts(spark, sf_dir):
    rows = inputs.scored(spark, sf_dir).withColumn("_us", F.unix_micros("event_time"))
    made = alerting.build_alerts(
        rows, F.col("event_time") + F.expr("INTERVAL 5 SECONDS"), alerting.repeatable_alert_id("log_id", "_us")
    )
    return stamped(made.drop("event_time"), "detected_at")


@query(
    "alerts_from_tables",
    f"WITH {ALERTS} SELECT a.alert_id, p.service, p.level, p.message FROM alerts a JOIN proc p USING (log_id)",
)
def alerts_from_tables(spark, sf_dir):
    bare = inputs.alerts(spark, sf_dir).select("alert_id", "log_id")
    rows = alerting.snapshot_from_logs(bare, inputs.processed(spark, sf_dir), ["service", "level", "message"])
    return rows.drop("log_id")


@query(
    "alert_severity",
    f"""WITH {ALERTS} SELECT alert_id, {SEVERITY_SQL} AS severity, CASE {SEVERITY_SQL} WHEN 'CRITICAL' THEN '#FF0000'
  WHEN 'HIGH' THEN '#FF6600' WHEN 'MEDIUM' THEN '#FFCC00' ELSE '#36A64F' END AS color FROM alerts""",
)
def alert_severity(spark, sf_dir):
    rows = alerting.with_severity(inputs.alerts(spark, sf_dir))
    return rows.select("alert_id", "severity", A.lookup(F.col("severity"), A.SEVERITY_COLOR).alias("color"))


@query("dedup_key", f"WITH {KEYED} SELECT alert_id, dedup_key FROM keyed")
def dedup_key(spark, sf_dir):
    return dedup.with_dedup_key(inputs.alerts(spark, sf_dir)).select("alert_id", "dedup_key")


def _register_dedup(name: str, ttl: int):
    @query(name, f"WITH RECURSIVE {KEYED}, {flagged(ttl)} SELECT alert_id, dedup_key, deduplicated FROM flagged")
    def run(spark, sf_dir):
        return inputs.flagged_alerts(spark, sf_dir, ttl).select("alert_id", "dedup_key", "deduplicated")


_register_dedup("dedup_alerts", 86_400)
_register_dedup("dedup_alerts_1h", 3_600)
_register_dedup("dedup_alerts_6h", 21_600)


@query(
    "dedup_by_service",
    f"""WITH RECURSIVE {ALERTS}, byservice AS (SELECT *, epoch_us(detected_at) AS us FROM alerts),
  {flagged(3_600, "service", "byservice")} SELECT alert_id, deduplicated FROM flagged""",
)
def dedup_by_service(spark, sf_dir):
    """One key per service: long unbroken chains over many chunks."""
    rows = dedup.dedup_alerts(inputs.stored_alerts(spark, sf_dir), 3_600, key="service")
    return rows.select("alert_id", "deduplicated")


@query(
    "dedup_ttl_remaining",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)},
  last AS (SELECT dedup_key, max(us) FILTER (NOT deduplicated AND us <= epoch_us(TIMESTAMP '{AS_OF}')) AS a
    FROM flagged GROUP BY 1)
  SELECT dedup_key, CAST(CASE WHEN a + 86400000000 > epoch_us(TIMESTAMP '{AS_OF}')
    THEN (a + 86400000000 - epoch_us(TIMESTAMP '{AS_OF}')) // 1000000 ELSE -1 END AS BIGINT) AS ttl_remaining
  FROM last""",
)
def dedup_ttl_remaining(spark, sf_dir):
    return dedup.dedup_ttl_remaining(inputs.flagged_alerts(spark, sf_dir), at(), 86_400)


@query(
    "dedup_with_clears",
    f"""WITH RECURSIVE {KEYED}, clears AS (SELECT DISTINCT dedup_key, us + 1000000 AS c FROM keyed WHERE user_id % 9 = 0),
  epochs AS (SELECT k.alert_id, k.dedup_key, k.us, (SELECT count(*) FROM clears c WHERE c.dedup_key = k.dedup_key
    AND c.c < k.us) AS epoch FROM keyed k),
  {flagged(86_400, "dedup_key, epoch", "epochs")} SELECT alert_id, deduplicated FROM flagged""",
)
def dedup_with_clears(spark, sf_dir):
    rows = inputs.stored_alerts(spark, sf_dir)
    clears = rows.filter("user_id % 9 = 0").select(
        "dedup_key", (F.col("detected_at") + F.expr("INTERVAL 1 SECOND")).alias("cleared_at")
    )
    return dedup.dedup_alerts(rows, 86_400, clears=clears).select("alert_id", "deduplicated")


# ---------------------------------------------------------------- history


@query(
    "alerts_upsert",
    f"""WITH RECURSIVE {ALERTS}, ch AS (
    SELECT *, 0 AS seq, message AS m, false AS dup FROM alerts
    UNION ALL SELECT *, 1, 'later ' || message, true FROM alerts WHERE user_id % 3 = 0)
  SELECT {SHAPED.format(h="md5(alert_id)")} AS alert_id,
    CASE WHEN min(event_id) % 2 = 0 THEN {SHAPED.format(h="md5(log_id)")} END AS log_id,
    arg_min(left(m, 255), seq) AS message, arg_max(NOT dup, seq) AS slack_sent, arg_max(dup, seq) AS deduplicated,
    min(anomaly_score) AS anomaly_score, '{END.replace(" ", "T")}.000000' AS created_at
  FROM ch GROUP BY alert_id, log_id""",
)
def alerts_upsert(spark, sf_dir):
    rows = inputs.alerts(spark, sf_dir).withColumns(
        {
            "alert_id": F.upper(shaped_uuid(F.md5("alert_id"))),
            "log_id": F.when(F.col("event_id") % 2 == 0, shaped_uuid(F.md5("log_id"))).otherwise(F.col("log_id")),
        }
    )
    first = rows.withColumns({"seq": F.lit(0), "deduplicated": F.lit(False)})
    later = rows.filter("user_id % 3 = 0").withColumns(
        {"seq": F.lit(1), "deduplicated": F.lit(True), "message": F.concat(F.lit("later "), "message")}
    )
    changes = alerting.history_rows(alerting.mark_notified(first.unionByName(later), ["slack", "email"]), the_end())
    now = alerting.alerts_upsert(changes)
    return now.select(
        "alert_id", "log_id", "message", "slack_sent", "deduplicated", "anomaly_score", stamp("created_at")
    )


@query(
    "history_rows",
    f"""WITH RECURSIVE {HISTORY} SELECT alert_id, service, level, slack_sent, email_sent, deduplicated,
  CASE WHEN slack_sent THEN 'slack,email' ELSE '' END AS channels FROM history""",
)
def history_rows(spark, sf_dir):
    channels = F.coalesce(F.array_join("notification_channels", ","), F.lit("")).alias("channels")
    return inputs.history(spark, sf_dir).select(
        "alert_id", "service", "level", "slack_sent", "email_sent", "deduplicated", channels
    )


@query(
    "serialise_alerts",
    f"""WITH RECURSIVE {HISTORY} SELECT alert_id, anomaly_score AS score,
  {iso("detected_at")} || '+00:00' AS detected_at, CAST(json_extract_string(metadata, '$.k') AS INTEGER) AS k
  FROM history""",
)
def serialise_alerts(spark, sf_dir):
    marked = alerting.mark_notified(inputs.flagged_alerts(spark, sf_dir), ["slack", "email"])
    marked = marked.withColumn("features", F.col("metadata"))
    rows = alerting.serialise_alerts(alerting.history_rows(marked, the_end(), require_uuid=False))
    return rows.select(
        "alert_id", "score", "detected_at", F.try_variant_get("anomaly_features", "$.k", "int").alias("k")
    )


@query(
    "normalise_alerts",
    f"""WITH {ALERTS} SELECT alert_id AS id, log_id, service, lower(level) AS level,
  CASE WHEN level IN ('CRITICAL', 'ERROR') THEN 'error' WHEN level = 'WARN' THEN 'warn' ELSE 'info' END AS severity,
  message, anomaly_score AS score, {iso("detected_at")} AS detected_at FROM alerts""",
)
def normalise_alerts(spark, sf_dir):
    return stamped(alerting.normalise_alerts(inputs.alerts(spark, sf_dir)), "detected_at")


# ---------------------------------------------------------------- notifications

EMOJI_SQL = f"""CASE {SEVERITY_SQL} WHEN 'CRITICAL' THEN ':rotating_light:' WHEN 'HIGH' THEN ':red_circle:'
  WHEN 'MEDIUM' THEN ':large_yellow_circle:' ELSE ':large_blue_circle:' END"""


@query(
    "notification_outbox",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)}, n AS (SELECT *, {SEVERITY_SQL} AS severity, {EMOJI_SQL} AS emoji
    FROM flagged WHERE NOT deduplicated)
  SELECT alert_id, 'slack' AS channel, severity, emoji || ' *Anomaly Detected* — `' || service || '` [' || severity
    || ']' AS title, '*Message:* ' || left(message, 200) AS text FROM n
  UNION ALL SELECT alert_id, 'email', severity, '[LogTide] [' || severity || '] Anomaly Detected in ' || service,
    'Log Message: ' || left(message, 500) FROM n""",
)
def notification_outbox(spark, sf_dir):
    rows = alerting.notification_outbox(inputs.flagged_alerts(spark, sf_dir), ["slack", "email"])
    chat = F.get_json_object("body", "$.attachments[0].text")
    mail = F.element_at(F.split("body", "\n"), -1)
    text = F.when(F.col("channel") == "slack", chat).otherwise(mail)
    return rows.select("alert_id", "channel", "severity", "title", text.alias("text"))


SCORE_TEXT = r"regexp_replace(printf('%.4f', round_even(anomaly_score, 4) + 0.0), '(\.\d+?)0+$', '\1')"


@query(
    "mail_bodies",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)} SELECT alert_id, concat_ws(chr(10), 'LogTide Anomaly Alert',
    'Severity: ' || {SEVERITY_SQL}, 'Service: ' || service, 'Level: ' || level, 'Anomaly Score: ' || {SCORE_TEXT},
    'Response Time: ' || coalesce(CAST(response_time_ms AS VARCHAR) || ' ms', 'N/A'),
    'Error Code: ' || coalesce(CAST(error_code AS VARCHAR), 'N/A'), 'Host: ' || coalesce(host, 'N/A'),
    'Detected At: ' || strftime(detected_at, '%Y-%m-%d %H:%M:%S') || ' UTC', 'Alert ID: ' || alert_id,
    'Log Message: ' || left(message, 500)) AS body
  FROM flagged WHERE NOT deduplicated""",
)
def mail_bodies(spark, sf_dir):
    return alerting.notification_outbox(inputs.flagged_alerts(spark, sf_dir), ["email"]).select("alert_id", "body")


@query(
    "chat_payloads",
    f"""WITH RECURSIVE {KEYED}, {flagged(86_400)}, n AS (SELECT *, {SEVERITY_SQL} AS severity, {EMOJI_SQL} AS emoji
    FROM flagged WHERE NOT deduplicated)
  SELECT alert_id, 'LogTide' AS username, ':rotating_light:' AS icon_emoji, '#alerts' AS channel,
    emoji || ' *Anomaly Detected* — `' || service || '` [' || severity || ']' AS text,
    CASE severity WHEN 'CRITICAL' THEN '#FF0000' WHEN 'HIGH' THEN '#FF6600' WHEN 'MEDIUM' THEN '#FFCC00'
      ELSE '#36A64F' END AS color,
    '[' || severity || '] Anomaly in ' || service || ': ' || left(message, 200) AS fallback,
    emoji || ' LogTide Anomaly Alert [' || severity || ']' AS title,
    'LogTide | Alert ID: ' || left(alert_id, 8) || '...' AS footer, epoch_us(detected_at) // 1000000 AS ts,
    'Service=`' || service || '`;Level=' || level || ';Anomaly Score=' || {SCORE_TEXT} || ';Severity=' || severity
      || coalesce(';Response Time=' || CAST(response_time_ms AS VARCHAR) || 'ms', '')
      || coalesce(';Error Code=' || CAST(error_code AS VARCHAR), '') AS fields
  FROM n""",
)
def chat_payloads(spark, sf_dir):
    """Every member of the chat payload."""
    rows = alerting.notification_outbox(inputs.flagged_alerts(spark, sf_dir), ["slack"])
    inner = "color: string, fallback: string, title: string, footer: string, ts: bigint, fields: array<struct<title: string, value: string>>"
    schema = f"username string, icon_emoji string, channel string, text string, attachments array<struct<{inner}>>"
    parsed = rows.select("alert_id", F.from_json("body", schema).alias("p")).withColumn("a", F.col("p.attachments")[0])
    fields = F.array_join(F.transform("a.fields", lambda f: F.concat_ws("=", f["title"], f["value"])), ";")
    return parsed.select(
        "alert_id",
        *[F.col(f"p.{c}").alias(c) for c in ("username", "icon_emoji", "channel", "text")],
        *[F.col(f"a.{c}").alias(c) for c in ("color", "fallback", "title", "footer", "ts")],
        fields.alias("fields"),
    )


@query("alert_topic_records", f"""WITH {ALERTS} SELECT service AS key, alert_id,
  {iso("detected_at")} || '+00:00' AS detected_at FROM alerts""")
def alert_topic_records(spark, sf_dir):
    from logtide.sources import topics

    rows = inputs.alerts(spark, sf_dir).select("alert_id", "service", "detected_at", "anomaly_score")
    out = topics.to_topic_records(rows, topics.ALERT_TOPIC, headers={"kind": "alert"})
    return out.select(
        "key",
        F.get_json_object("value", "$.alert_id").alias("alert_id"),
        F.get_json_object("value", "$.detected_at").alias("detected_at"),
    )


