"""Alerts: from scored logs, with notifications, into a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import alerting as A
from logtide.functions.text import canonical_uuid, clean_text, iso_text, shaped_uuid
from logtide.schemas import ALERT_HISTORY

TEXT_LIMIT = 255
STATUS_COLUMNS = ["slack_sent", "email_sent", "deduplicated", "notification_channels"]


def detect_anomalies(scored: DataFrame, threshold: float = 0.0, score: str = "anomaly_score") -> DataFrame:
    """Scored rows below the threshold."""
    return scored.filter(F.col(score) < threshold)


def build_alerts(
    scored: DataFrame, detected_at: Column, alert_id: Column | None = None, threshold: float | None = 0.0
) -> DataFrame:
    """One alert per anomalous row, with a snapshot of the log and its features."""
    rows = scored if threshold is None else detect_anomalies(scored, threshold)
    made = F.uuid() if alert_id is None else alert_id
    snapshot = [
        "service",
        "level",
        "message",
        "host",
        "event_time",
        "response_time_ms",
        "error_code",
        "anomaly_score",
        "prediction",
        "is_anomaly",
        "features",
    ]
    have = [c for c in snapshot if c in rows.columns]
    return rows.select(made.alias("alert_id"), "log_id", detected_at.alias("detected_at"), *have)


def snapshot_from_logs(detections: DataFrame, logs: DataFrame, snapshot: list[str]) -> DataFrame:
    """Alert rows rebuilt from bare detections (log_id, score, ...) and the log table."""
    return detections.join(logs.select("log_id", *snapshot), "log_id")


def repeatable_alert_id(*parts: str) -> Column:
    """Alert id that a retried task computes again from the same columns."""
    return shaped_uuid(F.sha2(F.concat_ws("|", *[F.col(p).cast("string") for p in parts]), 256))


def notification_outbox(
    alerts: DataFrame,
    channels: list[str],
    brand: str = "LogTide",
    chat_channel: str = "#alerts",
    chat_icon: str = ":rotating_light:",
) -> DataFrame:
    """One row per (notifying alert, channel) with the rendered texts. Delivery is up to the reader."""
    rows = alerts.filter(~F.col("deduplicated")) if "deduplicated" in alerts.columns else alerts
    severity = A.severity(F.col("anomaly_score"), F.col("level"))
    rows = rows.withColumn("severity", severity).withColumn(
        "channel", F.explode(F.array(*[F.lit(c) for c in channels]))
    )
    chat = F.col("channel") == "slack"
    return rows.select(
        "alert_id",
        "channel",
        "service",
        "severity",
        F.when(chat, chat_text()).otherwise(mail_subject(brand)).alias("title"),
        F.when(chat, chat_payload(brand, chat_channel, chat_icon)).otherwise(mail_body(brand)).alias("body"),
    )


def _score_text() -> Column:
    """Four digits, zeros behind the last one cut, never in scientific form; no score counts as 0."""
    digits = F.format_string("%.4f", F.bround(F.coalesce("anomaly_score", F.lit(0.0)), 4) + F.lit(0.0))
    return F.regexp_replace(digits, r"(\.\d+?)0+$", "$1")


def _service() -> Column:
    return F.coalesce("service", F.lit("unknown"))


def _level() -> Column:
    return F.coalesce("level", F.lit("UNKNOWN"))


def chat_text() -> Column:
    emoji = A.lookup(F.col("severity"), A.SEVERITY_EMOJI)
    return F.concat(emoji, F.lit(" *Anomaly Detected* — `"), _service(), F.lit("` ["), "severity", F.lit("]"))


def chat_payload(brand: str, chat_channel: str, chat_icon: str = ":rotating_light:") -> Column:
    """JSON for a chat webhook: sender, colour, text and the fields that have a value."""

    def field(title: str, value: Column) -> Column:
        return F.when(
            value.isNotNull(),
            F.struct(F.lit(title).alias("title"), value.alias("value"), F.lit(True).alias("short")),
        )

    message = F.left(F.coalesce("message", F.lit("")), F.lit(200))
    emoji = A.lookup(F.col("severity"), A.SEVERITY_EMOJI)
    fields = F.array_compact(
        F.array(
            field("Service", F.concat(F.lit("`"), _service(), F.lit("`"))),
            field("Level", _level()),
            field("Anomaly Score", _score_text()),
            field("Severity", F.col("severity")),
            field("Response Time", F.concat(F.col("response_time_ms").cast("string"), F.lit("ms"))),
            field("Error Code", F.col("error_code").cast("string")),
        )
    )
    attachment = F.struct(
        A.lookup(F.col("severity"), A.SEVERITY_COLOR).alias("color"),
        F.concat(F.lit("["), "severity", F.lit("] Anomaly in "), _service(), F.lit(": "), message).alias("fallback"),
        F.concat(emoji, F.lit(f" {brand} Anomaly Alert ["), "severity", F.lit("]")).alias("title"),
        F.concat(F.lit("*Message:* "), message).alias("text"),
        fields.alias("fields"),
        F.concat(F.lit(f"{brand} | Alert ID: "), F.left("alert_id", F.lit(8)), F.lit("...")).alias("footer"),
        F.unix_seconds("detected_at").alias("ts"),
    )
    return F.to_json(
        F.struct(
            F.lit(brand).alias("username"),
            F.lit(chat_icon).alias("icon_emoji"),
            F.lit(chat_channel).alias("channel"),
            chat_text().alias("text"),
            F.array(attachment).alias("attachments"),
        )
    )


def mail_subject(brand: str) -> Column:
    return F.concat(F.lit(f"[{brand}] ["), "severity", F.lit("] Anomaly Detected in "), _service())


def mail_body(brand: str) -> Column:
    """Plain listing of the alert; the message is cut to 500 characters."""

    def line(title: str, value: Column) -> Column:
        return F.concat(F.lit(f"{title}: "), F.coalesce(value.cast("string"), F.lit("N/A")))

    when = F.concat(F.date_format("detected_at", "yyyy-MM-dd HH:mm:ss"), F.lit(" UTC"))
    return F.concat_ws(
        "\n",
        F.lit(f"{brand} Anomaly Alert"),
        line("Severity", F.col("severity")),
        line("Service", _service()),
        line("Level", _level()),
        line("Anomaly Score", _score_text()),
        line("Response Time", F.concat(F.col("response_time_ms").cast("string"), F.lit(" ms"))),
        line("Error Code", F.col("error_code")),
        line("Host", F.col("host")),
        line("Detected At", when),
        line("Alert ID", F.col("alert_id")),
        line("Log Message", F.left(F.coalesce("message", F.lit("")), F.lit(500))),
    )


def mark_notified(flagged: DataFrame, channels: list[str]) -> DataFrame:
    """Channels an alert went to: all enabled ones, none for a duplicate."""
    sent = F.array(*[F.lit(c) for c in channels]).cast("array<string>")
    none = F.array().cast("array<string>")
    rows = flagged.withColumn("notification_channels", F.when(F.col("deduplicated"), none).otherwise(sent))
    return rows.withColumn("notification_sent", F.size("notification_channels") > 0)


def history_rows(
    alerts: DataFrame, now: Column, text_limit: int = TEXT_LIMIT, require_uuid: bool = True
) -> DataFrame:
    """Alert rows in the shape of the history table: checked ids, cut texts, defaults, channel flags."""
    have = alerts.columns

    def text(name: str) -> Column:
        return clean_text(F.col(name), text_limit) if name in have else F.lit(None).cast("string")

    def flag(name: str) -> Column:
        sent = F.array_contains("notification_channels", name)
        return F.coalesce(sent, F.lit(False)) if "notification_channels" in have else F.lit(False)

    if require_uuid:
        # a bad alert id is replaced by a digest of the row, the same on every retry
        fallback = shaped_uuid(F.sha2(F.to_json(F.struct(*have)), 256))
        alert_id = F.coalesce(canonical_uuid(F.col("alert_id")), fallback)
        log_id = canonical_uuid(F.col("log_id"))
    else:
        alert_id, log_id = F.col("alert_id"), F.col("log_id")
    channels = F.col("notification_channels") if "notification_channels" in have else F.array()
    features = F.lit(None).cast("string")
    if "features" in have:
        as_text = dict(alerts.dtypes)["features"] == "string"
        valid = F.when(F.try_parse_json("features").isNotNull(), F.col("features")) if as_text else None
        features = valid if as_text else F.to_json("features")
    dup = F.coalesce("deduplicated", F.lit(False)) if "deduplicated" in have else F.lit(False)
    extra = [c for c in ("seq",) if c in have]
    return alerts.select(
        alert_id.alias("alert_id"),
        log_id.alias("log_id"),
        *[text(c).alias(c) for c in ("service", "level", "message")],
        F.col("anomaly_score").try_cast("double").alias("anomaly_score"),
        text("host").alias("host"),
        F.col("response_time_ms").try_cast("double").alias("response_time_ms"),
        F.col("error_code").try_cast("int").alias("error_code"),
        F.coalesce(F.col("detected_at").try_cast("timestamp"), now).alias("detected_at"),
        flag("slack").alias("slack_sent"),
        flag("email").alias("email_sent"),
        dup.alias("deduplicated"),
        F.when(F.size(channels) > 0, channels.cast("array<string>")).alias("notification_channels"),
        features.alias("features"),
        now.alias("created_at"),
        *extra,
    )


def alerts_upsert(changes: DataFrame, seq: str = "seq") -> DataFrame:
    """Current history from an append-only change log.

    The first change of an alert writes the row; later ones only move the notification status. Both ends of the
    log are found by one aggregation with partial combine.
    """
    fixed = [f.name for f in ALERT_HISTORY.fields if f.name not in STATUS_COLUMNS and f.name != "alert_id"]
    return (
        changes.groupBy("alert_id")
        .agg(
            F.min_by(F.struct(*fixed), seq).alias("first"),
            F.max_by(F.struct(*STATUS_COLUMNS), seq).alias("last"),
        )
        .select("alert_id", "first.*", "last.*")
        .select(*ALERT_HISTORY.fieldNames())
    )


def serialise_alerts(history: DataFrame) -> DataFrame:
    """Rows as a client gets them: ISO times, text ids, parsed features, ``score`` alias."""
    cols = []
    for name, kind in history.dtypes:
        col = F.col(name)
        cols.append(iso_text(col).alias(name) if kind.startswith("timestamp") else col)
    rows = history.select(*cols)
    if dict(history.dtypes).get("features") == "string":
        parsed = F.try_parse_json("features")
        rows = rows.withColumns({"features": parsed, "anomaly_features": parsed})
    return rows.withColumns({"score": F.col("anomaly_score"), "notified_via": F.col("notification_channels")})


def normalise_alerts(alerts: DataFrame) -> DataFrame:
    """Alert rows as the overview shows them, with alternative field names folded together."""
    have = alerts.columns

    def pick(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in have])

    level = F.lower(F.coalesce("level", F.lit("ERROR")))
    return alerts.select(
        pick("alert_id", "id").alias("id"),
        "log_id",
        F.coalesce("service", F.lit("unknown")).alias("service"),
        level.alias("level"),
        A.ui_severity(level).alias("severity"),
        F.coalesce("message", F.lit("Anomaly detected")).alias("message"),
        F.coalesce(pick("anomaly_score", "score").try_cast("double"), F.lit(0.0)).alias("score"),
        pick("detected_at", "created_at", "timestamp").alias("detected_at"),
    )


def with_severity(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("severity", A.severity(F.col("anomaly_score"), F.col("level")))
