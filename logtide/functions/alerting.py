"""Severity, deduplication key and message texts of alerts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logtide.functions.text import strip

# Display attributes of each severity (fixed values).
SEVERITY_EMOJI = {
    "CRITICAL": ":rotating_light:",
    "HIGH": ":red_circle:",
    "MEDIUM": ":large_yellow_circle:",
    "LOW": ":large_blue_circle:",
}
SEVERITY_COLOR = {"CRITICAL": "#FF0000", "HIGH": "#FF6600", "MEDIUM": "#FFCC00", "LOW": "#36A64F"}


def severity(score: Column, level: Column) -> Column:
    """CRITICAL, HIGH, MEDIUM or LOW from score and level; a missing score counts as 0."""
    s = F.coalesce(score, F.lit(0.0))
    name = F.upper(F.coalesce(level, F.lit("UNKNOWN")))
    return (
        F.when((s < -0.3) & name.isin("CRITICAL", "ERROR"), "CRITICAL")
        .when((s < -0.2) | (name == "ERROR"), "HIGH")
        .when(s < -0.1, "MEDIUM")
        .otherwise("LOW")
    )


def lookup(col: Column, table: dict[str, str]) -> Column:
    result = F.when(F.lit(False), F.lit(None).cast("string"))
    for key, value in table.items():
        result = result.when(col == key, value)
    return result


def score_bucket(score: Column) -> Column:
    """Score to one decimal, half to even, never minus zero."""
    return (F.bround(F.coalesce(score, F.lit(0.0)), 1) + F.lit(0.0)).cast("string")


def dedup_key(
    service: Column, level: Column, error_code: Column, score: Column, namespace: str = "alert:dedup:"
) -> Column:
    """Namespaced 16 hex digits that equal alerts share."""
    raw = F.concat_ws(
        ":",
        F.lower(strip(F.coalesce(F.nullif(service, F.lit("")), F.lit("unknown")))),
        F.upper(strip(F.coalesce(F.nullif(level, F.lit("")), F.lit("UNKNOWN")))),
        F.coalesce(error_code, F.lit(0)).cast("string"),
        score_bucket(score),
    )
    return F.concat(F.lit(namespace), F.left(F.sha2(raw, 256), F.lit(16)))


def ui_severity(level: Column) -> Column:
    """Three-way class of a free-text level: error, warn or info."""
    name = F.lower(F.coalesce(level, F.lit("ERROR")))
    return (
        F.when(name.contains("crit") | name.contains("err"), "error")
        .when(name.contains("warn"), "warn")
        .otherwise("info")
    )


def ui_level_class(level: Column) -> Column:
    """Four-way class of a free-text level: critical, error, warn or info."""
    name = F.lower(F.coalesce(F.nullif(level, F.lit("")), F.lit("INFO")))
    result = F.when(name.contains("critical"), "critical")
    for part in ("error", "warn"):
        result = result.when(name.contains(part), part)
    return result.otherwise("info")
