"""Record checks at the edges: ingest, processor and model input."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import normalise as N
from logtide.functions.features import cap_latency
from logtide.functions.text import is_blank, strip

# Levels the ingest edge accepts, in any case (fixed values).
INGEST_LEVELS = ["DEBUG", "INFO", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL"]


def _text_rules(field: str, col: Column, limit: int, required: bool) -> list[tuple[Column, str, str]]:
    rules = [(F.char_length(col) > limit, field, "too_long")]
    if required:
        rules.append((col.isNull(), field, "missing"))
        rules.append((is_blank(col), field, "blank"))
    return rules


def _number_rules(field: str, col: Column, number: Column, low: float, high: float) -> list[tuple[Column, str, str]]:
    return [
        (col.isNotNull() & number.isNull(), field, "not_a_number"),
        (~number.between(low, high), field, "out_of_range"),
    ]


def entry_rules(field: Callable[[str], Column] = F.col) -> list[tuple[Column, str, str]]:
    """(broken, field, rule) of every ingest rule. ``field`` looks a field up by name."""
    level, latency, code, when = (
        field(c) for c in ("level", "response_time_ms", "error_code", "timestamp")
    )
    readable = field("epoch_seconds").isNotNull() | N.parse_iso(when).isNotNull()
    return [
        *_text_rules("service", field("service"), 128, required=True),
        (level.isNull(), "level", "missing"),
        (~F.upper(level).isin(INGEST_LEVELS), "level", "unknown"),
        *_text_rules("message", field("message"), 4096, required=True),
        *_text_rules("host", field("host"), 253, required=False),
        *_number_rules("response_time_ms", latency, N.safe_double(latency), 0.0, 300_000.0),
        *_number_rules("error_code", code, N.safe_int(code), 0, 99_999),
        (when.isNotNull() & ~readable, "timestamp", "not_iso"),
    ]


def entry_errors(field: Callable[[str], Column] = F.col) -> Column:
    """Array of (field, rule) pairs a log entry breaks.

    A plain condition tells first whether any rule is broken; only then is the array put together.
    """
    rules = entry_rules(field)
    found = F.array_compact(
        F.array(*[F.when(c, F.struct(F.lit(f).alias("field"), F.lit(r).alias("rule"))) for c, f, r in rules])
    )
    broken = F.lit(False)
    for condition, _, _ in rules:
        broken = broken | F.coalesce(condition, F.lit(False))
    return F.when(broken, found).otherwise(F.array().cast("array<struct<field:string,rule:string>>"))


def validate_log_entries(df: DataFrame) -> DataFrame:
    """Add ``errors``; an empty array means accepted."""
    return df.withColumn("errors", entry_errors())


def split_valid(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted rows without ``errors``, rejected rows with them)."""
    ok = F.size("errors") == 0
    return validated.filter(ok).drop("errors"), validated.filter(~ok)


def accept_entries(validated: DataFrame) -> DataFrame:
    """Accepted entries in their stored form: trimmed text, upper-case level."""
    accepted, _ = split_valid(validated)
    return accepted.withColumns(
        {
            "service": N.clean_service(F.col("service")),
            "level": F.upper("level"),
            "message": strip(F.col("message")),
        }
    )


def malformed_reason() -> Column:
    """Why the processor cannot use a record; null when it can."""
    return (
        F.when(F.col("service").isNull() | (is_blank(F.col("service"))), "service")
        .when(F.col("message").isNull(), "message_missing")
        .when(is_blank(F.col("message")), "message_empty")
    )


def quarantine_malformed(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable records, unusable records with ``reason``).

    The filter of the usable ones names each field once: it is moved below the expressions that make the fields, and would
    work them out again at every mention. A null field is not blank and not usable: its comparison is null.
    """
    usable = df.filter(~is_blank(F.col("service")) & ~is_blank(F.col("message")))
    return usable, df.withColumn("reason", malformed_reason()).filter(F.col("reason").isNotNull())


def validate_features(df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``reason``: the first feature outside its domain, null when all are inside."""
    f = F.col(features)
    domains = [
        ("hour_of_day", 0, 23),
        ("response_time_ms", 0, None),
        ("error_code", 0, 5),
        ("log_level_encoded", 0, 4),
        ("request_count_last_60s", 0, None),
        ("service_id_encoded", 0, None),
    ]
    reason = F.when(f.isNull(), "features")
    for name, low, high in domains:
        value = f[name]
        inside = value >= low if high is None else value.between(low, high)
        reason = reason.when(~F.coalesce(inside, F.lit(False)), name)
    return df.withColumn("reason", reason)


def score_inputs(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows that can be scored: a feature struct is there, missing members get defaults, latency is capped."""
    f = F.col(features)
    defaults = {
        "hour_of_day": F.lit(0),
        "response_time_ms": F.lit(0.0),
        "error_code": F.lit(0),
        "log_level_encoded": F.lit(1),
        "request_count_last_60s": F.lit(0).cast("bigint"),
        "service_id_encoded": F.lit(0),
    }
    cols = []
    for name, default in defaults.items():
        value = F.coalesce(f[name], default)
        cols.append((cap_latency(value) if name == "response_time_ms" else value).alias(name))
    return df.filter(f.isNotNull()).withColumn(features, F.struct(*cols))
