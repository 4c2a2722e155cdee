"""Raw record to normalised log row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions import normalise as N
from logtide.functions.text import strip
from logtide.operators.ingest import assign_log_ids
from logtide.operators.validate import quarantine_malformed


def normalise_logs(
    raw: DataFrame,
    as_of: Column | None = None,
    processed_at: Column | None = None,
    repeatable_ids: list[str] | None = None,
) -> DataFrame:
    """Usable raw records with canonical values. Other columns of ``raw`` pass through.

    A record without readable time gets its ingest time, else ``as_of`` (default: now).
    """
    as_of = F.current_timestamp() if as_of is None else as_of
    have = dict(raw.dtypes)
    # strip once; everything below works on the stripped texts
    texts = [c for c in ("service", "level", "message", "host", "timestamp", "ingested_at") if have.get(c) == "string"]
    usable, _ = quarantine_malformed(assign_log_ids(raw, repeatable_ids))
    usable = usable.withColumns({f"_{c}": strip(F.col(c)) for c in texts})
    ingested = F.lit(None)
    if "ingested_at" in have:
        ingested = N.parse_iso(F.col("_ingested_at")) if "ingested_at" in texts else F.col("ingested_at")
    epoch = F.col("epoch_seconds") if "epoch_seconds" in have else None
    default = F.coalesce(ingested.cast("timestamp"), as_of)
    if "timestamp" in texts:
        event_time = N.normalise_timestamp(F.col("_timestamp"), epoch, default)
    else:
        event_time = F.coalesce(F.col("timestamp").cast("timestamp"), default)
    numeric = have["response_time_ms"] == "double"
    latency = F.coalesce("response_time_ms", F.lit(0.0)) if numeric else N.safe_double(F.col("response_time_ms"), 0.0)
    return usable.withColumns(
        {
            "service": F.lower("_service"),
            "level": N.canonical_level(F.upper("_level")),
            "message": F.col("_message"),
            "host": F.left(F.nullif("_host", F.lit("")), F.lit(253)),
            "event_time": event_time,
            "response_time_ms": F.greatest(F.lit(0.0), latency),
            "error_code": N.clean_error_code(F.col("error_code")),
            "processed_at": F.current_timestamp() if processed_at is None else processed_at,
        }
    ).drop("timestamp", "epoch_seconds", *[f"_{c}" for c in texts])
