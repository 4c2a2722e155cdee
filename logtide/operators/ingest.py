"""Batch ingest: unpack requests, check entries, add ids, report per request."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.text import clean_text, shaped_uuid
from logtide.operators.validate import entry_errors

MAX_BATCH = 100


def unpack_batches(requests: DataFrame, logs: str = "logs", max_batch: int = MAX_BATCH) -> DataFrame:
    """One row per entry with its position; ``batch_ok`` says whether the request size is allowed."""
    ok = F.size(logs).between(1, max_batch)
    keep = [c for c in requests.columns if c != logs]
    return (
        requests.select(*keep, ok.alias("batch_ok"), F.posexplode_outer(logs).alias("pos", "entry"))
        .select(*keep, "batch_ok", "pos", "entry.*")
    )


def batch_ingest_summary(requests: DataFrame, logs: str = "logs", max_batch: int = MAX_BATCH) -> DataFrame:
    """Per request: accepted and rejected counts, rejected positions with reasons, answer text.

    A request carries its entries in one array, so the checks run inside the row and nothing is shuffled.
    """
    size_ok = F.size(logs).between(1, max_batch)

    def verdict(entry: Column, pos: Column) -> Column:
        broken = F.transform(
            entry_errors(lambda name: entry[name]), lambda e: F.concat_ws(":", e["field"], e["rule"])
        )
        reason = F.when(~size_ok, "batch_size").otherwise(F.nullif(F.concat_ws(",", broken), F.lit("")))
        return F.when(reason.isNotNull(), F.struct(pos.alias("index"), reason.alias("reason")))

    rejected = F.array_compact(F.transform(logs, verdict))
    return (
        requests.withColumn("rejected_details", rejected)
        .withColumn("rejected", F.size("rejected_details"))
        .withColumn("accepted", F.size(logs) - F.col("rejected"))
        .withColumn("batch_ok", size_ok)
        .withColumn(
            "message", F.format_string("Batch processed: %d accepted, %d rejected.", "accepted", "rejected")
        )
        .drop(logs)
    )


def assign_log_ids(df: DataFrame, repeatable_from: list[str] | None = None) -> DataFrame:
    """Keep a given ``log_id``; fill a blank one.

    With ``repeatable_from`` the new id is a digest of those columns: a retried task gives the same id, and since the
    column is then deterministic, later filters still reach the scan. Without it the id is random.
    """
    fresh: Column = F.uuid()
    if repeatable_from:
        parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in repeatable_from]
        fresh = shaped_uuid(F.sha2(F.concat_ws("|", *parts), 256))
    return df.withColumn("log_id", F.coalesce(clean_text(F.col("log_id")), fresh))


def stamp_ingest(df: DataFrame, now: Column, repeatable_from: list[str] | None = None) -> DataFrame:
    """Server-side fields of an accepted entry: id, ingest time and, where absent, the event time."""
    filled = assign_log_ids(df, repeatable_from).withColumn("ingested_at", now)
    if "event_time" in df.columns:
        filled = filled.withColumn("event_time", F.coalesce("event_time", "ingested_at"))
    return filled
