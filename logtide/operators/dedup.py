"""Alert deduplication: an alert repeats another if that one notified less than a TTL ago.

Only a notifying alert (an *anchor*) opens a suppression interval of one TTL; suppressed alerts do not extend
it. Anchors of one key therefore form a chain: each is the first alert at or after the end of the interval of
the one before. The chain is sequential in time, yet a busy key must not sit in one task, so it is computed as
a parallel scan over chunks of at most ``CHUNK_ROWS`` alert times of a key:

1. per (key, chunk): a chain that is free to notify from time b on when it enters the chunk, from when is it free
   again when it leaves? The answer is a step function of b, kept as breakpoints, never more than there are times.
2. level by level, the step functions of ``FAN`` neighbours put after one another give that of their group. A chain
   enters within one TTL of the group's first alert, so it has at most a step for each alert time of that TTL.
3. from the top level down: with the time from which a group is free, run through its members to learn theirs.
4. per (key, chunk): replay the chain from that time.

A key of one chunk, as nearly all are, needs the last step only. No array is longer than ``CHUNK_ROWS`` or the number of
distinct alert times that one key has within one TTL, and no row holds more than ``FAN`` of them, however many alerts a
key has in all and however they are spaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions.alerting import dedup_key
from logtide.operators.quantiles import value_ranks
from logtide.session import materialise

MICROS = 1_000_000
DEFAULT_TTL = 3600
CHUNK_ROWS = 10_000
FAN = 16
NEVER = -(2**62)

EXITS = T.StructType(
    [
        T.StructField("upto", T.ArrayType(T.LongType())),
        T.StructField("leave", T.ArrayType(T.LongType())),
    ]
)


def with_dedup_key(alerts: DataFrame, out: str = "dedup_key") -> DataFrame:
    cols = [F.col(c) for c in ("service", "level", "error_code", "anomaly_score")]
    return alerts.withColumn(out, dedup_key(*cols))


def _steps(upto: np.ndarray, leave: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Join neighbouring steps with the same value."""
    last = np.append(leave[1:] != leave[:-1], True)
    return upto[last], leave[last]


def chunk_exits(ttl: int):
    """UDF over the sorted alert times of a chunk: free from ``upto`` or before means free again at ``leave``."""

    @F.pandas_udf(EXITS)
    def exits(times: pd.Series) -> pd.DataFrame:
        found = []
        for t in times:
            t = np.asarray(t, dtype=np.int64)
            after = np.searchsorted(t, t + ttl)
            last = np.where(after < len(t), after, np.arange(len(t)))
            while True:
                jump = last[last]
                if np.array_equal(jump, last):
                    break
                last = jump
            # a chain cannot enter later than one TTL after the first alert
            entries = np.searchsorted(t, t[0] + ttl, side="right") + 1
            found.append(_steps(t[:entries], t[last[:entries]] + ttl))
        return pd.DataFrame(found, columns=["upto", "leave"])

    return exits


def group_exits(ttl: int):
    """UDF over the step functions of the members of a group, in order: the step function of the group."""

    @F.pandas_udf(EXITS)
    def exits(uptos: pd.Series, leaves: pd.Series) -> pd.DataFrame:
        found = []
        for us, ls in zip(uptos, leaves):
            upto, leave = (np.asarray(x[0], dtype=np.int64) for x in (us, ls))
            last = upto[0] + ttl  # a chain cannot enter later than one TTL after the first alert
            for u, v in zip(us[1:], ls[1:]):
                u, v = np.asarray(u, dtype=np.int64), np.asarray(v, dtype=np.int64)
                at = np.searchsorted(u, leave)
                moved = np.where(at < len(u), v[np.minimum(at, len(u) - 1)], leave)
                beyond = u > upto[-1]
                upto, leave = _steps(np.append(upto, u[beyond]), np.append(moved, v[beyond]))
                entries = np.searchsorted(upto, last, side="right") + 1
                upto, leave = upto[:entries], leave[:entries]
            found.append((upto, leave))
        return pd.DataFrame(found, columns=["upto", "leave"])

    return exits


def replay_chain(ttl: int):
    """UDF over the sorted alert times of a chunk and the time from which the chain is free: the anchors."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def anchors(times: pd.Series, free: pd.Series) -> pd.Series:
        found = []
        for t, start in zip(times, free):
            t = np.asarray(t, dtype=np.int64)
            at, own = int(np.searchsorted(t, start)), []
            while at < len(t):
                own.append(int(t[at]))
                at = int(np.searchsorted(t, t[at] + ttl))
            found.append(own)
        return pd.Series(found)

    return anchors


def _entries(steps: DataFrame, keys: list[str], start: DataFrame | None) -> DataFrame:
    """(keys, node, free): from when the chain is free at each node, given where it starts per ``keys``."""
    per_key = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("node", "upto", "leave"))).alias("steps"))
    free = F.lit(NEVER).cast("bigint")
    if start is not None:
        per_key = per_key.join(start, keys, "left")
        free = F.coalesce("free", free)

    def advance(acc: Column, step: Column) -> Column:
        pos = F.size(F.filter(step["upto"], lambda u: u < acc["free"]))
        leave = F.coalesce(F.get(step["leave"], pos), acc["free"])
        entry = F.struct(step["node"].alias("node"), acc["free"].alias("free"))
        return F.struct(leave.alias("free"), F.concat(acc["entries"], F.array(entry)).alias("entries"))

    none = F.array().cast("array<struct<node:bigint,free:bigint>>")
    walked = F.aggregate("steps", F.struct(free.alias("free"), none.alias("entries")), advance)
    return per_key.select(*keys, F.explode(walked["entries"]).alias("e")).select(*keys, "e.*")


def _parent() -> Column:
    return F.expr(f"node div {FAN}").alias("_parent")


def anchor_times(
    times: DataFrame,
    keys: list[str],
    ttl_us: int,
    carried: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """(keys, us) of the anchors, from distinct (keys, us) rows. The result has one row per anchor.

    ``carried`` (keys, free) says until when earlier alerts suppress a key.
    """
    ranked = value_ranks(times, "us", band_width=float(ttl_us), by=keys)
    node = F.expr(f"n_before div {chunk_rows}").alias("node")
    chunks = ranked.groupBy(*keys, node).agg(F.array_sort(F.collect_list("us")).alias("times"))
    chunks = materialise(chunks, "alert-chunks")
    last = chunks.agg(F.max("node")).first()[0] or 0
    if not last:
        free = chunks if carried is None else chunks.join(carried.select(*keys, "free"), keys, "left")
        begin = F.lit(NEVER).cast("bigint") if carried is None else F.coalesce("free", F.lit(NEVER).cast("bigint"))
        return free.select(*keys, F.explode(replay_chain(ttl_us)("times", begin)).alias("us"))
    steps = [chunks.select(*keys, "node", chunk_exits(ttl_us)("times").alias("x")).select(*keys, "node", "x.*")]
    steps[0] = materialise(steps[0], "chunk-steps")
    while last >= FAN:
        # breakpoints lie inside their node, so sorting by them puts the nodes in order
        members = steps[-1].groupBy(*keys, _parent().alias("node")).agg(
            F.array_sort(F.collect_list(F.struct("upto", "leave"))).alias("s")
        )
        parts = [F.transform("s", lambda p: p["upto"]), F.transform("s", lambda p: p["leave"])]
        joined = members.select(*keys, "node", group_exits(ttl_us)(*parts).alias("x")).select(*keys, "node", "x.*")
        steps.append(materialise(joined, "group-steps"))
        last //= FAN
    entries = _entries(steps.pop(), keys, carried)
    while steps:
        above = entries.withColumnRenamed("node", "_parent")
        entries = _entries(steps.pop().withColumn("_parent", _parent()), [*keys, "_parent"], above).drop("_parent")
    placed = chunks.join(entries, [*keys, "node"])
    return placed.select(*keys, F.explode(replay_chain(ttl_us)("times", "free")).alias("us"))


def dedup_alerts(
    alerts: DataFrame,
    ttl_seconds: int = DEFAULT_TTL,
    key: str = "dedup_key",
    time: str = "detected_at",
    id_col: str = "alert_id",
    clears: DataFrame | None = None,
    carried: DataFrame | None = None,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Add ``deduplicated``: true if the alert repeats one that notified less than the TTL before.

    At equal time and key the smallest id notifies. An alert without key is never a duplicate. ``clears``
    (key, cleared_at) ends suppression: the next alert of the key notifies again. ``carried`` (key, free) holds
    the suppression still open from alerts before these, as a stream keeps it. ``chunk_rows`` bounds the alert times
    of one key that a row holds.

    The plan reads ``alerts`` four times, three of them only for key, time and id: give it as a stored table.
    """
    if clears is not None and carried is not None:
        raise ValueError("clears need the whole history of a key")
    rows = alerts.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    if key not in rows.columns:
        rows = with_dedup_key(rows, key)
    keys = [key]
    if clears is not None:
        rows = _number_clears(rows, clears, key)
        keys = [key, "_epoch"]
    firsts = (
        rows.filter(F.col(key).isNotNull())
        .groupBy(*keys, F.col("_us").alias("us"))
        .agg(F.min(id_col).alias("_first"))
    )
    anchors = anchor_times(firsts.select(*keys, "us"), keys, ttl_seconds * MICROS, carried, chunk_rows)
    notified = firsts.join(anchors, [*keys, "us"], "left_semi").withColumnsRenamed(
        {"us": "_us", "_first": id_col}
    ).withColumn("_notified", F.lit(True))
    return (
        rows.join(notified, [*keys, "_us", id_col], "left")
        .withColumn("deduplicated", F.col(key).isNotNull() & F.col("_notified").isNull())
        .select(*alerts.columns, *([key] if key not in alerts.columns else []), "deduplicated")
    )


def open_suppressions(
    flagged: DataFrame,
    ttl_seconds: int,
    carried: DataFrame | None = None,
    late_seconds: int = 600,
    key: str = "dedup_key",
    time: str = "detected_at",
    now: Column | None = None,
) -> DataFrame:
    """(key, free) to carry into the next batch: one row per key whose suppression may still matter.

    What is over is told by the latest alert that is not dated after ``now`` (the batch's own time), so an alert with a
    wrong date ends no suppression.
    """
    us = F.unix_micros(F.col(time).cast("timestamp"))
    notified = flagged.filter(~F.col("deduplicated") & F.col(key).isNotNull())
    ends = notified.groupBy(key).agg((F.max(us) + ttl_seconds * MICROS).alias("free"))
    if carried is not None:
        ends = ends.unionByName(carried.select(key, "free")).groupBy(key).agg(F.max("free").alias("free"))
    believed = F.lit(True) if now is None else F.col(time).cast("timestamp") <= now
    horizon = flagged.agg(F.max(F.when(believed, us)) - late_seconds * MICROS).scalar()
    return ends.filter(F.coalesce(F.col("free") > horizon, F.lit(True)))


def _number_clears(rows: DataFrame, clears: DataFrame, key: str) -> DataFrame:
    """Add ``_epoch``, the number of clears of the key before the row, by a running count over daily bands."""
    cleared_us = F.unix_micros(F.col("cleared_at").cast("timestamp")).alias("_us")
    both = rows.select(key, "_us", F.lit(0).alias("c")).unionByName(clears.select(key, cleared_us, F.lit(1).alias("c")))
    ranked = value_ranks(both, "_us", {"c": F.sum("c")}, band_width=86_400.0 * MICROS, by=[key])
    return rows.join(ranked.select(key, "_us", F.col("c_before").alias("_epoch")), [key, "_us"], "left")


def dedup_ttl_remaining(
    flagged: DataFrame,
    at: Column,
    ttl_seconds: int = DEFAULT_TTL,
    key: str = "dedup_key",
    time: str = "detected_at",
) -> DataFrame:
    """Per key the whole seconds of suppression left at a moment, -1 if none."""
    us = F.unix_micros(F.col(time).cast("timestamp"))
    now = F.unix_micros(at)
    anchor = F.max(F.when(~F.col("deduplicated") & (us <= now), us))
    left = anchor + ttl_seconds * MICROS - now
    return flagged.groupBy(key).agg(
        F.when(left > 0, F.floor(left / MICROS)).otherwise(-1).cast("bigint").alias("ttl_remaining")
    )
