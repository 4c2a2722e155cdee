"""Minute roll-ups of logs and alerts: counts, latency sums, histogram slots and quantile sketches that can be merged.

A roll-up row stands for all rows of one minute, service and level. Rows of the same key from several batches are added up
when they are read or compacted, so a stream keeps roll-ups by upserting those of each micro-batch. Questions about recent
time then read a few rows per minute instead of the logs: whole minutes come from the roll-ups, the part of a minute at the
start of a window from the logs themselves, if they are given.

Rows without time are in no minute. A missing service or level is an empty text. Latency sums, histogram and sketch are over
rows that have a latency. Quantiles come from KLL sketches: of n values the rank is off by about 1.3 % of n at ``K`` = 200.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators.stats import LATENCY_BOUNDS_MS
from logtide.sources.snapshots import SnapshotTable

K = 200
KEYS = ["log_date", "minute", "service", "level"]
SLOTS = [f"slot_{i}" for i in range(len(LATENCY_BOUNDS_MS) + 1)]
SUMS = ["n", "errors", "latency_n", "latency_sum", *SLOTS]
ERROR_LEVELS = ("ERROR", "CRITICAL")


def _minute(time: str) -> Column:
    return F.date_trunc("minute", F.col(time))


def minute_rollup(logs: DataFrame, time: str = "event_time", latency: str = "response_time_ms") -> DataFrame:
    """One row per minute, service and level."""
    value = F.col(latency).cast("double")
    bounds = [None, *LATENCY_BOUNDS_MS, None]
    slots = []
    for i, name in enumerate(SLOTS):
        low, high = bounds[i], bounds[i + 1]
        inside = value.isNotNull() if low is None else value > low
        slots.append(F.count_if(inside if high is None else inside & (value <= high)).alias(name))
    minute = _minute(time)
    keyed = [F.to_date(minute).alias("log_date"), minute.alias("minute")]
    keyed += [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("service", "level")]
    return logs.groupBy(*keyed).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("level").isin(*ERROR_LEVELS)).alias("errors"),
        F.count(value).alias("latency_n"),
        F.coalesce(F.sum(value), F.lit(0.0)).alias("latency_sum"),
        *slots,
        F.max(value).alias("latency_max"),
        F.kll_sketch_agg_double(value, F.lit(K)).alias("latency_sketch"),
    )


def merge_rollups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Roll-up rows added up by their keys, or by some of them."""
    by = KEYS if by is None else by
    sketch = F.kll_merge_agg_double("latency_sketch").alias("latency_sketch")
    sums = [F.sum(c).alias(c) for c in SUMS]
    return rows.groupBy(*by).agg(*sums, F.max("latency_max").alias("latency_max"), sketch)


def alert_rollup(alerts: DataFrame, time: str = "detected_at") -> DataFrame:
    """Alerts per minute and service, all and those that are no duplicates."""
    minute = _minute(time)
    dup = F.coalesce("deduplicated", F.lit(False)) if "deduplicated" in alerts.columns else F.lit(False)
    service = F.coalesce("service", F.lit("")).alias("service")
    return alerts.groupBy(F.to_date(minute).alias("log_date"), minute.alias("minute"), service).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~dup).alias("n_unique")
    )


def log_rollup_table(spark: SparkSession, path: str) -> SnapshotTable:
    texts = [T.StructField(c, T.StringType()) for c in ("service", "level")]
    counts = [T.StructField(c, T.DoubleType() if c == "latency_sum" else T.LongType()) for c in SUMS]
    more = [T.StructField("latency_max", T.DoubleType()), T.StructField("latency_sketch", T.BinaryType())]
    schema = T.StructType([T.StructField("minute", T.TimestampType()), *texts, *counts, *more])
    return SnapshotTable(spark, path, schema, ["minute"], lambda base, deltas: merge_rollups(base.unionByName(deltas)))


def alert_rollup_table(spark: SparkSession, path: str) -> SnapshotTable:
    schema = T.StructType(
        [
            T.StructField("minute", T.TimestampType()),
            T.StructField("service", T.StringType()),
            T.StructField("n", T.LongType()),
            T.StructField("n_unique", T.LongType()),
        ]
    )

    def merge(base: DataFrame, deltas: DataFrame) -> DataFrame:
        both = base.unionByName(deltas).groupBy("log_date", "minute", "service")
        return both.agg(F.sum("n").alias("n"), F.sum("n_unique").alias("n_unique"))

    return SnapshotTable(spark, path, schema, ["minute"], merge)


def _seconds(n: int) -> Column:
    return F.make_dt_interval(secs=F.lit(n))


def _whole(start: Column) -> Column:
    """The first whole minute from ``start`` on."""
    floor = F.date_trunc("minute", start)
    return F.when(floor == start, start).otherwise(floor + _seconds(60))


def counts_since(
    rollup: DataFrame, starts: dict[str, Column], n: str = "n", rows: DataFrame | None = None, time: str = "event_time"
) -> DataFrame:
    """One row: how many rows each start has behind it, in whole minutes of the roll-up and the rows before the first.

    Without ``rows`` starts must be whole minutes.
    """
    whole = {name: _whole(start) for name, start in starts.items()}
    first = F.least(*whole.values()) if len(whole) > 1 else next(iter(whole.values()))
    recent = rollup.where((F.col("log_date") >= F.to_date(first)) & (F.col("minute") >= first))
    out = recent.agg(*[F.coalesce(F.sum(F.when(F.col("minute") >= w, F.col(n))), F.lit(0)).alias(name) for name, w in whole.items()])
    if rows is None:
        return out
    inside = {name: (F.col(time) >= starts[name]) & (F.col(time) < whole[name]) for name in starts}
    some = F.lit(False)
    for cut in inside.values():
        some = some | cut
    edges = rows.where(some).agg(F.struct(*[F.count_if(cut).alias(name) for name, cut in inside.items()]).alias("e"))
    return out.withColumn("_e", edges.scalar()).select(*[(F.col(name) + F.col(f"_e.{name}")).alias(name) for name in starts])


def system_stats(
    log_rollup: DataFrame,
    alert_rollup: DataFrame,
    as_of: Column,
    window_minutes: int = 60,
    unique_only: bool = False,
    logs: DataFrame | None = None,
    alerts: DataFrame | None = None,
) -> DataFrame:
    """The row of ``stats.system_stats`` from roll-ups. ``logs`` and ``alerts`` are needed unless ``as_of`` is a whole minute."""
    if not 1 <= window_minutes <= 1440:
        raise ValueError("window_minutes is 1..1440")
    spans = {"logs_last_minute": 60, "logs_last_hour": 3600, "logs_last_window": window_minutes * 60}
    counts = counts_since(log_rollup, {name: as_of - _seconds(s) for name, s in spans.items()}, rows=logs)
    n = "n_unique" if unique_only else "n"
    if alerts is not None and unique_only:
        alerts = alerts.where(~F.col("deduplicated"))
    hour = counts_since(alert_rollup, {"anomalies_last_hour": as_of - _seconds(3600)}, n, alerts, "detected_at")
    total = alert_rollup.agg(F.coalesce(F.sum(n), F.lit(0)))
    rate = F.col("anomalies_last_hour") / F.greatest(F.col("logs_last_hour"), F.lit(1)) * 100
    return (
        counts.withColumns({"anomalies_last_hour": hour.scalar(), "total_anomalies": total.scalar()})
        .withColumn("window_minutes", F.lit(window_minutes))
        .withColumn("log_rate_per_second", F.bround(F.col("logs_last_minute") / 60, 2))
        .withColumn("anomaly_rate_percent", F.bround(rate, 2))
    )


def latency_histogram(rollup: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Cumulative latency buckets (le, n) with sum and count, from the slots of the roll-up."""
    by = by or []
    total = rollup.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("latency_n", "latency_sum", *SLOTS)]).where("latency_n > 0")
    edges = [*[str(b) for b in LATENCY_BOUNDS_MS], "+Inf"]
    running, buckets = F.lit(0).cast("long"), []
    for edge, slot in zip(edges, SLOTS, strict=True):
        running = running + F.col(slot)
        buckets.append(F.struct(F.lit(edge).alias("le"), running.alias("n")))
    wide = total.select(*by, F.col("latency_n").alias("count"), F.col("latency_sum").alias("sum"), F.explode(F.array(*buckets)).alias("b"))
    return wide.select(*by, "b.le", "b.n", "count", "sum")


def latency_quantiles(rollup: DataFrame, points: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """Estimated latency quantiles, one column per point, from the merged sketches."""
    by = by or []
    known = rollup.where("latency_n > 0")
    merged = known.groupBy(*by).agg(F.sum("latency_n").alias("n"), F.kll_merge_agg_double("latency_sketch").alias("s"))
    merged = merged.where("n > 0")
    return merged.select(*by, "n", *[F.kll_sketch_get_quantile_double("s", F.lit(float(p))).alias(name) for name, p in points.items()])


def per_minute(rollup: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Tumbling counts per minute."""
    return rollup.groupBy(F.col("minute").alias("bucket"), *(by or [])).agg(F.sum("n").alias("n"))
