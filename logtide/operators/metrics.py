"""Functions over metric samples (ts, metric, labels, value): rates, quantiles, ratios, latest values.

A series is one metric with one set of labels. Rates are computed in slices of time, so a series of any length spreads over
tasks: a slice also gets the samples of the slice before that its windows reach back to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MICROS = 1_000_000


def select_series(
    samples: DataFrame,
    metric: str,
    equal: dict[str, str] | None = None,
    not_equal: dict[str, str] | None = None,
    match: dict[str, str] | None = None,
) -> DataFrame:
    """Samples of a metric whose labels meet the conditions; patterns match the whole label value."""
    found = samples.filter(F.col("metric") == metric)
    for name, value in (equal or {}).items():
        found = found.filter(label(name) == value)
    for name, value in (not_equal or {}).items():
        found = found.filter(F.coalesce(label(name), F.lit("")) != value)
    for name, pattern in (match or {}).items():
        found = found.filter(label(name).rlike(f"^({pattern})$"))
    return found


def label(name: str) -> Column:
    return F.try_element_at("labels", F.lit(name))


def series_key() -> Column:
    """Labels in an order that can be grouped and sorted by."""
    return F.array_sort(F.map_entries("labels"))


SLICE_SECONDS = 86_400


def counter_rate(samples: DataFrame, window_seconds: int, slice_seconds: int | None = None) -> DataFrame:
    """Add ``increase`` over (t - window, t] and ``rate`` per second, for every sample of a counter.

    A value below the one before means the counter restarted from 0. Only steps between two samples inside the
    window count; nothing is extrapolated. A step needs the sample before only if that lies inside the window too, so a
    slice (a day, or the window if that is longer) is whole with the samples of one window before it.
    """
    width = max(slice_seconds or SLICE_SECONDS, window_seconds) * MICROS
    rows = samples.withColumn("_series", series_key()).withColumn("_us", F.unix_micros("ts"))
    own = F.floor(F.col("_us") / width)
    to_end = (own + 1) * width - F.col("_us")
    slices = F.when(to_end < window_seconds * MICROS, F.array(own, own + 1)).otherwise(F.array(own))
    rows = rows.select("*", own.alias("_own"), F.explode(slices).alias("_slice"))
    in_time = Window.partitionBy("metric", "_series", "_slice").orderBy("_us")
    before = F.lag("value").over(in_time)
    step = F.when(before.isNull(), 0.0).when(F.col("value") < before, F.col("value")).otherwise(
        F.col("value") - before
    )
    recent = in_time.rangeBetween(1 - window_seconds * MICROS, 0)
    return (
        rows.withColumn("_step", step)
        .withColumn("_total", F.sum("_step").over(in_time.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("increase", F.col("_total") - F.min("_total").over(recent))
        .withColumn("rate", F.col("increase") / window_seconds)
        .where(F.col("_own") == F.col("_slice"))
        .drop("_series", "_us", "_step", "_total", "_own", "_slice")
    )


def sum_by(vector: DataFrame, value: str = "rate", by: list[str] | None = None, out: str = "value") -> DataFrame:
    """Sum over all series, or per label, at each time."""
    groups = [label(b).alias(b) for b in by or []]
    return vector.groupBy("ts", *groups).agg(F.sum(value).alias(out))


def cpu_busy(samples: DataFrame, metric: str = "node_cpu_seconds_total", window_seconds: int = 300) -> DataFrame:
    """100 minus the average idle percentage per instance."""
    idle = counter_rate(select_series(samples, metric, equal={"mode": "idle"}), window_seconds)
    return idle.groupBy("ts", label("instance").alias("instance")).agg(
        (100 - F.avg("rate") * 100).alias("value")
    )


def services_up(samples: DataFrame, job_pattern: str, metric: str = "up") -> DataFrame:
    """Number of matching targets that are up, at each time."""
    found = select_series(samples, metric, match={"job": job_pattern})
    return found.groupBy("ts").agg(F.count_if(F.col("value") == 1).alias("value"))


def error_ratio(
    samples: DataFrame,
    metric: str = "http_requests_total",
    pattern: str = "5..",
    window_seconds: int = 300,
    by: list[str] | None = None,
) -> DataFrame:
    """Rate of requests with a matching status over the rate of all, null when there are none."""
    rates = counter_rate(select_series(samples, metric), window_seconds)
    groups = [label(b).alias(b) for b in by or []]
    wrong = F.sum(F.when(label("status_code").rlike(f"^({pattern})$"), F.col("rate")).otherwise(0.0))
    return rates.groupBy("ts", *groups).agg(F.try_divide(wrong, F.sum("rate")).alias("value"))


def histogram_quantiles(
    buckets: DataFrame, points: dict[str, float], value: str = "rate", by: list[str] | None = None
) -> DataFrame:
    """Quantiles from cumulative buckets with label ``le``, interpolated inside the bucket they fall in.

    The lowest bucket starts at 0; a quantile in the last, open bucket is the highest finite bound. The buckets
    of one group and time form a short array: there are as many as there are bounds.
    """
    groups = [label(b).alias(b) for b in by or []]
    bound = F.when(label("le") == "+Inf", float("inf")).otherwise(label("le").try_cast("double"))
    per_le = buckets.groupBy("ts", *groups, bound.alias("le")).agg(F.sum(value).alias("n"))
    names = ["ts", *(by or [])]
    rows = per_le.groupBy(*names).agg(F.array_sort(F.collect_list(F.struct("le", "n"))).alias("b"))

    def quantile(q: float) -> Column:
        total = F.element_at("b", -1)["n"]
        rank = F.lit(q) * total
        above = F.size(F.filter("b", lambda x: x["n"] < rank)) + 1
        here, below = F.get("b", above - 1), F.get("b", above - 2)
        low = F.coalesce(below["le"], F.lit(0.0))
        seen = F.coalesce(below["n"], F.lit(0.0))
        inside = low + (here["le"] - low) * F.try_divide(rank - seen, here["n"] - seen)
        return F.when(total > 0, F.when(here["le"] == float("inf"), below["le"]).otherwise(inside))

    return rows.select(*names, *[quantile(q).alias(n) for n, q in points.items()])


def ratio_percent(
    samples: DataFrame, top: str, bottom: str, on: list[str], not_equal: dict[str, str] | None = None
) -> DataFrame:
    """``top`` / ``bottom`` * 100 for series with the same labels at the same time, in one aggregation."""
    found = select_series(samples, top, not_equal=not_equal).unionByName(
        select_series(samples, bottom, not_equal=not_equal)
    )
    groups = [label(b).alias(b) for b in on]
    part = {m: F.max(F.when(F.col("metric") == m, F.col("value"))) for m in (top, bottom)}
    return (
        found.groupBy("ts", *groups)
        .agg(part[top].alias("_top"), part[bottom].alias("_bottom"))
        .filter(F.col("_top").isNotNull() & F.col("_bottom").isNotNull())
        .withColumn("value", F.try_divide("_top", "_bottom") * 100)
        .drop("_top", "_bottom")
    )


def latest_values(samples: DataFrame, by: list[str]) -> DataFrame:
    """Last value of each series."""
    return samples.groupBy("metric", *[label(b).alias(b) for b in by]).agg(
        F.max_by("value", "ts").alias("value"), F.max("ts").alias("ts")
    )


def health_summary(samples: DataFrame, by: str = "job", metric: str = "up") -> DataFrame:
    """One row: targets up, targets known, ``n/m up`` and the names of those down."""
    last = latest_values(select_series(samples, metric), [by])
    up = F.col("value") == 1
    return last.agg(
        F.count_if(up).alias("up"),
        F.count(F.lit(1)).alias("known"),
        F.array_join(F.array_sort(F.collect_list(F.when(~up, F.col(by)))), ", ").alias("down"),
    ).withColumn("summary", F.format_string("%d/%d up", "up", "known"))
