"""Counts, rates, shares and histograms over logs and alerts. Time is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions.normalise import LEVEL_SPELLINGS

# Upper bounds of the latency histogram in ms (fixed values).
LATENCY_BOUNDS_MS = [
    1.0, 5.0, 10.0, 25.0, 50.0, 75.0, 100.0, 150.0, 200.0, 300.0, 500.0, 1000.0, 2000.0, 5000.0,
]


def since(time: str, as_of: Column, seconds: int) -> Column:
    return F.col(time) >= as_of - F.make_dt_interval(secs=F.lit(seconds))


def count_logs(logs: DataFrame, where: Column | None = None) -> DataFrame:
    found = logs if where is None else logs.filter(where)
    return found.agg(F.count(F.lit(1)).alias("n"))


def system_stats(
    logs: DataFrame,
    alerts: DataFrame,
    as_of: Column,
    window_minutes: int = 60,
    unique_only: bool = False,
) -> DataFrame:
    """One row: log counts over the last minute, hour and window, log rate, anomaly counts and rate.

    Each table is read once; the alert counts come in as one scalar subquery. Rows outside the widest window
    are cut before the aggregation, so only recent partitions are read.
    """
    if not 1 <= window_minutes <= 1440:
        raise ValueError("window_minutes is 1..1440")
    recent = logs.filter(since("event_time", as_of, max(window_minutes * 60, 3600)))
    log_counts = recent.agg(
        F.count_if(since("event_time", as_of, 60)).alias("logs_last_minute"),
        F.count_if(since("event_time", as_of, 3600)).alias("logs_last_hour"),
        F.count_if(since("event_time", as_of, window_minutes * 60)).alias("logs_last_window"),
    )
    counted = alerts.filter(~F.col("deduplicated")) if unique_only else alerts
    alert_counts = counted.agg(
        F.struct(
            F.count_if(since("detected_at", as_of, 3600)).alias("anomalies_last_hour"),
            F.count(F.lit(1)).alias("total_anomalies"),
        ).alias("counts")
    )
    rate = F.col("anomalies_last_hour") / F.greatest(F.col("logs_last_hour"), F.lit(1)) * 100
    return (
        log_counts.withColumn("c", alert_counts.scalar())
        .select("*", "c.*")
        .drop("c")
        .withColumn("window_minutes", F.lit(window_minutes))
        .withColumn("log_rate_per_second", F.bround(F.col("logs_last_minute") / 60, 2))
        .withColumn("anomaly_rate_percent", F.bround(rate, 2))
    )


def count_alerts(alerts: DataFrame, as_of: Column, unique_only: bool) -> DataFrame:
    """All or only notified alerts: total and last hour."""
    keep = ~F.col("deduplicated") if unique_only else F.lit(True)
    return alerts.agg(
        F.count_if(keep).alias("total"),
        F.count_if(keep & since("detected_at", as_of, 3600)).alias("last_hour"),
    )


def count_by(df: DataFrame, key: str) -> DataFrame:
    """Rows per key, most frequent first; a missing key is ``unknown``."""
    label = F.coalesce(F.nullif(F.col(key).cast("string"), F.lit("")), F.lit("unknown"))
    return df.groupBy(label.alias(key)).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key)


def top_groups(df: DataFrame, key: str, k: int = 6) -> DataFrame:
    return count_by(df, key).limit(k)


def group_bars(df: DataFrame, key: str = "service", k: int = 6) -> DataFrame:
    """The k largest groups with their size as a percentage of the largest. The window sees k rows."""
    top = top_groups(df, key, k)
    return top.withColumn("width_pct", F.col("n") / F.max("n").over(Window.partitionBy()) * 100)


def level_breakdown(logs: DataFrame) -> DataFrame:
    """Count and whole percentage of each canonical level; levels without rows stay with 0."""
    levels = list(LEVEL_SPELLINGS)
    counts = logs.agg(
        F.greatest(F.count(F.lit(1)), F.lit(1)).alias("total"),
        F.array(
            *[
                F.struct(F.lit(lvl).alias("level"), F.count_if(F.col("level") == lvl).alias("n"))
                for lvl in levels
            ]
        ).alias("levels"),
    )
    return (
        counts.select("total", F.explode("levels").alias("x"))
        .select("x.level", "x.n", F.floor(F.col("x.n") * 100 / F.col("total") + 0.5).alias("pct"))
    )


def pipeline_counters(df: DataFrame, labels: list[str], name: str) -> DataFrame:
    """A labelled counter: rows per label combination."""
    return df.groupBy(*labels).agg(F.count(F.lit(1)).alias("value")).withColumn("counter", F.lit(name))


def histogram(
    df: DataFrame, value: str, bounds: list[float] = LATENCY_BOUNDS_MS, by: list[str] | None = None
) -> DataFrame:
    """Cumulative buckets (le, n), with sum and count of the values.

    Each row is put in its smallest bucket and counted there, so the shuffle carries one row per bucket and
    group; the running sum then goes over a handful of buckets.
    """
    by = by or []
    first = F.array_position(F.transform(F.array(*[F.lit(b) for b in bounds]), lambda b: F.col(value) <= b), True)
    slot = F.when(first > 0, first).otherwise(len(bounds) + 1).cast("int")
    known = df.filter(F.col(value).isNotNull())
    per_slot = known.groupBy(*by, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("s"))
    wide = per_slot.groupBy(*by).agg(
        F.sum("n").alias("count"),
        F.sum("s").alias("sum"),
        F.map_from_entries(F.collect_list(F.struct("slot", "n"))).alias("slots"),
    )
    edges = [*[str(b) for b in bounds], "+Inf"]
    filled = F.transform(
        F.sequence(F.lit(1), F.lit(len(edges))), lambda i: F.coalesce(F.try_element_at("slots", i), F.lit(0))
    )
    cumulative = F.transform(
        F.sequence(F.lit(1), F.lit(len(edges))),
        lambda i: F.struct(
            F.element_at(F.array(*[F.lit(e) for e in edges]), i).alias("le"),
            F.aggregate(F.slice(filled, 1, i), F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"),
        ),
    )
    return wide.select(*by, "count", "sum", F.explode(cumulative).alias("b")).select(
        *by, "b.le", "b.n", "count", "sum"
    )


def score_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("is_anomaly").alias("anomaly_count"),
        F.bround(F.count_if("is_anomaly") / F.count(F.lit(1)), 3).alias("anomaly_rate"),
    )


def alert_history_totals(alerts: DataFrame) -> DataFrame:
    """Alerts by severity and service with subtotals (null means all)."""
    return alerts.rollup("severity", "service").agg(F.count(F.lit(1)).alias("n"))


def sent_by_channel(history: DataFrame) -> DataFrame:
    return (
        history.select(F.explode("notification_channels").alias("channel"))
        .groupBy("channel")
        .agg(F.count(F.lit(1)).alias("sent"))
    )


def anomaly_fraction(scored: DataFrame, as_of: Column, seconds: int = 60) -> DataFrame:
    """Share of anomalous rows in the last seconds, 0 when there are none."""
    recent = scored.filter(since("event_time", as_of, seconds) & (F.col("event_time") <= as_of))
    share = F.coalesce(F.try_divide(F.count_if("is_anomaly"), F.count(F.lit(1))), F.lit(0.0))
    return recent.agg(F.count(F.lit(1)).alias("n"), F.round(share, 6).alias("anomaly_rate"))


def suppression_rate(flagged: DataFrame, every: str = "1 day", time: str = "detected_at") -> DataFrame:
    """Share of duplicates per time bucket."""
    return (
        flagged.groupBy(F.window(time, every)["start"].alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("alerts"),
            F.round(F.count_if("deduplicated") / F.count(F.lit(1)), 6).alias("suppressed"),
        )
    )


def per_bucket(df: DataFrame, every: str = "1 minute", time: str = "event_time", by: list[str] | None = None):
    """Tumbling counts."""
    start = F.window(time, every)["start"].alias("bucket")
    return df.groupBy(start, *(by or [])).agg(F.count(F.lit(1)).alias("n"))


def trace_timeline(logs: DataFrame, trace_id: Column, time: str = "event_time") -> DataFrame:
    """Per trace: first and last time, records, errors and the services it touched, in name order."""
    return (
        logs.withColumn("trace_id", trace_id)
        .filter(F.col("trace_id").isNotNull())
        .groupBy("trace_id")
        .agg(
            F.min(time).alias("started"),
            F.max(time).alias("ended"),
            F.count(F.lit(1)).alias("records"),
            F.count_if(F.col("level").isin("ERROR", "CRITICAL")).alias("errors"),
            F.array_sort(F.collect_set("service")).alias("services"),
        )
    )


def find_trace(logs: DataFrame, trace_id: Column, value: str, time: str = "event_time") -> DataFrame:
    """Records of one trace across services in time order: a filter and a range sort."""
    return logs.filter(trace_id == value).orderBy(time, "log_id")


def retain_recent(df: DataFrame, as_of: Column, seconds: int, time: str = "event_time") -> DataFrame:
    """Rows within the retention time; on a daily table whole days outside it are not read."""
    kept = df.filter(since(time, as_of, seconds))
    if "log_date" in df.columns:
        kept = kept.filter(F.col("log_date") >= F.to_date(as_of - F.make_dt_interval(secs=F.lit(seconds))))
    return kept
