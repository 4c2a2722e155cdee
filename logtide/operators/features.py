"""The feature struct of a log row, with the rolling count and the service label."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logtide.functions import features as E
from logtide.operators.quantiles import numbered
from logtide.schemas import FEATURES
from logtide.session import materialise

MICROS = 1_000_000


def counts_per_micro(
    df: DataFrame, key: str = "service", time: str = "event_time", distinct_micros: bool = False
) -> DataFrame:
    """(key, _us, _n): rows per key and microsecond, combined before the shuffle."""
    n = F.lit(1).cast("bigint") if distinct_micros else F.count(F.lit(1))
    return df.groupBy(key, F.unix_micros(F.col(time).cast("timestamp")).alias("_us")).agg(n.alias("_n"))


def rolling_count(
    df: DataFrame,
    window_seconds: int = 60,
    key: str = "service",
    time: str = "event_time",
    out: str = "request_count_last_60s",
    distinct_micros: bool = False,
    slice_seconds: int | None = None,
    carried: DataFrame | None = None,
) -> DataFrame:
    """Rows of the same key in (t - window, t], counted at every row.

    Rows are first counted per (key, microsecond), so copies collapse before the shuffle. Each count then
    opens at t and closes at t + window; a running sum of openings and closings is the rolling count, linear
    in the rows. The running sum goes over (key, time slice): counts still open at the end of a slice are
    opened again at the start of the next, so a busy key spreads over as many tasks as it has slices.
    ``distinct_micros`` counts a microsecond once, however many rows it has. ``carried`` holds counts per
    (key, microsecond) of rows seen before ``df``, as a stream keeps them.
    """
    window = window_seconds * MICROS
    slice_len = max(window, (slice_seconds or 5 * window_seconds) * MICROS)
    rows = df.withColumn("_us", F.unix_micros(F.col(time).cast("timestamp")))
    per_us = counts_per_micro(df, key, time, distinct_micros)
    if carried is not None:
        both = F.max("_n") if distinct_micros else F.sum("_n")
        per_us = per_us.unionByName(carried.select(key, "_us", "_n")).groupBy(key, "_us").agg(both.alias("_n"))

    def slice_start(at):
        return at - F.pmod(at, F.lit(slice_len))

    def step(part, at, delta, real):
        return F.struct(part.alias("part"), at.alias("at"), delta.alias("delta"), F.lit(real).alias("real"))

    opened, closed = F.col("_us"), F.col("_us") + window
    carry = F.array(step(slice_start(closed), slice_start(closed), F.col("_n"), False))
    steps = F.array(
        step(slice_start(opened), opened, F.col("_n"), True),
        step(slice_start(closed), closed, -F.col("_n"), False),
    )
    steps = F.when(slice_start(closed) > slice_start(opened), F.concat(steps, carry)).otherwise(steps)
    running = Window.partitionBy(key, "part").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    counts = (
        per_us.select(key, F.explode(steps).alias("s"))
        .select(key, "s.*")
        .withColumn(out, F.sum("delta").over(running))
        .filter("real")
        .select(key, F.col("at").alias("_us"), out)
    )
    return rows.join(counts, [key, "_us"], "left").drop("_us")


def service_labels(df: DataFrame, known: DataFrame | None = None, time: str = "event_time") -> DataFrame:
    """(service, service_id): ids from 1 in order of first appearance; ``known`` labels keep theirs.

    Service names are client text, so there may be many: they are numbered by ranges (``quantiles.numbered``).
    """
    seen = df.groupBy("service").agg(F.min(time).alias("first_seen"))
    if known is None:
        return numbered(seen, ["first_seen", "service"]).select("service", F.col("number").cast("int").alias("service_id"))
    top = known.agg(F.coalesce(F.max("service_id"), F.lit(0)).alias("top")).scalar()
    fresh = numbered(seen.join(known, "service", "left_anti"), ["first_seen", "service"])
    fresh = fresh.select("service", (F.col("number") + top).cast("int").alias("service_id"))
    return known.select("service", "service_id").unionByName(fresh)


def encode_services(
    df: DataFrame, labels: DataFrame, out: str = "service_id_encoded", most_broadcast: int = 100_000
) -> DataFrame:
    """Add the label; a service without one gets its hash id.

    A label table of up to ``most_broadcast`` rows is broadcast, so that the rows are not shuffled by a column of few
    values. It is counted first: pass a stored table.
    """
    named = labels.select("service", F.col("service_id").alias("_id"))
    if named.limit(most_broadcast + 1).count() <= most_broadcast:
        named = F.broadcast(named)
    return df.join(named, "service", "left").withColumn(
        out, F.coalesce("_id", E.hash_service(F.col("service"))).cast("int")
    ).drop("_id")


def extract_features(
    df: DataFrame,
    labels: DataFrame | None = None,
    window_seconds: int = 60,
    time: str = "event_time",
    carried: DataFrame | None = None,
) -> DataFrame:
    """Add the ``features`` struct to normalised rows. Without ``labels`` the services of ``df`` define them."""
    labels = materialise(service_labels(df, time=time), "labels") if labels is None else labels
    counted = rolling_count(df, window_seconds, time=time, out="_count", carried=carried)
    return encode_services(counted, labels, out="_service").withColumn(
        "features", feature_struct(time)
    ).drop("_count", "_service")


def feature_struct(time: str = "event_time", count: str = "_count", service_id: str = "_service"):
    """The six model inputs from a normalised row, its rolling count and its service label."""
    struct = F.struct(
        F.hour(time).alias("hour_of_day"),
        F.greatest(F.lit(0.0), F.coalesce("response_time_ms", F.lit(0.0))).alias("response_time_ms"),
        E.encode_error_code(F.col("error_code")).alias("error_code"),
        E.encode_level(F.col("level")).alias("log_level_encoded"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("request_count_last_60s"),
        F.col(service_id).alias("service_id_encoded"),
    ).cast(FEATURES)
    return F.when(F.col(time).isNull(), E.zero_features(FEATURES)).otherwise(struct)


def impute_for_scoring(df: DataFrame, time: str = "event_time") -> DataFrame:
    """Feature struct for scoring a single row ad hoc, with defaults by level and a fixed count of 25."""
    error = F.col("level") == "ERROR"
    latency = F.coalesce("response_time_ms", F.when(error, 4500.0).otherwise(120.0))
    code = F.coalesce("error_code", F.when(error, 503).otherwise(200))
    return df.withColumn(
        "features",
        F.struct(
            F.hour(time).alias("hour_of_day"),
            latency.alias("response_time_ms"),
            E.encode_error_code(code).alias("error_code"),
            E.encode_level(F.col("level")).alias("log_level_encoded"),
            F.lit(25).cast("bigint").alias("request_count_last_60s"),
            E.charsum_service(F.col("service")).alias("service_id_encoded"),
        ).cast(FEATURES),
    )
