"""Search, listing and paging over logs and alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.functions.text import tokens
from logtide.session import materialise

MAX_PAGE_SIZE = 100


def search_logs(
    logs: DataFrame,
    level: str | None = None,
    service: str | None = None,
    start: str | None = None,
    end: str | None = None,
    q: str | None = None,
    where: Column | None = None,
    time: str = "event_time",
) -> DataFrame:
    """Logs that meet every given condition; time bounds are inclusive.

    On a table partitioned by ``log_date`` the time bounds also prune partitions.
    """
    found = logs
    dated = "log_date" in logs.columns
    if level:
        found = found.filter(F.col("level") == level.upper())
    if service:
        found = found.filter(F.col("service") == service.lower())
    if start:
        low = F.lit(start).cast("timestamp")
        found = found.filter(F.col(time) >= low)
        if dated:
            found = found.filter(F.col("log_date") >= F.to_date(low))
    if end:
        high = F.lit(end).cast("timestamp")
        found = found.filter(F.col(time) <= high)
        if dated:
            found = found.filter(F.col("log_date") <= F.to_date(high))
    if q:
        found = found.filter(matches_text(F.col("message"), q))
    return found if where is None else found.filter(where)


def matches_text(col: Column, q: str) -> Column:
    """True if the text has any word of the query."""
    return F.arrays_overlap(tokens(col), tokens(F.lit(q)))


def filter_logs(
    logs: DataFrame,
    text: str = "",
    service: str = "all",
    only_anomalies: bool = False,
    order: tuple[str, ...] = ("service", "level", "message"),
) -> DataFrame:
    """Any-case substring filter over a few columns, with service and anomaly toggles."""
    needle = text.strip().lower()
    found = logs
    if needle:
        joined = F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in order])
        found = found.filter(F.lower(joined).contains(needle))
    if service != "all":
        found = found.filter(F.col("service") == service)
    return found.filter("anomaly") if only_anomalies else found


def page_of(
    df: DataFrame,
    page: int = 1,
    size: int = 20,
    sort: str = "event_time",
    tie_break: str = "log_id",
    descending: bool = True,
    with_total: bool = False,
) -> DataFrame:
    """One page in sort order, missing values last, ties broken by id. Spark keeps only the top page*size rows per task;
    for pages far behind use ``page_after``.

    ``with_total`` adds the number of rows over all pages, counted by a scalar subquery.
    """
    if page < 1 or not 1 <= size <= MAX_PAGE_SIZE:
        raise ValueError("page starts at 1, size is 1..100")
    first = F.desc_nulls_last(sort) if descending else F.asc_nulls_last(sort)
    rows = df.orderBy(first, F.asc(tie_break)).offset((page - 1) * size).limit(size)
    if with_total:
        rows = rows.withColumn("total", df.agg(F.count(F.lit(1))).scalar())
    return rows


def page_after(
    df: DataFrame,
    last: tuple | None,
    size: int = 20,
    sort: str = "event_time",
    tie_break: str = "log_id",
    descending: bool = True,
) -> DataFrame:
    """The page behind the row with ``last`` = (sort value, id), the first page without it.

    The condition reaches the scan, so every page costs the same however far behind it is.
    """
    if last is not None:
        value, row = last
        at, end = F.col(sort), F.lit(value)
        behind = F.col(tie_break) > F.lit(row)
        if value is None:
            df = df.filter(at.isNull() & behind)
        else:
            further = at < end if descending else at > end
            df = df.filter(further | at.isNull() | ((at == end) & behind))
    return page_of(df, 1, size, sort, tie_break, descending)


def latest(df: DataFrame, k: int, time: str = "event_time", tie_break: str = "log_id") -> DataFrame:
    return df.orderBy(F.desc(time), F.asc(tie_break)).limit(k)


def between(df: DataFrame, time: str, start: str | None, end: str | None) -> DataFrame:
    """Closed time range; a missing start is 2000-01-01, a missing end is now."""
    low = F.lit(start or "2000-01-01T00:00:00Z").cast("timestamp")
    high = F.lit(end).cast("timestamp") if end else F.current_timestamp()
    return df.filter(F.col(time).between(low, high))


def alerts_by_service(alerts: DataFrame, service: str, narrow: bool = True) -> DataFrame:
    """Alerts of one service; the narrow form leaves out the wide columns."""
    found = alerts.filter(F.col("service") == service)
    wide = ["host", "response_time_ms", "error_code", "notification_channels", "features"]
    return found.drop(*wide) if narrow else found


def list_anomalies(
    alerts: DataFrame,
    service: str | None = None,
    start: str | None = None,
    end: str | None = None,
    combine_filters: bool = True,
) -> DataFrame:
    """Alerts by service and time range. Without ``combine_filters`` a time range hides the service filter."""
    found = alerts
    ranged = bool(start or end)
    if ranged:
        found = between(found, "detected_at", start, end)
    if service and (combine_filters or not ranged):
        found = found.filter(F.col("service") == service)
    return found


def flag_anomalous_logs(logs: DataFrame, alerts: DataFrame, most_broadcast: int = 500_000) -> DataFrame:
    """Add ``anomaly``: own flag, or an alert on the log, or level CRITICAL.

    The ids with an alert are stored and counted. Up to ``most_broadcast`` of them are broadcast, so the logs, by far the
    larger side, are not shuffled; beyond, the join is shuffled. Logs without id go by unjoined.
    """
    hits = materialise(alerts.filter(F.col("log_id").isNotNull()).select("log_id").distinct(), "alerted").withColumn("_hit", F.lit(True))
    if hits.limit(most_broadcast + 1).count() <= most_broadcast:
        hits = F.broadcast(hits)
    own = F.coalesce("is_anomaly", F.lit(False)) if "is_anomaly" in logs.columns else F.lit(False)
    flagged = own | F.col("_hit").isNotNull() | (F.upper("level") == "CRITICAL")
    return logs.join(hits, "log_id", "left").withColumn("anomaly", F.coalesce(flagged, F.lit(False))).drop("_hit")


def known_services(*frames: DataFrame) -> DataFrame:
    """Services seen in any frame in name order, after an entry for all of them."""
    names = None
    for df in frames:
        one = df.select("service").distinct()
        names = one if names is None else names.unionByName(one)
    names = names.distinct().withColumn("pos", F.lit(1))
    everything = names.sparkSession.range(1).select(F.lit("all").alias("service"), F.lit(0).alias("pos"))
    return everything.unionByName(names).orderBy("pos", "service")
