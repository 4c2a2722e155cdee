"""Alert rules over metric vectors: thresholds, hold times, intervals, grouping, routing, inhibition."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "<": lambda a, b: a < b,
    "==": lambda a, b: a == b,
}


@dataclass(frozen=True)
class Rule:
    """A condition on a vector (ts, job, value) that must hold for ``hold_seconds``."""

    name: str
    op: str
    limit: float
    hold_seconds: int
    severity: str
    summary: str = ""
    description: str = ""

    def broken(self, value: Column) -> Column:
        return F.coalesce(OPERATORS[self.op](value, F.lit(self.limit)), F.lit(False))


# Names, limits, hold times and texts of the monitoring rules (fixed values). In texts, labels of the series stand in braces;
# {value} is its value cut to two digits, {percent} the same of a share as a percentage, {duration} of seconds.
SERVICE_DOWN = Rule(
    "ServiceDown", "==", 0, 60, "critical", "Service {job} is down", "{job} has been down for more than 1 minute."
)
ANOMALY_RATE = Rule(
    "HighAnomalyRate", ">", 0.5, 120, "warning", "High anomaly rate detected",
    "Anomaly rate is {value} per second (threshold: 0.5/s)",
)
ERROR_RATE = Rule(
    "HighIngestionErrorRate", ">", 0.05, 120, "warning", "High error rate on log-ingestion-api",
    "Error rate is {percent} (threshold: 5%)",
)
CONSUMER_LAG = Rule(
    "KafkaConsumerLag", ">", 10_000, 300, "warning", "High Kafka consumer lag",
    "Consumer group {group} has lag {value} on topic {topic}",
)
SLOW_RESPONSE = Rule(
    "SlowAPIResponse", ">", 2, 300, "warning", "Slow API response times", "95th percentile response time is {duration}"
)
CPU_BUSY = Rule(
    "HighCPUUsage", ">", 85, 300, "warning", "High CPU usage on {instance}", "CPU usage is {value}%"
)
LOW_DISK = Rule(
    "LowDiskSpace", "<", 15, 300, "critical", "Low disk space on {instance}", "Available disk space is {value}%"
)
CLUSTER_RED = Rule(
    "ElasticsearchClusterUnhealthy", "==", 1, 120, "critical", "Elasticsearch cluster is RED",
    "Elasticsearch cluster health is RED \u2014 data may be unavailable",
)
RULES = (SERVICE_DOWN, ANOMALY_RATE, ERROR_RATE, CONSUMER_LAG, SLOW_RESPONSE, CPU_BUSY, LOW_DISK, CLUSTER_RED)


NUMBERS = {"value": (1, ""), "percent": (100, "%"), "duration": (1, "s")}  # factor and unit of the forms of the value


def rendered(text: str, labels: list[str]) -> Column:
    """A rule's text with the forms of the value and the labels in braces filled in from the columns of the vector.

    A label that the vector has no column for is empty, an instance without one is named by its job.
    """
    parts = []
    for i, part in enumerate(re.split(r"\{(\w+)\}", text)):
        if i % 2 == 0:
            parts.append(F.lit(part))
        elif part in NUMBERS:
            factor, unit = NUMBERS[part]
            number = F.format_string("%.2f", F.floor(F.col("value").cast("double") * factor * 100) / 100)
            parts.append(F.when(F.col("value").isNotNull(), F.concat(number, F.lit(unit))).otherwise("NaN"))
        else:
            name = "job" if part == "instance" and part not in labels else part
            parts.append(F.coalesce(F.col(name).cast("string"), F.lit("")) if name in labels else F.lit(""))
    return F.concat(*parts)


def apply_rule(vector: DataFrame, rule: Rule) -> DataFrame:
    """(alertname, severity, job, ts, value, active, summary, description) for every sample of the vector."""
    return vector.select(
        F.lit(rule.name).alias("alertname"),
        F.lit(rule.severity).alias("severity"),
        F.lit(rule.hold_seconds).alias("hold_seconds"),
        "job",
        "ts",
        "value",
        rule.broken(F.col("value")).alias("active"),
        rendered(rule.summary, vector.columns).alias("summary"),
        rendered(rule.description, vector.columns).alias("description"),
    )


def rule_firing(evaluated: DataFrame, slice_seconds: int = 86_400) -> DataFrame:
    """Add ``state``: inactive, pending or firing. Firing starts once a run of active samples is old enough.

    ``since`` is the first sample of the run. A series is cut into slices of time, so one of any length spreads over tasks.
    Each slice sends a summary: whether its last sample is active, whether all are, where its last run starts. From those
    of the slices before, in a window over slices, each slice learns since when the run has been open that it goes on with.
    """
    key = ["alertname", "job"]
    rows = evaluated.withColumn("_slice", F.floor(F.unix_micros("ts") / (slice_seconds * 1_000_000)))
    series = Window.partitionBy(*key, "_slice").orderBy("ts")
    starts = F.col("active") & ~F.coalesce(F.lag("active").over(series), F.lit(False))
    rows = rows.withColumn("_start", F.when(starts, F.col("ts")))
    so_far = series.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.max("_start").over(so_far))
    # whether the run at hand has been open since the first sample of the slice
    rows = rows.withColumn("_whole", F.min(F.coalesce("active", F.lit(False)).cast("int")).over(so_far) == 1)
    ends = rows.groupBy(*key, "_slice").agg(
        F.max_by(F.coalesce("active", F.lit(False)), "ts").alias("open"),
        F.min(F.coalesce("active", F.lit(False)).cast("int")).alias("all"),
        F.max("_start").alias("start"),
    )
    slices = Window.partitionBy(*key).orderBy("_slice")
    goes_on = (F.col("all") == 1) & F.coalesce(F.lag("open").over(slices), F.lit(False))
    ends = ends.withColumn("_opened", F.when(F.col("open") & ~goes_on, F.col("start")))
    before = slices.rowsBetween(Window.unboundedPreceding, -1)
    carried = F.when(F.lag("open").over(slices), F.max("_opened").over(before))
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in [*key, "_slice"]]
    ends = ends.select(*key, "_slice", carried.alias("_carried")).where("_carried IS NOT NULL")
    rows = rows.alias("r").join(ends.alias("e"), same, "left").select("r.*", "e._carried")
    since = F.when(F.col("_whole"), F.coalesce("_carried", "_run")).otherwise(F.col("_run"))
    rows = rows.withColumn("since", F.when(F.col("active"), since))
    rows = rows.drop("_start", "_slice", "_run", "_whole", "_carried")
    age = F.unix_micros("ts") - F.unix_micros("since")
    state = (
        F.when(~F.col("active"), "inactive")
        .when(age >= F.col("hold_seconds") * F.lit(1_000_000), "firing")
        .otherwise("pending")
    )
    return rows.withColumn("state", state)


def alert_intervals(states: DataFrame, resolve_seconds: int = 300) -> DataFrame:
    """One row per firing run: when it fired, its last firing sample and when it counts as resolved."""
    firing = states.filter(F.col("state") == "firing")
    return firing.groupBy("alertname", "severity", "job", "since").agg(
        F.min("ts").alias("fired_at"),
        F.max("ts").alias("last_at"),
        (F.max("ts") + F.make_dt_interval(secs=F.lit(resolve_seconds))).alias("resolved_at"),
    )


def inhibit_alerts(firing: DataFrame) -> DataFrame:
    """Drop warnings while a critical alert with the same name and job fires at the same time."""
    critical = firing.filter(F.col("severity") == "critical").select("alertname", "job", "ts").distinct()
    warnings = firing.filter(F.col("severity") == "warning").join(critical, ["alertname", "job", "ts"], "left_anti")
    return firing.filter(F.col("severity") != "warning").unionByName(warnings)


def route_alerts(firing: DataFrame) -> DataFrame:
    """One row per receiver: critical goes to its own and on, warning to the common one, others to the default."""
    critical, warning = F.col("severity") == "critical", F.col("severity") == "warning"
    receivers = F.array_compact(
        F.array(
            F.when(critical, F.lit("slack-critical")),
            F.when(warning, F.lit("slack-notifications")),
        )
    )
    receivers = F.when(F.size(receivers) > 0, receivers).otherwise(F.array(F.lit("slack-notifications")))
    return firing.withColumn("receiver", F.explode(receivers))


def group_notifications(
    intervals: DataFrame,
    by: tuple[str, ...] = ("alertname", "job"),
    wait_seconds: int = 30,
    every_seconds: int = 300,
    repeat_seconds: int = 10_800,
) -> DataFrame:
    """Notice times per group: after the wait, at the tick after a change, then repeated.

    Overlapping intervals of a group form one episode. Its first notice comes ``wait_seconds`` after it opens.
    A change (an alert joins or resolves) is told at the next tick of ``every_seconds``; without change the notice
    repeats every ``repeat_seconds`` until the episode ends.
    """
    us = 1_000_000
    group = Window.partitionBy(*by).orderBy("start", "stop")
    rows = intervals.select(
        *by, F.unix_micros("fired_at").alias("start"), F.unix_micros("resolved_at").alias("stop")
    )
    reach = F.max("stop").over(group.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > reach, F.lit(True))
    rows = rows.withColumn("_open", F.when(opens, F.col("start")))
    rows = rows.withColumn(
        "opened", F.max("_open").over(group.rowsBetween(Window.unboundedPreceding, 0))
    ).drop("_open")
    ends = rows.groupBy(*by, "opened").agg(F.max("stop").alias("closed"))
    first = F.col("opened") + wait_seconds * us
    tick = every_seconds * us
    late = F.greatest(F.col("change") - first, F.lit(0))
    changes = (
        rows.select(*by, "opened", F.explode(F.array("start", "stop")).alias("change"))
        .select(*by, "opened", (first + F.ceil(late / tick) * tick).alias("at"))
        .distinct()
        .join(ends, [*by, "opened"])
    )
    following = F.lead("at").over(Window.partitionBy(*by, "opened").orderBy("at"))
    until = F.least(F.coalesce(following, F.col("closed")), F.col("closed"))
    told = changes.withColumn("_until", F.greatest(until - 1, F.col("at")))
    ticks = F.sequence(F.col("at"), F.col("_until"), F.lit(repeat_seconds * us))
    return told.select(*by, "opened", F.explode(ticks).alias("at")).select(
        *by, F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("at").alias("notify_at")
    )
