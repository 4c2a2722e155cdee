"""Stateful stream operators that keep their state per key in Spark's state store, with event-time timers.

They give the rows of their batch twins (``dedup.dedup_alerts``, ``features.rolling_count``) for rows that come in order of time
across micro-batches, whatever the order within one. State is in RocksDB, checkpointed with the query, and ends by a timer
when the watermark has passed what it can still be needed for. Rows behind the watermark are dropped by Spark and counted
in the progress of the query. The rows of one key in one micro-batch are held by one task: bound the batch at the source.
Rolling counts have a key for each service and time slice, so a busy service is dealt to as many tasks as it has slices.
``jobs.ProcessLogs`` and ``jobs.HandleAlerts`` keep state in tables instead, which spread a busy key over tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from logtide.session import ship

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
MICROS = 1_000_000
SLICE_SECONDS = 3600
SLICE_WINDOWS = 4  # a slice is at least so many windows long, so that at most every fourth row goes to two slices


def use_state_store(spark: SparkSession) -> None:
    """State variables need the RocksDB store; a store that the session has chosen itself stays."""
    ship(spark)
    if "HDFSBackedStateStoreProvider" in spark.conf.get(PROVIDER, "HDFSBackedStateStoreProvider"):
        spark.conf.set(PROVIDER, ROCKSDB)


def joined(rows: Iterator[pd.DataFrame], columns: list[str]) -> pd.DataFrame:
    """The rows of a key in one frame. Spark renames columns that are no Python names, so they are named by place."""
    return pd.concat(list(rows), ignore_index=True).set_axis(columns, axis=1)


class TtlDedup(StatefulProcessor):
    """Marks alerts of a key within the TTL of the last one that notified."""

    def __init__(self, ttl_seconds: int, id_col: str, columns: list[str]) -> None:
        self.ttl, self.id_col, self.columns = ttl_seconds * MICROS, id_col, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.free = handle.getValueState("free", "free long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = joined(rows, [*self.columns, "_us"]).sort_values(["_us", self.id_col], kind="stable", ignore_index=True)
        state = self.free.get() if self.free.exists() else None
        free = before = None if state is None else state[0]
        duplicate = np.zeros(len(batch), bool)
        for i, at in enumerate(batch["_us"].tolist()):
            if free is not None and at < free:
                duplicate[i] = True
            else:
                free = at + self.ttl
        if free != before:
            self.free.update((free,))
            if before is not None:
                self.handle.deleteTimer(-(-before // 1000))
            self.handle.registerTimer(-(-free // 1000))
        yield batch.assign(deduplicated=duplicate)[[*self.columns, "deduplicated"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """No alert that may still come lies before the end of the suppression."""
        self.free.clear()
        return iter(())

    def close(self) -> None:
        pass


def dedup_stream(
    alerts: DataFrame, ttl_seconds: int, key: str = "dedup_key", time: str = "detected_at", id_col: str = "alert_id", late: str = "10 minutes"
) -> DataFrame:
    """The stream with ``deduplicated``, as ``dedup.dedup_alerts``. An alert without key or time is never a duplicate."""
    use_state_store(alerts.sparkSession)
    keyed = F.col(key).isNotNull() & F.col(time).isNotNull()
    rows = alerts.where(keyed).withWatermark(time, late).withColumn("_us", F.unix_micros(time))
    schema = T.StructType([*alerts.schema.fields, T.StructField("deduplicated", T.BooleanType())])
    marked = rows.groupBy(key).transformWithStateInPandas(
        TtlDedup(ttl_seconds, id_col, alerts.columns), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return marked.unionByName(alerts.where(~keyed).withColumn("deduplicated", F.lit(False)))


class RollingCount(StatefulProcessor):
    """Rows of a service in (t - window, t], with the times that later rows may need as state.

    A key is a service and a slice, named by its start. Rows from before the slice are counted there and given out by their own.
    """

    def __init__(self, window_seconds: int, late_seconds: int, columns: list[str], out: str) -> None:
        self.window, self.keep, self.columns, self.out = window_seconds * MICROS, (window_seconds + late_seconds) * MICROS, columns, out

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getListState("seen", "us long, n long")
        self.ends = handle.getValueState("ends", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = joined(rows, [*self.columns, "_us", "_slice"])
        own = batch["_us"].to_numpy()
        held = list(self.seen.get()) if self.seen.exists() else []
        times = np.concatenate([np.array([r[0] for r in held], np.int64), own])
        number = np.concatenate([np.array([r[1] for r in held], np.int64), np.ones(len(own), np.int64)])
        times, place = np.unique(times, return_inverse=True)
        number = np.bincount(place, number).astype(np.int64)
        total = np.append(0, np.cumsum(number))
        upto = total[np.searchsorted(times, own, "right")]
        before = total[np.searchsorted(times, own - self.window, "right")]
        kept = times > times[-1] - self.keep
        self.seen.put(list(zip(times[kept].tolist(), number[kept].tolist(), strict=True)))
        end = int(times[-1] + self.keep) // 1000
        if self.ends.exists():
            self.handle.deleteTimer(self.ends.get()[0])
        self.handle.registerTimer(end)
        self.ends.update((end,))
        inside = own >= key[1]
        if inside.any():
            yield batch.assign(**{self.out: upto - before})[inside][[*self.columns, self.out]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.ends.clear()
        return iter(())

    def close(self) -> None:
        pass


def rolling_count_stream(
    logs: DataFrame, window_seconds: int = 60, time: str = "event_time", key: str = "service", late_seconds: int = 600, out: str = "request_count_last_60s"
) -> DataFrame:
    """The stream with its rolling counts, as ``features.rolling_count``; null where time or key is missing.

    The state has the key and a time slice as its key; a row goes to its slice, and to the next one if its window reaches there.
    """
    use_state_store(logs.sparkSession)
    keyed = F.col(key).isNotNull() & F.col(time).isNotNull()
    width = max(SLICE_SECONDS, SLICE_WINDOWS * window_seconds) * MICROS
    begin = F.col("_us") - F.pmod("_us", F.lit(width))
    reaches = F.col("_us") + window_seconds * MICROS > begin + width
    slices = F.when(reaches, F.array(begin, begin + width)).otherwise(F.array(begin))
    rows = logs.where(keyed).withWatermark(time, f"{late_seconds} seconds").withColumn("_us", F.unix_micros(time))
    rows = rows.withColumn("_slice", F.explode(slices))
    schema = T.StructType([*logs.schema.fields, T.StructField(out, T.LongType())])
    counted = rows.groupBy(key, "_slice").transformWithStateInPandas(
        RollingCount(window_seconds, late_seconds, logs.columns, out), outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )
    return counted.unionByName(logs.where(~keyed).withColumn(out, F.lit(None).cast("long")))


def once_delivered(records: DataFrame, keys: tuple[str, ...] = ("topic", "partition", "offset"), time: str = "timestamp", within: str = "1 hour") -> DataFrame:
    """Each topic record once, though a producer's or consumer's retry delivers it again within that time.

    A record is known by its place in the topic; the state of a place ends when the watermark has passed its time. Equal
    lines at other places are records of their own.
    """
    return records.withWatermark(time, within).dropDuplicatesWithinWatermark([c for c in keys if c in records.columns])
