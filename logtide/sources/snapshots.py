"""Tables of immutable folders behind a list of snapshots: cheap upserts, merged when read, compacted later.

A write adds one folder of Parquet files (a delta) and commits the next snapshot, a small file that names every folder and
partition of the table. Readers take one snapshot and see it whole, whatever is written, compacted or expired meanwhile.
Only partitions that have deltas are merged when read; all others are read as they are. ``compact`` rewrites just those,
``expire`` drops partitions from the list, ``vacuum`` deletes what no kept snapshot names.

A commit renames its file to the next number, which fails if another writer was faster; the change is then applied to the
newer snapshot. A write may carry a transaction (application, batch number): a batch that is run again finds its number in
the snapshot and writes nothing, so a stream stores each batch once.

Rows without key or partition value cannot be stored; they are counted as failures.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators.alerts import STATUS_COLUMNS
from logtide.schemas import ALERT_HISTORY

TRIES = 20
FEW_ROWS = 100_000


@dataclass
class Snapshot:
    """One state of a table. ``base`` and ``deltas`` have folder -> partition directories; ``done`` the last batch by writer."""

    version: int = 0
    base: dict[str, list[str]] = field(default_factory=dict)
    deltas: dict[str, list[str]] = field(default_factory=dict)
    done: dict[str, list[int]] = field(default_factory=dict)

    def dirty(self) -> set[str]:
        """Partitions that have deltas."""
        return {p for parts in self.deltas.values() for p in parts}

    def folders(self) -> set[tuple[str, str]]:
        return {(f, p) for kind in (self.base, self.deltas) for f, parts in kind.items() for p in parts}


def without(folders: dict[str, list[str]], gone: set[tuple[str, str]]) -> dict[str, list[str]]:
    left = {f: [p for p in parts if (f, p) not in gone] for f, parts in folders.items()}
    return {f: parts for f, parts in left.items() if parts}


class SnapshotTable:
    """``schema`` without the partition column; ``merge(base rows, delta rows)`` gives the rows of the partitions they hold."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        keys: list[str],
        merge: Callable[[DataFrame, DataFrame], DataFrame],
        partition: str = "log_date",
        kind: T.DataType | None = None,
    ) -> None:
        self.spark, self.path, self.keys, self.merge, self.partition = spark, path.rstrip("/"), keys, merge, partition
        fields = [f for f in schema.fields if f.name != partition]
        self.schema = T.StructType([*fields, T.StructField(partition, kind or T.DateType())])
        self._jvm = spark._jvm
        self._root = self._jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ snapshots

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._root, name)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def versions(self) -> list[int]:
        return [int(n.removesuffix(".json")) for n in self._names("_snapshots") if n.endswith(".json")]

    def snapshot(self, version: int | None = None) -> Snapshot:
        """A snapshot by number, the newest by default; an empty one before the first write."""
        known = self.versions()
        if version is None and not known:
            return Snapshot()
        number = known[-1] if version is None else version
        if number not in known:
            raise ValueError(f"{self.path} has no snapshot {number}; it has {known}")
        stream = self._fs.open(self._path(f"_snapshots/{number:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Snapshot(**json.loads(text))

    def _commit(self, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
        """Apply a change to the newest snapshot; again from the start if another writer commits first."""
        for _ in range(TRIES):
            now = self.snapshot()
            new = change(now)
            if new is None:
                return now
            new.version = now.version + 1
            draft = self._path(f"_snapshots/.{uuid.uuid4().hex}")
            out = self._fs.create(draft)
            out.write(bytearray(json.dumps(vars(new)).encode()))
            out.close()
            if self._rename_to_new(draft, self._path(f"_snapshots/{new.version:010d}.json")):
                return new
            self._fs.delete(draft, False)
        raise RuntimeError(f"no commit to {self.path} in {TRIES} tries")

    def _rename_to_new(self, source, target) -> bool:
        """Rename unless the target exists, in one step of the file system."""
        fs = self._jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        rename = self.spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 1)
        rename[0] = getattr(fs, "Options$Rename").NONE
        try:
            context.rename(self._fs.makeQualified(source), self._fs.makeQualified(target), rename)
        except Exception as exc:  # noqa: BLE001
            if "FileAlreadyExists" in str(exc):
                return False
            raise
        return True

    # ------------------------------------------------------------ writing

    def _put(self, rows: DataFrame) -> tuple[str, list[str]]:
        """Write rows as a folder; returns it with its partition directories."""
        folder = f"written_part={uuid.uuid4().hex}"
        columns = [F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in self.schema.fields]
        rows.select(*columns).hint("rebalance", self.partition).write.partitionBy(self.partition).parquet(f"{self.path}/data/{folder}")
        return folder, [n for n in self._names(f"data/{folder}") if n.startswith(f"{self.partition}=")]

    def upsert(self, rows: DataFrame, txn: tuple[str, int] | None = None) -> tuple[int, int]:
        """Add rows; returns (stored, failed). With ``txn`` a batch that was stored before only returns its counts."""
        if txn is not None:
            last = self.snapshot().done.get(txn[0])
            if last is not None and last[0] >= txn[1]:
                return (last[1], last[2]) if last[0] == txn[1] else (0, 0)
        usable = F.lit(True)
        for name in [*self.keys, self.partition]:
            usable = usable & F.col(f"`{name}`").isNotNull()
        seen = Observation()
        watched = rows.withColumn("_usable", usable).observe(
            seen, F.count_if("_usable").alias("stored"), F.count_if(~F.col("_usable")).alias("failed")
        )
        folder, parts = self._put(watched.where("_usable"))
        counts = seen.get["stored"], seen.get["failed"]

        def add(now: Snapshot) -> Snapshot | None:
            last = now.done.get(txn[0]) if txn else None
            if last is not None and last[0] >= txn[1]:
                return None
            done = {**now.done, txn[0]: [txn[1], *counts]} if txn else now.done
            deltas = {**now.deltas, folder: parts} if parts else now.deltas
            return Snapshot(base=now.base, deltas=deltas, done=done)

        self._commit(add)
        return counts

    def compact(self) -> int:
        """Merge the deltas into the base; returns the number of partitions rewritten. Writes may go on meanwhile."""
        start = self.snapshot()
        dirty = start.dirty()
        if not dirty:
            return 0
        used = {(f, p) for f, p in start.folders() if p in dirty}
        folder, parts = self._put(self._merged(start, dirty))

        def swap(now: Snapshot) -> Snapshot | None:
            if not used <= now.folders():
                return None  # another compaction or an expiry took them; this one's folder is left to vacuum
            return Snapshot(base={**without(now.base, used), folder: parts}, deltas=without(now.deltas, used), done=now.done)

        return len(dirty) if folder in self._commit(swap).base else 0

    def expire(self, keep: Callable[[str], bool]) -> int:
        """Drop the partitions whose value (as in the directory name) ``keep`` refuses; returns how many."""
        gone: set[str] = set()

        def drop(now: Snapshot) -> Snapshot | None:
            gone.clear()
            gone.update(p for _, p in now.folders() if not keep(p.split("=", 1)[1]))
            out = {(f, p) for f, p in now.folders() if p in gone}
            return Snapshot(base=without(now.base, out), deltas=without(now.deltas, out), done=now.done) if out else None

        self._commit(drop)
        return len(gone)

    def vacuum(self, keep_snapshots: int = 2, older_than_seconds: float = 3600) -> int:
        """Delete snapshots but the last ones, and partition directories none of those names; returns how many of the latter.

        Directories younger than ``older_than_seconds`` stay, as a write that has not committed yet may own them.
        """
        known = self.versions()
        used = set().union(*(self.snapshot(v).folders() for v in known[-keep_snapshots:])) if known else set()
        for version in known[:-keep_snapshots]:
            self._fs.delete(self._path(f"_snapshots/{version:010d}.json"), False)
        before = (time.time() - older_than_seconds) * 1000
        deleted = 0
        for folder in self._names("data"):
            parts = self._names(f"data/{folder}")
            old = self._fs.getFileStatus(self._path(f"data/{folder}")).getModificationTime() <= before  # a deletion makes it young
            left = 0
            for part in parts:
                path = self._path(f"data/{folder}/{part}")
                young = self._fs.getFileStatus(path).getModificationTime() > before
                if (folder, part) in used or young:
                    left += 1
                elif self._fs.delete(path, True):
                    deleted += part.startswith(f"{self.partition}=")
            if not left and old:
                self._fs.delete(self._path(f"data/{folder}"), True)
        return deleted

    # ------------------------------------------------------------ reading

    def _rows(self, folders: dict[str, list[str]], partitions: Callable[[str], bool]) -> DataFrame:
        paths = [f"{self.path}/data/{f}/{p}" for f, parts in sorted(folders.items()) for p in parts if partitions(p)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        found = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data").parquet(*paths)
        return found.select(*self.schema.fieldNames())

    def _merged(self, at: Snapshot, dirty: set[str]) -> DataFrame:
        found = self.merge(self._rows(at.base, dirty.__contains__), self._rows(at.deltas, dirty.__contains__))
        return found.select(*[F.col(f"`{f.name}`") for f in self.schema.fields])

    def read(self, version: int | None = None, only: Callable[[str], bool] | None = None) -> DataFrame:
        """The rows of a snapshot, the newest by default.

        ``only`` chooses partitions by their value before any file is listed; filters on the partition column prune too.
        """
        at = self.snapshot(version)
        if only is not None:
            chosen = {(f, p) for f, p in at.folders() if not only(p.split("=", 1)[1])}
            at = Snapshot(at.version, without(at.base, chosen), without(at.deltas, chosen), at.done)
        dirty = at.dirty()
        clean = self._rows(at.base, lambda p: p not in dirty)
        if not dirty:
            return clean
        if not any(p not in dirty for parts in at.base.values() for p in parts):
            return self._merged(at, dirty)
        return clean.unionByName(self._merged(at, dirty))

    def parts(self, version: int | None = None) -> DataFrame:
        """All stored rows of a snapshot, not merged: for tables whose rows of one key only add up, as roll-ups do."""
        at = self.snapshot(version)
        return self._rows({**at.base, **at.deltas}, lambda p: True)

    def files(self) -> int:
        """Partition directories that the newest snapshot names."""
        return len(self.snapshot().folders())


def last_by(keys: list[str], order: list[str], few: int = FEW_ROWS) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A merge that keeps the last row of each key by ``order``; ties by a hash of the row.

    Base rows whose key is in no delta pass by the keys of up to ``few`` delta rows, which are broadcast, and are not shuffled.
    Beyond, all rows are dealt by key once, and only columns that are asked for.
    """

    def last(rows: DataFrame) -> DataFrame:
        rest = [c for c in rows.columns if c not in keys]
        plain = [c for c in rest if not isinstance(rows.schema[c].dataType, (T.MapType, T.VariantType))]
        # the hash is taken before the shuffle, so that columns nobody asks for stay behind
        turned = rows.withColumn("_turn", F.struct(*order, F.xxhash64(*plain)))
        place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn")))
        return turned.withColumn("_place", place).where("_place = 1").select(*rows.columns)

    def merge(base: DataFrame, deltas: DataFrame) -> DataFrame:
        if deltas.limit(few + 1).count() > few:
            return last(base.unionByName(deltas))
        changed = F.broadcast(deltas.select(*keys).distinct())
        again = base.join(changed, keys, "left_semi").select(*base.columns)
        return base.join(changed, keys, "left_anti").select(*base.columns).unionByName(last(again.unionByName(deltas)))

    return merge


def log_table(spark: SparkSession, path: str, schema: T.StructType) -> SnapshotTable:
    """The daily log table: of copies of a log in a day the one processed last."""
    return SnapshotTable(spark, path, schema, ["log_id"], last_by(["log_date", "log_id"], ["processed_at"]))


BUCKETS = 64


def alert_bucket() -> Column:
    return F.pmod(F.xxhash64("alert_id"), F.lit(BUCKETS)).cast("int")


def merge_alerts(base: DataFrame, deltas: DataFrame) -> DataFrame:
    """The first change of an alert gives its row, the last one its notification status."""
    fixed = [f.name for f in ALERT_HISTORY.fields if f.name not in STATUS_COLUMNS and f.name != "alert_id"]
    both = base.unionByName(deltas)
    return (
        both.groupBy("bucket", "alert_id")
        .agg(
            F.min_by(F.struct(*fixed), "first_seq").alias("first"),
            F.max_by(F.struct(*STATUS_COLUMNS), "seq").alias("last"),
            F.min("first_seq").alias("first_seq"),
            F.max("seq").alias("seq"),
        )
        .select("bucket", "alert_id", "first.*", "last.*", "first_seq", "seq")
    )


def alert_table(spark: SparkSession, path: str) -> SnapshotTable:
    """The alert history by buckets of the id, kept up to date by changes."""
    orders = [T.StructField("first_seq", T.LongType()), T.StructField("seq", T.LongType())]
    schema = T.StructType([*ALERT_HISTORY.fields, *orders])
    return SnapshotTable(spark, path, schema, ["alert_id"], merge_alerts, "bucket", T.IntegerType())


def alert_changes(changes: DataFrame) -> DataFrame:
    """Rows of ``history_rows`` with ``seq`` in the form that ``alert_table`` takes."""
    return changes.withColumns({"first_seq": F.col("seq").cast("long"), "bucket": alert_bucket()})
