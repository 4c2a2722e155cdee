"""A word index beside a snapshot table: which files of the table hold a word.

Per file of the table the distinct words of a text column are stored as (word, file), dealt to buckets by a hash of the word
and sorted by word, so a lookup reads one bucket per word and, by row-group statistics, little of it. A search reads the
files that the index names and matches their rows; what it can't know is read in full, so results are always whole:
files written after the last ``update``, and partitions with deltas, where a row found may be replaced by a later one.

The index is a snapshot table of its own; ``update`` adds the files that are new, once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.functions.text import tokens
from logtide.sources.snapshots import Snapshot, SnapshotTable

BUCKETS = 64
MOST_FILES = 10_000  # a word in more files of the table is not rare: reading them all costs no lookup


def word_bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


class TextIndex:
    """Index of ``column`` of a table."""

    def __init__(self, table: SnapshotTable, path: str, column: str = "message") -> None:
        self.table, self.column, self.spark = table, column, table.spark
        fields = [T.StructField("word", T.StringType()), T.StructField("file", T.StringType()), T.StructField("directory", T.StringType())]
        both = lambda base, deltas: base.unionByName(deltas).distinct()
        self.words = SnapshotTable(table.spark, path, T.StructType(fields), ["word", "file"], both, "bucket", T.IntegerType())

    def _indexed(self, at: Snapshot) -> set[str]:
        """Directories of the table that the index knows, as its transactions name them."""
        return set(at.done)

    def update(self) -> int:
        """Index the directories of the newest snapshot that are new; returns how many. Words are counted nowhere on the driver."""
        at = self.table.snapshot()
        known = self._indexed(self.words.snapshot())
        new = sorted(f"{f}/{p}" for f, p in at.folders() if f"{f}/{p}" not in known)
        if not new:
            return 0
        data = f"{self.table.path}/data"
        rows = self.spark.read.schema(self.table.schema).option("basePath", data).parquet(*[f"{data}/{d}" for d in new])
        found = rows.select(F.explode(F.array_distinct(tokens(F.col(self.column)))).alias("word"), F.input_file_name().alias("_path"))
        found = found.select("word", *[F.regexp_extract("_path", p, 1).alias(c) for p, c in ((r"/data/(.*)$", "file"), (r"/data/(.*)/[^/]*$", "directory"))])
        found = found.distinct().withColumn("bucket", word_bucket(F.col("word")))
        self.words.upsert(found.repartition(F.col("bucket")).sortWithinPartitions("bucket", "word"))
        there = {f"{f}/{p}" for f, p in at.folders()}
        self.words._commit(
            lambda now: Snapshot(base=now.base, deltas=now.deltas, done={d: [0] for d in [*now.done, *new] if d in there})
        )
        if len(self.words.snapshot().deltas) > 8:
            self.words.compact()
        return len(new)

    def files_with(self, q: str) -> tuple[list[str] | None, set[str]]:
        """(files that hold any word of the query, directories indexed); none if they are too many to name."""
        at = self.words.snapshot()
        asked = [r["word"] for r in self.spark.range(1).select(F.explode(F.array_distinct(tokens(F.lit(q)))).alias("word")).collect()]
        if not asked:
            return [], self._indexed(at)
        buckets = {str(r["b"]) for r in self.spark.createDataFrame([(w,) for w in asked], "word string").select(word_bucket(F.col("word")).alias("b")).collect()}
        hits = self.words.read(at.version or None, only=buckets.__contains__).where(F.col("word").isin(asked)).select("file").distinct()
        files = [r["file"] for r in hits.limit(MOST_FILES + 1).collect()]
        return (None if len(files) > MOST_FILES else files), self._indexed(at)

    def search(self, q: str, only=None) -> DataFrame:
        """Rows of the table whose text has any word of the query, as ``search.matches_text`` finds them by reading all.

        ``only`` chooses partitions of the table by value.
        """
        at = self.table.snapshot()
        keep = lambda p: only is None or only(p.split("=", 1)[1])
        dirty = {p for p in at.dirty() if keep(p)}
        files, known = self.files_with(q)
        clean = {f"{f}/{p}" for f, parts in at.base.items() for p in parts if p not in dirty and keep(p)}
        matches = F.arrays_overlap(tokens(F.col(self.column)), tokens(F.lit(q)))
        data = f"{self.table.path}/data"
        paths = [f"{data}/{d}" for d in sorted(clean if files is None else clean - known)]
        if files is not None:
            paths += [f"{data}/{f}" for f in sorted(files) if f.rsplit("/", 1)[0] in clean & known]
        found = self.table.spark.createDataFrame([], self.table.schema)
        if paths:
            rows = self.spark.read.schema(self.table.schema).option("basePath", data).parquet(*paths)
            found = rows.select(*self.table.schema.fieldNames()).where(matches)
        if dirty:
            found = found.unionByName(self.table._merged(at, dirty).where(matches))
        return found
