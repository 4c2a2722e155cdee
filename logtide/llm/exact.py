"""Exact deduplication against a persistent digest index.

The index is a Parquet table, bucketed and sorted by digest. New rows are reduced to one row per digest, joined to the
index by a sort-merge anti-join that reads the buckets in place, and what is unseen is appended to the index. Only
digests and ids move; texts are read once and never shuffled for the decision.

Texts are equal when they are the same after each run of white space became one space; a null text counts as empty. Of
equal texts the row with the smallest ``doc_id`` stays, null ids behind all others; among rows with the same id and text
exactly one stays. A group of copies of any size is pre-aggregated before the shuffle, and joins that bring a group's
result back to its rows are plain equi-joins whose large partitions adaptive execution splits.
"""

from __future__ import annotations

import hashlib

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm.common import SPACE, fresh, keep_rows, row_hash, whole_text
from logtide.session import materialise, scratch_path


def text_digest(column: str = "text") -> Column:
    """SHA-256 of the text with white space made uniform, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(whole_text(column), SPACE, " "), 256))


class DigestIndex:
    """The stored index: one row per known digest with the row that stays.

    ``path`` is a folder in the shared store and outlives the session. The number of buckets, which every reader must know,
    is stored beside it when the index is made; a later opening takes it from there and refuses another number.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None) -> None:
        self.spark = spark
        self.buckets = self._layout(path.rstrip("/"), buckets)
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()[:16]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest BINARY, keep_id BIGINT, keep_row BIGINT) USING parquet"
            f" CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def _layout(self, path: str, asked: int | None) -> int:
        """The stored number of buckets; of a new index the one asked for, by default as many as a shuffle has partitions."""
        beside = f"{path}.layout"
        schema = "buckets int"
        try:
            stored = self.spark.read.schema(schema).json(beside).first()["buckets"]
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            if folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(folder):
                raise ValueError(f"{path} has no layout beside it, so its buckets cannot be read") from None
            new = asked or int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self.spark.createDataFrame([(new,)], schema).coalesce(1).write.json(beside)
            return new
        if asked is not None and asked != stored:
            raise ValueError(f"{path} has {stored} buckets, not {asked}")
        return stored

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, batch: DataFrame) -> None:
        """Append the digests of a batch (digest, doc_id, row) that the index does not have.

        Running a batch again appends nothing, so a job that was lost half-way can simply be repeated.
        """
        first_row = F.coalesce(F.min_by("row", "doc_id"), F.min("row"))
        new = batch.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), first_row.alias("keep_row"))
        # stored, or the anti-join would be moved below the aggregation and all copies of a text would meet in one task
        new = materialise(new, "new-digests")
        new.join(self.rows().select("digest").hint("merge"), "digest", "left_anti").write.insertInto(self.name)


def report_copies(docs: DataFrame, index: DigestIndex, batches: int = 2) -> DataFrame:
    """One row per document: the row that stays in its place, the size of its group, whether it is kept, its digest.

    The documents are added in ``batches`` ranges of ``doc_id`` one after another, as they would arrive over time; ranges
    rise, so the first copy to arrive is the one with the smallest id. An empty table gives no rows.
    """
    found = materialise(
        docs.select("doc_id", text_digest().alias("digest"), F.monotonically_increasing_id().alias("row")), "digests"
    )
    steps = [i / batches for i in range(1, batches)]
    cuts = found.agg(F.percentile_approx("doc_id", steps, 1000).alias("cuts")).first()["cuts"] if steps else []
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = found
        if low is not None:
            part = part.where((F.col("doc_id") > low) | F.col("doc_id").isNull())
        if high is not None:
            part = part.where(F.col("doc_id") <= high)
        index.add(part)
    sizes = found.groupBy("digest").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = materialise(sizes.join(index.rows().hint("merge"), "digest"), "copy-groups")
    return found.join(groups, "digest", "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The documents that stay, with their columns.

    ``path`` names an index of earlier data: texts known there go, and those that stay are appended. Without it the
    documents are only held against one another. Rows equal in every column are copies too; one of them stays.
    """
    spark = docs.sparkSession
    digest, row = fresh(docs, "digest"), fresh(docs, "row")
    marked = docs.withColumns({digest: text_digest(), row: row_hash(docs).bitwiseAND(F.lit(-2))})
    keys = materialise(marked.select(F.col(digest).alias("digest"), "doc_id", F.col(row).alias("row")), "digests")
    index = DigestIndex(spark, path or scratch_path(spark, "digest-index"))
    known = materialise(index.rows().select("digest"), "known-digests") if path else None
    index.add(keys)
    # the lowest bit of the winner's row number tells whether other rows equal it in every column
    same = keys.groupBy("digest", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    mark = F.col("row").bitwiseAND(F.lit(-2)).bitwiseOR(F.when(F.col("n") > 1, 1).otherwise(0))
    same = same.select("digest", "doc_id", mark.alias("mark"))
    first = same.groupBy("digest").agg(F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark"))
    first = materialise(first, "first-copies")
    if known is not None:
        first = first.join(known, "digest", "left_anti")
    winners = first.select(
        F.col("digest").alias(digest),
        F.col("mark").bitwiseAND(F.lit(-2)).alias(row),
        (F.col("mark").bitwiseAND(F.lit(1)) == 1).alias("twins"),
    )
    return keep_rows(marked, winners, [digest, row], docs.columns)
