"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.session import ship

# The white space of the word and text contracts, in the syntax of Java's and RE2's patterns.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_for_texts(spark: SparkSession) -> None:
    """Give the workers this package, and texts in Arrow batches of 1,000 rows unless the session asks for another size.

    Spark's 10,000 rows are meant for numbers; as many texts take tens of megabytes on both sides of each task.
    """
    ship(spark)
    if spark.conf.get(BATCH_CONF) == "10000":
        spark.conf.set(BATCH_CONF, "1000")


def whole_text(column: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have yet (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_hash(df: DataFrame) -> Column:
    """One number for all columns of a row; maps, which have no hash, go in as their sorted entries."""
    parts = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        kind = field.dataType.typeName()
        parts.append(F.to_json(column) if kind in ("map", "struct", "array", "variant") else column)
    return F.xxhash64(*parts)


def keep_rows(marked: DataFrame, winners: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The rows of ``marked`` whose keys are among ``winners`` (keys, twins), with the given columns.

    Where ``twins`` is true several rows are equal in every column; one of them stays. Keys have no null.
    """
    twins = fresh(marked, "twins")
    kept = marked.join(winners.withColumnRenamed("twins", twins), keys)
    single = kept.where(~F.col(twins)).unionByName(kept.where(twins).dropDuplicates(keys))
    return single.select(*[F.col(f"`{c}`") for c in columns])
