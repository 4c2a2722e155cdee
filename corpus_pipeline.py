"""A corpus pipeline: toxicity, exact copies, near copies, benchmark leaks, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the documents
of the next. All but the last return the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logtide.llm import decontam, exact, jaccard, mixing, toxicity
from logtide.llm.common import table
from logtide.session import materialise

NEAR_WORDS, NEAR_PERCENT = 5, 80  # shingles of five words, similarity of 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network predicts as toxic go. It learns from the labels of the folder."""
    network = toxicity.fit_on(docs, table(spark, sf_dir, "labels"))
    marked = docs.select(F.struct("*").alias("doc"), F.col("text"))
    return toxicity.score(marked, network).where("predicted = 0").select("doc.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts stays."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar texts stays."""
    return jaccard.keep_one_of_each(docs, NEAR_WORDS, NEAR_PERCENT)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequence: copies of the documents in order of position, with epoch and words taken."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mixture),
]

# the network and the order of shingles by frequency have no SQL form; tests hold run() against a plain version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
