"""Search by the word index: the rows that a full read finds, from few files."""

import datetime as dt

from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators import search
from logtide.session import scratch_path
from logtide.sources import snapshots
from logtide.sources.text_index import TextIndex

SCHEMA = T.StructType([T.StructField("log_id", T.StringType()), T.StructField("message", T.StringType()), T.StructField("processed_at", T.IntegerType())])


def logs(spark, start, n, at=0):
    rare = F.when(F.col("id") % 97 == 5, F.concat(F.lit(" rare-"), F.col("id") % 3, F.lit(" can't"))).otherwise("")
    return spark.range(start, start + n).select(
        F.concat(F.lit("l"), "id").alias("log_id"),
        F.when(F.col("id") % 11 != 0, F.concat(F.lit("Request "), F.col("id"), F.lit(" done."), rare)).alias("message"),
        F.lit(at).alias("processed_at"),
        F.date_add(F.lit(dt.date(2024, 1, 1)), (F.col("id") / 100).cast("int")).alias("log_date"),
    )


def same(table, index, q, **how):
    got = sorted(r["log_id"] for r in index.search(q, **how).collect())
    whole = table.read(**how).where(search.matches_text(F.col("message"), q))
    assert got == sorted(r["log_id"] for r in whole.collect())
    return got


def test_search(spark):
    table = snapshots.log_table(spark, scratch_path(spark, "logs"), SCHEMA)
    index = TextIndex(table, scratch_path(spark, "words"))
    assert same(table, index, "request") == [] and index.update() == 0
    table.upsert(logs(spark, 0, 1_000))
    assert len(same(table, index, "RARE-1!")) > 0  # nothing is indexed yet, and every day has a delta
    table.compact()
    assert index.update() == 10 and index.update() == 0
    assert same(table, index, "371") == ["l371"]
    assert len(index.search("371").inputFiles()) == 1 < len(table.read().inputFiles())
    assert len(index.search("371 905").inputFiles()) == 2
    for q in ("can't 12", "rare", "request", "no such word", " . "):
        same(table, index, q)
    assert same(table, index, "request 371", only=lambda d: d == "2024-01-04") != []
    # a replaced message, new files and a compaction that the index has not seen
    table.upsert(logs(spark, 371, 1, 1).withColumn("message", F.lit("other words")))
    table.upsert(logs(spark, 1_000, 150, 1))
    assert same(table, index, "371") == [] and same(table, index, "words 1010") == ["l1010", "l371"]
    table.compact()
    assert same(table, index, "words 1010") == ["l1010", "l371"]
    assert index.update() == 3
    assert same(table, index, "words 1010") == ["l1010", "l371"] and len(index.search("words 1010").inputFiles()) == 2
    table.expire(lambda day: day >= "2024-01-05")
    assert same(table, index, "words 1010") == ["l1010"]
