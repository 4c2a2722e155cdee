import hashlib
import re

import cases
import pytest
from pyspark.sql import functions as F

from logtide.llm import exact
from logtide.session import scratch_path


def digest(text):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()


def order(doc_id):
    return (doc_id is None, doc_id or 0)


def test_report(spark):
    texts = cases.odd_texts()
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 4)
    rows = exact.report_copies(cases.odd_docs(spark), index).collect()
    assert len(rows) == len(texts)
    groups = {}
    for i, t, _ in texts:
        groups.setdefault(digest(t), []).append(i)
    for r in rows:
        group = groups[r["text_sha256"]]
        assert r["keep_id"] == min(group, key=order) and r["group_size"] == len(group)
        assert not r["kept"] or r["doc_id"] == r["keep_id"]
    assert sum(r["kept"] for r in rows) == len(groups)
    assert index.rows().count() == len(groups)


def test_keep_first_keeps_columns_and_one_of_each(spark):
    docs = cases.odd_docs(spark)
    kept = exact.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    got = {digest(r["text"]): r["doc_id"] for r in rows}
    assert len(got) == len(rows)
    want = {}
    for i, t, _ in cases.odd_texts():
        d = digest(t)
        want[d] = min([want[d], i] if d in want else [i], key=order)
    assert got == want


def test_index_outlives_a_batch(spark):
    path = scratch_path(spark, "index")
    one = cases.odd_docs(spark, [(1, "a b", "s"), (2, "c", "s")])
    two = cases.odd_docs(spark, [(3, "a  b", "s"), (4, "d", "s"), (0, "c", "s")])
    assert {r["doc_id"] for r in exact.keep_first(one, path).collect()} == {1, 2}
    assert {r["doc_id"] for r in exact.keep_first(two, path).collect()} == {4}
    assert exact.keep_first(two, path).count() == 0
    assert exact.DigestIndex(spark, path).rows().count() == 3


def test_empty(spark):
    assert exact.keep_first(cases.no_docs(spark)).collect() == []
    index = exact.DigestIndex(spark, scratch_path(spark, "index"))
    assert exact.report_copies(cases.no_docs(spark), index).collect() == []


def test_plan_reads_buckets_in_place(spark):
    index = exact.DigestIndex(spark, scratch_path(spark, "index"), 8)
    docs = cases.odd_docs(spark).selectExpr("doc_id", "unhex(sha2(coalesce(text, ''), 256)) digest", "doc_id row")
    index.add(docs)
    new = docs.groupBy("digest").count()
    plan = new.join(index.rows().select("digest").hint("merge"), "digest", "left_anti")
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and text.count("Exchange") == 1


def test_index_opened_with_another_number_of_partitions(spark):
    """The buckets are those that the index was made with, whatever the session's shuffle partitions are by then."""
    path = scratch_path(spark, "index")
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    batch = docs.select(exact.text_digest().alias("digest"), "doc_id", F.col("doc_id").alias("row"))
    exact.DigestIndex(spark, path, 4).add(batch)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.sql(f"DROP TABLE {exact.DigestIndex(spark, path).name}")  # as in a new session
        index = exact.DigestIndex(spark, path)
        assert index.buckets == 4
        index.add(batch)
        assert index.rows().count() == 2_000 == index.rows().distinct().count()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    with pytest.raises(ValueError, match="4 buckets"):
        exact.DigestIndex(spark, path, 7)


def test_index_without_layout_is_refused(spark):
    path = scratch_path(spark, "index")
    spark.range(3).write.parquet(path)
    with pytest.raises(ValueError, match="layout"):
        exact.DigestIndex(spark, path)
