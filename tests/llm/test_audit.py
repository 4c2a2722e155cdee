"""The audit of filters against filters that are really applied one after another."""

import re
from itertools import permutations

import pytest
from cases import no_docs, odd_docs
from pyspark.sql import functions as F

from logtide.llm import audit


def plain(docs, labels):
    """(part, order, step) -> counts, by removing documents; docs are (doc_id, text, lang)."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    far = float("inf")
    fails = []
    for i, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        mine = far if i is None else i
        checks = [
            len(words) < 100,
            100 * len(set(words)) < 80 * len(words),
            100 * len(re.findall("[A-Z]", text)) > 10 * len(text),
            bool(re.search("[#$%&*|]", text)),
            any((far if j is None else j) < mine and (t or "") == text for j, t, _ in docs),
        ]
        fails.append({f for f, c in zip("ABCDE", checks, strict=True) if c})
    out, shapley = {}, {}
    for part in {lang or "" for *_, lang in docs}:
        for order in permutations("ABCDE"):
            left = [n for n, d in enumerate(docs) if (d[2] or "") == part]
            every = list(left)
            for step, f in enumerate(order, 1):
                gone = [n for n in left if f in fails[n]]
                left = [n for n in left if f not in fails[n]]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
                seen = [n for n in every if f in fails[n] and fails[n] & set(order[: step - 1])]
                only = [n for n in every if fails[n] == {f}]
                ids = [docs[n][0] for n in gone]
                out[part, "".join(order), step] = [len(left), len(gone), len(seen), len(only), sum(i in good for i in ids), sum(i in toxic for i in ids), f]
    return {k: (*v[:-1], shapley[k[0], v[-1]]) for k, v in out.items()}


def compare(spark, docs, labels):
    rows = audit.audit(docs, labels, F.col("lang"), audit.text_failures(), "E").collect()
    want = plain(docs.select("doc_id", "text", "lang").collect(), labels.select("doc_id", "quality", "toxic").collect())
    assert len(rows) == len(want)
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in rows} == want


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_whole_small_table(spark, small_dir):
    compare(spark, spark.read.parquet(f"{small_dir}/documents.parquet"), spark.read.parquet(f"{small_dir}/labels.parquet"))


def test_odd_rows_and_labels(spark):
    docs = odd_docs(spark)
    docs = docs.unionByName(docs.withColumn("lang", F.lit("xx"))).unionByName(docs.where("doc_id > 9").withColumn("doc_id", F.col("doc_id") + 50))
    labels = labels_of(spark, [(3, 1, 0), (3, 0, 1), (12, 1, 1), (12, 1, 1), (None, 1, 1), (13, None, 1), (14, None, None), (99, 1, 1), (6, 2, 3)])
    compare(spark, docs, labels)


def test_many_copies(spark):
    docs = spark.range(3_000).select(F.col("id").alias("doc_id"), F.lit("same text $ here").alias("text"), F.lit("en").alias("lang"))
    rows = audit.audit(docs, labels_of(spark, []), F.col("lang"), audit.text_failures(), "E").where("filter_order = 'EDCBA'").orderBy("step").collect()
    assert [r["removed"] for r in rows] == [2_999, 1, 0, 0, 0]


def test_empty(spark):
    assert audit.audit(no_docs(spark), labels_of(spark, []), F.col("lang"), audit.text_failures(), "E").count() == 0


def test_paths_of_the_lattice():
    for n in range(1, 7):
        edges = audit.paths(n)
        through = {}
        for order in permutations(range(n)):
            state = 0
            for f in order:
                through[state, f] = through.get((state, f), 0) + 1
                state |= 1 << f
        assert {(s, f): k for s, f, k in edges} == through


def test_other_filters(spark):
    """Own conditions, none on equal texts; a null condition passes."""
    docs = spark.createDataFrame([(1, "ab", 5), (2, "abc", None), (3, "b", 7)], "doc_id bigint, text string, n int")
    fails = {"X": F.col("n") > 6, "Y": F.length("text") > 1}
    rows = audit.audit(docs, labels_of(spark, [(3, 1, 0)]), F.lit(None), fails).orderBy("filter_order", "step").collect()
    assert [(r["part"], r["filter_order"], r["step"], r["kept"], r["removed"], r["good_lost"], r["shapley"]) for r in rows] == [
        ("", "XY", 1, 2, 1, 1, 2),
        ("", "XY", 2, 0, 2, 0, 4),
        ("", "YX", 1, 1, 2, 0, 4),
        ("", "YX", 2, 0, 1, 1, 2),
    ]
    with pytest.raises(ValueError):
        audit.audit(docs, labels_of(spark, []), F.lit(""), fails, "X")
