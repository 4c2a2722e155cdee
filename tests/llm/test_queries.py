import zlib

import brute
import check
import pytest

from logtide.llm import queries

NUMBERS = range(1, 14)


@pytest.fixture(scope="module")
def con(small_dir):
    return check.connect(small_dir)


def test_one_query_for_each_operator():
    for n in NUMBERS:
        assert len([q for q in queries.QUERIES if q.startswith(f"op{n}_")]) == 1


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_same_rows(spark, con, small_dir, name):
    assert check.compare(spark, con, small_dir, queries.QUERIES[name], queries.ORACLES[name]) is None


def test_language_model(spark, small_dir):
    docs = sorted(tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect())
    train = [t for i, t in docs if zlib.crc32(str(i).encode()) % 7 != 2]
    texts = [t for _, t in docs]
    want = list(zip(brute.kneser_ney(train, texts), brute.longer_scores(train, texts, 3), strict=True))
    rows = sorted(queries.QUERIES["op7_language_model"](spark, small_dir).collect())
    for r, (i, _), (w, score) in zip(rows, docs, want, strict=True):
        assert r["doc_id"] == i and r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2)
        assert (r["n_tokens"], r["n_known"]) == w[:2]
        assert r["base_score"] == pytest.approx(w[2], rel=1e-9) and r["score"] == pytest.approx(score, rel=1e-9)


def test_toxicity_columns(spark, small_dir):
    df = queries.QUERIES["op1_toxicity"](spark, small_dir)
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{small_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_decontamination_finds_whole_items(spark, small_dir):
    found = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op3_decontamination"](spark, small_dir).collect()}
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()
    items = spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()
    whole = {(d["doc_id"], i["item_id"]) for d in docs for i in items if i["text"] in (d["text"] or "")}
    assert whole <= found
