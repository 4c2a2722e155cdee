import hashlib
import re

import brute
import cases
import pytest

import corpus_pipeline
from logtide.llm import decontam, jaccard
from logtide.session import materialise


@pytest.fixture(scope="module")
def kept(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, small_dir), name)
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages_keep_the_columns(kept):
    for df in kept[1:-1]:
        assert df.columns == kept[0].columns
    assert set(kept[0].columns) < set(kept[-1].columns)


def test_toxic_documents_go(spark, small_dir, kept):
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{small_dir}/labels.parquet").where("toxic = 1").collect()}
    before, after = texts(kept[0]), texts(kept[1])
    assert set(after) <= set(before)
    gone = set(before) - set(after)
    assert len(gone & toxic) >= 0.6 * len(toxic & set(before)) and len(gone - toxic) <= 0.03 * len(before)


def test_exact_copies_go(kept):
    before, after = texts(kept[1]), texts(kept[2])
    first = {}
    for i in sorted(before):
        first.setdefault(hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", before[i]).encode()).digest(), i)
    assert set(after) == set(first.values())


def test_near_copies_go(kept):
    before, after = texts(kept[2]), texts(kept[3])
    rows = brute.component_rows(sorted(before.items()), 5, 80)
    assert set(after) == {c if n else i for i, n, c in rows}


def test_leaks_go(spark, small_dir, kept):
    before, after = texts(kept[3]), texts(kept[4])
    split = lambda t: [w for w in re.split(r"[^\w]+|_", t.lower()) if w]
    items = [split(r["text"]) for r in spark.read.parquet(f"{small_dir}/benchmark.parquet").collect()]
    whole = {i for i, t in before.items() if any(f" {' '.join(x)} " in f" {' '.join(split(t))} " for x in items)}
    assert not whole & set(after)
    assert set(before) - set(after) >= whole and len(set(before) - set(after)) <= 2 * len(whole) + 2


def test_mixture(kept):
    rows = kept[-1].collect()
    sizes = {i: len(brute.split_words(t)) for i, t in texts(kept[4]).items()}
    assert abs(sum(r["taken"] for r in rows) - 1.5 * sum(sizes.values())) <= 20
    for r in rows:
        assert 0 < r["taken"] <= sizes[r["doc_id"]]


def test_odd_documents_pass_every_stage(spark, small_dir):
    for docs in (cases.odd_docs(spark), cases.no_docs(spark)):
        for name, stage in corpus_pipeline.STAGES:
            columns = docs.columns
            docs = materialise(stage(spark, docs, small_dir), name)
            assert docs.columns[: len(columns)] == columns


def test_settings_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "jaccard_join", "decontamination", "mixing"]
    assert (corpus_pipeline.NEAR_WORDS, corpus_pipeline.NEAR_PERCENT) == (5, 80)
    assert decontam.SHARE == 0.8 and jaccard.keep_one_of_each.__defaults__ == (5, 80)
