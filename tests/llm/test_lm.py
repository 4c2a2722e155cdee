import pathlib
import pickle
import random
import urllib.parse
import zlib

import brute
import cases
import numpy as np
import pytest

from logtide.llm import lm
from logtide.llm.arrays import texts_of


def same(got, want):
    return got[:2] == want[:2] and all(abs(a - b) <= 1e-9 * max(1, abs(b)) for a, b in zip(got[2:], want[2:], strict=True))


def scores(spark, train, texts):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    model = lm.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(2))
    rows = sorted(lm.score(docs, model).collect())
    return [(r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in rows], model


@pytest.mark.parametrize("words", [3, 40, 4000])
def test_scores(spark, words):
    rng = random.Random(words)
    texts = [cases.prose(rng, rng.randrange(0, 80), words) for _ in range(60)] + ["", None, "A a Ä ä", "w1 " * 50]
    train = texts[::2]
    got, model = scores(spark, train, texts)
    want = list(brute.kneser_ney(train, texts))
    assert all(same(a, b) for a, b in zip(got, want, strict=True))
    assert model.tokens == sum(len(brute.split_words(t)) + 1 for t in train)


def test_chunks_and_stripes_do_not_matter(spark, monkeypatch):
    rng = random.Random(1)
    texts = [cases.prose(rng, 50, 200) for _ in range(50)]
    one, _ = scores(spark, texts[:30], texts)
    monkeypatch.setattr(lm, "CHUNK", 100)
    monkeypatch.setattr(lm, "BLOCK", 500)
    monkeypatch.setattr(lm, "STRIPE_TOKENS", 50)
    two, model = scores(spark, texts[:30], texts)
    assert model.stripes > 8
    assert all(same(a, b) for a, b in zip(one, two, strict=True))


def test_probabilities_sum_to_one(spark):
    train = ["a b c a b d", "a a b e e f g", "b c d", "c d a b"]
    model = scores(spark, train, ["a"])[1]
    after_b = lm.np.array([model.numbers(lm.tokens_of(texts_of(lm.pa.array(["b"])))[0])[0]])
    numbers = lm.np.arange(-1, model.words)  # the unknown word and all known ones
    pairs = lm.np.column_stack([lm.np.repeat(after_b, len(numbers)), numbers]).ravel()
    logs = model.log_probabilities(pairs, lm.np.arange(0, len(pairs), 2))
    assert abs((10 ** logs[1::2]).sum() - 1) < 1e-9


def test_nothing_to_train_on(spark):
    got, model = scores(spark, [], ["a b", None])
    assert model.words == 0 and [g[:2] for g in got] == [(3, 0), (1, 0)]
    assert all(abs(v) < 1e-12 for g in got for v in g[2:])


def test_odd_documents(spark):
    docs = cases.odd_docs(spark)
    found = lm.score(docs, lm.fit(docs.select("text")))
    assert found.columns == [*docs.columns, "n_tokens", "n_known", "base_score", "score_"]
    rows = found.collect()
    assert len(rows) == len(cases.odd_texts())
    assert all(r["n_tokens"] == len(brute.split_words(r["text"])) + 1 == r["n_known"] for r in rows)
    assert lm.score(cases.no_docs(spark), lm.fit(cases.no_docs(spark))).collect() == []


def test_id_remainder(spark):
    rows = spark.createDataFrame([(i,) for i in (0, 5, 123456, -3, None)], "doc_id bigint").select("doc_id", lm.id_remainder(7).alias("r"))
    assert all(r["r"] == zlib.crc32(str(r["doc_id"]).encode() if r["doc_id"] is not None else b"") % 7 for r in rows.collect())


@pytest.mark.parametrize(("order", "words"), [(3, 3), (3, 40), (4, 12)])
def test_longer_runs(spark, monkeypatch, order, words):
    monkeypatch.setattr(lm, "FEW", 2)
    rng = random.Random(words)
    texts = [cases.prose(rng, rng.randrange(0, 60), words) for _ in range(40)] + ["", None, "w1 w2 unknown w1 w2"]
    train = texts[:30] + [""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(3)
    model = lm.fit(spark.createDataFrame([(t,) for t in train], "text string").repartition(2), order=order)
    rows = sorted(lm.score(docs, model).collect())
    assert [r["score"] for r in rows] == pytest.approx(list(brute.longer_scores(train, texts, order)), rel=1e-9)


def test_counts_and_keys_do_not_wrap():
    counts = np.array([1, 2**33 + 5], np.uint64)
    assert lm.narrow(counts).tolist() == counts.tolist()
    assert [lm.narrow(np.array([m], np.uint64)).itemsize for m in (255, 256, 65_536, 2**32 - 1, 2**32)] == [1, 2, 4, 4, 8]
    lm.guard_keys(2**40, 2**23)
    with pytest.raises(OverflowError):
        lm.guard_keys(2**40, 2**24)


def test_missing_table_is_an_error(spark):
    docs = cases.odd_docs(spark)
    model = lm.fit(docs.select("text"), order=3)
    folder = pathlib.Path(urllib.parse.urlparse(model.path).path)
    files = [f.name for f in folder.iterdir() if not f.name.startswith(".")]
    for kind in sorted({f.rsplit("-", 1)[0] for f in files}):
        file = next(folder / f for f in files if f.rsplit("-", 1)[0] == kind)
        away = file.with_name("." + file.name)
        file.rename(away)
        fresh = pickle.loads(pickle.dumps(model))
        with pytest.raises(FileNotFoundError):
            fresh.table(file.name, np.uint8)
        away.rename(file)
