import random
import re

import cases
import numpy as np
import pyarrow as pa
import pytest

from logtide.llm import queries, toxicity
from logtide.llm.arrays import texts_of


def test_gradients():
    none = np.zeros(toxicity.BUCKETS, np.float32)
    net = toxicity.Network(none, none)
    net.p = {k: v.astype(float) for k, v in net.p.items()}
    texts = texts_of(pa.array(["you are an idiot today", "what a nice day", "hello trash world of mine"]))
    vocabulary = toxicity.Vocabulary(texts)
    of, place = toxicity.windows_of(vocabulary.words, 3, 6, 4)
    index = np.where(place >= 0, vocabulary.of[place], -1)
    labels, weights = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, g = net.gradients(vocabulary, index, labels, weights)
    rng = np.random.default_rng(0)
    for name, values in net.p.items():
        used = np.argwhere(np.abs(g[name]) > 1e-9)
        assert len(used)
        for at in map(tuple, used[rng.integers(len(used), size=3)]):
            old, losses = values[at], []
            for step in (1e-3, -1e-3):
                values[at] = old + step
                losses.append(net.gradients(vocabulary, index, labels, weights)[0])
            values[at] = old
            assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=1e-6, rel=1e-3)


def test_windows_cover_every_word():
    texts = texts_of(pa.array(["a " * n for n in (0, 1, 31, 32, 33, 56, 57, 200)]))
    words = toxicity.Vocabulary(texts).words
    of, place = toxicity.windows_of(words, len(texts))
    assert sorted(set(place[place >= 0].tolist())) == list(range(len(words)))
    assert all((words.of[p[p >= 0]] == t).all() for t, p in zip(of, place, strict=True))


def test_grams_of_a_word():
    one = toxicity.Vocabulary(texts_of(pa.array(["abcde"])))
    two = toxicity.Vocabulary(texts_of(pa.array(["xabcde"])))
    three = toxicity.Vocabulary(texts_of(pa.array(["abcdz"])))
    assert len(one.grams) == 3 + 2 + 1
    assert len(set(one.grams) & set(two.grams)) == 3 - 1 + 2 - 1  # the marked ones at the start differ
    assert len(set(one.grams) & set(three.grams)) == 2 + 1


@pytest.fixture(scope="module")
def setting(spark):
    rng = random.Random(8)
    rows, labels = [], []
    for i in range(900):
        words = cases.prose(rng, rng.randrange(5, 150), 800).split()
        toxic = i % 4 == 0
        if toxic:
            bad = rng.choice(["grumpf", f"snarlox{rng.randrange(60)}"])  # a word, and a stem with many endings
            words.insert(rng.randrange(len(words) + 1), bad)
        rows.append((i, " ".join(words), "s"))
        labels.append((i, int(toxic)))
    docs = cases.odd_docs(spark, rows)
    return docs, spark.createDataFrame(labels, "doc_id bigint, toxic int")


def test_held_out_accuracy(spark, setting):
    docs, labels = setting
    network = toxicity.fit_on(docs, labels, usable=toxicity.F.col("doc_id") < 700)
    found = toxicity.score(docs, network)
    assert found.columns == [*docs.columns, "score_", "predicted"]
    rows = found.join(labels, "doc_id").where("doc_id >= 700").collect()
    right = [r["predicted"] == r["toxic"] for r in rows]
    assert np.mean(right) > 0.9
    assert all(0 <= r["score_"] <= 1 and r["predicted"] == (r["score_"] >= 0.5) for r in rows)
    caught = [r["predicted"] for r in rows if r["toxic"]]
    assert np.mean(caught) > 0.75


def test_odd_documents(spark, setting):
    docs, labels = setting
    network = toxicity.fit_on(docs, labels)
    odd = cases.odd_docs(spark)
    rows = toxicity.score(odd, network).collect()
    assert len(rows) == len(cases.odd_texts())
    assert all(r["score_"] == 0 for r in rows if not (r["text"] or "").strip())
    twice = [r["score_"] for r in rows if r["doc_id"] == 12]
    assert twice[0] == twice[1]
    assert toxicity.score(cases.no_docs(spark), network).collect() == []


def test_nothing_to_learn(spark):
    docs = cases.odd_docs(spark)
    labels = spark.createDataFrame([(5, 0), (3, None), (None, 1), (999, 1)], "doc_id bigint, toxic int")
    assert toxicity.fit_on(docs, labels) is None
    assert {r["predicted"] for r in toxicity.score(docs, None).collect()} == {0}
    assert toxicity.fit_on(cases.no_docs(spark), labels.limit(0)) is None


def plain_logit(net, text):
    """The highest logit of a text's windows, word by word and gate by gate."""
    p, hidden = {k: v.astype(float) for k, v in net.p.items()}, toxicity.HIDDEN
    sigmoid = lambda v: 1 / (1 + np.exp(-v))
    words = [w for w in re.split("[ \t-\r]+", text or "") if w]
    known = {}
    for w in set(words):
        single = toxicity.Vocabulary(texts_of(pa.array([w])))
        if not len(single.bucket):
            return None
        grams = p["grams"][single.grams].mean(axis=0) if len(single.grams) else np.zeros(toxicity.WIDTH)
        known[w] = np.concatenate([p["words"][single.bucket[0]], grams])
    best = -np.inf
    last = max(len(words) - toxicity.SPAN, 0)
    for start in sorted({min(s, last) for s in range(0, last + toxicity.STEP, toxicity.STEP)}):
        window = [known[w] for w in words[start : start + toxicity.SPAN]]
        states = []
        for way, order in (("f", range(len(window))), ("b", range(len(window) - 1, -1, -1))):
            h, found = np.zeros(hidden), [None] * len(window)
            for t in order:
                x = window[t] @ p[f"in_{way}"] + p[f"in_bias_{way}"]
                u = h @ p[f"state_{way}"]
                z, r = sigmoid(x[:hidden] + u[:hidden]), sigmoid(x[hidden : 2 * hidden] + u[hidden : 2 * hidden])
                n = np.tanh(x[2 * hidden :] + r * u[2 * hidden :])
                h = z * h + (1 - z) * n
                found[t] = h
            states.append(found)
        both = [np.concatenate(s) for s in zip(*states, strict=True)]
        look = np.array([b @ p["look"] for b in both])
        share = np.exp(look - look.max()) / np.exp(look - look.max()).sum()
        best = max(best, float(sum(s * b for s, b in zip(share, both, strict=True)) @ p["out"] + p["bias"][0]))
    return best


def test_scores_of_the_whole_table_by_a_plain_forward_pass(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    net = toxicity.fit_on(docs, spark.read.parquet(f"{small_dir}/labels.parquet"))
    for r in toxicity.score(docs, net).collect():
        logit = plain_logit(net, r["text"]) if (r["text"] or "").split() else None
        assert r["score"] == pytest.approx(0 if logit is None else 1 / (1 + np.exp(-logit)), abs=2e-3)


def test_recall_and_false_alarms_on_held_out_documents(spark):
    """Of labels that training has not seen: toxic documents found, clean ones left alone."""
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = queries.QUERIES["op1_toxicity"](spark, sf).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = ([r["predicted"] for r in rows if r["toxic"] == t] for t in (1, 0))
    assert sum(toxic) >= 0.6 * len(toxic) and sum(clean) <= 0.03 * len(clean)


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(5_000)] + [(2, "b")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    assert sorted(map(tuple, toxicity.labelled_sample(docs, labels, None, 10).collect())) == [("b", 0), ("text 0", 1)]
