"""The line field against plain versions: every labelling of short chains, features text by text, gradients by differences."""

import itertools
import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from cases import no_docs, odd_docs

from logtide.llm import arrays, quality, queries


def texts(*values):
    return arrays.texts_of(pa.array(list(values), pa.string()))


def plain_lines(text):
    """(start, end, features) of each line, read off the text without arrays."""
    data = (text or "").encode()
    out, at = [], 0
    for raw in data.split(b"\n"):
        words, w = [], 0
        space = {0x20, *range(9, 14)}
        while w < len(raw):
            if raw[w] in space:
                w += 1
                continue
            e = w
            while e < len(raw) and raw[e] not in space:
                e += 1
            words.append((w, e))
            w = e
        if words:
            out.append((at + words[0][0], at + words[-1][1], [raw[a:b] for a, b in words]))
        at += len(raw) + 1
    if not out:
        blank = np.zeros(quality.OWN)
        blank[1] = 1
        return [(0, 0, blank)]
    lines = []
    for start, end, words in out:
        f = np.zeros(quality.OWN)
        body = data[start:end]
        f[0] = 1
        f[2], f[3] = math.log1p(len(words)) / 4, math.log1p(len(body)) / 6
        f[4] = sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words)
        f[5] = 1 - len(set(words)) / len(words)
        f[6] = len(body) / len(words) / 10
        f[7] = sum(words == other for *_, other in out) > 1
        f[8] = body[-1:] in (b".", b",", b";", b":")
        for byte in body:
            if quality._KIND[byte] < quality.KINDS:
                f[9 + quality._KIND[byte]] += 1 / len(body)
        for word in words:
            runs = [k for k, _ in itertools.groupby(int(quality._SHAPE[b]) for b in word)]
            hashed = 0
            for i, k in enumerate(runs):
                hashed += int(arrays._BYTE[k]) * pow(0xD1342543DE82EF95, i, 2**64)
            bucket = int(arrays.mix64(np.array([hashed % 2**64], np.uint64))[0] % np.uint64(quality.SHAPES))
            f[9 + quality.KINDS + bucket] += 1 / len(words)
        lines.append((start, end, f))
    return lines


def plain_score(field, text):
    """Forward and backward line by line."""
    lines = plain_lines(text)
    none = np.zeros(quality.OWN)
    node = []
    for i, (*_, own) in enumerate(lines):
        before = lines[i - 1][2] if i else none
        after = lines[i + 1][2] if i + 1 < len(lines) else none
        node.append(float(np.concatenate([own, before, after, [i > 0, i + 1 < len(lines)]]) @ field.node))
    local = [np.array([1.0, math.exp(min(s, 500))]) for s in node]
    local = [v / v.sum() for v in local]
    step = np.exp(field.edge)
    ahead = [local[0]]
    for v in local[1:]:
        a = (ahead[-1] @ step) * v
        ahead.append(a / a.sum())
    behind = [np.ones(2)]
    for v in reversed(local[1:]):
        b = step @ (v * behind[-1])
        behind.append(b / b.sum())
    good = [a[1] * b[1] / (a @ b) for a, b in zip(ahead, reversed(behind), strict=True)]
    weight = [max(end - start, 1) for start, end, _ in lines]
    return float(field.score(np.array([np.average(good, weights=weight)]))[0])


def test_probabilities_equal_a_sum_over_all_labellings():
    rng = np.random.default_rng(3)
    lengths = [1, 4, 2, 7, 1]
    at = np.append(0, np.cumsum(lengths))
    node, edge = rng.normal(0, 2, at[-1]), rng.normal(0, 1, (2, 2))
    chains = quality.Chains(node, edge, at)
    for d, (a, b) in enumerate(zip(at[:-1], at[1:], strict=True)):
        total, good = 0.0, np.zeros(b - a)
        pairs = np.zeros((b - a, 2, 2))
        for labels in itertools.product((0, 1), repeat=b - a):
            s = sum(node[a + i] * y for i, y in enumerate(labels)) + sum(edge[x, y] for x, y in itertools.pairwise(labels))
            total += math.exp(s)
            good += math.exp(s) * np.array(labels)
            for i, (x, y) in enumerate(itertools.pairwise(labels), 1):
                pairs[i, x, y] += math.exp(s)
        assert chains.log_total[d] == pytest.approx(math.log(total))
        assert chains.good[a:b] == pytest.approx(good / total)
        for i in range(1, b - a):
            found = chains.pairs[np.flatnonzero(chains.inner == a + i)[0]]
            assert found == pytest.approx(pairs[i] / total)


def test_long_and_extreme_chains_stay_finite():
    node = np.concatenate([np.full(5_000, 800.0), np.full(5_000, -800.0), [0.0]])
    chains = quality.Chains(node, np.array([[2.0, -40.0], [-40.0, 2.0]]), np.array([0, 10_000, 10_001]))
    assert np.isfinite(chains.good).all() and np.isfinite(chains.log_total).all()
    assert chains.good[0] > 0.99 and chains.good[9_999] < 0.01 and chains.good[10_000] == pytest.approx(0.5)


def test_gradient_by_differences():
    rng = np.random.default_rng(5)
    lines = quality.Lines(texts("One line.\nANOTHER LINE!!\nthird", "ok\nok\n\nno", "", "a | b | c |\nplain words here, all of them.\n1 2 3"))
    own = [lines.own[a:b].tobytes() for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 0, 0, 0], pa.int32()), pa.array(own, pa.binary())], ["quality", "own"])
    first = rng.normal(0, 0.3, quality.ALL).astype(np.float32)

    def value(w):
        row = next(quality.loss_of(w, True, first)(iter([batch])))
        return row.column(1)[0].as_py(), np.array(row.column(2)[0].as_py())

    w = rng.normal(0, 0.3, quality.ALL + 4).astype(np.float32).astype(float)
    _, slope = value(w)
    for i in [0, 2, 9, 20, quality.OWN + 3, quality.ALL - 1, *range(quality.ALL, quality.ALL + 4)]:
        e = np.zeros(len(w))
        e[i] = 1e-2
        assert slope[i] == pytest.approx((value(w + e)[0] - value(w - e)[0]) / 2e-2, abs=2e-3)


def test_good_lines_of_bad_documents():
    at, found = np.array([0, 3, 5, 6]), np.array([1.0, -2.0, 3.0, 5.0, 4.0, -9.0])
    assert quality.line_labels(np.array([0, 0, 1]), at, found).tolist() == [1, 0, 1, 1, 0, 1]
    assert quality.line_labels(np.array([0, 0, 1]), at, None).tolist() == [0, 0, 0, 0, 0, 1]


def test_lines_of_odd_texts():
    values = ["", None, "\n\n", "a", " \n a  b \n\n c.\r\n", "ß é\nß é", "x" * 3_000, "a\n" * 2_000, "#" * 50 + "\n" + "!?" * 9]
    lines = quality.Lines(texts(*values))
    for i, value in enumerate(values):
        want, rows = plain_lines(value), range(lines.at[i], lines.at[i + 1])
        assert [(lines.start[r], lines.end[r]) for r in rows] == [(a, b) for a, b, _ in want]
        assert lines.own[lines.at[i] : lines.at[i + 1]] == pytest.approx(np.array([f for *_, f in want]), abs=1e-5)


@pytest.fixture(scope="module")
def fitted(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{small_dir}/labels.parquet").where(~(queries.lm.id_remainder(3) == 1))
    return quality.fit_on(docs, labels)


def test_query_equals_plain_field_on_the_whole_table(spark, small_dir, fitted):
    """Features, chains and mean of every whole text by loops, with the weights that the query fits."""
    rows = queries.QUERIES["op11_line_quality"](spark, small_dir)
    assert dict(rows.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    found = {r["doc_id"]: r for r in rows.collect()}
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:
        r = found[d["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert r["score"] == pytest.approx(plain_score(fitted, d["text"]), abs=2e-3)
        assert r["predicted"] == (r["score"] >= 0.5)


def test_held_out_accuracy(spark):
    """On documents whose labels the fit has not seen: bad ones found, good ones left alone."""
    sf = "/root/testdata/sf0.01"
    scored = queries.QUERIES["op11_line_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    bad, good = ([r["predicted"] for r in scored if r["quality"] == q] for q in (0, 1))
    assert len(bad) > 10 and sum(bad) <= 0.1 * len(bad)
    assert sum(good) >= 0.97 * len(good)


def test_tasks_and_blocks_do_not_change_scores(spark, small_dir, fitted):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    one = sorted(map(tuple, quality.score(docs.coalesce(1), fitted).drop("text").collect()))
    many = sorted(map(tuple, quality.score(docs.repartition(13), fitted).drop("text").collect()))
    assert one == many


def test_odd_rows_and_spans(spark, fitted):
    docs = odd_docs(spark)
    out = quality.score(docs, fitted, spans=True)
    assert out.columns == [*docs.columns, "score_", "predicted", "lines"]
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        size = len((r["text"] or "").encode())
        assert 0 <= r["score_"] <= 1 and r["lines"] and all(0 <= s["start"] <= s["end"] <= size for s in r["lines"])
    assert len({r["score_"] for r in rows if not (r["text"] or "").strip()}) == 1
    assert quality.score(no_docs(spark), fitted).count() == 0


def test_sample_is_bounded_when_ids_repeat(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "b"), (None, "c")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (None, 1), (3, None), (4, 7)], "doc_id bigint, quality int")
    rows = sorted(map(tuple, quality.labelled_sample(docs, labels, 10).collect()))
    assert rows == [(0, "b"), (0, "text 0"), (1, "text 0")]


def test_without_two_classes(spark):
    docs = odd_docs(spark)
    labels = spark.createDataFrame([(3, 1), (5, 1)], "doc_id bigint, quality int")
    assert quality.fit_on(docs, labels) == 1.0
    assert quality.fit_on(docs, labels.limit(0)) == 0.5
    assert quality.fit_on(no_docs(spark), labels) == 1.0
    assert {r["score_"] for r in quality.score(docs, 0.5).collect()} == {0.5}


def test_separable_sample(spark):
    rng = random.Random(2)
    rows = []
    for i in range(300):
        line = " ".join(rng.choice(["alpha", "beta", "gamma"]) + str(rng.randrange(9)) for _ in range(8))
        rows.append((i, line + ".\n" + line.upper() + "!!" if i % 3 == 0 else line + ".", int(i % 3 != 0)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int")
    field = quality.fit_on(df.select("doc_id", "text"), df.select("doc_id", "quality"))
    out = quality.score(df, field).collect()
    assert all(r["predicted"] == r["quality"] for r in out)
