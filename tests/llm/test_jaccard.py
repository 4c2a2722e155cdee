import random

import brute
import cases
import numpy as np
import pytest

from logtide.llm import jaccard
from logtide.llm.components import components


def near_docs(seed, groups=25, chain=True):
    rng = random.Random(seed)
    rows = []
    for _ in range(groups):
        words = cases.prose(rng, rng.choice([3, 6, 12, 30, 80, 200]), 60 if rng.random() < 0.3 else 4000).split()
        for _ in range(rng.randrange(1, 7)):
            rows.append(" ".join(words))
            if chain or rng.random() < 0.5:
                for _ in range(rng.randrange(0, 2 + len(words) // 25)):
                    words[rng.randrange(len(words))] = f"n{rng.randrange(9999)}"
    ids = list(range(len(rows)))
    rng.shuffle(ids)
    return list(zip(ids, rows, strict=True))


def report(spark, rows, words, percent):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    return sorted(map(tuple, jaccard.report_components(docs, words, percent).collect()))


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 50)])
def test_components(spark, words, percent):
    rows = near_docs(words)
    assert report(spark, rows, words, percent) == brute.component_rows(rows, words, percent)


def test_long_lists_are_cut_into_parts(spark, monkeypatch):
    rows = near_docs(9, 12)
    fn = jaccard.document_components
    monkeypatch.setattr(jaccard, "document_components", lambda d, w, p: fn(d, w, p, most=200))
    assert report(spark, rows, 4, 85) == brute.component_rows(rows, 4, 85)


def drifting(seed, number, words=120):
    """One large group: copies that drift away from each other, some of them joined by a few links only, and strangers."""
    rng = random.Random(seed)
    first = cases.prose(rng, words, 4000).split()
    now, rows = list(first), []
    for i in range(number):
        rows.append(" ".join(now))
        now[rng.randrange(words)] = f"n{rng.randrange(9999)}"
        if i % 40 == 39:
            now = first[: words // 2] + cases.prose(rng, words // 2, 4000).split()
    return list(enumerate(rows))


def searched_rows(monkeypatch):
    """Rows of each search, by its name."""
    rows, fn = {}, jaccard._search

    def search(found, sets, percent, name):
        rows[name] = rows.get(name, 0) + found.count()
        return fn(found, sets, percent, name)

    monkeypatch.setattr(jaccard, "_search", search)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_a_large_block_is_searched_in_parts(spark, monkeypatch, seed):
    rows = drifting(seed, 170)
    fn, seen = jaccard.document_components, searched_rows(monkeypatch)
    monkeypatch.setattr(jaccard, "document_components", lambda d, w, p: fn(d, w, p, most=1500))
    assert report(spark, rows, 4, 85) == brute.component_rows(rows, 4, 85)
    assert set(seen) == {"links", "top-links", "rest-links"} and seen["rest-links"] > 0


def test_a_group_of_copies_is_sent_in_proportion(spark, monkeypatch):
    fn = jaccard.document_components
    monkeypatch.setattr(jaccard, "document_components", lambda d, w, p: fn(d, w, p, most=1500))
    sent = []
    for number in (80, 320):
        rng = random.Random(4)
        base = cases.prose(rng, 120, 4000).split()
        rows = []
        for i in range(number):
            words = list(base)
            words[rng.randrange(120)] = f"n{i}"
            rows.append((i, " ".join(words)))
        seen = searched_rows(monkeypatch)
        assert {r[2] for r in report(spark, rows, 4, 85)} == {0}
        sent.append(sum(seen.values()))
    assert sent[1] < 6 * sent[0]


def test_whole_table(spark, small_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert report(spark, rows, 4, 85) == brute.component_rows(rows, 4, 85)


def test_merge_skip():
    rng = random.Random(2)
    for _ in range(200):
        lists = [sorted(rng.sample(range(30), rng.randrange(12))) for _ in range(rng.randrange(1, 8))]
        least = rng.randrange(1, len(lists) + 1)
        counts = {v: sum(v in x for x in lists) for v in range(30)}
        assert list(jaccard.merge_skip(lists, least)) == [(v, n) for v, n in counts.items() if n >= least]


def test_block_links():
    rng = random.Random(3)
    for _ in range(30):
        sets = []
        for _ in range(rng.randrange(2, 12)):
            base = set(rng.choice(sets).tolist()) if sets and rng.random() < 0.7 else set(rng.sample(range(500), rng.randrange(1, 60)))
            base ^= set(rng.sample(range(500), rng.randrange(0, 4)))
            if base:
                sets.append(np.array(sorted(base), np.uint64))
        sets.sort(key=len)
        part = jaccard.block_links(sets, 80)
        parent = list(range(len(sets)))
        for _ in sets:
            for i, a in enumerate(sets):
                for j, b in enumerate(sets[:i]):
                    both = len(np.intersect1d(a, b))
                    if 100 * both >= 80 * (len(a) + len(b) - both):
                        parent[i] = parent[j] = min(parent[i], parent[j])
        assert part.tolist() == parent


def test_a_dense_block_is_counted(monkeypatch):
    """Sets just below the similarity are no heap work for each pair, and the components are those of all pairs."""
    rng = random.Random(5)
    calls, fn = [], jaccard.merge_skip
    monkeypatch.setattr(jaccard, "merge_skip", lambda *a: calls.append(1) or fn(*a))
    for missing in (4, 5, 6):
        base = rng.sample(range(10_000), 60)
        sets = []
        for i in range(150):
            own = set(base) - set(rng.sample(base, missing)) | {10_000 + 10 * i + j for j in range(rng.randrange(3))}
            sets.append(np.array(sorted(own), np.uint64))
        sets.sort(key=len)
        calls.clear()
        dense = jaccard.block_links(sets, 85).tolist()
        assert len(calls) < 75
        for limits in ({"DENSE": 10**9}, {"DENSE": 0, "PROBE": 0}):
            with monkeypatch.context() as m:
                for name, value in limits.items():
                    m.setattr(jaccard, name, value)
                assert jaccard.block_links(sets, 85).tolist() == dense
        parent = list(range(len(sets)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                both = len(np.intersect1d(a, b))
                if 100 * both >= 85 * (len(a) + len(b) - both):
                    low, high = sorted((parent[i], parent[j]))
                    parent = [low if x == high else x for x in parent]
        assert dense == parent


def test_settled_links_take_no_round(spark, monkeypatch):
    from logtide.llm import components as module

    names, fn = [], module.materialise
    monkeypatch.setattr(module, "materialise", lambda df, name: names.append(name) or fn(df, name))
    stars = spark.createDataFrame([(1, 2), (1, 3), (7, 9)], "a bigint, b bigint")
    assert sorted(map(tuple, components(stars).collect())) == [(2, 1), (3, 1), (9, 7)]
    assert names == ["edges"]


def test_short_lists_meet():
    """Any two sets that reach the similarity share enough shingles of their short lists, at worst one less than c."""
    for percent in (80, 85):
        for big in range(1, 400):
            for small in range(-(-percent * big // 100), big + 1):
                need = -(-percent * (big + small) // (100 + percent))
                left = max(s - jaccard.short_lists(s, percent) for s in (big, small))
                assert need - left >= jaccard.least_common(big)
                assert need - left >= jaccard.least_common(small)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)} | {201: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_odd_documents(spark):
    docs = cases.odd_docs(spark)
    texts = cases.odd_texts()
    found = jaccard.report_components(docs, 4, 85).collect()
    assert len(found) == len(texts)
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append((r["n_shingles"], r["component_id"]))
    assert by_id[9][0][1] == by_id[5][0][1] == by_id[7][0][1] == 3 and by_id[8][0] == (1, 6)
    assert by_id[1] == [(0, 1)] and by_id[2] == [(0, 2)] and (0, None) in by_id[None]
    assert by_id[11][0][1] == 10
    kept = jaccard.keep_one_of_each(docs, 4, 85)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in kept.collect())
    assert ids == [(False, i) for i in (1, 2, 3, 4, 6, 10, 12, 13, 13, 14)] + [(True, 0)]
    assert jaccard.keep_one_of_each(cases.no_docs(spark)).collect() == []
    assert jaccard.report_components(cases.no_docs(spark)).collect() == []
