import itertools
import math
import random

import brute
import cases
import pytest

from logtide.llm import decontam


def setting(spark):
    rng = random.Random(5)
    items = [cases.prose(rng, n, 300) for n in (40, 15, 25, 5, 12)]
    item_rows = [*enumerate(items), (5, None), (6, " .. "), (7, items[0])]

    def inside(words, at=30):
        text = cases.prose(rng, 60, 300).split()
        return " ".join(text[:at] + words + text[at:])

    def changed(words, *places):
        return [("zz" if i in places else w) for i, w in enumerate(words)]

    i0, i1, i2, i3 = (x.split() for x in items[:4])
    texts = [
        (0, inside(i0), "s"),
        (1, inside(changed(i0, 4, 9, 19, 24, 31)), "s"),
        (2, inside(changed(i1, 7)).upper(), "s"),
        (3, inside(i2).replace(" ", " - "), "s"),
        (4, items[3], "s"),
        (5, inside(changed(i0, *range(0, 40, 2))), "s"),
        (6, inside(i0[:9]), "s"),
        (7, inside([]), "s"),
        (8, None, "s"),
        (9, "", "s"),
        (10, inside(i0[:20]), "s"),
        (None, inside(i1, 0), "s"),
        (11, inside(i3), "s"),
        (7, items[1], "s"),
    ]
    return cases.odd_docs(spark, texts), spark.createDataFrame(item_rows, "item_id bigint, text string")


WANT = {(0, 0), (0, 7), (1, 0), (1, 7), (2, 1), (3, 2), (4, 3), (10, 0), (10, 7), (None, 1), (11, 3), (7, 1)}


def test_overlaps_with_substitutions(spark):
    docs, items = setting(spark)
    found = decontam.find_overlaps(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == WANT
    by = {(r["doc_id"], r["item_id"]): r for r in found}
    assert by[0, 0]["similarity"] == 1.0 and by[0, 0]["at"] == 30 and by[2, 1]["similarity"] < 1.0


def test_shuffled_join_gives_the_same(spark):
    docs, items = setting(spark)
    key = lambda r: (r["doc_id"] is None, r["doc_id"], r["item_id"], r["text_key"], r["similarity"], r["at"])
    one = sorted(map(key, decontam.find_overlaps(docs, items).collect()), key=str)
    two = sorted(map(key, decontam.find_overlaps(docs, items, most_broadcast=0).collect()), key=str)
    assert one == two


def test_places_and_items_of_one_id(spark):
    rng = random.Random(8)
    a, b, c = (cases.prose(rng, n, 300) for n in (20, 20, 30))
    items = [(1, a), (1, b), (None, c), (1, a), (None, None)]
    texts = [(1, f'"{a}', "s"), (2, f"- {b} {a}", "s"), (3, f"one {c}", "s"), (4, f"two {c} {c}", "s")]
    docs, bench = cases.odd_docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")
    found = sorted((r["doc_id"], r["item_id"], r["similarity"], r["at"]) for r in decontam.find_overlaps(docs, bench).collect())
    assert found == [(1, 1, 1.0, 0), (2, 1, 1.0, 0), (3, None, 1.0, 1), (4, None, 1.0, 1)]


def test_repetitive_texts_are_one_hit_for_each_shift(spark, monkeypatch):
    stored, keep = {}, decontam.materialise
    monkeypatch.setattr(decontam, "materialise", lambda df, name: stored.setdefault(name, keep(df, name)))
    docs = spark.createDataFrame([(1, "so " * 400)], "doc_id bigint, text string")
    found = decontam.find_overlaps(docs, spark.createDataFrame([(1, "so " * 300)], "item_id bigint, text string")).collect()
    assert [(r["similarity"], r["at"]) for r in found] == [(1.0, 0)]
    assert stored["seed-hits"].count() < 700 and "words" not in stored["seed-hits"].columns


def test_only_leaks_go(spark):
    docs, items = setting(spark)
    kept = decontam.drop_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [5, 6, 7, 8, 9]


def test_empty(spark):
    docs, items = setting(spark)
    assert decontam.drop_contaminated(cases.no_docs(spark), items).collect() == []
    assert decontam.drop_contaminated(docs, items.limit(0)).count() == docs.count()
    assert decontam.find_overlaps(cases.odd_docs(spark), items).count() == 0


def same_as_brute_force(docs, items):
    texts = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows = [(r["item_id"], r["text"]) for r in items.collect()]
    want = brute.overlaps([t for _, t in texts], rows, list(decontam.MASKS))
    found = decontam.find_overlaps(docs, items).collect()
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 9)) for r in found)
    assert got == sorted((str(texts[d][0]), i, round(s, 9)) for (d, i), (s, _) in want.items())
    return len(got)


def test_same_as_brute_force(spark, small_dir):
    assert same_as_brute_force(*setting(spark)) == len(WANT)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert same_as_brute_force(docs, spark.read.parquet(f"{small_dir}/benchmark.parquet")) > 0


def test_same_as_brute_force_with_few_words(spark):
    rng = random.Random(11)
    texts = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 60))), "s") for i in range(25)]
    items = [(i, " ".join(rng.choice("abc") for _ in range(rng.randrange(0, 24)))) for i in range(12)]
    assert same_as_brute_force(cases.odd_docs(spark, texts), spark.createDataFrame(items, "item_id bigint, text string")) > 0


@pytest.mark.parametrize("share", [0.8, 0.7, 0.95])
def test_masks_lose_no_choice_of_differing_tokens(share):
    for need in range(1, 21):
        masks = decontam.masks_for(need, share)
        whole = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(need - len(m) + 1)]
        for gone in itertools.combinations(range(need), need - math.ceil(need * share - 1e-9)):
            lost = sum(1 << i for i in gone)
            assert any(not lost & w for w in whole), (need, masks, gone)


def aligned(texts, items, stretch=20, share=0.8):
    """(doc, item, similarity) by comparing every stretch of every item with every place of every text."""
    out = {}
    for (d, text), (i, item) in itertools.product(texts, items):
        a, b = text.split(), item.split()
        need = min(stretch, len(b))
        for p, q in itertools.product(range(len(a) - need + 1), range(len(b) - need + 1)):
            equal = sum(x == y for x, y in zip(a[p : p + need], b[q : q + need], strict=True))
            if equal >= math.ceil(need * share - 1e-9):
                out[d, i] = max(out.get((d, i), 0), equal / need)
    return sorted((d, i, round(v, 9)) for (d, i), v in out.items())


def test_every_overlap_at_the_limit_is_found(spark):
    rng = random.Random(17)
    items = [(n, cases.prose(rng, n, 100_000)) for n in (*range(1, 23), 30)]
    texts = []
    for n, item in items:
        for more in (0, 0, 0, 0, 0, 0, 1):
            words = item.split()
            begin = rng.randrange(max(n - 20, 0) + 1)
            size = min(n, 20)
            for p in rng.sample(range(size), min(size // 5 + more, size)):
                words[begin + p] = "zz"
            words = [w if begin <= k < begin + size else "yy" for k, w in enumerate(words)]
            texts.append((len(texts), f"{cases.prose(rng, 5)} {' '.join(words)} {cases.prose(rng, 3)}"))
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    found = decontam.find_overlaps(docs, spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = aligned(texts, items)
    assert sorted((r["doc_id"], r["item_id"], round(r["similarity"], 9)) for r in found) == want
    assert len(want) == 6 * len(items)
