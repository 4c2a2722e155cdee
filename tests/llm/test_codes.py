"""Vector codes against plain loops over Python integers."""

import hashlib
import math

import numpy as np
import pytest

from logtide.llm import codes

SCHEMA = "vec_id bigint, embedding array<double>, label int, whole string, Code int, `of` int"


def plain(rows, parts=8, entries=16, rounds=6):
    """{row number: (code, error)} and the codebooks, for (vec_id, vector) rows."""
    kept = [(i, v, n) for n, (i, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    kept = [r for r in kept if len(r[1]) == len(kept[0][1])]
    dims = len(kept[0][1])
    cuts = [p * dims // parts for p in range(parts + 1)]
    most = codes.limit(dims)
    whole = [[max(-most, min(most, math.floor(x * 4096))) for x in v] for _, v, _ in kept]
    books = [[w[a:b] for w in whole[:entries]] for a, b in zip(cuts, cuts[1:], strict=False)]

    def nearest(p, part):
        return min((sum((x - y) ** 2 for x, y in zip(part, e, strict=True)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for w in whole:
                part = w[cuts[p] : cuts[p + 1]]
                groups.setdefault(nearest(p, part)[1], []).append(part)
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e], strict=True)] if e in groups else b for e, b in enumerate(books[p])]
    found = {}
    for (_, _, n), w in zip(kept, whole, strict=True):
        near = [nearest(p, w[cuts[p] : cuts[p + 1]]) for p in range(parts)]
        found[n] = ("".join(f"{i:02x}" for _, i in near), sum(d for d, _ in near))
    return found, hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()


def frame(spark, rows):
    """Rows numbered in ``label``."""
    return spark.createDataFrame([(i, v, n, "w", 1, 2) for n, (i, v) in enumerate(rows)], SCHEMA)


def compare(spark, rows, tasks=3, **how):
    out = codes.compress(frame(spark, rows).repartition(tasks), **how).collect()
    want, digest = plain(rows, **how)
    assert {r["label"]: (r["code"], r["error"]) for r in out} == want
    assert all(r["codebooks_sha256"] == digest and r["label_error"] == r["error"] for r in out)


def test_whole_small_table(spark, small_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{small_dir}/embeddings.parquet").collect()]
    compare(spark, rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 16).tolist()) for i in range(60)]
    rows += [(3, [0.5] * 16), (3, [0.5] * 16), (None, [0.1] * 16), (None, [0.1] * 16)]
    rows += [(-5, None), (-4, []), (-3, [None] * 16), (-2, [0.1] * 15 + [math.nan]), (-1, [math.inf] + [0.0] * 15)]
    rows += [(70, [0.1] * 17), (71, [1e300] * 16), (72, [-1e300] * 16), (73, [-0.0] * 16), (74, [-1e-9] * 16)]
    compare(spark, rows)


def test_ties_and_few_vectors(spark):
    compare(spark, [(i, [float(i % 2)] * 8) for i in range(40)])
    compare(spark, [(2, [0.25, -0.25, 1.0, 2.0, 3.0, 4.0, 5.0, 6.5]), (1, [0.0] * 8)])


def test_lengths_that_parts_do_not_divide(spark):
    rng = np.random.default_rng(2)
    compare(spark, [(i, rng.normal(0, 1, 11).tolist()) for i in range(50)])
    compare(spark, [(i, rng.normal(0, 1, 5).tolist()) for i in range(30)])


def test_empty_tables(spark):
    assert codes.compress(frame(spark, [])).count() == 0
    assert codes.compress(frame(spark, [(1, None), (2, [math.nan])])).count() == 0


def test_labels_are_summed_with_null_as_one(spark):
    rows = [(i, [float(i)] * 8, None if i % 3 == 0 else i % 3) for i in range(30)]
    out = codes.compress(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int"), entries=2).collect()
    for label in (None, 1, 2):
        some = [r for r in out if r["label"] == label]
        assert len(some) == 10 and {r["label_error"] for r in some} == {sum(r["error"] for r in some)}


@pytest.mark.parametrize("entries", [1, 2, 16, 64, 150])
def test_candidates_hold_the_nearest(entries):
    """Against all distances; 150 entries need three mask words."""
    rng = np.random.default_rng(entries)
    for spread in (3, 4_000, codes.limit(4)):
        book = rng.integers(-spread, spread + 1, (entries, 4))
        x = np.vstack([rng.integers(-spread, spread + 1, (500, 4)), book])
        slices = codes.Slices(book)
        index, best = slices.nearest(x)
        d = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (best == d.min(axis=1)).all() and (index == d.argmin(axis=1)).all()
        radius = np.full(len(x), spread // 2)
        inside = (np.abs(x[:, None, :] - book[None]) <= spread // 2).all(axis=2)
        for e in range(entries):
            assert ((slices.candidates(x, radius)[e // 64] >> np.uint64(e % 64) & np.uint64(1)) == inside[:, e]).all()
