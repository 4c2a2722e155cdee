import math
import re

import brute
import cases
import pytest

from logtide.llm import mixing


def targets(sizes):
    """Water filling by repeated rounds."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    total = mixing.SHARE * sum(sizes.values())
    done, open_ = {}, set(names)
    while open_:
        level = (total - sum(done.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]}
        if not over:
            return done | {s: level * weight[s] for s in open_}
        done |= {s: 2.0 * sizes[s] for s in over}
        open_ -= over
    return done


def check(rows, texts):
    sizes = {}
    for _, t, s in texts:
        sizes[s] = sizes.get(s, 0) + len(brute.split_words(t))
    want = targets(sizes)
    assert len(rows) == len(texts)
    taken = {}
    for r in rows:
        assert r["taken"] <= 2 * r["size"]
        assert r["copies"] == 0 or r["taken"] > 0
        key = next(s for s in sizes if sizes[s] == r["source_size"] and math.isclose(want[s], r["target"], rel_tol=1e-9, abs_tol=1e-9))
        taken[key] = taken.get(key, 0) + r["taken"]
    for s, n in taken.items():
        assert abs(n - want[s]) <= 1


def test_targets_and_words_taken(spark):
    texts = cases.odd_texts()
    check(mixing.report_mix(cases.odd_docs(spark, texts)).collect(), texts)


def test_capped_sources(spark):
    texts = [(i, "w " * n, s) for i, (n, s) in enumerate([(500, "a"), (3, "b"), (40, "c"), (2000, "d"), (7, "e"), (90, None)])]
    check(mixing.report_mix(cases.odd_docs(spark, texts)).collect(), texts)


def test_reruns_agree(spark):
    docs = cases.odd_docs(spark)
    one, two = (sorted(map(str, mixing.report_mix(docs.repartition(n)).collect())) for n in (1, 5))
    assert one == two


def test_sequence(spark):
    docs = cases.odd_docs(spark)
    rows = mixing.mix(docs)
    assert rows.columns[: len(docs.columns)] == docs.columns
    assert rows.columns[len(docs.columns) :] == ["epoch_", "taken_", "position_"]
    got = rows.collect()
    assert [r["position_"] for r in got] == sorted(r["position_"] for r in got)
    assert all(0 <= r["position_"] < 1 and r["taken_"] > 0 for r in got)
    plan = mixing.report_mix(docs).collect()
    assert sum(r["taken_"] for r in got) == sum(r["taken"] for r in plan)
    assert len(got) == sum(r["copies"] for r in plan)


@pytest.mark.parametrize("tilt", mixing.TILTS)
def test_position_inverts_the_demand(spark, tilt):
    f = mixing.F
    rows = spark.range(0, 101, 5).select("id", mixing.position(f.col("id").cast("double"), f.lit(100.0), f.lit(tilt)).alias("t"))
    for r in rows.collect():
        assert math.isclose(100 * (r["t"] - tilt * (r["t"] - r["t"] ** 2)), r["id"], abs_tol=1e-9)


def test_words_as_in_the_contract(spark):
    odd = ["a\x1fb c", "a\x85b", " a ", "", None, "a\x0bb\x0cc\rd"]
    docs = spark.createDataFrame([(t,) for t in odd], "text string")
    got = [r[0] for r in docs.select(mixing.count_words()).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in odd]


def test_empty(spark):
    assert mixing.mix(cases.no_docs(spark)).collect() == []
    assert mixing.report_mix(cases.no_docs(spark)).collect() == []
    rows = mixing.report_mix(cases.odd_docs(spark, [(1, None, "s"), (2, "", None)])).collect()
    assert [r["taken"] for r in rows] == [0, 0]
