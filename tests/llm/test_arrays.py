import pathlib
import pickle
import urllib.parse

import brute
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logtide.llm import sketch
from logtide.llm.arrays import Words, blocks, run_hashes, texts_of, whole_runs
from logtide.llm.lm import pack, sum_up, unpack
from logtide.llm.suffix import blind_trie, common_prefixes, deep_shallow, sliding_min

TEXT = st.text(alphabet=st.sampled_from(list("ab é\n\t\x0b\x1f\x85 ")), max_size=30)


@given(st.lists(st.one_of(st.none(), TEXT), max_size=6))
@settings(max_examples=200, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    found = texts_of(pa.array(texts, pa.string()))
    words = Words(found)
    want = [(i, w) for i, t in enumerate(texts) for w in brute.split_words(t)]
    got = [(int(o), found.data[s:e].tobytes().decode()) for o, s, e in zip(words.of, words.start, words.end, strict=True)]
    assert got == want
    by_hash = {}
    for h, (_, w) in zip(words.hash.tolist(), want, strict=True):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(by_hash.values()))


@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_run_hashes_tell_runs_apart(values, n):
    got = run_hashes(np.array(values, np.uint64), n).tolist()
    want = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(got) == len(want)
    assert len(set(zip(got, want, strict=True))) == len(set(got)) == len(set(want))


def test_runs_stay_in_their_text():
    assert whole_runs(np.array([0, 0, 0, 1, 1]), 2).tolist() == [True, True, False, True]
    assert whole_runs(np.array([0]), 2).tolist() == []


@given(st.lists(st.integers(0, 1 << 22), max_size=50))
@settings(max_examples=100, deadline=None)
def test_codes_round_trip(values):
    ranked = np.sort(np.array(values, np.int64))
    assert sketch.decode(sketch.encode(ranked)).tolist() == ranked.tolist()
    wide = np.array(values, np.uint64) * np.uint64(2**40 + 1)
    assert unpack(pack(wide), len(wide)).tolist() == wide.tolist()


def test_sum_up():
    keys, counts = sum_up(np.array([5, 3, 5], np.uint64), np.array([1, 2, 4], np.uint64))
    assert (keys.tolist(), counts.tolist()) == ([3, 5], [2, 5])


@given(st.lists(st.integers(0, 9), min_size=1, max_size=40), st.integers(1, 8))
@settings(max_examples=100, deadline=None)
def test_sliding_min(values, n):
    got = sliding_min(np.array(values, np.uint64), n).tolist()
    assert got == [min(values[i : i + n]) for i in range(len(values) - n + 1)]


@given(st.lists(st.binary(min_size=24, max_size=24).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=60))
@settings(max_examples=100, deadline=None)
def test_deep_shallow_sorts(rows):
    rows = rows + rows[:3] + [rows[0][:20] + b"\x09" * 4]
    table = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, 24)
    order = deep_shallow(table, 1)
    assert [rows[i] for i in order] == sorted(rows)
    assert sorted(order.tolist()) == list(range(len(rows)))
    prefixes = common_prefixes(table, order)
    for k in range(1, len(order)):
        a, b = rows[order[k - 1]], rows[order[k]]
        assert prefixes[k] == next((i for i in range(24) if a[i] != b[i]), 24)


def test_deep_shallow_splits_large_segments():
    rng = np.random.default_rng(3)
    table = np.repeat(rng.integers(0, 2, (300, 32)).astype(np.uint8), 2, axis=0)
    rows = [r.tobytes() for r in table]
    assert [rows[i] for i in deep_shallow(table)] == sorted(rows)
    assert [rows[i] for i in blind_trie(list(range(600)), rows)] == sorted(rows)


def test_blocks_cover_all_rows():
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 5, "", None, "b" * 30, "c", "d", ""])], ["i", "text"])
    parts = list(blocks(iter([batch]), most=8))
    assert [i for b, _ in parts for i in b.column(0).to_pylist()] == list(range(7))
    assert b"".join(t.data.tobytes() for _, t in parts) == b"aaaaa" + b"b" * 30 + b"cd"


def test_missing_stripe_is_an_error(spark):
    """A stripe that was written and is not there must not be taken for one without counters."""
    docs = spark.createDataFrame([("a",)] * 50 + [("b",)] * 50, "text string")
    hashes = lambda batches: (np.arange(1, 400, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) for _ in batches)
    built = sketch.build(docs.coalesce(2).select("text"), hashes, "probe", 24, rows=1)
    asked = next(iter(hashes([0])))
    assert built.repeated(asked).sum() >= 0 and len(built.written) == 4
    folder = pathlib.Path(urllib.parse.urlparse(built.path).path)
    (folder / "stripe-2").rename(folder / "gone")
    with pytest.raises(FileNotFoundError):
        pickle.loads(pickle.dumps(built)).repeated(asked)


def test_paths_are_qualified_as_spark_does(spark):
    from logtide.llm import store

    path = store.shared_path(spark, "x")
    assert path.startswith("file:/")
    store.save(path, "a", np.arange(3))
    store.save(path, "a", np.arange(3))  # a task that runs twice
    assert store.load(path, "a", np.int64).tolist() == [0, 1, 2]
    spark.read.format("binaryFile").load(f"{path}/a").select("path").collect()
