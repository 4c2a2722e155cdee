import hashlib
import random

import brute
import cases
import pytest

from logtide.llm import substring, suffix


def small_docs(seed, letters, count, most):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(most))) for _ in range(count)]
    texts += [t[: len(t) // 2] + rng.choice(texts) for t in texts[:10]]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)


def words_of(spark, rows, n):
    found = substring.drop_repeated_windows(as_docs(spark, rows), n).collect()
    return sorted((r["doc_id"], r["n_words"], r["n_removed"], hashlib.sha256(r["kept_text"].encode()).hexdigest()) for r in found)


def bytes_of(spark, rows, n):
    found = suffix.drop_repeated_strings(as_docs(spark, rows), n).collect()
    return sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in found)


@pytest.mark.parametrize(("letters", "n"), [("ab ", 3), ("abcde \n", 2), ("é b ", 4)])
def test_words(spark, letters, n):
    rows = small_docs(1, letters, 40, 60)
    assert words_of(spark, rows, n) == brute.substring_rows(rows, n)


@pytest.mark.parametrize(("letters", "n"), [("a", 6), ("ab", 10), ("abcdefgh", 6), ("éa\n", 9)])
def test_bytes(spark, letters, n):
    rows = small_docs(2, letters, 40, 60)
    assert bytes_of(spark, rows, n) == brute.byte_rows(rows, n)


def test_common_anchors_go_string_by_string(spark, monkeypatch):
    monkeypatch.setattr(suffix, "COMMON", -1_000_000)
    rows = small_docs(3, "abc", 40, 80)
    assert bytes_of(spark, rows, 8) == brute.byte_rows(rows, 8)


def test_classes_of_regions_that_differ(spark):
    line = "The quick brown fox jumps over the lazy dog and runs home."
    rng = random.Random(6)
    rows = [(i, cases.prose(rng, 8) + line * (1 + i % 2) + cases.prose(rng, 8)) for i in range(60)]
    assert bytes_of(spark, rows, 30) == brute.byte_rows(rows, 30)


def test_whole_table(spark, small_dir):
    docs = spark.read.parquet(f"{small_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert words_of(spark, rows, 20) == brute.substring_rows(rows)
    assert bytes_of(spark, rows, 100) == brute.byte_rows(rows)


@pytest.mark.parametrize("drop", [substring.drop_repeated_windows, suffix.drop_repeated_strings])
def test_odd_documents(spark, drop):
    docs = cases.odd_docs(spark)
    found = drop(docs, 4)
    assert found.columns[: len(docs.columns)] == docs.columns and len(set(found.columns)) == len(found.columns)
    rows = found.collect()
    assert len(rows) == len(cases.odd_texts())
    removed = found.columns[len(docs.columns) + 1]
    by_id = {}
    for r in rows:
        by_id.setdefault(r["doc_id"], []).append((r["text"], r[removed]))
    assert by_id[3][0][1] < by_id[5][0][1]  # the copy with the smaller id stays
    assert by_id[12][0] == by_id[12][1]  # equal rows are one document
    assert {n for t, n in by_id[None] if t is None} == {0}
    assert drop(cases.no_docs(spark), 4).collect() == []


@pytest.mark.parametrize("common", [suffix.COMMON, -1_000_000])
def test_repeated_rows_in_several_partitions_are_one_document(spark, monkeypatch, common):
    monkeypatch.setattr(suffix, "COMMON", common)
    rows = small_docs(4, "abcd", 30, 80)
    shared = rows[0][1] + "abcdabcdabcdabcd" + rows[1][1]
    rows += [(100, shared), (101, shared + "dcba"), (None, "b" + shared[2:] + "aabbccddabcabd")]
    again = rows[:8] + rows[-3:] + rows[-3:]  # with null ids among them
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows + again, len(rows + again)), "doc_id bigint, text string")
    found = suffix.drop_repeated_strings(docs, 8).collect()
    got = {(suffix_id(r["doc_id"]), r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(r["kept_bytes"]).hexdigest()) for r in found}
    assert len(found) == len(rows + again)
    assert sorted(got) == brute.byte_rows([(suffix_id(i), t) for i, t in rows], 8)


def suffix_id(i):
    return substring.LAST_ID if i is None else i


def test_runs_grow_with_the_documents_of_a_shared_passage(spark):
    """Five times the documents with one passage give five times the runs, not more."""
    passage = "".join(random.Random(1).choice("abcdefgh ") for _ in range(400))
    sizes = []
    for n in (300, 1_500):
        rng = random.Random(n)
        rows = [(i, "".join(rng.choice("abcdefgh ") for _ in range(80)) + passage + str(i)) for i in range(n)]
        found = suffix.repeated_strings(as_docs(spark, rows), 100)
        sizes.append(sum(len(r["parts"]) for r in found.collect()))
    assert sizes[0] >= 299 and sizes[1] <= 5.5 * sizes[0]
