"""Removal of repeated word windows, with a count-min prefilter.

A window is ``n`` consecutive words of one document. Every word goes that is covered by a window whose words also start
earlier: in a document with a smaller id, or further ahead in the same one. Three passes over the texts:

1. each task sketches its windows; the merged count-min sketch never estimates too low, so a window that it takes for
   unique is unique;
2. only windows that may be repeated are grouped exactly. A task first groups its own: all but the earliest of a window
   are settled there, so a window sends at most one row per chunk of a task however common it is. The rows of the
   earliest are sorted by window across the cluster and all but the first of each are settled too;
3. the settled windows are joined back to their documents and the words they cover are cut out.

Windows are told apart by 64-bit hashes of their words. A null text has no words. A null id stands behind all others. Rows that repeat an id and
text are one document and get the same result; rows with one id and different texts are ordered by a hash of the text. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm import sketch
from logtide.llm.arrays import Words, blocks, run_hashes, whole_runs
from logtide.llm.common import fresh, ready_for_texts, whole_text

WINDOW = 20
ROOM = 4  # counters per window in each row of the sketch
BYTES_PER_WORD = 6  # to size the sketch from the bytes of the texts
LAST_ID = 2**63 - 1
BLOCK = 2_000_000  # bytes of text whose windows are grouped before they are sent
RUNS = "id bigint, text_key bigint, runs binary"


def keyed(docs: DataFrame) -> DataFrame:
    """(id, text_key, text): the order of the documents; a null id stands behind all others."""
    ready_for_texts(docs.sparkSession)
    return docs.select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)).alias("id"),
        F.xxhash64(whole_text()).alias("text_key"),
        whole_text().alias("text"),
    )


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def windows_of(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    for _, texts in blocks(batches):
        words = Words(texts)
        yield run_hashes(words.hash, n)[whole_runs(words.of, n)]


def ordered(batch: pa.RecordBatch) -> np.ndarray:
    """Row numbers in the order of the documents, each (id, text_key) once."""
    ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
    order = np.lexsort((keys, ids))
    new = np.append(True, (np.diff(ids[order]) != 0) | (np.diff(keys[order]) != 0)) if len(order) else np.zeros(0, bool)
    return order[new[: len(order)]]


def later(keys: np.ndarray) -> np.ndarray:
    """True for all but the first row of each key; rows are in order."""
    order = np.argsort(keys, kind="stable")
    same = np.append(False, np.diff(keys[order].view(np.int64)) != 0)
    out = np.zeros(len(keys), bool)
    if len(keys):
        first = same
        first[0] = True
        out[order[~first]] = True
    return out


def runs_batch(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.RecordBatch:
    """Runs [start, end) by document; the rows of a document stand together."""
    if not len(ids):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.binary())], ["id", "text_key", "runs"])
    edges = np.flatnonzero(np.append(True, (np.diff(ids) != 0) | (np.diff(keys) != 0)))
    pairs = np.column_stack([starts, ends]).astype(np.int32)
    data = [pairs[lo:hi].tobytes() for lo, hi in zip(edges, np.append(edges[1:], len(ids)), strict=True)]
    return pa.RecordBatch.from_arrays([pa.array(ids[edges]), pa.array(keys[edges]), pa.array(data, pa.binary())], ["id", "text_key", "runs"])


def joined_runs(ids: np.ndarray, keys: np.ndarray, places: np.ndarray) -> pa.RecordBatch:
    """Places (rows in order) as runs of neighbours by document."""
    if not len(ids):
        return runs_batch(ids, keys, places, places)
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(keys) != 0) | (np.diff(places) != 1))
    edges = np.flatnonzero(new)
    last = np.append(edges[1:], len(ids)) - 1
    return runs_batch(ids[edges], keys[edges], places[edges], places[last] + 1)


def read_runs(parts) -> np.ndarray:
    """All runs of a document from its parts, as rows (start, end)."""
    return np.frombuffer(b"".join(parts), np.int32).reshape(-1, 2)


def covered(runs: np.ndarray, n: int, size: int) -> np.ndarray:
    """True for the places that a window of ``n`` starting within one of the runs covers."""
    steps = np.zeros(size + 1, np.int64)
    np.add.at(steps, runs[:, 0], 1)
    np.add.at(steps, np.minimum(runs[:, 1] + n - 1, size), -1)
    return np.cumsum(steps[:-1]) > 0


def repeated_windows(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """(id, text_key, parts): the runs of window starts that go, for the documents that have any."""
    rows = keyed(docs)
    width = sketch.log_width_for(text_bytes(rows) // BYTES_PER_WORD, ROOM)
    seen = sketch.build(rows.select("text"), lambda b: windows_of(b, n), "windows", width)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The earliest of each window of a block that may be repeated, and the runs that are settled here."""
        for batch, texts in blocks(batches, "text", BLOCK):
            order = ordered(batch)
            words = Words(texts)
            hashes = run_hashes(words.hash, n)
            at = np.flatnonzero(whole_runs(words.of, n))
            at = at[seen.repeated(hashes[at])]
            rank = np.full(len(texts), -1)
            rank[order] = np.arange(len(order))
            of = rank[words.of[at]]
            at, of = at[of >= 0], of[of >= 0]
            turn = np.argsort(of, kind="stable")
            at, of = at[turn], of[turn]
            ids = batch.column(0).to_numpy(zero_copy_only=False)[order][of]
            keys = batch.column(1).to_numpy(zero_copy_only=False)[order][of]
            places = (at - words.at[words.of[at]]).astype(np.int32)
            found = hashes[at].view(np.int64)
            settled = later(found)
            first = ~settled
            yield pa.RecordBatch.from_arrays(
                [pa.array(found[first]), pa.array(ids[first]), pa.array(keys[first]), pa.array(places[first]), pa.nulls(int(first.sum()), pa.binary())],
                ["window", "id", "text_key", "place", "runs"],
            )
            done = joined_runs(ids[settled], keys[settled], places[settled])
            none = pa.nulls(done.num_rows, pa.int64()), pa.nulls(done.num_rows, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [none[0], done.column(0), done.column(1), none[1], done.column(2)], ["window", "id", "text_key", "place", "runs"]
            )

    found = rows.mapInArrow(candidates, "window bigint, id bigint, text_key bigint, place int, runs binary")
    # settled runs go where their document's number falls, so that they do not gather in one task
    dealt = found.repartition(F.coalesce("window", F.xxhash64("id", "text_key")))
    dealt = dealt.sortWithinPartitions("window", "id", "text_key", "place")

    def not_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None  # window, id, text_key, place of the first row of the last window
        for batch in batches:
            lost = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if lost.any():
                yield batch.filter(pa.array(lost)).select(["id", "text_key", "runs"])
                batch = batch.filter(pa.array(~lost))
            if not batch.num_rows:
                continue
            window, ids, keys, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            new = np.append(True, np.diff(window) != 0)
            if now is not None and window[0] == now[0]:
                new[0] = False
            heads = np.flatnonzero(new)
            group = np.cumsum(new) - 1  # -1: goes on from the batch before
            head = [c[heads][np.maximum(group, 0)] if len(heads) else c for c in (ids, keys, places)]
            if now is not None:
                head = [np.where(group < 0, v, h) for v, h in zip(now[1:], head, strict=True)]
            repeat = (ids != head[0]) | (keys != head[1]) | (places != head[2])
            if len(heads):
                now = tuple(c[heads[-1]] for c in (window, ids, keys, places))
            order = np.flatnonzero(repeat)
            order = order[np.lexsort((places[order], keys[order], ids[order]))]
            yield joined_runs(ids[order], keys[order], places[order])

    return dealt.mapInArrow(not_first, RUNS).groupBy("id", "text_key").agg(F.collect_list("runs").alias("parts"))


def with_runs(docs: DataFrame, runs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents with the runs found in them; returns the names of the added columns too."""
    names = {c: fresh(docs, c) for c in ("id", "text_key", "parts")}
    marked = docs.withColumns(
        {names["id"]: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LAST_ID)), names["text_key"]: F.xxhash64(whole_text())}
    )
    runs = runs.withColumnsRenamed(names)
    return marked.join(runs, [names["id"], names["text_key"]], "left"), names


def apply_runs(docs: DataFrame, runs: DataFrame, added: T.StructType, cut, carry: list[str] | None = None) -> DataFrame:
    """Run ``cut(text bytes, runs) -> values of the added columns`` on every document.

    The result has the documents' columns, or those that ``carry`` names, and the added ones.
    """
    joined, names = with_runs(docs, runs)
    columns = docs.columns if carry is None else carry
    into = [fresh(docs, f.name) for f in added.fields]
    schema = T.StructType([docs.schema[c] for c in columns] + [T.StructField(n, f.dataType) for n, f in zip(into, added.fields, strict=True)])
    arrow = [pa.int64() if isinstance(f.dataType, T.LongType) else pa.string() if isinstance(f.dataType, T.StringType) else pa.binary() for f in added.fields]
    text = fresh(joined, "whole_text")
    joined = joined.withColumn(text, F.to_binary(whole_text(), F.lit("utf-8")))
    joined = joined.select(*[F.col(f"`{c}`") for c in columns], names["parts"], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in blocks(iter([whole]), text):
                parts = batch.column(batch.schema.get_field_index(names["parts"])).to_pylist()
                values = [cut(texts.bytes_of(i), read_runs(p) if p else None) for i, p in enumerate(parts)]
                kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
                new = [pa.array([v[j] for v in values], kind) for j, kind in enumerate(arrow)]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*columns, *into])

    return joined.mapInArrow(run, schema)


def drop_repeated_windows(docs: DataFrame, n: int = WINDOW, carry: list[str] | None = None) -> DataFrame:
    """The documents with n_words, n_removed and kept_text (the words that stay, joined by one space).

    ``carry`` names the columns to go on with; all by default.
    """

    def cut(text: bytes, runs: np.ndarray | None) -> tuple[int, int, str]:
        words = text.split()
        if runs is None:
            return len(words), 0, b" ".join(words).decode("utf-8", "replace")
        gone = covered(runs, n, len(words))
        kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g])
        return len(words), int(gone.sum()), kept.decode("utf-8", "replace")

    added = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_text", T.StringType())])
    return apply_runs(docs, repeated_windows(docs, n), added, cut, carry)
