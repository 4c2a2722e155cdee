"""Removal of repeated byte strings with a sparse suffix array, sorted deep-shallow.

Every byte goes that is covered by a string of ``n`` bytes that also starts earlier: in a document with a smaller id, or
further ahead in the same one. Sorting every suffix of the corpus is not needed for that:

* Each string of ``n`` bytes has an anchor, its gram (of n/2 bytes) with the smallest hash. Equal strings have equal
  anchors at the same place, and neighbours share theirs, so one suffix per anchor stands for about n/4 strings.
* A count-min sketch of the anchors' hashes drops those that occur once.
* A task settles equal regions (the bytes of all strings of an anchor) among its own texts, so a group of copies sends
  one row per chunk. Rows are then dealt by anchor across the cluster and equal regions are settled again.
* What is left differs somewhere within reach. The suffixes that begin at the anchors, and the reversed prefixes that end
  there, are put in order by deep-shallow sorting: multikey quicksort over the first bytes, blind tries for groups that
  are still equal then. Neighbours' common prefixes give, for each distance of the anchor from the start of the string,
  the classes of equal strings; all but the first of a class go.
* An anchor with more rows than a task should hold is sent string by string under the string's own hash, so that its rows
  are spread and those that are equal are settled early. This is the exact way beyond the bound ``COMMON``: each of its
  regions becomes at most n/2 + 1 rows, whatever the size of the group.

A null text has no bytes. A null id stands behind all others. Rows that repeat an id and text are one document and get the same result; rows with one id and
different texts are ordered by a hash of the text. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm import sketch
from logtide.llm.arrays import _BASE, _BYTE, Texts, U, blocks, join_hash, mix64, powers, texts_of
from logtide.llm.substring import RUNS, apply_runs, covered, joined_runs, keyed, later, ordered, text_bytes

LENGTH = 100
ROOM = 16  # counters per anchor in each row of the sketch
COMMON = 100_000  # rows of one anchor that a task holds, above 8 times the mean load of a counter; more are dealt by string
HELD = 50_000  # rows of whole anchors that are settled at once
SHALLOW = 2  # words of 8 bytes that quicksort compares before the tries take over
BLOCK = 500_000  # bytes of text that are hashed at once
SMALL = 24  # segments up to this size are sorted directly
_INVERSE = U(pow(int(_BASE), -1, 2**64))
_inverses = np.ones(1, U)


def inverses(n: int) -> np.ndarray:
    global _inverses
    if len(_inverses) < n:
        more = np.full(max(n, 2 * len(_inverses)), _INVERSE, U)
        more[0] = 1
        _inverses = np.multiply.accumulate(more)
    return _inverses[:n]


class Hashes:
    """Hashes of any byte range of a block, from one running sum."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(_BYTE[data] * powers(len(data)), out=self.sums[1:])
        self.back = inverses(len(data) + 1)

    def every(self, n: int) -> np.ndarray:
        if len(self.sums) <= n:
            return np.zeros(0, U)
        return mix64((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.sums) - n])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix64((self.sums[end] - self.sums[start]) * self.back[start] + (end - start).astype(U))


def sliding_min(values: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n neighbours, from running minima of blocks in both directions."""
    size = len(values)
    if size < n:
        return values[:0]
    rows = -(-size // n)
    table = np.full(rows * n, np.iinfo(values.dtype).max, values.dtype)
    table[:size] = values
    table = table.reshape(rows, n)
    ahead = np.minimum.accumulate(table, axis=1).ravel()
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: size - n + 1], ahead[n - 1 : size])


class Anchors:
    """Anchors of a block: place, first and last start of the strings that they stand for, hash, text number."""

    def __init__(self, texts: Texts, n: int) -> None:
        gram = n // 2
        size = len(texts.data)
        self.hashes = Hashes(texts.data)
        grams = self.hashes.every(gram)
        low = U((1 << max(size, 1).bit_length()) - 1)
        least = sliding_min((grams & ~low) | np.arange(len(grams), dtype=U), n - gram + 1)
        room = np.repeat(texts.at[1:], np.diff(texts.at)) - np.arange(size)
        starts = np.flatnonzero(room[: len(least)] >= n)
        spots = (least[starts] & low).astype(np.int64)
        new = np.append(True, (np.diff(spots) != 0) | (np.diff(starts) != 1)) if len(starts) else np.zeros(0, bool)
        edges = np.flatnonzero(new)
        self.spot = spots[edges]
        self.first = starts[edges]
        self.last = starts[np.append(edges[1:], len(starts)) - 1] if len(edges) else edges
        self.hash = grams[self.spot] if len(edges) else np.zeros(0, U)
        self.of = np.searchsorted(texts.at, self.first, "right") - 1


def anchor_hashes(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[np.ndarray]:
    for _, texts in blocks(batches, most=BLOCK):
        yield Anchors(texts, n).hash


def blind_trie(rows: list[int], strings: list[bytes]) -> list[int]:
    """Rows in order of their strings (all of one length). Inner nodes keep only the place at which they branch."""
    root: list = [None, [rows[0]]]  # leaf: [None, rows]; inner node: [place, {byte: node}]
    for row in rows[1:]:
        text = strings[row]
        node = root
        while node[0] is not None:
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        if other == text:
            node[1].append(row)
            continue
        common = int.from_bytes(text, "big") ^ int.from_bytes(other, "big")
        place = len(text) - (common.bit_length() + 7) // 8
        holder, branch, node = None, 0, root
        while node[0] is not None and node[0] < place:
            holder, branch = node, text[node[0]]
            node = node[1][branch]
        leaf = [None, [row]]
        if node[0] == place:
            node[1][text[place]] = leaf
            continue
        joint = [place, {other[place]: node, text[place]: leaf}]
        if holder is None:
            root = joint
        else:
            holder[1][branch] = joint
    out: list[int] = []
    open_nodes = [root]
    while open_nodes:
        node = open_nodes.pop()
        if node[0] is None:
            out.extend(node[1])
        else:
            open_nodes.extend(node[1][b] for b in sorted(node[1], reverse=True))
    return out


def deep_shallow(table: np.ndarray, shallow: int = SHALLOW) -> np.ndarray:
    """Order of the rows of a byte table whose width is a multiple of 8."""
    words = table.view(">u8").astype(U)
    shallow = min(shallow, words.shape[1])
    strings = [r.tobytes() for r in table]
    heads = [s[: 8 * shallow] for s in strings]
    out: list[int] = []
    work: list[tuple[np.ndarray | list[int], int]] = [(np.arange(len(table)), 0)]
    while work:
        rows, depth = work.pop()
        if len(rows) == 1:
            out.append(int(rows[0]))
        elif depth == shallow:
            out.extend(blind_trie([int(r) for r in rows], strings))
        elif len(rows) <= SMALL:
            ranked = sorted((int(r) for r in rows), key=heads.__getitem__)
            start = 0
            for i in range(1, len(ranked) + 1):
                if i == len(ranked) or heads[ranked[i]] != heads[ranked[start]]:
                    same = ranked[start:i]
                    out.extend(same if len(same) == 1 else blind_trie(same, strings))
                    start = i
        else:
            keys = words[rows, depth]
            pivot = np.partition(keys[:: max(1, len(keys) // 64)], min(len(keys), 64) // 2 - 1)[min(len(keys), 64) // 2 - 1]
            # what lies on top of the stack comes first
            for part, step in ((keys > pivot, 0), (keys == pivot, 1), (keys < pivot, 0)):
                if part.any():
                    work.append((rows[part], depth + step))
    return np.array(out, np.int64)


def common_prefixes(table: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row with the one before it in the order; 0 for the first."""
    out = np.zeros(len(order), np.int64)
    for lo in range(1, len(order), 100_000):
        hi = min(lo + 100_000, len(order))
        differ = table[order[lo:hi]] != table[order[lo - 1 : hi - 1]]
        out[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), table.shape[1])
    return out


def gather(data: np.ndarray, start: np.ndarray, length: np.ndarray, width: int, step: int = 1) -> np.ndarray:
    """Rows of ``width`` bytes from ``start`` on, in steps of 1 or -1; zero beyond ``length``."""
    place = np.arange(width)
    out = np.zeros((len(start), width), np.uint8)
    for lo in range(0, len(start), 10_000):
        some = slice(lo, lo + 10_000)
        at = np.clip(start[some, None] + step * place, 0, max(len(data) - 1, 0))
        out[some] = np.where(place < length[some, None], data[at], 0)
    return out


def settle_classes(texts: Texts, back: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, distance) of the strings that occur in an earlier row, for regions whose anchor lies at ``back``."""
    wide = -(-n // 8) * 8
    size = np.diff(texts.at)
    spot = texts.at[:-1] + back
    right = gather(texts.data, spot, np.minimum(size - back, n), wide)
    left = gather(texts.data, spot - 1, back, wide, -1)
    ranks = []
    for table in (right, left):
        order = deep_shallow(table)
        ranks.append((order, common_prefixes(table, order)))
    rows, distances = [], []
    nearest = back - (size - n)
    for distance in range(n - n // 2 + 1):
        live = np.flatnonzero((nearest <= distance) & (distance <= back))
        if len(live) < 2:
            continue
        classes = []
        for (order, prefix), depth in zip(ranks, (n - distance, distance), strict=True):
            group = np.empty(len(order), np.int64)
            group[order] = np.cumsum(prefix < depth)
            classes.append(group[live])
        gone = live[later((classes[0] * len(back) + classes[1]).astype(U))]
        rows.append(gone)
        distances.append(np.full(len(gone), distance))
    none = np.zeros(0, np.int64)
    return (np.concatenate(rows), np.concatenate(distances)) if rows else (none, none)


ROWS = "anchor bigint, id bigint, text_key bigint, spot int, back int, region binary, runs binary"
NAMES = ["anchor", "id", "text_key", "spot", "back", "region", "runs"]


def repeated_strings(docs: DataFrame, n: int = LENGTH) -> DataFrame:
    """(id, text_key, parts): the runs of starts of strings that go, for the documents that have any."""
    rows = keyed(docs)
    expected = text_bytes(rows) * 4 // n
    width = sketch.log_width_for(expected, ROOM)
    seen = sketch.build(rows.select("text"), lambda b: anchor_hashes(b, n), "anchors", width)
    coarse = sketch.log_width_for(expected // 16, 1)
    load = sketch.build(rows.select("text"), lambda b: anchor_hashes(b, n), "anchor-load", coarse, rows=1, bits=False)
    common = COMMON + 8 * (expected >> coarse)

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, most=BLOCK):
            order = ordered(batch)
            rank = np.full(len(texts), -1)
            rank[order] = np.arange(len(order))
            ids, keys = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            found = Anchors(texts, n)
            use = np.flatnonzero(seen.repeated(found.hash))
            use = use[rank[found.of[use]] >= 0]
            use = use[np.argsort(rank[found.of[use]], kind="stable")]
            spot, first, last, of, hashes = (x[use] for x in (found.spot, found.first, found.last, found.of, found.hash))
            often = load.counts(hashes) > common
            regions = join_hash(hashes, found.hashes.of(first, last + n) + (spot - first).astype(U))
            done = later(regions)
            settled = [(of[done], first[done], last[done])]
            keep = ~often & ~done
            at = texts.at[of]
            yield _rows(
                hashes[keep],
                ids[of[keep]],
                keys[of[keep]],
                (spot - at)[keep],
                (spot - first)[keep],
                [texts.data[s:e].tobytes() for s, e in zip(first[keep].tolist(), (last[keep] + n).tolist(), strict=True)],
            )
            single = np.flatnonzero(often & ~done)
            if len(single):
                number = last[single] - first[single] + 1
                start = np.repeat(first[single], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
                text = np.repeat(of[single], number)
                strings = join_hash(found.hashes.of(start, start + n), np.full(len(start), 1, U))
                again = later(strings)
                settled.append((text[again], start[again], start[again]))
                new = ~again
                yield _rows(strings[new], ids[text[new]], keys[text[new]], start[new] - texts.at[text[new]], np.zeros(int(new.sum()), np.int64), None)
            text, lo, hi = (np.concatenate(x) for x in zip(*settled, strict=True))
            turn = np.lexsort((lo, rank[text]))
            text, lo, hi = text[turn], lo[turn], hi[turn]
            yield _runs(ids[text], keys[text], lo - texts.at[text], hi - texts.at[text])

    found = rows.mapInArrow(candidates, ROWS)
    # runs go where their document's number falls, so that they do not gather in one task
    dealt = found.repartition(F.coalesce("anchor", F.xxhash64("id", "text_key")))
    dealt = dealt.sortWithinPartitions("anchor", "id", "text_key", "spot")

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            lost = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            if lost.any():
                yield batch.filter(pa.array(lost)).select(["id", "text_key", "runs"])
                batch = batch.filter(pa.array(~lost))
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size >= HELD:
                block = pa.Table.from_batches(held).combine_chunks()
                anchors = block.column(0).to_numpy()
                whole = int(np.searchsorted(anchors, anchors[-1]))  # the last group may go on
                if whole:
                    yield _settled(block.slice(0, whole), n)
                held, size = block.slice(whole).to_batches(), block.num_rows - whole
        if held:
            yield _settled(pa.Table.from_batches(held).combine_chunks(), n)

    return dealt.mapInArrow(settle, RUNS).groupBy("id", "text_key").agg(F.collect_list("runs").alias("parts"))


def _rows(anchor, ids, keys, spot, back, regions) -> pa.RecordBatch:
    size = len(anchor)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(anchor.view(np.int64)),
            pa.array(ids),
            pa.array(keys),
            pa.array(spot.astype(np.int32)),
            pa.array(back.astype(np.int32)),
            pa.nulls(size, pa.binary()) if regions is None else pa.array(regions, pa.binary()),
            pa.nulls(size, pa.binary()),
        ],
        NAMES,
    )


def _spread(ids, keys, lo, hi) -> pa.RecordBatch:
    """Runs of starts lo..hi (last included) as single places, then as runs by document."""
    number = hi - lo + 1
    places = np.repeat(lo, number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    ids, keys = np.repeat(ids, number), np.repeat(keys, number)
    turn = np.lexsort((places, keys, ids))
    ids, keys, places = ids[turn], keys[turn], places[turn]
    new = np.append(True, (np.diff(ids) != 0) | (np.diff(keys) != 0) | (np.diff(places) != 0)) if len(ids) else np.zeros(0, bool)
    return joined_runs(ids[new], keys[new], places[new].astype(np.int32))


def _runs(ids, keys, lo, hi) -> pa.RecordBatch:
    done = _spread(ids, keys, lo, hi)
    size = done.num_rows
    none = [pa.nulls(size, k) for k in (pa.int64(), pa.int32(), pa.int32(), pa.binary())]
    return pa.RecordBatch.from_arrays([none[0], done.column(0), done.column(1), *none[1:], done.column(2)], NAMES)


def _different(block: pa.Table) -> pa.Table:
    """Rows without those equal to the one before in anchor, document and place: a repeated row's, sent by another block."""
    keys = [block.column(i).to_numpy() for i in range(4)]
    new = np.append(True, np.any([k[1:] != k[:-1] for k in keys], axis=0))
    return block if new.all() else block.filter(pa.array(new)).combine_chunks()


def _settled(block: pa.Table, n: int) -> pa.RecordBatch:
    """The runs that go among rows of whole anchor groups, which come in order."""
    block = _different(block)
    anchor, ids, keys, spot, back = (block.column(i).to_numpy() for i in range(5))
    column = block.column(5).combine_chunks()
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    single = column.is_null().to_numpy(zero_copy_only=False)
    texts = texts_of(column.fill_null(b""))
    size = np.where(single, n, np.diff(texts.at))
    first = spot - back
    hashes = Hashes(texts.data).of(texts.at[:-1], texts.at[1:])
    digest = join_hash(join_hash(anchor.view(U), hashes), back.astype(U) + U(1) * single.astype(U))
    done = later(digest)
    lo, hi = [first[done]], [first[done] + size[done] - n]
    which = [np.flatnonzero(done)]
    rest = np.flatnonzero(~done & ~single)
    if len(rest):
        group = anchor[rest]
        same = np.append(False, group[1:] == group[:-1])
        rest = rest[same | np.append(same[1:], False)]
    if len(rest) > 1:
        some = Texts(*_packed(texts, rest))
        row, distance = settle_classes(some, back[rest], n)
        which.append(rest[row])
        start = spot[rest[row]] - distance
        lo.append(start)
        hi.append(start)
    at, lo, hi = np.concatenate(which), np.concatenate(lo), np.concatenate(hi)
    return _spread(ids[at], keys[at], lo.astype(np.int64), hi.astype(np.int64))


def _packed(texts: Texts, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of some of the texts, one after another."""
    size = np.diff(texts.at)[rows]
    at = np.append(0, np.cumsum(size))
    return texts.data[np.repeat(texts.at[rows] - at[:-1], size) + np.arange(at[-1])], at


def drop_repeated_strings(docs: DataFrame, n: int = LENGTH, carry: list[str] | None = None) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans (maximal removed runs) and kept_bytes.

    ``carry`` names the columns to go on with; all by default.
    """

    def cut(text: bytes, runs: np.ndarray | None) -> tuple[int, int, int, bytes]:
        if runs is None:
            return len(text), 0, 0, text
        gone = covered(runs, n, len(text))
        spans = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
        return len(text), int(gone.sum()), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()

    longs = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    added = T.StructType([*longs, T.StructField("kept_bytes", T.BinaryType())])
    return apply_runs(docs, repeated_strings(docs, n), added, cut, carry)
