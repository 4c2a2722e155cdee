"""Texts as numpy arrays: bytes, words, hashes of words and of runs of words, all computed for a block of texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
# all of ASCII but letters and digits; bytes beyond ASCII belong to letters
NO_LETTER = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK_BYTES = 2_000_000  # texts are handled in blocks of about this size; a longer text is a block of its own


def mix64(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all bits depend on all bits."""
    x = x ^ (x >> U(30))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


_BYTE = mix64(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))
_BASE = U(0xD1342543DE82EF95)
_powers = np.ones(1, U)


def powers(n: int) -> np.ndarray:
    """The first n powers of the hash base, modulo 2^64."""
    global _powers
    if len(_powers) < n:
        more = np.full(max(n, 2 * len(_powers)), _BASE, U)
        more[0] = 1
        _powers = np.multiply.accumulate(more)
    return _powers[:n]


def join_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair; the order counts."""
    return mix64(a * U(0x9FB21C651E98DF25) + b)


class Texts:
    """The bytes of several texts, one after another. ``at`` has the offsets, one more than there are texts."""

    def __init__(self, data: np.ndarray, at: np.ndarray) -> None:
        self.data, self.at = data, at

    def __len__(self) -> int:
        return len(self.at) - 1

    def bytes_of(self, i: int) -> bytes:
        return self.data[self.at[i] : self.at[i + 1]].tobytes()

    def lower(self) -> Texts:
        """Letters A-Z in lower case."""
        return Texts(_LOWER[self.data], self.at)


def texts_of(column: pa.Array) -> Texts:
    """A string column as bytes; null counts as empty."""
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    if len(column) == 0:
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return Texts(raw[at[0] : at[-1]], at - at[0])


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """Cut Arrow batches into blocks of rows whose texts have about ``most`` bytes."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        whole = texts_of(column)
        start = 0
        while start < len(whole):
            end = int(np.searchsorted(whole.at, whole.at[start] + most, "right")) - 1
            end = min(max(end, start + 1), len(whole))
            lo, hi = whole.at[start], whole.at[end]
            yield batch.slice(start, end - start), Texts(whole.data[lo:hi], whole.at[start : end + 1] - lo)
            start = end


class Words:
    """Words of a block: byte range, hash and text number of each. Words are runs of bytes that are no separators."""

    def __init__(self, texts: Texts, separators: np.ndarray = _SPACE) -> None:
        data, at = texts.data, texts.at
        n = len(data)
        space = separators[data]
        begins, ends = ~space, ~space
        cut = at[1:-1]
        cut = cut[(cut > 0) & (cut < n)]  # empty texts lie on a border of others
        if n:
            begins[1:] &= space[:-1]
            ends[:-1] &= space[1:]
            begins[cut] = ~space[cut]
            ends[cut - 1] = ~space[cut - 1]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.of = np.searchsorted(at, self.start, "right") - 1
        self.at = np.searchsorted(self.of, np.arange(len(texts) + 1))
        if len(self.start):
            first = self.start[0]
            place = np.arange(n - first) - np.repeat(self.start - first, np.diff(np.append(self.start, n)))
            terms = _BYTE[data[first:]] * powers(int(place.max()) + 1)[place]
            terms[space[first:]] = 0
            self.hash = mix64(np.add.reduceat(terms, self.start - first) + (self.end - self.start).astype(U))
        else:
            self.hash = np.zeros(0, U)

    def __len__(self) -> int:
        return len(self.start)


def run_hashes(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n neighbours, by doubling."""
    if len(hashes) < n:
        return np.zeros(0, U)
    out, have = None, 0
    power, size = hashes, 1
    while True:
        if n & size:
            if out is None:
                out, have = power, size
            else:
                keep = len(hashes) - have - size + 1
                out, have = join_hash(out[:keep], power[have : have + keep]), have + size
        if size * 2 > n:
            break
        power = join_hash(power[: len(power) - size], power[size:])
        size *= 2
    return out


def whole_runs(of: np.ndarray, n: int) -> np.ndarray:
    """True where a run of n neighbours lies within one text."""
    if len(of) < n:
        return np.zeros(0, bool)
    return of[: len(of) - n + 1] == of[n - 1 :]
