"""Count-min sketches built in tasks and merged by a shuffle.

Each row of the sketch maps a 64-bit hash to one of ``2^log_width`` counters. A task does not send counters but the sorted
numbers of those it has raised, coded as differences (about one byte each); the numbers are dealt to stripes of
``2^STRIPE`` counters and added up there. Counters never miss an occurrence, so what they estimate is never too low. The
merged sketch stays in files of the shared folder, one for each stripe, and workers map them into memory; nothing of it
passes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from logtide.llm import store
from logtide.llm.arrays import U, mix64

STRIPE = 22
CHUNK = 4_000_000  # hashes that a task gathers before it sends their counters
_SEEDS = [0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3]


def encode(numbers: np.ndarray) -> bytes:
    """Sorted numbers as bytes: differences, 255 meaning 255 and more to come."""
    steps = np.diff(numbers, prepend=0).astype(np.int64)
    long, rest = np.divmod(steps, 255)
    out = np.full(len(steps) + int(long.sum()), 255, np.uint8)
    out[np.cumsum(long + 1) - 1] = rest
    return out.tobytes()


def decode(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def counter(hashes: np.ndarray, row: int, log_width: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch."""
    spread = hashes if row == 0 else mix64(hashes ^ U(_SEEDS[row]))
    return (spread >> U(64 - log_width)).astype(np.int64)


def _sent(hashes: np.ndarray, rows: int, log_width: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """The raised counters of a chunk by stripe; a counter that is raised more than ``most`` times is sent so often."""
    stripe = min(STRIPE, log_width)
    starts = np.arange(1 << (log_width - stripe)) << stripe
    for row in range(rows):
        numbers = np.empty(len(hashes), np.uint32 if log_width <= 32 else np.int64)
        for lo in range(0, len(hashes), 1 << 18):
            numbers[lo : lo + (1 << 18)] = counter(hashes[lo : lo + (1 << 18)], row, log_width)
        numbers.sort()
        if most is not None and len(numbers) > most:
            numbers = numbers[np.append(np.ones(most, bool), numbers[most:] != numbers[:-most])]
        edges = np.append(np.searchsorted(numbers, starts.astype(numbers.dtype)), len(numbers))
        full = np.flatnonzero(np.diff(edges))
        data = [encode(numbers[edges[i] : edges[i + 1]].astype(np.int64) - starts[i]) for i in full]
        ids = (row << (log_width - stripe)) + full
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(data, pa.binary())], ["stripe", "raised"])


class Sketch:
    """A merged sketch in files below ``path``."""

    def __init__(self, path: str, rows: int, log_width: int, dtype) -> None:
        self.path, self.rows, self.log_width, self.dtype = path, rows, log_width, dtype
        self.written: frozenset[int] = frozenset()  # stripes that have a file; no counter of another one was raised
        self._files: dict[int, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def _stripe(self, number: int) -> np.ndarray:
        if number not in self._files:
            there = number in self.written
            self._files[number] = store.load(self.path, f"stripe-{number}", self.dtype) if there else np.zeros(0, self.dtype)
        return self._files[number]

    def _look(self, row: int, numbers: np.ndarray, read: Callable) -> np.ndarray:
        stripe = min(STRIPE, self.log_width)
        order = np.argsort(numbers)
        ranked = numbers[order]
        out = np.zeros(len(numbers), np.int64)
        edges = np.searchsorted(ranked, np.arange((1 << (self.log_width - stripe)) + 1) << stripe)
        for i in range(len(edges) - 1):
            lo, hi = edges[i], edges[i + 1]
            if hi > lo:
                values = self._stripe((row << (self.log_width - stripe)) + i)
                if len(values):
                    out[order[lo:hi]] = read(values, ranked[lo:hi] & ((1 << stripe) - 1))
        return out

    def repeated(self, hashes: np.ndarray) -> np.ndarray:
        """True for hashes that may have come twice or more (of a sketch of bits)."""
        maybe = np.arange(len(hashes))
        for row in range(self.rows):
            bits = self._look(
                row, counter(hashes[maybe], row, self.log_width), lambda v, n: (v[n >> 3] >> (n & 7).astype(np.uint8)) & 1
            )
            maybe = maybe[bits > 0]
        found = np.zeros(len(hashes), bool)
        found[maybe] = True
        return found

    def counts(self, hashes: np.ndarray) -> np.ndarray:
        """Estimated counts, never too low (of a sketch of counts)."""
        rows = [self._look(r, counter(hashes, r, self.log_width), lambda v, n: v[n]) for r in range(self.rows)]
        return np.minimum.reduce(rows)


def build(
    docs: DataFrame,
    hashes: Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]],
    name: str,
    log_width: int,
    rows: int = 2,
    bits: bool = True,
) -> Sketch:
    """The sketch of all hashes that ``hashes`` makes of the batches of ``docs``.

    With ``bits`` it keeps one bit per counter, whether it was raised at least twice; otherwise it keeps counts.
    """
    path = store.shared_path(docs.sparkSession, name)
    out = Sketch(path, rows, log_width, np.uint8 if bits else np.uint32)
    most = 2 if bits else None

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = np.empty(CHUNK, U), 0
        for part in hashes(batches):
            while len(part):
                fits = part[: CHUNK - size]
                held[size : size + len(fits)] = fits
                size, part = size + len(fits), part[len(fits) :]
                if size == CHUNK:
                    yield from _sent(held, rows, log_width, most)
                    size = 0
        if size:
            yield from _sent(held[:size], rows, log_width, most)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by stripe; one stripe is held at a time."""
        width, now, sums = 1 << min(STRIPE, log_width), None, None
        done = []

        def close() -> None:
            if now is not None:
                store.save(path, f"stripe-{now}", np.packbits(sums >= 2, bitorder="little") if bits else sums)
                done.append(now)

        for batch in batches:
            for stripe, raised in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if stripe != now:
                    close()
                    now, sums = stripe, np.zeros(width, np.uint8 if bits else np.uint32)
                numbers = decode(raised.as_py())
                if bits:
                    sums[numbers] = np.minimum(sums[numbers] + 1, 2)
                    sums[numbers[1:][numbers[1:] == numbers[:-1]]] = 2
                else:
                    sums += np.bincount(numbers, minlength=width).astype(np.uint32)
        close()
        yield pa.RecordBatch.from_arrays([pa.array(done, pa.int32())], ["stripe"])

    sent = docs.mapInArrow(send, "stripe int, raised binary")
    merged = sent.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(add_up, "stripe int")
    out.written = frozenset(r["stripe"] for r in merged.collect())  # numbers of stripes, at most rows * 2^(34 - STRIPE)
    return out


def log_width_for(count: int, room: int, most: int = 34) -> int:
    """Width with ``room`` counters for each of ``count`` hashes. Beyond 2^most counters estimates only get coarser."""
    return int(min(max(int(np.ceil(np.log2(max(count, 1) * room))), 16), most))
