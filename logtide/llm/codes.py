"""Product codes of vectors: each vector is cut into parts, each part is replaced by the nearest entry of its codebook.

All arithmetic is in integers, so results don't depend on the number of tasks. Codebooks are fitted in rounds over the
whole table: tasks assign their vectors and send one partial sum per entry; only codebooks reach the driver.

The nearest entry is found by slicing and intersecting. Per dimension the entries' coordinates are sorted and carry prefix
masks: bit e of mask i is set when entry e is among the first i. An initial radius, the distance to the entry next to
the part in the dimension with the widest spread, selects a range of each sorted list; the entries in the range are the exclusive or of two
prefix masks. The masks of all dimensions, ANDed, leave the entries inside the cube around the part. No entry outside is
nearer than the initial one, so the candidates are exact; only their distances are computed.

Kept are rows whose vector has no null and only finite components and as many of them as the first kept row (that with
the smallest id); null, empty and other vectors are dropped. Ids order with null last, equal ids by their components; each
row counts. Components beyond ``limit(dims)`` in size (32,768 before scaling at 64 dimensions) are cut to it, so that an
error fits 64 bits; a sum over a label that does not is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import ready_for_texts
from logtide.session import materialise

U = np.uint64
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6
MASK_BITS = 64


def limit(dims: int) -> int:
    """The largest component, a power of two, with which the squared distances of a vector stay below 2^62."""
    return 1 << ((62 - max(dims - 1, 1).bit_length()) // 2 - 1)


def cuts_of(dims: int, parts: int) -> list[int]:
    """Where the parts of a vector begin, and its end."""
    return [p * dims // parts for p in range(parts + 1)]


def rows_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column as doubles, null as NaN, and the offsets of its rows; a null list is empty."""
    at = np.append(0, np.cumsum(np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False).astype(float), at


def whole_vectors(vectors: DataFrame, vector: str, carry: list[str]) -> DataFrame:
    """The rows of finite vectors without null, with integer components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, at = rows_of(batch.column(len(carry)))
            size = np.diff(at)
            of = np.repeat(np.arange(len(size)), size)
            good = (size > 0) & (np.bincount(of, ~np.isfinite(flat), len(size)) == 0)
            used = good[of]
            most = np.array([limit(int(n)) for n in size[good]], float)[np.cumsum(good) - 1][of[used]] if good.any() else np.zeros(0)
            with np.errstate(over="ignore"):
                whole = np.clip(np.floor(flat[used] * SCALE), -most, most).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size[good])), pa.int32()), pa.array(whole))
            kept = batch.filter(pa.array(good))
            yield pa.RecordBatch.from_arrays([*[kept.column(i) for i in range(len(carry))], lists], [*carry, "whole"])

    columns = vectors.select(*[F.col(f"`{c}`") for c in [*carry, vector]])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns.schema.fields[:-1])
    return columns.mapInArrow(run, f"{schema}, whole array<int>")


class Slices:
    """The entries of one codebook (entries x dimensions), sorted in each dimension, with prefix masks of 64 entries."""

    def __init__(self, book: np.ndarray) -> None:
        self.book = book
        self.order = np.argsort(book, axis=0, kind="stable")
        self.sorted = np.take_along_axis(book, self.order, axis=0)
        spread = self.sorted[-1] - self.sorted[0]
        self.widest = int(np.argmax(spread)) if len(spread) else 0
        self.words = []  # for each 64 entries: prefix masks, one row more than there are entries
        for low in range(0, len(book), MASK_BITS):
            inside = (self.order >= low) & (self.order < low + MASK_BITS)
            bit = np.where(inside, U(1) << (np.where(inside, self.order - low, 0)).astype(U), U(0))
            self.words.append(np.vstack([np.zeros((1, book.shape[1]), U), np.bitwise_or.accumulate(bit, axis=0)]))

    def candidates(self, x: np.ndarray, radius: np.ndarray) -> list[np.ndarray]:
        """For each 64 entries the masks of those inside the cube of that radius around each row."""
        masks = [np.full(len(x), ~U(0)) for _ in self.words]
        for d in range(x.shape[1]):
            low = np.searchsorted(self.sorted[:, d], x[:, d] - radius, "left")
            high = np.searchsorted(self.sorted[:, d], x[:, d] + radius, "right")
            for mask, prefix in zip(masks, self.words, strict=True):
                mask &= prefix[high, d] ^ prefix[low, d]
        return masks

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of the nearest entry of each row; of equally near ones the first."""
        if not x.shape[1] or not len(x):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        line = self.sorted[:, self.widest]
        after = np.searchsorted(line, x[:, self.widest])
        before = np.maximum(after - 1, 0)
        after = np.minimum(after, len(line) - 1)
        nearer = x[:, self.widest] - line[before] < line[after] - x[:, self.widest]
        start = self.order[np.where(nearer, before, after), self.widest]
        best = ((x - self.book[start]) ** 2).sum(axis=1)
        radius = np.ceil(np.sqrt(best.astype(float))).astype(np.int64) + 1  # the root of a large integer is rounded
        index = start.copy()
        for k, mask in enumerate(self.candidates(x, radius)):
            for e in range(min(MASK_BITS, len(self.book) - k * MASK_BITS)):
                rows = np.flatnonzero(mask >> U(e) & U(1))
                number = k * MASK_BITS + e
                d = ((x[rows] - self.book[number]) ** 2).sum(axis=1)
                better = (d < best[rows]) | ((d == best[rows]) & (number < index[rows]))
                rows, d = rows[better], d[better]
                best[rows], index[rows] = d, number
        return index, best


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(column), -1)


class Coder:
    """Codebooks: for each part a matrix of entries x positions."""

    def __init__(self, books: list[np.ndarray]) -> None:
        self.books = books
        self.cuts = np.cumsum([0, *[b.shape[1] for b in books]])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, a:b] for a, b in zip(self.cuts[:-1], self.cuts[1:], strict=True)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x parts) and squared distances summed over the parts."""
        found = [Slices(b).nearest(p) for b, p in zip(self.books, self.parts(x), strict=True)]
        return np.stack([i for i, _ in found], axis=1), np.sum([d for _, d in found], axis=0)

    def sums(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One row for each part and entry that the task's vectors use: count and sums, filled up to the widest part."""
        entries, wide = len(self.books[0]), max(b.shape[1] for b in self.books)
        count = np.zeros((len(self.books), entries), np.int64)
        total = np.zeros((len(self.books), entries, wide), np.int64)
        for batch in batches:
            x = matrix(batch.column(0))
            codes, _ = self.assign(x)
            for p, part in enumerate(self.parts(x)):
                count[p] += np.bincount(codes[:, p], minlength=entries)
                np.add.at(total[p, :, : part.shape[1]], codes[:, p], part)
        p, e = np.nonzero(count)
        offsets = pa.array(np.arange(len(p) + 1) * wide, pa.int32())
        lists = pa.ListArray.from_arrays(offsets, pa.array(total[p, e].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(count[p, e]), lists], ["part", "entry", "n", "total"])

    def refined(self, vectors: DataFrame) -> Coder:
        """Each entry replaced by the floor of the mean of its parts; unused entries stay."""
        wide = max(b.shape[1] for b in self.books)
        sent = vectors.select("whole").mapInArrow(self.sums, "part bigint, entry bigint, n bigint, total array<bigint>")
        means = [F.sum(F.get("total", F.lit(i))).alias(f"s{i}") for i in range(wide)]
        books = [b.copy() for b in self.books]
        for r in sent.groupBy("part", "entry").agg(F.sum("n").alias("n"), *means).collect():  # one row per entry of a codebook
            width = books[r["part"]].shape[1]
            books[r["part"]][r["entry"]] = [r[f"s{i}"] // r["n"] for i in range(width)]
        return Coder(books)

    def digest(self) -> str:
        """SHA-256 of all components as decimal text, by part, entry and position."""
        return hashlib.sha256(",".join(str(c) for b in self.books for c in b.ravel().tolist()).encode()).hexdigest()

    def encode(self, vectors: DataFrame) -> DataFrame:
        """The rows with ``code`` (two hex digits for each part, more where the codebook needs them) and ``error``."""
        carry = [c for c in vectors.columns if c != "whole"]
        digits = max(2, len(f"{len(self.books[0]) - 1:x}"))
        names = np.array([f"{e:0{digits}x}" for e in range(len(self.books[0]))], f"S{digits}")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                codes, error = self.assign(matrix(batch.column(batch.schema.get_field_index("whole"))))
                text = np.ascontiguousarray(names[codes]).view(f"S{digits * codes.shape[1]}").ravel().astype(str)
                kept = [batch.column(batch.schema.get_field_index(c)) for c in carry]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(text, pa.string()), pa.array(error)], [*carry, "code", "error"])

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields if f.name != "whole")
        return vectors.mapInArrow(run, f"{schema}, code string, error bigint")


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Coder | None:
    """Codebooks for rows (vec_id, whole) of equal lengths; none without rows."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "whole").limit(entries).select("whole").collect()  # ``entries`` rows
    if not first:
        return None
    start = np.array([r["whole"] for r in first], np.int64)
    cuts = cuts_of(start.shape[1], parts)
    coder = Coder([start[:, a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    for _ in range(rounds):
        coder = coder.refined(vectors)
    return coder


def compress(vectors: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) for every kept vector.

    ``label_error`` sums the errors of all rows with the same label, null labels together. Fewer than ``entries`` vectors
    give codebooks of as many entries; an empty table gives no rows. Other columns are not read.
    """
    ready_for_texts(vectors.sparkSession)
    kept = materialise(whole_vectors(vectors, vector, ["vec_id", "label"]), "whole-vectors")
    head = kept.orderBy(F.col("vec_id").asc_nulls_last(), "whole").select(F.size("whole").alias("n")).first()
    kept = kept.where(F.size("whole") == (head["n"] if head else 0))
    coder = fit_codes(kept, parts, entries, rounds)
    if coder is None:
        coded = kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"))
    else:
        coded = coder.encode(kept)
    coded = materialise(coded, "codes")
    # stored, so that both sides of the join are plain: a small table is broadcast by its size, a large one's hot labels are split
    sums = coded.groupBy("label").agg(F.try_sum("error").alias("label_error")).withColumnRenamed("label", "of")
    sums = materialise(sums, "label-errors")
    found = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    digest = F.lit(coder.digest() if coder else hashlib.sha256(b"").hexdigest())
    return found.select("vec_id", "label", "code", "error", "label_error", digest.alias("codebooks_sha256"))
