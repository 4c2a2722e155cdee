"""Document quality by a linear-chain conditional random field over lines.

Every line that has a word is a node with two labels, bad (0) and good (1); a text without words is one empty line. A node sees
figures of its own line and of both neighbours: shares of kinds of bytes, of words that repeat, of word shapes hashed to
buckets, lengths, whether the line occurs again in the text. Edges carry a weight for each pair of labels. Forward-backward
gives each line's probability of being good; their mean, weighted by the lines' bytes, is the document's raw quality, which
a logistic curve turns into a score.

Only documents have labels, so lines get theirs in two steps: a fit without edges on lines that take over the label of
their document; then, in bad documents, lines which that fit finds good are taken for good (never all of them), and the
field is fitted with edges. Training runs on at most ``SAMPLE`` documents of each class, picked by a hash of their id
before texts are read. Features of the sample are stored once; each step of the optimiser is a Spark job that sends one
gradient per task, so the driver holds weights only. A quarter of the sample is set apart for the logistic curve.

Nulls count as empty texts. Of rows that share an id the sample takes the smallest text. Labels with null id or null value
are not used; an id with both labels is used with both. Without documents of both classes no field is fitted, and the score
is the share of good labels (0.5 without labels). Chains are evaluated as products of matrices in a number of passes that
grows with the logarithm of the longest chain, so a text of a million lines is no loop over lines.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.arrays import _BYTE, U, Texts, Words, blocks, mix64, powers
from logtide.llm.common import fresh, ready_for_texts, whole_text
from logtide.session import materialise

SAMPLE = 4_000  # documents of each class
APART = 4  # one in so many is set apart
SHAPES = 32
STEPS = 30  # of the optimiser, in each fit
RIDGE = 1e-3
TASKS = 8  # of a training step

_KIND = np.full(256, 8)
_KIND[48:58] = 0
_KIND[65:91] = 1
_KIND[97:123] = 2
_KIND[128:] = 3
for _i, _signs in enumerate((".,;:", "!?", "'\"()[]{}-", "#$%&*|@/\\<>=+_~^`")):
    _KIND[list(_signs.encode())] = 4 + _i
KINDS = 8  # the ninth is white space and control characters
_SHAPE = np.arange(256)
_SHAPE[97:123] = _SHAPE[128:] = 97
_SHAPE[65:91] = 65
_SHAPE[48:58] = 48
OWN = KINDS + 9 + SHAPES
ALL = 3 * OWN + 2  # own line, line before, line after, whether there are such


class Lines:
    """Lines of a block of texts: text number, byte range and features. ``at`` has the first line of each text."""

    def __init__(self, texts: Texts) -> None:
        words = Words(texts)
        n = len(texts)
        newline = np.append(0, np.cumsum(texts.data == 10))[words.start]
        change = np.ones(len(words), bool)
        change[1:] = (np.diff(newline) != 0) | (np.diff(words.of) != 0)
        first = np.flatnonzero(change)
        last = np.append(first[1:], len(words))[: len(first)] - 1
        line = np.cumsum(change) - 1
        of = words.of[first]
        some = self._features(texts, words, first, last, line, of)
        blank = np.setdiff1d(np.arange(n), of)
        self.of = np.concatenate([of, blank])
        order = np.argsort(self.of, kind="stable")
        self.of = self.of[order]
        empty = np.zeros((len(blank), OWN), np.float32)
        empty[:, 1] = 1
        self.own = np.concatenate([some, empty])[order]
        zero = np.zeros(len(blank), np.int64)
        self.start = np.concatenate([words.start[first] - texts.at[of], zero])[order]
        self.end = np.concatenate([words.end[last] - texts.at[of], zero])[order]
        self.at = np.searchsorted(self.of, np.arange(n + 1))

    @staticmethod
    def _features(texts: Texts, words: Words, first, last, line, of) -> np.ndarray:
        lines = len(first)
        out = np.zeros((lines, OWN), np.float32)
        if not lines:
            return out
        number = (last - first + 1).astype(np.float32)
        start, end = words.start[first], words.end[last]
        size = (end - start).astype(np.float32)
        kind = _KIND[texts.data]
        for k in range(KINDS):
            total = np.append(0, np.cumsum(kind == k))
            out[:, 9 + k] = (total[end] - total[start]) / size
        same = np.zeros(len(words), bool)
        same[1:] = (words.hash[1:] == words.hash[:-1]) & (line[1:] == line[:-1])
        order = np.lexsort((words.hash, line))
        new = np.ones(len(words), bool)
        new[1:] = (np.diff(words.hash[order]) != 0) | (np.diff(line[order]) != 0)
        place = np.arange(len(words)) - first[line]
        whole = np.add.reduceat(mix64(words.hash) * powers(int(place.max()) + 1)[place], first)
        _, group, times = np.unique(mix64(whole) ^ mix64(of.astype(U)), return_inverse=True, return_counts=True)
        out[:, 0] = 1
        out[:, 2] = np.log1p(number) / 4
        out[:, 3] = np.log1p(size) / 6
        out[:, 4] = np.bincount(line, same, lines) / number
        out[:, 5] = 1 - np.bincount(line[order], new, lines) / number
        out[:, 6] = size / number / 10
        out[:, 7] = times[group] > 1
        out[:, 8] = kind[end - 1] == 4
        out[:, 9 + KINDS :] = Lines._shapes(texts, words, line, lines) / number[:, None]
        return out

    @staticmethod
    def _shapes(texts: Texts, words: Words, line, lines: int) -> np.ndarray:
        """How many words of each line have each shape: the word's kinds of signs, runs as one, hashed to a bucket."""
        shape = _SHAPE[texts.data]
        turn = np.ones(len(shape), bool)
        turn[1:] = shape[1:] != shape[:-1]
        turn[words.start] = True
        inside = np.zeros(len(shape) + 1, np.int8)
        inside[words.start] += 1
        inside[words.end] -= 1
        spot = np.flatnonzero(turn & (np.cumsum(inside[:-1]) > 0))
        begin = np.searchsorted(spot, words.start)
        place = np.arange(len(spot)) - np.repeat(begin, np.diff(np.append(begin, len(spot))))
        hashed = np.add.reduceat(_BYTE[shape[spot]] * powers(int(place.max()) + 1)[place], begin)
        bucket = (mix64(hashed) % U(SHAPES)).astype(np.int64)
        return np.bincount(line * SHAPES + bucket, minlength=lines * SHAPES).reshape(lines, SHAPES)


def with_neighbours(own: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Features of each line, its neighbours' in the same text, and whether it has them."""
    n = len(own)
    has_before, has_after = np.ones(n, bool), np.ones(n, bool)
    has_before[at[:-1]] = False
    has_after[at[1:] - 1] = False
    out = np.zeros((n, ALL), np.float32)
    out[:, :OWN] = own
    out[has_before, OWN : 2 * OWN] = own[np.flatnonzero(has_before) - 1]
    out[has_after, 2 * OWN : 3 * OWN] = own[np.flatnonzero(has_after) + 1]
    out[:, -2], out[:, -1] = has_before, has_after
    return out


def chain_products(steps: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each line the product of the 2 x 2 matrices from the begin of its chain up to it, and the log of its scale.

    ``place`` is the line's number within its chain. Neighbouring products are multiplied over doubling distances.
    """
    product, scale = steps.copy(), np.zeros(len(steps))
    far, longest = 1, int(place.max(initial=0))
    while far <= longest:
        here = np.flatnonzero(place >= far)
        joined = np.matmul(product[here - far], product[here])
        size = joined.max(axis=(1, 2))
        moved = scale[here] + scale[here - far] + np.log(size)
        product[here], scale[here] = joined / size[:, None, None], moved
        far *= 2
    return product, scale


class Chains:
    """Forward-backward over the chains of a block. ``good`` is each line's probability of the label good."""

    def __init__(self, node: np.ndarray, edge: np.ndarray, at: np.ndarray) -> None:
        n, length = len(node), np.diff(at)
        place = np.arange(n) - np.repeat(at[:-1], length)
        shift = np.maximum(node, 0)
        local = np.exp(np.stack([-shift, node - shift], axis=1))
        steps = np.exp(edge)[None] * local[:, None, :]
        steps[place == 0] = local[place == 0][:, None, :]
        forward, scale = chain_products(steps, place)
        ahead = forward[:, 0]  # both rows are equal, as the first matrix has equal rows
        # behind a line: the product of the steps after it, from the end, so turned round and transposed
        turned = np.empty_like(steps)
        turned[:-1] = steps[1:].transpose(0, 2, 1)
        turned[at[1:] - 1] = np.eye(2)
        back_place = np.repeat(length, length) - 1 - place
        behind, _ = chain_products(turned[::-1], back_place[::-1])
        behind = behind[::-1].sum(axis=1)
        both = ahead * behind
        self.good = both[:, 1] / both.sum(axis=1)
        last = at[1:] - 1
        self.log_total = np.log(ahead[last].sum(axis=1)) + scale[last] + np.bincount(np.repeat(np.arange(len(length)), length), shift, len(length))
        inner = np.flatnonzero(place > 0)
        pairs = ahead[inner - 1][:, :, None] * steps[inner] * behind[inner][:, None, :]
        self.inner, self.pairs = inner, pairs / pairs.sum(axis=(1, 2), keepdims=True)


def raw_quality(good: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Mean of the lines' probabilities by their bytes."""
    weight, n = np.maximum(size, 1).astype(float), len(at) - 1
    of = np.repeat(np.arange(n), np.diff(at))
    return np.bincount(of, weight * good, n) / np.bincount(of, weight, n)


class Field:
    """Node weights, edge weights and the curve from raw quality to score."""

    def __init__(self, node: np.ndarray, edge: np.ndarray, slope: float = 1.0, shift: float = 0.0) -> None:
        self.node, self.edge, self.slope, self.shift = node, edge, slope, shift

    def good(self, own: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Probability of each line being good."""
        return Chains((with_neighbours(own, at) @ self.node).astype(float), self.edge, at).good

    def raw(self, own: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        return raw_quality(self.good(own, at), at, size)

    def score(self, raw: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * log_odds(raw) + self.shift, -30, 30)))


def log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(p / (1 - p))


def line_labels(quality: np.ndarray, at: np.ndarray, found: np.ndarray | None) -> np.ndarray:
    """Labels of lines: those of their documents; with ``found`` (good above 0), good lines of bad documents count as good.

    The line of a bad document with the lowest ``found`` stays bad.
    """
    label = np.repeat(quality, np.diff(at)).astype(np.int64)
    if found is not None:
        label |= found > 0
        of = np.repeat(np.arange(len(quality)), np.diff(at))
        worst = np.lexsort((found, of))[at[:-1]]
        label[worst[quality == 0]] = 0
    return label


def loss_of(weights: np.ndarray, edges: bool, first: np.ndarray | None) -> Callable:
    """A task that sends the summed loss and gradient of its documents; each document counts once, its lines share it."""
    node, edge = weights[:ALL].astype(np.float32), weights[ALL:].reshape(2, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, down, across, seen = 0.0, np.zeros(ALL), np.zeros((2, 2)), 0
        for batch in batches:
            own, at = stored_lines(batch.column(1))
            sizes = np.diff(at)
            x = with_neighbours(own, at)
            label = line_labels(batch.column(0).to_numpy(), at, None if first is None else x @ first)
            score = (x @ node).astype(float)
            chains = Chains(score, edge, at)
            share = 1 / np.repeat(sizes, sizes)
            seen += len(sizes)
            loss += float((chains.log_total / sizes).sum() - (score * label * share).sum())
            down += (share * (chains.good - label)).astype(np.float32) @ x
            if edges and len(chains.inner):
                i = chains.inner
                loss -= float((edge[label[i - 1], label[i]] * share[i]).sum())
                across += (chains.pairs * share[i][:, None, None]).sum(axis=0)
                np.add.at(across, (label[i - 1], label[i]), -share[i])
        yield pa.RecordBatch.from_arrays(
            [pa.array([float(seen)]), pa.array([loss]), pa.array([np.concatenate([down, across.ravel()]).tolist()])], ["n", "loss", "slope"]
        )

    return run


def minimise(value: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, steps: int, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton descent with halved steps."""
    at = start
    loss, slope = value(at)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        way, parts = -slope, []
        for move, turn in reversed(past):
            a = move @ way / (move @ turn)
            way = way - a * turn
            parts.append(a)
        if past:
            way = way * (past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1])
        for (move, turn), a in zip(past, reversed(parts), strict=True):
            way = way + (a - turn @ way / (move @ turn)) * move
        far = 1.0 if past else 1 / max(float(np.abs(slope).sum()), 1.0)
        for _ in range(12):
            there = at + far * way
            new_loss, new_slope = value(there)
            if new_loss <= loss + 1e-4 * far * float(slope @ way):
                break
            far /= 2
        else:
            return at
        if (there - at) @ (new_slope - slope) > 1e-12:
            past = [*past[-memory + 1 :], (there - at, new_slope - slope)]
        done = loss - new_loss < 1e-7
        at, loss, slope = there, new_loss, new_slope
        if done:
            break
    return at


def labelled_sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(quality, text) of the sampled documents: of each class the first by a hash of the id."""
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("quality")).distinct()
    classes = [rows.where(F.col("quality") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    picked = classes[0].unionByName(classes[1])  # at most twice ``most`` rows
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    return texts.groupBy("doc_id", "quality").agg(F.min("text").alias("text")).select("quality", "text")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in blocks(batches):
        lines = Lines(texts)
        own = [lines.own[a:b].tobytes() for a, b in zip(lines.at[:-1], lines.at[1:], strict=True)]
        size = pa.ListArray.from_arrays(pa.array(lines.at, pa.int32()), pa.array(lines.end - lines.start, pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(own, pa.binary()), size], ["quality", "apart", "own", "size"])


def stored_lines(own: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Line features and the first line of each text, as ``_features`` stored them."""
    values = own.to_pylist()
    at = np.append(0, np.cumsum([len(b) // (4 * OWN) for b in values])).astype(np.int64)
    return np.frombuffer(b"".join(values), np.float32).reshape(-1, OWN), at


def fitted_curve(raw: np.ndarray, label: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and shift of the logistic curve over the log odds of raw quality, classes weighted to their true shares."""
    x = np.stack([log_odds(raw), np.ones(len(raw))], axis=1)
    several = max(int((label == 1).sum()), 1), max(int((label == 0).sum()), 1)
    weight = np.where(label == 1, share / several[0], (1 - share) / several[1])
    curve = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (weight * (p - label)) + RIDGE * (curve - [1.0, 0.0])
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(2)
        move = np.linalg.solve(bend, slope)
        curve = curve - move * min(1.0, 2.0 / max(float(np.abs(move).max()), 1e-12))
        if np.abs(move).max() < 1e-9:
            break
    return max(float(curve[0]), 0.05), float(curve[1])


def fit(sample: DataFrame, share: float, steps: int = STEPS) -> Field | float:
    """The field fitted to (quality, text) rows; ``share`` is the share of good documents among all labels."""
    apart = (F.pmod(F.xxhash64("text"), F.lit(APART)) == 0).alias("apart")
    sample = sample.select("quality", "text", apart).repartition(TASKS, F.xxhash64("text")).sortWithinPartitions("text", "quality")
    stored = materialise(sample.mapInArrow(_features, "quality int, apart boolean, own binary, size array<bigint>"), "line-features")
    train, checked = stored.where("not apart").select("quality", "own"), stored.where("apart").select("quality", "own", "size")
    if train.select("quality").distinct().count() < 2:
        return share

    def descend(start: np.ndarray, edges: bool, first: np.ndarray | None) -> np.ndarray:
        def value(w: np.ndarray) -> tuple[float, np.ndarray]:
            rows = train.mapInArrow(loss_of(w, edges, first), "n double, loss double, slope array<double>").collect()  # one row per task
            n = sum(r["n"] for r in rows)
            slope = np.sum([r["slope"] for r in rows], axis=0) / n + RIDGE * w
            if not edges:
                slope[ALL:] = 0
            return sum(r["loss"] for r in rows) / n + RIDGE / 2 * float(w @ w), slope

        return minimise(value, start, steps)

    first = descend(np.zeros(ALL + 4), False, None)
    weights = descend(first, True, first[:ALL].astype(np.float32))
    field = Field(weights[:ALL].astype(np.float32), weights[ALL:].reshape(2, 2))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, at = stored_lines(batch.column(1))
            size = batch.column(2).flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(field.raw(own, at, size))], ["quality", "raw"])

    held = checked.mapInArrow(raw, "quality int, raw double").toPandas()  # at most twice SAMPLE rows
    if held.quality.nunique() == 2:
        field.slope, field.shift = fitted_curve(held.raw.to_numpy(), held.quality.to_numpy(), min(max(share, 0.01), 0.99))
    return field


def fit_on(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, steps: int = STEPS) -> Field | float:
    """The field fitted to documents (doc_id, text) and labels (doc_id, quality); a constant score without two classes."""
    ready_for_texts(docs.sparkSession)
    share = labels.where(F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    return fit(labelled_sample(docs, labels, most), 0.5 if share is None else float(share), steps)


def score(docs: DataFrame, field: Field | float, spans: bool = False) -> DataFrame:
    """The documents with ``score`` (0 to 1), ``predicted`` (1 from 0.5 on) and, if asked for, ``lines``.

    ``lines`` has the byte range of each line within the text and the probability that it is good. Columns of these names
    stay; the new ones get an underscore behind.
    """
    ready_for_texts(docs.sparkSession)
    columns = docs.columns
    into = [fresh(docs, name) for name in ("score", "predicted", "lines")][: 3 if spans else 2]
    text = fresh(docs, "whole_text")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("good", T.DoubleType())]))
    kinds = [T.DoubleType(), T.IntegerType(), span]
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(into, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text):
            lines = Lines(texts)
            if isinstance(field, float):
                good, found = np.full(len(lines.of), field), np.full(len(texts), field)
            else:
                good = field.good(lines.own, lines.at)
                found = field.score(raw_quality(good, lines.at, lines.end - lines.start))
            found = np.round(found, 6)  # beyond, sums depend on a block's neighbours
            out = [pa.array(found), pa.array((found >= 0.5).astype(np.int32))]
            if spans:
                each = pa.StructArray.from_arrays([pa.array(lines.start), pa.array(lines.end), pa.array(np.round(good, 6))], ["start", "end", "good"])
                out.append(pa.ListArray.from_arrays(pa.array(lines.at, pa.int32()), each))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *out], [*columns, *into])

    return docs.withColumn(text, whole_text()).mapInArrow(run, schema)
