"""Interpolated modified Kneser-Ney word model, counted in Spark, stored as sorted arrays, mapped into memory by workers.

The model goes up to ``order`` lower-cased (A-Z) words, 2 by default, with one end token per document. All tables grow with the corpus
and stay in files of the shared folder; the driver sees totals only:

* vocabulary: sorted 64-bit word hashes with counts, in stripes of the hash; a word's number is its place;
* pairs: sorted numbers ``context * V + word`` with counts, in stripes of contexts, and for each context its total and how
  many words follow it once, twice, more often;
* continuations: for each word, how many different contexts it follows;
* longer runs, for an order above 2: sorted numbers ``place of the run without its last word * V + word`` with counts, in
  stripes of those places. Runs below the highest order are counted by the different words before them; those that begin a
  document have none before them and keep their own count. Totals are stored for contexts of more than FEW rows, others
  are summed from their rows.

Tasks count a chunk of tokens, code the sorted result as byte planes of differences, and send one row per stripe, so a
frequent word or pair costs one entry per chunk. Stripes are merged one at a time.

P(w | v) = max(c(v w) - D(c), 0) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v) * P(w), with P(w) built in the same way
from the continuation counts and spread over V + 1 words, of which one stands for all unknown ones. After an unknown word
P(w) alone is used.

A null text counts as empty and has its end token only. A null id is in training (its text as an id is empty). Rows that
repeat are documents of their own. With nothing to train on, V = 0 and every token has probability 1. An empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm import store
from logtide.llm.arrays import U, Words, blocks, mix64
from logtide.llm.common import fresh, ready_for_texts, whole_text
from logtide.llm.substring import text_bytes
from logtide.session import materialise

CHUNK = 3_000_000  # tokens that a task counts before it sends them
STRIPE_TOKENS = 4_000_000  # tokens of the corpus for each stripe of the pairs
VOCAB_STRIPES = 64
BYTES_PER_TOKEN = 6
BLOCK = 4_000_000
FEW = 16  # rows of a context that are summed when asked for
END = mix64(np.array([0x5EED], U))  # the hash that stands for the end of a document


def pack(values: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, as many as the largest needs."""
    values = np.ascontiguousarray(values, "<u8")
    need = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return bytes([need]) + values.view(np.uint8).reshape(-1, 8)[:, :need].T.tobytes()


def unpack(data: bytes, size: int) -> np.ndarray:
    need = data[0]
    out = np.zeros((size, 8), np.uint8)
    out[:, :need] = np.frombuffer(data, np.uint8, need * size, 1).reshape(need, size).T
    return out.reshape(-1).view("<u8").astype(U)


def sum_up(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different keys with the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[edges], np.add.reduceat(counts, edges)


def narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in as few bytes as their largest needs."""
    most = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.uint32 if most < 1 << 32 else np.uint64)


def guard_keys(contexts: int, words: int) -> None:
    """Keys of runs are context * words + word in 64 bits; refuse a corpus whose keys would wrap around."""
    if contexts * words >= 1 << 64:
        raise OverflowError(f"{contexts} contexts of {words} words do not fit 64-bit keys; use a lower order")


def stripe_rows(keys: np.ndarray, counts: np.ndarray, edges: np.ndarray) -> pa.RecordBatch:
    """Counted keys cut at ``edges`` (the first key of each stripe but the first), as one row per stripe."""
    cuts = np.append(0, np.append(np.searchsorted(keys, edges), len(keys)))
    full = [i for i in range(len(cuts) - 1) if cuts[i + 1] > cuts[i]]
    parts = [(keys[cuts[i] : cuts[i + 1]], counts[cuts[i] : cuts[i + 1]]) for i in full]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full, pa.int32()),
            pa.array([len(k) for k, _ in parts], pa.int32()),
            pa.array([pack(np.diff(k, prepend=U(0))) for k, _ in parts], pa.binary()),
            pa.array([pack(c) for _, c in parts], pa.binary()),
        ],
        ["stripe", "size", "keys", "counts"],
    )


STRIPE_SCHEMA = "stripe int, size int, keys binary, counts binary"
FOLLOWER_SCHEMA = ", classes array<bigint>, pairs bigint, source int"


def merge_stripes(rows: DataFrame, merge: Callable, schema: str) -> DataFrame:
    """Run ``merge(stripe, keys, counts) -> RecordBatch`` on the sums of each stripe."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            return sum_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]))

        for batch in batches:
            for stripe, n, keys, counts in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if stripe != now:
                    if held:
                        yield merge(now, *total())
                    now, held, size = stripe, [], 0
                held.append((np.cumsum(unpack(keys, n), dtype=U), unpack(counts, n)))
                size += n
                if size > 2 * STRIPE_TOKENS and len(held) > 1:  # sum up what repeats
                    held = [total()]
                    size = len(held[0][0]) // 2
        if held:
            yield merge(now, *total())

    return rows.repartition("stripe").sortWithinPartitions("stripe").mapInArrow(run, schema)


def tokens_of(texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block, each document's words and its end, and the documents' offsets."""
    words = Words(texts.lower())
    at = words.at + np.arange(len(texts) + 1)
    out = np.empty(at[-1], U)
    out[at[1:] - 1] = END
    if len(words):
        out[np.arange(len(words)) + words.of] = words.hash
    return out, at


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3 from the numbers of things that were counted 1, 2, 3 and 4 times; a fixed discount where one is missing."""
    if not all(n):
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return [min(max(d, 0.0), k + 1.0) for k, d in enumerate(found)]


def _discount(counts: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(counts, 3).astype(np.int64)]


@dataclass
class Model:
    """Totals of a model and the folder with its tables."""

    path: str
    stripes: int = 1
    offsets: list[int] = field(default_factory=list)  # number of the first word of each vocabulary stripe, and V
    tokens: int = 0
    pair_discounts: list[float] = field(default_factory=list)
    word_discounts: list[float] = field(default_factory=list)
    pairs: int = 0  # different pairs
    word_classes: list[int] = field(default_factory=list)  # words that follow 1, 2, 3 or more contexts
    order: int = 2
    places: dict = field(default_factory=dict)  # by length of runs: place of the first of each stripe, and their number
    run_discounts: dict = field(default_factory=dict)  # by length of runs
    _open: dict = field(default_factory=dict)

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    @property
    def words(self) -> int:
        return self.offsets[-1]

    def table(self, name: str, dtype) -> np.ndarray:
        if name not in self._open:
            self._open[name] = store.load(self.path, name, dtype) if self.written(name) else np.zeros(0, dtype)
        return self._open[name]

    def written(self, name: str) -> bool:
        """Whether the stripe that a table is named after has rows, by what the writing tasks have reported."""
        kind, stripe = name.rsplit("-", 1)
        i = int(stripe)
        if kind.startswith("vocab"):
            first = self.offsets
        elif kind == "continuations":
            first = np.minimum([0, *self.context_edges(), self.words], self.words)
        else:
            length = kind.split("-", 1)[0]
            first = self.places[int(length) if length.isdigit() else 2]
        return first[i + 1] > first[i]

    def counts(self, name: str, rows: int) -> np.ndarray:
        """A table of counts, whose width follows from its size."""
        data = self.table(name, np.uint8)
        return data.view(f"<u{len(data) // rows}") if rows else data

    def context_edges(self) -> np.ndarray:
        """The first context of each stripe but the first; context number V is the beginning of a document."""
        return np.linspace(0, self.words + 1, self.stripes + 1).astype(np.int64)[1:-1]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Word numbers, -1 for unknown ones."""
        different, back = np.unique(hashes, return_inverse=True)
        out = np.full(len(different), -1, np.int64)
        for i, lo, hi in _cuts(different, _hash_edges()):
            known = self.table(f"vocab-{i}", U)
            if len(known):
                place = np.minimum(np.searchsorted(known, different[lo:hi]), len(known) - 1)
                out[lo:hi] = np.where(known[place] == different[lo:hi], place + self.offsets[i], -1)
        return out[back]

    def word_counts(self, numbers: np.ndarray) -> np.ndarray:
        return self._by_number(numbers, np.array(self.offsets[1:-1]), self.offsets, "vocab-counts", 1)[:, 0]

    def continuations(self, numbers: np.ndarray) -> np.ndarray:
        edges = self.context_edges()
        return self._by_number(numbers, edges, [0, *edges], "continuations", 1)[:, 0]

    def contexts(self, numbers: np.ndarray) -> np.ndarray:
        """(total, N1, N2, N3) of contexts."""
        edges = self.context_edges()
        return self._by_number(numbers, edges, [0, *edges], "contexts", 4)

    def _by_number(self, numbers: np.ndarray, edges: np.ndarray, offsets: list[int], name: str, width: int) -> np.ndarray:
        """Rows of a table that is cut at ``edges`` by number; zero for unknown ones."""
        different, back = np.unique(numbers, return_inverse=True)
        out = np.zeros((len(different), width), U)
        for i, lo, hi in _cuts(different, edges):
            rows = self.table(f"{name}-{i}", np.uint64).reshape(-1, width)
            own = different[lo:hi] - offsets[i]
            if len(rows):
                fits = (own >= 0) & (own < len(rows))
                out[lo:hi][fits] = rows[own[fits]]
        return out[back]

    def pair_counts(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """How often a known word followed a known context."""
        asked = contexts.astype(U) * U(max(self.words, 1)) + words.astype(U)
        different, back = np.unique(asked, return_inverse=True)
        out = np.zeros(len(different), U)
        for i, lo, hi in _cuts(different, self.context_edges().astype(U) * U(max(self.words, 1))):
            keys = self.table(f"pairs-{i}", U)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, different[lo:hi]), len(keys) - 1)
                counts = self.counts(f"pair-counts-{i}", len(keys))
                out[lo:hi] = np.where(keys[place] == different[lo:hi], counts[place], 0)
        return out[back]

    def run_edges(self, length: int) -> np.ndarray:
        """The first context of each stripe but the first of runs of a length."""
        if length == 2:
            return self.context_edges()
        return np.linspace(0, self.places[length - 1][-1], self.stripes + 1).astype(np.int64)[1:-1]

    def run_keys(self, length: int, stripe: int) -> np.ndarray:
        return self.table(f"pairs-{stripe}" if length == 2 else f"{length}-runs-{stripe}", U)

    def run_counts(self, length: int, stripe: int) -> np.ndarray:
        """Counts of runs as their order uses them: by the words before them below the highest."""
        if length < self.order:
            name = f"{length}-adjusted-{stripe}"
        else:
            name = f"pair-counts-{stripe}" if length == 2 else f"{length}-run-counts-{stripe}"
        return self.counts(name, len(self.run_keys(length, stripe)))

    def run_places(self, length: int, contexts: np.ndarray, words: np.ndarray, counted: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Places of runs (context, word), -1 for those not seen or with a part that is -1, and, if asked for, their counts."""
        out, counts = np.full(len(words), -1, np.int64), np.zeros(len(words), U)
        fit = np.flatnonzero((contexts >= 0) & (words >= 0))
        size = U(max(self.words, 1))
        different, back = np.unique(contexts[fit].astype(U) * size + words[fit].astype(U), return_inverse=True)
        found, number = np.full(len(different), -1, np.int64), np.zeros(len(different), U)
        for i, lo, hi in _cuts(different, self.run_edges(length).astype(U) * size):
            keys = self.run_keys(length, i)
            if len(keys):
                place = np.minimum(np.searchsorted(keys, different[lo:hi]), len(keys) - 1)
                there = keys[place] == different[lo:hi]
                found[lo:hi] = np.where(there, place + self.places[length][i], -1)
                if counted:
                    number[lo:hi] = np.where(there, self.run_counts(length, i)[place], 0)
        out[fit], counts[fit] = found[back], number[back]
        return out, counts

    def run_facts(self, length: int, contexts: np.ndarray) -> np.ndarray:
        """(total, N1, N2, N3) of contexts of runs of a length; zero for -1."""
        different, back = np.unique(contexts, return_inverse=True)
        out = np.zeros((len(different), 4))
        size = U(max(self.words, 1))
        for i, lo, hi in _cuts(different, self.run_edges(length)):
            some = np.arange(lo, hi)[different[lo:hi] >= 0]
            keys = self.run_keys(length, i)
            if not len(keys) or not len(some):
                continue
            asked = different[some].astype(U)
            first = np.searchsorted(keys, asked * size)
            number = np.searchsorted(keys, (asked + U(1)) * size) - first
            few = np.flatnonzero((number > 0) & (number <= FEW))
            if len(few):
                at = np.cumsum(number[few]) - number[few]
                rows = np.arange(number[few].sum()) + np.repeat(first[few] - at, number[few])
                out[some[few]] = _facts(self.run_counts(length, i)[rows], at)
            many = np.flatnonzero(number > FEW)
            if len(many):
                held = self.table(f"{length}-facts-{i}", U).reshape(-1, 5)
                out[some[many]] = held[np.searchsorted(held[:, 0], asked[many]), 1:]
        return out[back]

    def run_numbers(self, numbers: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
        """Place of the run of a length that ends at each token; -1 where none was seen."""
        found = numbers
        for k in range(2, length + 1):
            found = self.run_places(k, self.before(found, begins, k), numbers)[0]
        return found

    def before(self, found: np.ndarray, begins: np.ndarray, length: int) -> np.ndarray:
        """The context of each token from the runs, shorter by one, that end at the tokens."""
        out = np.append(-1, found[:-1])
        out[begins] = self.words if length == 2 else -1
        return out

    def word_probabilities(self, numbers: np.ndarray) -> np.ndarray:
        """P of each token without context."""
        known = numbers >= 0
        spread = self.pairs or 1
        lower = np.zeros(len(numbers))
        follows = self.continuations(numbers[known]).astype(float)
        lower[known] = np.maximum(follows - _discount(follows, self.word_discounts), 0) / spread
        rest = sum(d * n for d, n in zip(self.word_discounts, self.word_classes, strict=True)) / spread if self.pairs else 1.0
        return lower + rest / (self.words + 1)

    def run_log_probabilities(self, numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 P of each token after the ``order`` - 1 before it."""
        p, found = self.word_probabilities(numbers), numbers
        for k in range(2, self.order + 1):
            contexts = self.before(found, begins, k)
            found, counts = self.run_places(k, contexts, numbers, counted=True)
            facts = self.run_facts(k, contexts)
            total = np.maximum(facts[:, 0], 1)
            share = np.maximum(counts - _discount(counts, self.run_discounts[k]), 0) / total
            p = share + np.where(facts[:, 0] > 0, facts[:, 1:] @ np.array(self.run_discounts[k]) / total, 1.0) * p
        return np.log10(p)

    def log_probabilities(self, numbers: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 P of each token after the one before; ``begins`` marks the first token of each document."""
        before = np.append(self.words, numbers[:-1])
        before[begins] = self.words
        known = numbers >= 0
        lower = self.word_probabilities(numbers)
        facts = self.contexts(before).astype(float)
        total = np.maximum(facts[:, 0], 1)
        counted = np.zeros(len(numbers), U)
        both = known & (facts[:, 0] > 0)
        counted[both] = self.pair_counts(before[both], numbers[both])
        share = np.maximum(counted - _discount(counted, self.pair_discounts), 0) / total
        left = np.where(facts[:, 0] > 0, facts[:, 1:] @ np.array(self.pair_discounts) / total, 1.0)
        return np.log10(share + left * lower)


def _facts(counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(total, N1, N2, N3) of groups of counts that begin at ``at``."""
    return np.column_stack([np.add.reduceat(x.astype(U), at) for x in (counts, counts == 1, counts == 2, counts > 2)])


def _save_facts(path: str, name: str, contexts: np.ndarray, counts: np.ndarray) -> None:
    """Totals of the contexts (sorted) with more than FEW rows."""
    at = np.flatnonzero(np.append(True, contexts[1:] != contexts[:-1])) if len(contexts) else np.zeros(0, np.int64)
    many = np.diff(np.append(at, len(contexts))) > FEW
    facts = np.column_stack([contexts[at], _facts(counts, at)])[many] if len(at) else np.zeros((0, 5))
    store.save(path, name, facts.astype(U))


def _hash_edges() -> np.ndarray:
    return np.arange(1, VOCAB_STRIPES, dtype=U) << U(64 - VOCAB_STRIPES.bit_length() + 1)


def _cuts(ranked: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(stripe, from, to) of sorted numbers in stripes that begin at ``edges``."""
    cuts = np.append(0, np.append(np.searchsorted(ranked, edges), len(ranked)))
    for i in range(len(cuts) - 1):
        if cuts[i + 1] > cuts[i]:
            yield i, int(cuts[i]), int(cuts[i + 1])


def _chunks(batches: Iterator[pa.RecordBatch], keys: Callable, edges: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Keys of the texts, counted chunk by chunk."""
    held, size = [], 0
    for _, texts in blocks(batches, most=BLOCK):
        held.append(np.unique(keys(texts), return_counts=True))
        size += len(held[-1][0])
        if size >= CHUNK:
            yield stripe_rows(*_joined(held), edges)
            held, size = [], 0
    if size:
        yield stripe_rows(*_joined(held), edges)


def _joined(held: list) -> tuple[np.ndarray, np.ndarray]:
    return sum_up(np.concatenate([k for k, _ in held]), np.concatenate([c for _, c in held]).astype(U))


def fit(texts: DataFrame, path: str | None = None, order: int = 2) -> Model:
    """Count a model of runs of up to ``order`` words over column ``text`` of the rows. Tables are written below ``path``."""
    if order < 2:
        raise ValueError("order must be 2 or more")
    ready_for_texts(texts.sparkSession)
    path = path or store.shared_path(texts.sparkSession, "language-model")
    rows = texts.select(whole_text().alias("text"))
    model = Model(path, stripes=max(8, text_bytes(rows) // BYTES_PER_TOKEN // STRIPE_TOKENS), order=order)

    def save_words(stripe: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        store.save(path, f"vocab-{stripe}", keys)
        store.save(path, f"vocab-counts-{stripe}", counts)
        return pa.RecordBatch.from_pylist([{"stripe": stripe, "words": len(keys), "tokens": int(counts.sum())}])

    edges = _hash_edges()
    words = rows.mapInArrow(lambda b: _chunks(b, lambda t: tokens_of(t)[0], edges), STRIPE_SCHEMA)
    found = merge_stripes(words, save_words, "stripe bigint, words bigint, tokens bigint").collect()  # a row per stripe
    sizes = [0] * VOCAB_STRIPES
    for r in found:
        sizes[r["stripe"]] = r["words"]
    model.offsets = [0, *np.cumsum(sizes).tolist()]
    model.tokens = sum(r["tokens"] for r in found)

    size = U(max(model.words, 1))
    guard_keys(model.words + 1, model.words)
    context_edges = model.context_edges()

    def pair_keys(texts) -> np.ndarray:
        hashes, at = tokens_of(texts)
        numbers = model.numbers(hashes)
        before = np.append(model.words, numbers[:-1])
        before[at[:-1]] = model.words
        return before.astype(U) * size + numbers.astype(U)

    def save_pairs(stripe: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        store.save(path, f"pairs-{stripe}", keys)
        store.save(path, f"pair-counts-{stripe}", narrow(counts))
        bounds = np.append(0, np.append(context_edges, model.words + 1))
        context = (keys // size).astype(np.int64) - bounds[stripe]
        rows = int(bounds[stripe + 1] - bounds[stripe])
        facts = [np.bincount(context, weights=counts, minlength=rows)]
        facts += [np.bincount(context[c], minlength=rows) for c in (counts == 1, counts == 2, counts > 2)]
        store.save(path, f"contexts-{stripe}", np.column_stack(facts).astype(np.uint64))
        follow, times = np.unique(keys % size, return_counts=True)
        out = stripe_rows(follow, times.astype(U), context_edges.astype(U))
        classes = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        mine = [classes if i == 0 else None for i in range(out.num_rows)]
        return out.append_column("classes", pa.array(mine, pa.list_(pa.int64()))).append_column(
            "pairs", pa.array([len(keys) if m else None for m in mine], pa.int64())
        ).append_column("source", pa.array([stripe] * out.num_rows, pa.int32()))

    pairs = rows.mapInArrow(
        lambda b: _chunks(b, pair_keys, context_edges.astype(U) * size), STRIPE_SCHEMA
    )
    merged = materialise(merge_stripes(pairs, save_pairs, STRIPE_SCHEMA + FOLLOWER_SCHEMA), "followers")
    of = [F.coalesce(F.sum(F.col("classes")[k]), F.lit(0)) for k in range(4)]
    *counts, model.pairs = merged.agg(*of, F.coalesce(F.sum("pairs"), F.lit(0))).first()
    model.pair_discounts = discounts(counts)

    def save_followers(stripe: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        bounds = np.append(0, np.append(context_edges, model.words + 1))
        dense = np.zeros(int(bounds[stripe + 1] - bounds[stripe]), np.uint64)
        dense[keys.astype(np.int64) - bounds[stripe]] = counts
        store.save(path, f"continuations-{stripe}", dense)
        return pa.RecordBatch.from_pylist([{f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)} | {"n": len(counts)}])

    totals = merge_stripes(merged.select("stripe", "size", "keys", "counts"), save_followers, "n1 bigint, n2 bigint, n3 bigint, n4 bigint, n bigint")
    counts = [int(v or 0) for v in totals.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "n")]).first()]
    model.word_discounts = discounts(counts[:4])
    model.word_classes = [counts[0], counts[1], counts[4] - counts[0] - counts[1]]
    model.run_discounts[2] = model.pair_discounts
    model.places[2] = _places(merged, model.stripes)
    for length in range(3, order + 1):
        _count_runs(rows, model, length)
    return model


def _places(merged: DataFrame, stripes: int) -> list[int]:
    """Place of the first run of each stripe, and the number of runs."""
    sizes = [0] * stripes
    for r in merged.where("pairs IS NOT NULL").select("source", "pairs").collect():  # a row per stripe
        sizes[r["source"]] = r["pairs"]
    return [0, *np.cumsum(sizes).tolist()]


def _count_runs(rows: DataFrame, model: Model, length: int) -> None:
    """Count runs of a length, and those shorter by one by the different words before them."""
    path, size, top = model.path, U(max(model.words, 1)), length == model.order
    edges, shorter = model.run_edges(length), model.places[length - 1]
    guard_keys(shorter[-1], model.words)
    targets = np.array(shorter[1:-1]).astype(U)

    def keys_of(texts) -> np.ndarray:
        hashes, at = tokens_of(texts)
        numbers = model.numbers(hashes)
        contexts = model.before(model.run_numbers(numbers, at[:-1], length - 1), at[:-1], length)
        fit = contexts >= 0
        return contexts[fit].astype(U) * size + numbers[fit].astype(U)

    def without_first(places: np.ndarray) -> np.ndarray:
        """What is left of runs shorter by one without their first word: a word, or the place of a run."""
        out = np.zeros(len(places), np.int64)
        for i, lo, hi in _cuts(places, targets.astype(np.int64)):
            own = places[lo:hi] - shorter[i]
            if length == 3:
                out[lo:hi] = (model.run_keys(2, i)[own] % size).astype(np.int64)
            else:
                out[lo:hi] = model.table(f"{length - 1}-ends-{i}", U)[own].astype(np.int64)
        return out

    def save_runs(stripe: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        store.save(path, f"{length}-runs-{stripe}", keys)
        store.save(path, f"{length}-run-counts-{stripe}", narrow(counts))
        contexts = keys // size
        if top:
            _save_facts(path, f"{length}-facts-{stripe}", contexts, counts)
        ends = model.run_places(length - 1, without_first(contexts.astype(np.int64)), (keys % size).astype(np.int64))[0]
        if not top:
            store.save(path, f"{length}-ends-{stripe}", ends.astype(U))
        follow, times = np.unique(ends, return_counts=True)
        out = stripe_rows(follow.astype(U), times.astype(U), targets)
        classes = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        mine = [i == 0 for i in range(out.num_rows)]
        return (
            out.append_column("classes", pa.array([classes if m else None for m in mine], pa.list_(pa.int64())))
            .append_column("pairs", pa.array([len(keys) if m else None for m in mine], pa.int64()))
            .append_column("source", pa.array([stripe] * out.num_rows, pa.int32()))
        )

    runs = rows.mapInArrow(lambda b: _chunks(b, keys_of, edges.astype(U) * size), STRIPE_SCHEMA)
    merged = materialise(merge_stripes(runs, save_runs, STRIPE_SCHEMA + FOLLOWER_SCHEMA), f"followers-{length}")
    model.places[length] = _places(merged, model.stripes)
    if top:
        of = [F.coalesce(F.sum(F.col("classes")[k]), F.lit(0)) for k in range(4)]
        model.run_discounts[length] = discounts([int(c) for c in merged.agg(*of).first()])

    def save_adjusted(stripe: int, keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        name = f"pair-counts-{stripe}" if length == 3 else f"{length - 1}-run-counts-{stripe}"
        adjusted = np.zeros(shorter[stripe + 1] - shorter[stripe], U)
        adjusted[keys.astype(np.int64) - shorter[stripe]] = counts
        own = model.counts(name, len(adjusted))
        adjusted = np.where(adjusted == 0, own, adjusted)  # nothing stands before the beginning of a document
        store.save(path, f"{length - 1}-adjusted-{stripe}", narrow(adjusted))
        _save_facts(path, f"{length - 1}-facts-{stripe}", model.run_keys(length - 1, stripe) // size, adjusted)
        return pa.RecordBatch.from_pylist([{f"n{k}": int((adjusted == k).sum()) for k in (1, 2, 3, 4)}])

    # every stripe is written, also one whose runs all begin documents
    first = [(i, 1, pack(np.array([lo], U)), pack(np.zeros(1, U))) for i, lo in enumerate(shorter[:-1]) if shorter[i + 1] > lo]
    every = merged.select("stripe", "size", "keys", "counts").union(rows.sparkSession.createDataFrame(first, STRIPE_SCHEMA))
    totals = merge_stripes(every, save_adjusted, "n1 bigint, n2 bigint, n3 bigint, n4 bigint")
    counts = totals.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4")]).first()
    model.run_discounts[length - 1] = discounts([int(c or 0) for c in counts])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with n_tokens, n_known, base_score (by single words) and score, log10 probabilities of the text.

    ``score`` is that of the model: each token after the ``order`` - 1 before it.
    """
    columns = docs.columns
    into = [fresh(docs, n) for n in ("n_tokens", "n_known", "base_score", "score")]
    text = fresh(docs, "whole_text")
    kinds = [T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType()]
    schema = T.StructType(list(docs.schema.fields) + [T.StructField(n, k) for n, k in zip(into, kinds, strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text, BLOCK):
            hashes, at = tokens_of(texts)
            numbers = model.numbers(hashes)
            counts = model.word_counts(numbers)
            base = np.log10((counts + 1.0) / (model.tokens + model.words + 1.0))
            logs = model.log_probabilities(numbers, at[:-1]) if model.order == 2 else model.run_log_probabilities(numbers, at[:-1])
            number = np.diff(at)
            values = [
                pa.array(number, pa.int64()),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), at[:-1])),
                pa.array(np.add.reduceat(base, at[:-1])),
                pa.array(np.add.reduceat(logs, at[:-1])),
            ]
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, *values], [*columns, *into])

    return docs.withColumn(text, whole_text()).mapInArrow(run, schema)


def id_remainder(modulus: int) -> Column:
    """crc32 of the id as text, modulo a number; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % modulus
