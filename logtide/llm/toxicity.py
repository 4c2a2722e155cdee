"""Toxicity scores by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word goes in as the embedding of its own hash and the mean of the embeddings of its character n-grams (3 to 7 bytes, the
beginning of the word marked), so misspelt or joined words are known by their parts. The network reads windows of ``SPAN``
words forwards and backwards, attention pools its states, and a logistic unit gives the window's score. A document's score
is the highest of its windows; windows overlap and cover the whole text.

Training takes a bounded sample: up to ``SAMPLE`` labelled documents of each class, the first by a hash of their ids. Spark counts
in which classes of the sample the words and n-grams occur (they start the embeddings) and picks the windows of each
sampled document that carry the strongest of them, and one by hash; the driver fits the network on these windows of bounded
size, and shifts its bias so that 0.5 separates a part of the sample that was left out of training best. Every text is then
scored where it lies; nothing is shuffled.

Words are runs of letters and digits in lower case (A-Z). A text without words, or null, gets score 0. Rows are scored
one by one, so repeated rows get the same score. Labels without a document or with a null are left out; with only one class in
the sample every score is 0. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.llm.arrays import NO_LETTER, Texts, U, Words, blocks, join_hash, mix64, texts_of
from logtide.llm.common import fresh, ready_for_texts, whole_text
from logtide.session import materialise

SAMPLE = 4_000  # documents of each class that are used for training, at most
SPAN = 32  # words in a window
STEP = 16  # words from one window to the next
BUCKETS = 1 << 15  # embeddings of words, and as many of character n-grams
WIDTH = 4  # of an embedding
HIDDEN = 6  # units in each direction
GRAMS = (3, 4, 5, 6, 7)
PRIOR = 10.0  # documents that smooth a word's odds
CHECKED = 4  # one in so many sampled documents sets the bias and is not trained on
LEAST = 5  # sampled documents that a word or n-gram must occur in to have an embedding
EPOCHS = 6
BATCH = 128
STEPS = 200  # batches at least, so that a small sample is read more often
RATE = 0.01
DROP = 0.5  # share of a batch's different words whose own embedding is left out, so that their parts are learned too


class Vocabulary:
    """The different words of a block: bucket of each, and the buckets of its n-grams (``grams[at[i] : at[i + 1]]``)."""

    def __init__(self, texts: Texts) -> None:
        low = texts.lower()
        self.words = Words(low, NO_LETTER)
        hashes, first, self.of = np.unique(self.words.hash, return_index=True, return_inverse=True)
        self.bucket = (hashes % U(BUCKETS)).astype(np.int64)
        start, end = self.words.start[first], self.words.end[first]
        owner, ids = [], []
        for n in GRAMS:
            number = np.maximum(end - start - n + 1, 0)
            own = np.repeat(np.arange(len(first)), number)
            place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
            at = start[own] + place
            value = np.zeros(len(at), U)
            for k in range(n):
                value = value * U(0x100000001B3) + low.data[at + k].astype(U) + U(1)
            ids.append(join_hash(mix64(value), (n + 8 * (place == 0)).astype(U)) % U(BUCKETS))
            owner.append(own)
        owner, ids = np.concatenate(owner), np.concatenate(ids).astype(np.int64)
        turn = np.argsort(owner, kind="stable")
        self.grams = ids[turn]
        self.at = np.searchsorted(owner[turn], np.arange(len(first) + 1))

    def means(self, values: np.ndarray) -> np.ndarray:
        """Mean of a row of values over the n-grams of each word; 0 without any."""
        running = np.zeros((len(self.grams) + 1, values.shape[1]), values.dtype)
        np.cumsum(values[self.grams], axis=0, out=running[1:])
        return (running[self.at[1:]] - running[self.at[:-1]]) / np.maximum(np.diff(self.at), 1)[:, None].astype(values.dtype)


def windows_of(words: Words, texts: int, span: int = SPAN, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(text of each window, word places padded with -1): windows of every text, together covering all its words."""
    number = np.diff(words.at)
    many = np.where(number > 0, 1 + -(-np.maximum(number - span, 0) // step), 0)
    of = np.repeat(np.arange(texts), many)
    turn = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    first = np.minimum(turn * step, np.maximum(number[of] - span, 0))
    place = first[:, None] + np.arange(span)
    return of, np.where(place < number[of][:, None], words.at[of][:, None] + place, -1)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters with forward and backward pass."""

    def __init__(self, word_odds: np.ndarray, gram_odds: np.ndarray, rare: np.ndarray | None = None, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale=0.1: rng.normal(0, scale, shape).astype(np.float32)
        size = 2 * WIDTH
        self.p = {"words": normal(BUCKETS, WIDTH), "grams": normal(BUCKETS, WIDTH, scale=0.03), "bias": np.zeros(1, np.float32)}
        self.p["words"][:, 0] = word_odds
        self.p["grams"][:, 0] = gram_odds
        rare = np.zeros(2 * BUCKETS, bool) if rare is None else rare
        self.rare = {"words": rare[:BUCKETS], "grams": rare[BUCKETS:]}  # these have no embedding
        for name, rows in self.rare.items():
            self.p[name][rows] = 0
        for way in "fb":
            self.p[f"in_{way}"] = normal(size, 3 * HIDDEN, scale=0.3)
            self.p[f"state_{way}"] = normal(HIDDEN, 3 * HIDDEN, scale=0.3)
            self.p[f"in_bias_{way}"] = np.zeros(3 * HIDDEN, np.float32)
        self.p["look"] = normal(2 * HIDDEN, scale=0.3)
        self.p["out"] = normal(2 * HIDDEN, scale=0.3)

    def inputs(self, vocabulary: Vocabulary, held: np.ndarray | None = None) -> np.ndarray:
        own = self.p["words"][vocabulary.bucket]
        return np.hstack([own if held is None else own * held[:, None], vocabulary.means(self.p["grams"])])

    def _read(self, gates: np.ndarray, index: np.ndarray, live: np.ndarray, way: str, keep: list | None) -> np.ndarray:
        """States after each word, reading forwards (f) or backwards (b). Padding leaves the state as it is."""
        steps = range(index.shape[1]) if way == "f" else range(index.shape[1] - 1, -1, -1)
        h = np.zeros((len(index), HIDDEN), np.float32)
        out = np.empty((index.shape[1], len(index), HIDDEN), np.float32)
        weight = self.p[f"state_{way}"]
        for t in steps:
            x = gates[index[:, t]]
            u = h @ weight
            zr = _logistic(x[:, : 2 * HIDDEN] + u[:, : 2 * HIDDEN])
            z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
            n = np.tanh(x[:, 2 * HIDDEN :] + r * u[:, 2 * HIDDEN :])
            m = live[:, t, None]
            if keep is not None:
                keep.append((t, h, z, r, n, u[:, 2 * HIDDEN :], m))
            h = h + m * ((1 - z) * (n - h))
            out[t] = h
        return out

    def forward(self, x: np.ndarray, index: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. ``x`` has the inputs of the different words, ``index`` their numbers by window, -1 padded."""
        live = (index >= 0).astype(np.float32)
        states = []
        for way in "fb":
            gates = x @ self.p[f"in_{way}"] + self.p[f"in_bias_{way}"]
            kept: list | None = [] if keep is not None else None
            states.append(self._read(gates, index, live, way, kept))
            if keep is not None:
                keep[way] = kept
        h = np.concatenate(states, axis=2)
        look = h @ self.p["look"] + np.where(live.T > 0, 0, -1e9)
        look = np.exp(look - look.max(axis=0))
        share = look / look.sum(axis=0)
        pooled = (h * share[:, :, None]).sum(axis=0)
        if keep is not None:
            keep |= {"h": h, "share": share, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"]

    def gradients(
        self, vocabulary: Vocabulary, index: np.ndarray, labels: np.ndarray, weights: np.ndarray, held: np.ndarray | None = None
    ) -> tuple[float, dict]:
        """Weighted mean cross entropy and its gradients; ``held`` is 0 for words whose own embedding is left out."""
        x = self.inputs(vocabulary, held)
        keep: dict = {}
        logits = self.forward(x, index, keep)
        chance = _logistic(logits)
        total = weights.sum()
        loss = float(-(weights * (labels * np.log(chance + 1e-9) + (1 - labels) * np.log(1 - chance + 1e-9))).sum() / total)
        d_logit = (weights * (chance - labels) / total).astype(np.float32)
        h, share, pooled = keep["h"], keep["share"], keep["pooled"]
        g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * self.p["out"]
        d_share = (h * d_pooled).sum(axis=2)
        d_look = share * (d_share - (share * d_share).sum(axis=0))
        g["look"] = np.einsum("tbh,tb->h", h, d_look)
        d_h = share[:, :, None] * d_pooled + d_look[:, :, None] * self.p["look"]
        d_x = np.zeros_like(x)
        for way, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            d_gates = np.zeros((len(x), 3 * HIDDEN), np.float32)
            d_weight = np.zeros_like(self.p[f"state_{way}"])
            weight = self.p[f"state_{way}"]
            carry = np.zeros((len(index), HIDDEN), np.float32)
            for t, before, z, r, n, inner, m in reversed(keep[way]):
                d = carry + d_h[t, :, part]
                d_new = m * d
                d_z = d_new * (before - n) * z * (1 - z)
                d_n = d_new * (1 - z) * (1 - n * n)
                d_r = d_n * inner * r * (1 - r)
                d_u = np.hstack([d_z, d_r, d_n * r])
                d_weight += before.T @ d_u
                carry = d * (1 - m) + d_new * z + d_u @ weight.T
                live = m[:, 0] > 0
                np.add.at(d_gates, index[live, t], np.hstack([d_z, d_r, d_n])[live])
            g[f"state_{way}"] = d_weight
            g[f"in_{way}"] = x.T @ d_gates
            g[f"in_bias_{way}"] = d_gates.sum(axis=0)
            d_x += d_gates @ self.p[f"in_{way}"].T
        g["words"] = np.zeros_like(self.p["words"])
        np.add.at(g["words"], vocabulary.bucket, d_x[:, :WIDTH] if held is None else d_x[:, :WIDTH] * held[:, None])
        g["grams"] = np.zeros_like(self.p["grams"])
        number = np.diff(vocabulary.at)
        np.add.at(g["grams"], vocabulary.grams, np.repeat(d_x[:, WIDTH:] / np.maximum(number, 1)[:, None], number, axis=0))
        return loss, g

    def train(self, texts: list[str], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, seed: int = 2) -> list[float]:
        """Adam over shuffled batches of windows; returns the mean loss of each epoch."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        step, history = 0, []
        for _ in range(max(epochs, -(-STEPS * BATCH // max(len(texts), 1)))):
            losses = []
            order = rng.permutation(len(texts))
            for lo in range(0, len(order), BATCH):
                some = order[lo : lo + BATCH]
                block = texts_of(pa.array([texts[i] for i in some], pa.string()))
                vocabulary = Vocabulary(block)
                of, place = windows_of(vocabulary.words, len(block))
                head = np.append(True, np.diff(of) != 0)[: len(of)]  # a training window is one window
                of, place = of[head], place[head]
                if not len(of):
                    continue
                index = np.where(place >= 0, vocabulary.of[place], -1)
                held = (rng.random(len(vocabulary.bucket)) >= DROP).astype(np.float32)
                loss, g = self.gradients(vocabulary, index, labels[some][of], weights[some][of], held)
                losses.append(loss)
                for name, rows in self.rare.items():
                    g[name][rows] = 0
                step += 1
                for k, d in g.items():
                    first[k] += 0.1 * (d - first[k])
                    second[k] += 0.001 * (d * d - second[k])
                    self.p[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            history.append(float(np.mean(losses)) if losses else 0.0)
        return history


def document_logits(network: Network, texts: Texts) -> np.ndarray:
    """The highest logit of each text's windows; minus infinity without words."""
    out = np.full(len(texts), -np.inf)
    vocabulary = Vocabulary(texts)
    of, place = windows_of(vocabulary.words, len(texts))
    if len(of):
        index = np.where(place >= 0, vocabulary.of[place], -1)
        np.maximum.at(out, of, network.forward(network.inputs(vocabulary), index).astype(float))
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, usable: Column | None, most: int) -> DataFrame:
    """(text, toxic) of the sampled documents: the first of each class by a hash of the id.

    Of rows that share an id the smallest text is taken; an id with labels of both classes is taken with both.
    """
    rows = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "toxic")
    if usable is not None:
        rows = rows.where(usable)
    classes = [rows.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)]
    picked = classes[0].unionByName(classes[1])  # at most twice ``most`` rows
    texts = docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(picked), "doc_id")
    # one row for each id and class, so that an id that repeats does not multiply the sample
    texts = texts.groupBy("doc_id", F.col("toxic").cast("int").alias("toxic")).agg(F.min("text").alias("text"))
    return materialise(texts.select("text", "toxic"), "toxicity-sample")


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each class in which a bucket occurs; words first, then n-grams."""
    counts = np.zeros((2, 2 * BUCKETS), np.int64)
    for batch, texts in blocks(batches):
        vocabulary = Vocabulary(texts)
        toxic = batch.column(1).to_numpy()
        pairs = np.unique(vocabulary.words.of * len(vocabulary.bucket) + vocabulary.of)
        text, word = pairs // max(len(vocabulary.bucket), 1), pairs % max(len(vocabulary.bucket), 1)
        number = np.diff(vocabulary.at)[word]
        gram = vocabulary.grams[np.repeat(vocabulary.at[word], number) + np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)]
        keys = np.concatenate([text * 2 * BUCKETS + vocabulary.bucket[word], np.repeat(text, number) * 2 * BUCKETS + BUCKETS + gram])
        keys = np.unique(keys)
        np.add.at(counts, (toxic[keys // (2 * BUCKETS)], keys % (2 * BUCKETS)), 1)
    used = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[0, used]), pa.array(counts[1, used])], ["bucket", "clean", "toxic"])


def fit(sample: DataFrame, toxic_share: float) -> Network | None:
    """A network trained on (text, toxic) rows; none if they are of one class."""
    apart = F.pmod(F.xxhash64("text"), F.lit(CHECKED)) == 0
    checked, sample = sample.where(apart), sample.where(~apart)
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return None
    counted = sample.mapInArrow(_class_counts, "bucket bigint, clean bigint, toxic bigint")
    counted = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # at most 2 * BUCKETS rows
    odds = np.zeros(2 * BUCKETS)
    prior = sizes[1] / (sizes[0] + sizes[1])
    got = np.log((counted.toxic + PRIOR * prior) / (counted.clean + PRIOR * (1 - prior))) - np.log(prior / (1 - prior))
    odds[counted.bucket] = got
    rare = np.ones(2 * BUCKETS, bool)
    rare[counted.bucket] = counted.toxic + counted.clean < LEAST
    word_odds, gram_odds = (np.clip(o, -1, 4).astype(np.float32) for o in (odds[:BUCKETS], odds[BUCKETS:]))

    def strongest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of a toxic document the strongest window, of a clean one the strongest and one by hash."""
        for batch, texts in blocks(batches):
            vocabulary = Vocabulary(texts)
            words = vocabulary.words
            of, place = windows_of(words, len(texts))
            top = np.full(len(vocabulary.bucket), -np.inf, np.float32)
            np.maximum.at(top, np.repeat(np.arange(len(top)), np.diff(vocabulary.at)), gram_odds[vocabulary.grams])
            top = np.maximum(top, word_odds[vocabulary.bucket])
            strength = np.where(place >= 0, np.append(top[vocabulary.of], 0)[place], -np.inf).max(axis=1) if len(of) else np.zeros(0)
            dice = mix64(words.hash[place[:, 0]]) if len(of) else np.zeros(0, U)
            toxic = batch.column(1).to_numpy()
            out = []
            for order in (np.lexsort((dice, -strength, of)), np.lexsort((dice, of))):
                head = order[np.append(True, np.diff(of[order]) != 0)[: len(order)]]
                if len(out):
                    head = head[toxic[of[head]] == 0]
                out += [(words.start[p[0]], words.end[p.max()], int(toxic[t])) for p, t in zip(place[head], of[head], strict=True)]
            data = [texts.data[a:b].tobytes().decode("utf-8", "replace") for a, b, _ in out]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.string()), pa.array([c for *_, c in out], pa.int32())], ["text", "toxic"])

    windows = sample.mapInArrow(strongest, "text string, toxic int").orderBy(F.xxhash64("text"), "toxic").toPandas()  # at most 3 * SAMPLE
    labels = windows.toxic.to_numpy(np.float32)
    if not 0 < labels.mean() < 1:
        return None
    network = Network(word_odds, gram_odds, rare)
    network.train(windows.text.tolist(), labels, np.ones(len(labels), np.float32))

    def logits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(document_logits(network, texts)), batch.column(1)], ["logit", "toxic"])

    scored = checked.mapInArrow(logits, "logit double, toxic int").toPandas().sort_values("logit", kind="stable")
    several = max(int((scored.toxic == 1).sum()), 1), max(int((scored.toxic == 0).sum()), 1)
    weight = np.where(scored.toxic == 1, toxic_share / several[0], (1 - toxic_share) / several[1])
    missed = np.append(0, np.cumsum(weight * (scored.toxic == 1)))
    alarms = np.append(np.cumsum((weight * (scored.toxic == 0))[::-1])[::-1], 0)
    wrong = missed + alarms
    best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
    if not len(scored):
        return network
    cut = int(best[len(best) // 2])  # the middle of the best cuts
    found = np.clip(scored.logit.to_numpy(), -30, 30)
    below, above = found[max(cut - 1, 0)], found[min(cut, len(found) - 1)]
    network.p["bias"] = network.p["bias"] - np.float32((below + above) / 2)
    return network


def score(docs: DataFrame, network: Network | None) -> DataFrame:
    """The documents with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on)."""
    columns = docs.columns
    into = [fresh(docs, n) for n in ("score", "predicted")]
    text = fresh(docs, "whole_text")
    schema = T.StructType([*docs.schema.fields, T.StructField(into[0], T.DoubleType()), T.StructField(into[1], T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in blocks(batches, text):
            found = np.zeros(len(texts))
            if network is not None:
                logits = document_logits(network, texts)
                some = np.isfinite(logits)
                found[some] = np.round(_logistic(logits[some]), 6)  # beyond, sums depend on a block's neighbours
            kept = [batch.column(batch.schema.get_field_index(c)) for c in columns]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(found), pa.array((found >= 0.5).astype(np.int32))], [*columns, *into])

    return docs.withColumn(text, whole_text()).mapInArrow(run, schema)


def fit_on(docs: DataFrame, labels: DataFrame, usable: Column | None = None, most: int = SAMPLE) -> Network | None:
    """Train on a sample of the labelled documents; ``usable`` says which labels (by ``doc_id``) may be used."""
    ready_for_texts(docs.sparkSession)
    share = labels.agg(F.avg("toxic")).first()[0] or 0.5
    return fit(labelled_sample(docs, labels, usable, most), float(share))
