"""Benchmark decontamination by spaced-seed hashing.

A spaced seed is a window of tokens of which a fixed mask compares only some; substitutions at the other places leave the
hash as it is. Every window of a document is hashed under each mask, the hashes are joined to those of the benchmark, and
around each hit the document is aligned with the item: an overlap counts if in some stretch of ``stretch`` tokens (the
whole item if it is shorter) at least ``share`` of the tokens agree. The work is DataFrame expressions only; a document's
token array is read in place, so texts are never shuffled to find hits.

The masks lose nothing: for a stretch of L tokens of which k may differ, whichever k do, some mask lies within the stretch
at a place where all that it compares is equal. Shorter items have masks of their own with fewer compared tokens, and only
masks that the benchmark's lengths ask for are hashed.

Tokens are runs of letters and digits in lower case. Items without tokens match nothing, as do null and empty
texts. Rows that repeat an id and text give one result. Items of one ``item_id`` (null too) with different texts are one item, of
which the best stretch counts. Documents are told apart by id and text, so of rows with one id only those with the leaked text are marked.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import fresh, whole_text
from logtide.session import materialise

# Masks by length of a stretch and how many of its tokens may differ: 1 compares a token, 0 ignores it. Every choice of
# differing tokens leaves one of the masks whole at some place.
FAMILIES = {
    (5, 1): ("111", "11011"),
    (10, 2): ("111001", "10000111"),
    (15, 3): ("110111", "1101101"),
    (20, 4): ("110111", "1101101"),
}
MASKS = tuple(dict.fromkeys(m for family in FAMILIES.values() for m in family))
STRETCH = 20
SHARE = 0.8
# The join to the benchmark's hashes is broadcast up to this many rows of three numbers (about 20 MB); beyond, it is shuffled.
MOST_BROADCAST = 200_000


def tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def masks_for(need: int, share: float = SHARE) -> tuple[str, ...]:
    """Masks that lose no stretch of ``need`` tokens of which ``share`` agree.

    Of ``misses`` + 1 runs side by side one is whole; a family is taken where it compares more tokens than such a run.
    """
    misses = need - math.ceil(need * share - 1e-9)
    run = ("1" * max(need // (misses + 1), 1),)
    fit = [f for (n, k), f in FAMILIES.items() if n <= need and misses <= k]
    return max([run, *fit], key=lambda f: min(m.count("1") for m in f))


def _seed(hashes: Column, at: Column, mask: str, number: int) -> Column:
    picked = [F.get(hashes, at + F.lit(i)) for i, c in enumerate(mask) if c == "1"]
    return F.xxhash64(F.lit(number), *picked)


def _seeds(rows: DataFrame, masks: list[str], *keep: str) -> DataFrame:
    """(keep, at, seed) of every window of ``hashes`` under every mask that fits."""
    shortest = min(len(m) for m in masks)
    room = F.size("hashes") - F.lit(shortest)
    # a condition, not a filter: that would be moved below and split the text once more
    placed = rows.select("*", F.explode(F.when(room >= 0, F.sequence(F.lit(0), room))).alias("at"))
    seeds = F.array(*[_seed(F.col("hashes"), F.col("at"), m, i) for i, m in enumerate(masks)])
    return placed.select(*keep, "at", F.posexplode(seeds).alias("mask", "seed"))


def find_overlaps(
    docs: DataFrame,
    items: DataFrame,
    stretch: int = STRETCH,
    share: float = SHARE,
    most_broadcast: int = MOST_BROADCAST,
) -> DataFrame:
    """(doc_id, text_key, item_id, similarity, at): documents that overlap a benchmark item.

    ``similarity`` is the share of equal tokens in the best stretch, ``at`` the token of the document where it begins.
    """
    hashed = lambda words: F.transform(words, lambda w: F.xxhash64(w))
    key = F.xxhash64("item_id", F.concat_ws(" ", "item"))
    bench = items.select("item_id", tokens(whole_text()).alias("item")).where(F.size("item") > 0).withColumn("item_key", key)
    bench = materialise(bench.dropDuplicates(["item_key"]), "benchmark-tokens")
    need = F.least(F.lit(stretch), F.size("item"))
    families = {r["n"]: masks_for(r["n"], share) for r in bench.select(need.alias("n")).distinct().collect()}  # at most ``stretch``
    masks = sorted({m for f in families.values() for m in f}, key=lambda m: (len(m), m)) or ["1"]
    seeds = _seeds(bench.withColumn("hashes", hashed(F.col("item"))), masks, "item_key", "item")
    # a mask that reaches beyond the end of an item would hash missing tokens; an item has the masks of its length only
    lengths = F.element_at(F.array(*[F.lit(len(m)) for m in masks]), F.col("mask") + 1)
    seeds = seeds.where(F.col("at") + lengths <= F.size("item"))
    asked = [(need == n) & F.col("mask").isin(*[masks.index(m) for m in f]) for n, f in families.items()]
    seeds = seeds.where(reduce(or_, asked, F.lit(False)))
    seeds = materialise(seeds.select("item_key", F.col("at").alias("item_at"), "seed"), "benchmark-seeds")

    texts = docs.select("doc_id", F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    split = texts.select("doc_id", "text_key", tokens(F.col("text")).alias("words"))
    windows = _seeds(split.withColumn("hashes", hashed(F.col("words"))), masks, "doc_id", "text_key")
    hits = windows.join(F.broadcast(seeds) if seeds.count() <= most_broadcast else seeds, "seed")
    # hits along one shift of the item against the document are one, however often its tokens repeat
    hits = hits.select("doc_id", "text_key", "item_key", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = materialise(hits, "seed-hits")

    # the few documents that are hit are split once more and read apart from the windows
    hit = materialise(hits.select(F.col("doc_id").alias("of"), F.col("text_key").alias("same")).distinct(), "hit-documents")
    is_hit = lambda of, same: (F.col("text_key") == F.col(same)) & F.col("doc_id").eqNullSafe(F.col(of))
    read = texts.join(hit, is_hit("of", "same"), "left_semi").dropDuplicates(["doc_id", "text_key"])
    read = read.select(F.col("doc_id").alias("of"), F.col("text_key").alias("same"), tokens(F.col("text")).alias("words"))
    along = hits.join(materialise(read, "hit-texts"), is_hit("of", "same")).join(bench, "item_key")
    # the stretch of the document that lies along the item; what hangs over at either end is cut on both sides
    first = F.greatest(-F.col("shift"), F.lit(0))
    room = F.least(F.size("item"), F.size("words") - F.col("shift")) - first
    item_part, part = F.slice("item", first + 1, room), F.slice("words", F.col("shift") + first + 1, room)
    equal = F.zip_with(item_part, part, lambda a, b: F.when(a == b, 1).otherwise(0))
    along = along.where(room >= need).select(
        "doc_id", "text_key", "item_id", (F.col("shift") + first).alias("begin"), need.alias("need"), equal.alias("equal")
    )
    starts = F.sequence(F.lit(0), F.size("equal") - F.col("need"))
    score = lambda s: F.aggregate(F.slice("equal", s + 1, F.col("need")), F.lit(0), lambda a, x: a + x)
    best = along.withColumn("best", F.array_max(F.transform(starts, lambda s: F.struct(score(s).alias("equal"), (-s).alias("back")))))
    best = best.where(F.col("best.equal") >= F.ceil(F.col("need") * F.lit(share)))
    similarity = F.col("best.equal") / F.col("need")
    found = best.select(
        "doc_id", "text_key", "item_id", similarity.alias("similarity"), (F.col("begin") - F.col("best.back")).alias("at")
    )
    # of equally good stretches the earliest
    return (
        found.groupBy("doc_id", "text_key", "item_id")
        .agg(F.max(F.struct("similarity", (-F.col("at")).cast("long").alias("back"))).alias("best"))
        .select("doc_id", "text_key", "item_id", "best.similarity", (-F.col("best.back")).alias("at"))
    )


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents without an overlap, with their columns."""
    key = fresh(docs, "text_key")
    found = find_overlaps(docs, items).select(F.col("doc_id").alias("of"), F.col("text_key").alias(key)).distinct()
    found = materialise(found, "contaminated")
    keyed = docs.withColumn(key, F.xxhash64(whole_text()))
    marked = (keyed[key] == found[key]) & keyed["doc_id"].eqNullSafe(found["of"])
    return keyed.join(found, marked, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
