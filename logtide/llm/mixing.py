"""Mixing sources to target weights along a curriculum.

Each source has a demand in words. Its weight varies over training time t in [0, 1]: source number r starts at
``1 - tilt(r)`` and ends at ``1 + tilt(r)`` times its mean weight, so the demand up to t is the integral
``target * (t - tilt * (t - t^2))``. A source's documents are laid out in a fixed pseudo-random order, again and again
until the demand is met; the copy that begins after ``c`` words gets the training position t at which the cumulative
demand is ``c`` (the inverse of the integral). Copies are then sorted by position across the cluster.

The running count of words is a two-level prefix sum: words per (source, slice of the order), a short running sum over the
slices, then a running sum inside each slice. A source with a third of all rows is spread over all its slices.

A null or empty text has size 0 and is never taken. Null is a source of its own, behind all others. Rows that repeat an
id are documents of their own; the order between rows equal in every column does not matter. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm.common import WORD, fresh, whole_text
from logtide.session import materialise

# Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5  # of all words
MOST = 2.0  # times a source's size
SLICE_DIGITS = 3  # hexadecimal digits of the order that name a slice: 4096 slices of each source
# Tilt of the weight over time, by source number, repeating: falls, stays, rises.
TILTS = (-0.5, 0.0, 0.5)


def count_words(column: str = "text") -> Column:
    return F.regexp_count(whole_text(column), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """Per source: number, size and target, from (source, words). One row per source, few rows.

    Water filling: with sources sorted by the level at which they reach their cap, the first source that stays within
    its cap at the level left for it and those behind it sets the level of all of these.
    """
    sums = sizes.groupBy("source").agg(F.sum("words").alias("source_size"))
    number = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("number") % len(WEIGHTS) + 1).cast("int"))
    ranked = sums.withColumn("number", number).withColumn("weight", weight)
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(MOST))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "number")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    behind = by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = by_level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(SHARE) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    ranked = ranked.withColumn("level", left / F.sum("weight").over(behind))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("level"))
    ranked = ranked.withColumn("level", F.first(fits, ignorenulls=True).over(everything))
    target = F.least(F.col("level") * F.col("weight"), F.col("cap"))
    return ranked.select("source", "number", "source_size", target.alias("target"))


def position(words: Column, target: Column, tilt: Column) -> Column:
    """Training time at which the cumulative demand reaches ``words``: the root of tilt t^2 + (1 - tilt) t = share."""
    share = F.least(F.when(target > 0, words / target).otherwise(0.0), F.lit(1.0))
    linear = F.lit(1.0) - tilt
    root = F.sqrt(F.greatest(linear * linear + F.lit(4.0) * tilt * share, F.lit(0.0)))
    return F.when(tilt == 0, share).otherwise(F.lit(2.0) * share / (linear + root))


def tilt_of(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in TILTS]), (number % len(TILTS) + 1).cast("int"))


def plan_mix(sized: DataFrame, slice_digits: int = SLICE_DIGITS) -> DataFrame:
    """Adds source size, target and copies to rows of (doc, source, size, turn).

    ``turn`` is the place in the source's order as hexadecimal text. ``copies`` lists (epoch, words, position, share) of
    the copies that are taken: whole documents, the last one of a source cut where the demand is met. ``share`` is the
    part of all demand up to the position; it rises with the position.
    """
    # a source as a key without null, so that the window and the join behind it deal the rows out alike, and only once
    sized = sized.withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    sized = sized.withColumn("slice", F.substring("turn", 1, slice_digits))
    within = materialise(sized.groupBy("source", "key", "slice").agg(F.sum("size").alias("words")), "slice-sizes")
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    begins = within.withColumn("base", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
    targets = materialise(source_targets(within), "targets")
    tilted = F.sum(F.col("target") * tilt_of(F.col("number"))) / F.sum("target")
    demand = targets.agg(F.when(F.sum("target") > 0, tilted).alias("tilt")).first()["tilt"] or 0.0
    begins = begins.alias("b").join(targets.alias("t"), F.col("b.source").eqNullSafe(F.col("t.source")))
    begins = begins.select(
        F.col("key").alias("of"), F.col("slice").alias("part"), "base", "number", "source_size", "target"
    )
    inside = Window.partitionBy("key", "slice").orderBy("turn", "size")
    laid = sized.withColumn(
        "before", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    )
    laid = laid.join(begins, (F.col("key") == F.col("of")) & (F.col("slice") == F.col("part")))
    goal = F.round("target").cast("long")

    def copy(epoch: int) -> Column:
        begin = F.col("base") + F.col("before") + F.lit(epoch) * F.col("source_size")
        words = F.greatest(F.least(F.col("size"), goal - begin), F.lit(0))
        when = position(begin.cast("double"), F.col("target"), tilt_of(F.col("number")))
        share = when - F.lit(demand) * (when - when * when)
        fields = [F.lit(epoch).alias("epoch"), words.cast("long").alias("words"), when.alias("position")]
        return F.struct(*fields, share.alias("share"))

    copies = F.filter(F.array(*[copy(e) for e in range(int(MOST))]), lambda c: c["words"] > 0)
    return laid.select("doc", "source", "size", "source_size", "target", "turn", copies.alias("copies"))


def sized_rows(docs: DataFrame, *carried: str) -> DataFrame:
    """The rows that ``plan_mix`` reads; ``carried`` columns travel in ``doc``."""
    place = F.md5(F.concat_ws(":", F.lit("mix"), F.col("doc_id").cast("string")).cast("binary"))
    return docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carried]).alias("doc"),
        F.col("source").cast("string").alias("source"),
        count_words().alias("size"),
        place.alias("turn"),
    )


def report_mix(docs: DataFrame) -> DataFrame:
    """One row per document: sizes, target of its source, words taken, copies, position of the first copy."""
    numbered = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("row"))
    plan = materialise(plan_mix(materialise(sized_rows(numbered, "doc_id", "row"), "sized")), "mix-plan")
    sequence = materialise(in_sequence(plan).select("doc.row", "copy.words", "copy.position"), "mix-sequence")
    dealt = sequence.groupBy("row").agg(
        F.sum("words").alias("taken"), F.count(F.lit(1)).alias("copies_dealt"), F.min("position").alias("position")
    )
    dealt = materialise(dealt, "mix-taken").withColumnRenamed("row", "dealt_row")
    none = F.lit(0).cast("long")
    return plan.join(dealt, F.col("doc.row") == F.col("dealt_row"), "left").select(
        "doc.doc_id",
        "size",
        "source_size",
        "target",
        F.coalesce("taken", none).alias("taken"),
        F.coalesce("copies_dealt", none).alias("copies"),
        F.round("position", 9).alias("position"),
    )


def in_sequence(plan: DataFrame) -> DataFrame:
    """(doc, copy) of every copy that is taken, dealt to partitions by ranges of position and sorted there."""
    rows = plan.select("doc", "turn", F.explode("copies").alias("copy"))
    parts = int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.least(F.greatest(F.floor(F.col("copy.share") * parts), F.lit(0)), F.lit(parts - 1)).cast("int")
    return rows.repartitionById(parts, part).sortWithinPartitions("copy.position", "turn")


def mix(docs: DataFrame) -> DataFrame:
    """The training sequence: the documents' columns with epoch, words taken and position, sorted by position.

    The share of all demand up to a position says which partition it belongs to, so partitions are ranges of positions
    with equally many words, and no pass over the texts is needed to sample them. One row per copy that is taken. ``taken`` below the document's size means that training stops after so many words of
    this copy. Added names that the documents have already get an underscore.
    """
    epoch, taken, place = (fresh(docs, n) for n in ("epoch", "taken", "position"))
    rows = in_sequence(plan_mix(sized_rows(docs, *docs.columns)))
    added = [F.col("copy.epoch").alias(epoch), F.col("copy.words").alias(taken), F.col("copy.position").alias(place)]
    return rows.select("doc.*", *added)
