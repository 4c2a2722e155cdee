"""What each of several filters removes in every order in which they may be applied, and its Shapley share.

Filters are applied one after another, so a state is the set of filters already applied: a corner of the subset lattice. An
edge leads from a state to the state with one filter more. What an edge removes depends on the state alone, not on the
order in which it was reached: the documents that fail the new filter and none of the earlier ones. So the documents are
counted once per part and pattern of failures, the counts are summed onto the edges, and everything else is read from the
edges: a step of an order is an edge, and the Shapley share of a filter is the sum over its edges of what they remove times
the number of orders through them. That number is the paths from the start to the edge times those from it to the end,
counted forward and backward over the lattice.

Documents move once as (id, digest, pattern); texts are never shuffled. A part with a third of all rows is a partial
aggregate of at most 2^n patterns in each task. The lattice of n filters has n * 2^(n-1) edges, the result n * n! rows for
each part, so n is bounded by ``MOST_FILTERS``.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logtide.llm.common import SPACE, whole_text
from logtide.session import materialise

MOST_FILTERS = 7


def text_failures(text: str = "text") -> dict[str, Column]:
    """The conditions A to D of the registered query, true where a text fails."""
    whole = whole_text(text)
    words = F.filter(F.split(whole, SPACE), lambda w: w != "")
    capitals = F.length(F.regexp_replace(whole, "[^A-Z]+", ""))
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)) < 80 * F.size(words),
        "C": 100 * capitals.cast("long") > 10 * F.length(whole).cast("long"),
        "D": whole.rlike("[#$%&*|]"),
    }


def paths(n: int) -> list[tuple[int, int, int]]:
    """(state, filter, orders through the edge) of the lattice of n filters; a state is a bit mask."""
    full = (1 << n) - 1
    reach, leave = [0] * (full + 1), [0] * (full + 1)
    reach[0] = leave[full] = 1
    edges = [(s, f) for s in range(full + 1) for f in range(n) if not s >> f & 1]
    for s, f in edges:
        reach[s | 1 << f] += reach[s]
    for s, f in reversed(edges):
        leave[s] += leave[s | 1 << f]
    return [(s, f, reach[s] * leave[s | 1 << f]) for s, f in edges]


def order_steps(names: str) -> list[tuple[str, int, int, int]]:
    """(order, step, state before it, filter) of every step of every order."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, f in enumerate(order, 1):
            rows.append(("".join(names[i] for i in order), step, state, f))
            state |= 1 << f
    return rows


def failure_patterns(docs: DataFrame, labels: DataFrame, part: Column, failures: dict[str, Column], repeats: str | None) -> DataFrame:
    """(part, pattern, docs, good, toxic): how many documents of a part fail just these filters.

    ``failures`` gives one condition per filter, null as passed. ``repeats`` names the filter that equal texts fail, the
    last bit: a document fails it when a smaller ``doc_id`` of the whole table has the same text. A null id counts as
    larger than all others. Rows of one id are documents of their own and do not fail it by one another. A document is good
    (toxic) when any label row of its id says so; a null id has no label.
    """
    pattern = F.lit(0)
    for i, failed in enumerate(failures.values()):
        pattern = pattern + F.when(failed, 1 << i).otherwise(0)
    digest = F.unhex(F.sha2(whole_text(), 256)) if repeats else F.lit(None).cast("binary")
    rows = docs.select("doc_id", F.coalesce(part.cast("string"), F.lit("")).alias("part"), pattern.alias("pattern"), digest.alias("digest"))
    rows = materialise(rows, "patterns")
    if repeats:
        # stored, so that both sides of the join are plain shuffles, which adaptive execution can split
        copies = rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        copies = materialise(copies.select("digest", "first"), "copies")
        later = (F.col("doc_id") > F.col("first")) | (F.col("doc_id").isNull() & F.col("first").isNotNull())
        bit = 1 << len(failures)
        rows = rows.join(copies, "digest", "left").withColumn("pattern", F.col("pattern") + F.when(later, bit).otherwise(0))
    marks = [F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("int")).alias(a) for c, a in (("quality", "good"), ("toxic", "toxic"))]
    known = labels.select("doc_id", "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(*marks)
    known = materialise(known.where("good + toxic > 0"), "marks")
    counted = rows.select("doc_id", "part", "pattern").join(known, "doc_id", "left")
    return counted.groupBy("part", "pattern").agg(
        F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("good"), F.lit(0)).alias("good"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")
    )


def edge_counts(patterns: DataFrame, n: int) -> DataFrame:
    """(part, state, filter, orders, kept, removed, redundant, unique_fails, good_lost, toxic_lost), one row per edge and part."""
    spark = patterns.sparkSession
    passes = []
    for pattern in range(1 << n):
        for state, f, orders in paths(n):
            fails, gone = bool(pattern >> f & 1), bool(pattern & state)
            stays = not gone and not fails
            passes.append((pattern, state, f, orders, stays, fails and not gone, fails and gone, pattern == 1 << f))
    schema = "pattern int, state int, filter int, orders long, stays boolean, goes boolean, gone boolean, only boolean"
    lattice = spark.createDataFrame(passes, schema)  # n * 2^(2n - 1) rows
    zero = F.lit(0).cast("long")

    def total(flag: str, column: str, name: str) -> Column:
        return F.sum(F.when(F.col(flag), F.col(column)).otherwise(zero)).alias(name)

    return patterns.join(F.broadcast(lattice), "pattern").groupBy("part", "state", "filter", "orders").agg(
        total("stays", "docs", "kept"),
        total("goes", "docs", "removed"),
        total("gone", "docs", "redundant"),
        total("only", "docs", "unique_fails"),
        total("goes", "good", "good_lost"),
        total("goes", "toxic", "toxic_lost"),
    )


def audit(docs: DataFrame, labels: DataFrame, part: Column, failures: dict[str, Column], repeats: str | None = None) -> DataFrame:
    """One row per part, order of the filters and step.

    Filters have names of one letter; ``repeats`` is the filter on equal texts (see ``failure_patterns``), the last one. Parts
    are the values of ``part`` in the table, null as empty text; an empty table gives no rows. Other columns of the tables,
    whatever their names, are not read.
    """
    names = "".join(failures) + (repeats or "")
    if len(set(names)) != len(failures) + bool(repeats) or len(names) > MOST_FILTERS:
        raise ValueError(f"filters need different names of one letter, at most {MOST_FILTERS}")
    patterns = failure_patterns(docs, labels, part, failures, repeats)
    edges = materialise(edge_counts(patterns, len(names)), "edges")
    shapley = edges.groupBy("part", "filter").agg(F.sum(F.col("removed") * F.col("orders")).alias("shapley"))
    steps = docs.sparkSession.createDataFrame(order_steps(names), "filter_order string, step int, state int, filter int")
    found = edges.join(F.broadcast(steps), ["state", "filter"]).join(shapley, ["part", "filter"])
    counts = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return found.select("part", "filter_order", "step", *counts)
