"""Near copies: documents whose shingle sets reach a Jaccard similarity, found by T-occurrence search.

A document's set has its distinct shingles, ordered so that shingles which a count-min sketch takes for frequent come
last and by hash otherwise. Two sets that reach the similarity share at least T shingles, so even without the T - c last
ones of each (the long lists) they share about c of those before (the short lists). That is used three times:

1. A sketch of the short-list shingles of all documents shows which of them occur twice. A document with fewer than c such
   shingles has no partner and drops out; the sets of the others are stored.
2. The short lists are inverted: rows (shingle, set) are sorted by shingle across the cluster. A list is cut where sizes
   are too far apart to match; lists with the same first set are one block, so that a group of copies, whose lists differ
   by a few members each, goes into few blocks. A large block is searched in parts; then one set of the largest component
   of each part is searched against those of the other parts, and what is not in the block's largest component after that
   against all parts. A group of copies of any size is so sent once or twice, not once for each part.
3. In each block the T-occurrence search runs as DivideSkip: the short inverted lists of a set are merged with a heap that
   skips what cannot reach the threshold, the long ones are probed by binary search, and sets that reach the overlap are
   linked. Sets that a block has connected already are not searched again, so a group of copies costs a chain of links,
   not all pairs. Where the lists hold so many entries that a heap would skip little, as in a group of sets just below the
   similarity, they are merged by counting the entries of each set, for all candidates at once.

Equal sets count once in all of this. Links become components by alternating stars, and no link between different texts
is lost: any pair that reaches the similarity meets in a block.

Words are lower-cased (A-Z). With fewer words than a shingle has, the whole sequence is the only shingle; a text without words, or null, is
linked with nothing. Rows that repeat an id or a text are documents of their own with equal sets. A null id counts behind
all others. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logtide.llm import sketch
from logtide.llm.arrays import U, Words, blocks, join_hash, mix64, run_hashes, whole_runs
from logtide.llm.common import fresh, keep_rows, row_hash, ready_for_texts, whole_text
from logtide.llm.components import components
from logtide.llm.substring import BYTES_PER_WORD, text_bytes
from logtide.session import materialise

ROOM = 16  # counters per short-list shingle in each row of the sketch
FREQUENT = 32  # estimated count, above the mean load of a counter, from which a shingle counts as frequent
EXTRA = 10  # one more short list for so many shingles; c of the module text
MOST = 200_000  # shingles of the sets of a block that are searched in one go; larger blocks are searched in parts
LEAST_SETS = 8  # sets of a part on average, so that parts are fewer than sets
MU = 0.0085  # weight of a probe against a merge step in DivideSkip's choice of long lists
DENSE = 256  # entries of short lists, and one for 16 sets, from which they are merged by counting instead of a heap
PROBE = 32  # entries of long lists that are counted in the time of one probe


def least_overlap(size: int, percent: int) -> int:
    """Shingles that a set of this size shares at least with any set that reaches the similarity."""
    return -(-percent * size // 100)


def short_lists(size: int, percent: int) -> int:
    return min(size, size - least_overlap(size, percent) + 1 + size // EXTRA)


def least_common(size: int) -> int:
    """Short-list shingles that a set of this size shares at least with a partner of its size or smaller."""
    return max(1, size // EXTRA)


class Shingles:
    """The sets of a block of texts: sorted distinct keys of each text, 6 bits of frequency level above 58 bits of hash."""

    def __init__(self, words: int, percent: int, load: sketch.Sketch, mean: int) -> None:
        self.words, self.percent, self.load, self.mean = words, percent, load, mean

    def hashes(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Shingle hashes with their text numbers."""
        found = Words(texts.lower())
        number = np.diff(found.at)
        whole = whole_runs(found.of, self.words)
        runs, of = run_hashes(found.hash, self.words)[whole], found.of[: len(whole)][whole]
        short = np.flatnonzero((number > 0) & (number < self.words))
        if len(short):
            alone = [run_hashes(found.hash[found.at[i] : found.at[i + 1]], int(number[i])) for i in short]
            few = join_hash(np.concatenate(alone), number[short].astype(U))
            runs, of = np.concatenate([runs, few]), np.concatenate([of, short])
            turn = np.argsort(of, kind="stable")
            runs, of = runs[turn], of[turn]
        return runs, of

    def sets(self, texts) -> list[np.ndarray]:
        runs, of = self.hashes(texts)
        level = np.zeros(len(runs), U)
        counts = self.load.counts(runs) // (FREQUENT + 2 * self.mean)
        often = counts > 0
        level[often] = np.floor(np.log2(counts[often])).astype(U) + U(1)
        keys = (level << U(58)) | (runs >> U(6))
        at = np.searchsorted(of, np.arange(len(texts) + 1))
        return [np.unique(keys[lo:hi]) for lo, hi in zip(at, at[1:], strict=False)]

    def short(self, one: np.ndarray) -> np.ndarray:
        return one[: short_lists(len(one), self.percent)]


def set_digest(one: np.ndarray) -> int:
    """A 64-bit digest of a set."""
    return int(mix64(np.array([mix64(one).sum(dtype=U) + U(len(one))], U)).view(np.int64)[0])


def merge_skip(lists: list[list[int]], least: int) -> Iterator[tuple[int, int]]:
    """Members of at least ``least`` sorted lists, with their number of lists, by a heap that skips."""
    heap = [(values[0], i, 0) for i, values in enumerate(lists) if values]
    heapq.heapify(heap)
    while len(heap) >= least:
        top = heap[0][0]
        taken = []
        while heap and heap[0][0] == top:
            taken.append(heapq.heappop(heap))
        if len(taken) >= least:
            yield top, len(taken)
            for _, i, at in taken:
                if at + 1 < len(lists[i]):
                    heapq.heappush(heap, (lists[i][at + 1], i, at + 1))
            continue
        # too few: of the least - 1 smallest cursors all may jump to the next one's value
        while heap and len(taken) < least - 1:
            taken.append(heapq.heappop(heap))
        if not heap:
            return
        goal = heap[0][0]
        for _, i, at in taken:
            at = bisect_left(lists[i], goal, at)
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i, at))


def _counts(owners: np.ndarray, begin: np.ndarray, end: np.ndarray, number: int) -> np.ndarray:
    """For each of so many sets, the number of these lists that have it."""
    if not len(begin):
        return np.zeros(number, np.int64)
    return np.bincount(np.concatenate([owners[i:j] for i, j in zip(begin, end, strict=True)]), minlength=number)


def block_links(sets: list[np.ndarray], percent: int, classes: np.ndarray | None = None) -> np.ndarray:
    """For sets in order of size: the number of the first set of each one's component within the block.

    Sets of equal ``classes`` are connected from the start and are not compared.
    """
    size = np.array([len(s) for s in sets])
    at = np.append(0, np.cumsum(size))
    order = np.argsort(np.concatenate(sets), kind="stable")
    owners = np.repeat(np.arange(len(sets)), size)[order]
    ranked = np.concatenate(sets)[order]
    new = np.append(True, ranked[1:] != ranked[:-1])
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(ranked))
    list_of = np.empty(len(ranked), np.int64)
    list_of[order] = np.cumsum(new) - 1
    place_of = np.empty(len(ranked), np.int64)
    place_of[order] = np.arange(len(ranked))  # a list is in order of sets, so those before this place are before the set
    part = np.arange(len(sets))
    if classes is not None:
        _, first, of = np.unique(classes, return_index=True, return_inverse=True)
        part = first[of]
    for q in range(1, len(sets)):
        if (part[:q] == part[q]).all():
            continue
        mine = list_of[at[q] : at[q + 1]]
        length = end[mine] - begin[mine]
        need = least_overlap(int(size[q]), percent)
        many = int(need / (MU * np.log2(max(int(length.max()), 2)) + 1))
        many = max(0, min(many, need - 1))
        turn = np.argsort(length, kind="stable")
        near, far = turn[: len(mine) - many], turn[len(mine) - many :]
        before = place_of[at[q] : at[q + 1]]
        entries = before - begin[mine]
        if entries[near].sum() >= DENSE + q // 16:
            common = _counts(owners, begin[mine][near], before[near], q)
            reach = (common >= need - many) & (part[:q] != part[q]) & (100 * size[:q] >= percent * size[q])
            found = np.flatnonzero(reach)
            if entries[far].sum() <= PROBE * many * len(found):
                common = (common + _counts(owners, begin[mine][far], before[far], q))[found]
            else:
                probes = sets[q][far]
                common = common[found] + np.array([np.isin(probes, sets[r], assume_unique=True).sum() for r in found], np.int64)
            found = found[100 * common >= percent * (size[q] + size[found] - common)]
            if len(found):
                joined = np.unique(part[np.append(found, q)])
                part[np.isin(part, joined)] = joined[0]
            continue
        short, probe = mine[near], sets[q][np.sort(far)]
        lists = [owners[begin[i] : end[i]] for i in short[length[turn[: len(short)]] > 1]]
        refused: set[int] = set()
        linked = True
        while linked:
            linked = False
            lists = [v[(v < q) & (part[v] != part[q])] for v in lists]
            lists = [v for v in lists if len(v)]
            for r, common in merge_skip([v.tolist() for v in lists], need - many):
                if r in refused or 100 * size[r] < percent * size[q]:
                    continue
                place = np.minimum(np.searchsorted(sets[r], probe), size[r] - 1)
                common += int((sets[r][place] == probe).sum())
                if 100 * common >= percent * int(size[q] + size[r] - common):
                    low, high = sorted((int(part[q]), int(part[r])))
                    part[part == high] = low
                    linked = True
                    break
                refused.add(r)
    return part


def _per_text(shingles: Shingles, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for batch, texts in blocks(batches):
        yield batch, shingles.sets(texts)


def _document_sets(rows: DataFrame, shingles: Shingles, seen: sketch.Sketch) -> DataFrame:
    """(doc_id, row, digest, size, shingles): sets of documents that may have partners, once per task for equal sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch, sets in _per_text(shingles, batches):
            digests = [set_digest(s) for s in sets]
            prefixes = [shingles.short(s) for s in sets]
            at = np.append(0, np.cumsum([len(p) for p in prefixes]))
            twice = np.append(0, np.cumsum(seen.repeated(np.concatenate([*prefixes, np.zeros(0, U)])))) if len(sets) else at
            found = (twice[at[1:]] - twice[at[:-1]]).tolist()
            data = []
            for one, digest, number in zip(sets, digests, found, strict=True):
                if len(one) and number >= least_common(len(one)) and digest not in sent:
                    sent.add(digest)
                    data.append(one.tobytes())
                else:
                    data.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array(digests, pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(data, pa.binary()),
                ],
                ["doc_id", "row", "digest", "size", "shingles"],
            )

    return rows.mapInArrow(run, "doc_id bigint, row bigint, digest bigint, size bigint, shingles binary")


def _inverted(sets: DataFrame, shingles: Shingles, seen: sketch.Sketch) -> DataFrame:
    """(shingle, size, digest) for the short-list shingles that may occur twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prefixes = [shingles.short(np.frombuffer(v, U)) for v in batch.column(2).to_pylist()]
            if not prefixes:
                continue
            number = [len(p) for p in prefixes]
            keys = np.concatenate(prefixes)
            use = seen.repeated(keys)
            digests, sizes = (np.repeat(batch.column(i).to_numpy(), number)[use] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys[use].view(np.int64)), pa.array(sizes), pa.array(digests)], ["shingle", "size", "digest"]
            )

    return sets.mapInArrow(run, "shingle bigint, size bigint, digest bigint")


def _lists(rows: DataFrame, percent: int) -> DataFrame:
    """(block, digest, size, number): inverted lists with the same first set are one block of ``number`` parts.

    A copy lacks some shingles of its group, so a group has many lists that differ a little, but few first sets. A list
    is read as it comes, so its length does not matter. A set leaves the blocks that hold fewest of its lists, as long as
    these lists are within what it may miss: chance matches end there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = [np.zeros(0, np.int64)] * 3  # the row before, with the first set of its list, and whether it was sent
        name, sent = 0, False
        for batch in batches:
            shingle, size, digest = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate(last))
            if not len(shingle):
                continue
            new = np.append(True, (np.diff(shingle) != 0) | (np.diff(digest) != 0))  # a set that several tasks have stored
            shingle, size, digest = shingle[new], size[new], digest[new]
            far = (np.diff(shingle) != 0) | (100 * size[:-1] < percent * size[1:])  # no match across a gap in size
            begin = np.flatnonzero(np.append(True, far))
            number = np.diff(np.append(begin, len(shingle)))
            names = digest[begin]
            if len(last[0]):
                names[0] = name
            several = np.repeat(number > 1, number)
            due = several.copy()
            due[0] &= not sent
            sent = bool(several[-1]) or (sent and len(begin) == 1)
            name, last = names[-1], [c[-1:] for c in (shingle, size, digest)]
            block, size, digest = np.repeat(names, number)[due], size[due], digest[due]
            turn = np.lexsort((digest, block))
            block, size, digest = block[turn], size[turn], digest[turn]
            edges = np.flatnonzero(np.append(True, (np.diff(block) != 0) | (np.diff(digest) != 0))[: len(block)])
            lists = np.diff(np.append(edges, len(block)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[edges]), pa.array(digest[edges]), pa.array(size[edges]), pa.array(lists)],
                ["block", "digest", "size", "lists"],
            )

    by_shingle = rows.repartition("shingle").sortWithinPartitions("shingle", "size", "digest")
    found = by_shingle.mapInArrow(run, "block bigint, digest bigint, size bigint, lists bigint")
    found = found.groupBy("block", "digest").agg(F.first("size").alias("size"), F.sum("lists").alias("lists"))
    weakest = Window.partitionBy("digest").orderBy("lists", "block")
    missed = F.sum("lists").over(weakest.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # half of what least_common leaves over: two sets together miss fewer lists than they share
    may_miss = F.expr(f"(greatest(1, size div {EXTRA}) - 1) div 2")
    found = found.withColumn("missed", missed).where(F.col("missed") > may_miss)
    return materialise(found.select("block", "digest", "size"), "inverted-lists")


def _in_parts(members: DataFrame, most: int) -> DataFrame:
    """(block, digest, size, number): blocks of several sets, with the number of parts that they are searched in."""
    blocks_ = members.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total")).where("n > 1")
    number = _parts_of(F.col("total"), F.col("n"), most)
    blocks_ = materialise(blocks_.select("block", number.alias("number")), "block-parts")  # so that a large block is split
    return members.join(blocks_, "block").select("block", "digest", "size", "number")


def _parts_of(total: Column, n: Column, most: int) -> Column:
    """Parts for n sets of so many shingles: about ``most`` shingles in each, but LEAST_SETS sets at least."""
    ratio = F.greatest(F.least(2 * total / F.lit(most), n / F.lit(LEAST_SETS)), F.lit(1.0))
    return F.pow(F.lit(2), F.floor(F.log2(ratio))).cast("long")


def _part(number: Column) -> Column:
    return F.pmod(F.xxhash64("digest"), number)


def _search(rows: DataFrame, sets: DataFrame, percent: int, name: str) -> DataFrame:
    """(a, b): links that connect what a block connects, from rows (block, digest, root).

    Sets of one root are connected already.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digests, roots, found = None, [], [], []

        def links() -> pa.RecordBatch:
            own = np.array(digests, np.int64)
            first = block_links(found, percent, np.array(roots, np.int64))
            joined = np.flatnonzero(first != np.arange(len(first)))
            return pa.RecordBatch.from_arrays([pa.array(own[joined]), pa.array(own[first[joined]])], ["a", "b"])

        for batch in batches:
            for block, digest, root, data in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4)), strict=True):
                if block != now:
                    if found:
                        yield links()
                    now, digests, roots, found = block, [], [], []
                digests.append(digest)
                roots.append(root)
                found.append(np.frombuffer(data, U))
        if found:
            yield links()

    searched = rows.join(sets, "digest").select("block", "size", "digest", "root", "shingles")
    searched = searched.repartition("block").sortWithinPartitions("block", "size", "digest")
    return materialise(searched.mapInArrow(run, "a bigint, b bigint"), name)


def _sub_block(*of: str) -> Column:
    return F.xxhash64("block", "number", *of).alias("block")


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots.withColumnRenamed("node", "digest"), "digest", "left").withColumn("root", F.coalesce("root", "digest"))


def _across_parts(long: DataFrame, sets: DataFrame, roots: DataFrame, percent: int, most: int) -> DataFrame:
    """(node, root) with the links between parts of the blocks ``long`` (block, digest, size, number).

    First one set of the largest component in each part is searched against those of the other parts, in parts again
    where they are many, so that a group of copies is one component, each of its sets having been sent once. Then the
    sets outside a block's largest component are searched against all parts. These searches lose no link.
    """

    def with_links(links: DataFrame) -> DataFrame:
        return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links))

    level = long
    while not level.isEmpty():
        classes = _with_roots(level, roots).groupBy("block", _part(F.col("number")).alias("part"), "root")
        classes = classes.agg(F.sum("size").alias("s"), F.min(F.struct("digest", "size")).alias("one"))
        tops = classes.groupBy("block", "part").agg(F.max_by("one", F.struct("s", "root")).alias("one"))
        tops = materialise(tops.select("block", "one.digest", "one.size"), "part-tops")
        tops = materialise(_in_parts(tops, most), "part-tops-in-parts")
        rows = _with_roots(tops, roots).withColumn("part", _part(F.col("number"))).select(_sub_block("part"), "digest", "root")
        roots = with_links(_search(rows, sets, percent, "top-links"))
        level = tops.where("number > 1")

    rows = materialise(_with_roots(long, roots).select("block", "digest", "size", "number", "root"), "long-roots")
    classes = rows.groupBy("block", "root").agg(F.sum("size").alias("s"), F.count(F.lit(1)).alias("n"))
    hub = classes.groupBy("block").agg(
        F.max_by("root", F.struct("s", "root")).alias("hub"),
        (F.sum("s") - F.max("s")).alias("rest"),
        (F.sum("n") - F.max_by("n", F.struct("s", "root"))).alias("n_rest"),
    )
    others = _parts_of(F.col("rest"), F.col("n_rest"), most)
    hub = materialise(hub.where("n_rest > 0").select("block", "hub", others.alias("others")), "hubs")
    rows = rows.join(hub, "block")
    every = F.sequence(F.lit(0), F.col("others") - 1)
    own, all_of = _part(F.col("others")), F.sequence(F.lit(0), F.col("number") - 1)
    one = rows.select("block", "number", "digest", "root", _part(F.col("number")).alias("j"), F.explode(every).alias("i"))
    two = rows.where("root <> hub").select("block", "number", "digest", "root", F.explode(all_of).alias("j"), own.alias("i"))
    pairs = one.unionByName(two).select(_sub_block("i", "j"), "digest", "root").dropDuplicates(["block", "digest"])
    return with_links(_search(pairs, sets, percent, "rest-links"))


def document_components(docs: DataFrame, words: int = 4, percent: int = 85, most: int = MOST) -> DataFrame:
    """(doc_id, row, size, component): ``component`` is a digest that linked documents share, null without words.

    ``row`` is the hash of all columns of the document.
    """
    ready_for_texts(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_hash(docs).alias("row"), whole_text().alias("text"))
    expected = text_bytes(rows) // BYTES_PER_WORD
    coarse = sketch.log_width_for(expected // 64, 1, 24)
    plain = Shingles(words, percent, None, 0)

    def all_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, texts in blocks(batches):
            yield plain.hashes(texts)[0]

    load = sketch.build(rows.select("text"), all_hashes, "shingle-load", coarse, rows=1, bits=False)
    shingles = Shingles(words, percent, load, expected >> coarse)

    def short_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for _, sets in _per_text(shingles, batches):
            different = {set_digest(s): s for s in sets}
            yield np.concatenate([*[shingles.short(s) for s in different.values()], np.zeros(0, U)])

    width = sketch.log_width_for(expected * (100 - percent + 100 // EXTRA) // 100, ROOM)
    seen = sketch.build(rows.select("text"), short_keys, "short-lists", width)
    found = materialise(_document_sets(rows, shingles, seen), "document-sets")
    some = found.where(F.col("shingles").isNotNull()).select("digest", "size", "shingles")
    members = _in_parts(_lists(_inverted(some, shingles, seen), percent), most)
    unique = some.dropDuplicates(["digest"])
    parted = members.withColumn("part", _part(F.col("number"))).select(_sub_block("part"), "digest", F.col("digest").alias("root"))
    roots = components(_search(parted, unique, percent, "links"))
    long = materialise(members.where("number > 1"), "long-lists")
    if not long.isEmpty():
        long_sets = materialise(unique.join(long.select("digest").distinct(), "digest", "left_semi"), "long-sets")
        roots = _across_parts(long, long_sets, roots, percent, most)
    filled = found.where("size > 0").select("doc_id", "row", "digest", "size")
    joined = filled.join(roots.withColumnRenamed("node", "digest"), "digest", "left")
    none = found.where("size = 0").select("doc_id", "row", "size", F.lit(None).cast("bigint").alias("component"))
    return joined.select("doc_id", "row", "size", F.coalesce("root", "digest").alias("component")).unionByName(none)


def report_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """One row per document: the size of its set and the smallest id that links reach from it."""
    found = materialise(document_components(docs, words, percent), "components")
    least = found.where(F.col("component").isNotNull()).groupBy("component")
    least = least.agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    least = materialise(least, "component-ids")  # so that both sides of the join are plain and a large component is split
    return found.join(least, "component", "left").select(
        "doc_id", F.col("size").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )


def keep_one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents with their columns, of each component the one with the smallest id; texts without words all stay."""
    row = fresh(docs, "row")
    found = document_components(docs, words, percent)
    low = F.lit(-2)
    equal = found.groupBy("component", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    mark = F.col("row").bitwiseAND(low).bitwiseOR(F.when((F.col("n") > 1), 1).otherwise(0))
    equal = materialise(equal.select("component", "doc_id", mark.alias("mark")), "component-rows")
    first = equal.where(F.col("component").isNotNull()).groupBy("component")
    first = first.agg(F.coalesce(F.min_by("mark", "doc_id"), F.min("mark")).alias("mark")).select("mark")
    winners = first.select(F.col("mark").bitwiseAND(low).alias(row), (F.col("mark").bitwiseAND(F.lit(1)) == 1).alias("twins"))
    empty = equal.where(F.col("component").isNull()).select(F.col("mark").bitwiseAND(low).alias(row)).distinct()
    winners = materialise(winners.unionByName(empty.withColumn("twins", F.lit(False))), "winners")
    marked = docs.withColumn(row, row_hash(docs).bitwiseAND(low))
    return keep_rows(marked, winners, [row], docs.columns)
