"""Long exact spans shared between records, from compact windows.

Tokens are the overlapping grams of a text's UTF-8 bytes, each with a hash. A window of that many tokens as a span of
the least length must hold has one smallest hash; all windows that share it form a compact window (left, centre,
right). Compact windows are the upper part of the Cartesian tree over the hashes: those nodes whose subtree is at least
a window wide. Nodes that wide are exactly the minima of some window, so sliding minima find them first and the tree
is built over them alone. Two texts with a common span have a compact window in common: the same hash at the
centre, enough room on both sides of the two centres, and, as a span reaches farther than one gram, the same bytes
either before or behind it. That interval join gives candidate pairs; each is then verified on the texts themselves,
which also yields the spans.

Copies of a text are one class: fingerprints carry the hash of the text, so that copies collapse before the join, and
pairs are made between classes. Pairs of records follow from the members of both classes. Hashes of many classes and classes of
many records are paired in cells of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut, semi_join
from ..plans.skew import group_pairs, hot_lookup_join, member_pairs
from ..sources.tables import table
from .arrow import text_bytes

#: Least length of a span in code points, and bytes of a gram.
SPAN, GRAM = 120, 56
#: Bytes worked on at a time.
BLOCK = 1 << 19
#: Fixed base of the rolling hashes (odd).
BASE = 0x9E3779B97F4A7C15 | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(letters: np.ndarray, n: int) -> np.ndarray:
    """A hash of letters[i : i + n] for each i that has n letters left."""
    done, length, power, width = None, 0, letters, 1
    while True:
        if n & width:
            if done is None:
                done, length = power, width
            else:
                end = len(letters) - length - width + 1
                if end <= 0:
                    return np.zeros(0, np.uint64)
                done = done[:end] * np.uint64(pow(BASE, width, 1 << 64)) + power[length : length + end]
                length += width
        if length == n:
            return _mix(done)
        end = len(letters) - 2 * width + 1
        if end <= 0:
            return np.zeros(0, np.uint64)
        power = power[:end] * np.uint64(pow(BASE, width, 1 << 64)) + power[width : width + end]
        width *= 2


def sliding(a: np.ndarray, n: int, best) -> np.ndarray:
    """``best`` (minimum or maximum) of a[i : i + n] for each i that has n values left."""
    width = 1
    while 2 * width <= n:
        a = best(a[:-width], a[width:])
        width *= 2
    rest = n - width
    return best(a[: len(a) - rest], a[rest:]) if rest else a


def tree_extents(h: list, first: int, last: int, at: list) -> tuple[list, list]:
    """The range of each node of the Cartesian tree over hashes ``h`` at positions ``at``, within first..last.

    A node's subtree reaches from behind the nearest smaller hash on its left to before the nearest one on its
    right. Of equal hashes the left one is the smaller.
    """
    left, right, stack = [0] * len(h), [0] * len(h), []
    for i, x in enumerate(h):
        while stack and h[stack[-1]] > x:
            right[stack.pop()] = at[i] - 1
        left[i] = at[stack[-1]] + 1 if stack else first
        stack.append(i)
    for i in stack:
        right[i] = last
    return left, right


def compact_windows(data: np.ndarray, bounds: np.ndarray, span: int = SPAN, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text, hash, rooms, before, behind) of the compact windows of texts end to end.

    rooms: 256 times the tokens on the left, at most a window's width less one, and the same on the right. before and
    behind: hashes of the bytes that are next to the gram, as many as a span must reach into on one of the sides.
    """
    window, side = span - gram + 1, (span - gram) // 2
    if not 1 <= side or window > 255:
        raise ValueError("a gram has to be shorter than a span by 2 to 254")
    letters = LETTERS[data]
    h = gram_hashes(letters, gram)
    smallest = sliding(h, window, np.minimum) if len(h) >= window else np.zeros(0, np.uint64)
    lengths = np.diff(bounds)
    usable = np.flatnonzero(lengths >= span)
    if not len(smallest) or not len(usable):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.int32, np.int32, np.int32))
    # Windows that cross the border of a text count as nothing.
    within = np.zeros(len(data) + 1, np.int32)
    np.add.at(within, bounds[usable], 1)
    np.add.at(within, bounds[usable] + lengths[usable] - span + 1, -1)
    inside = np.cumsum(within[: len(smallest)]) > 0
    smallest = np.where(inside, smallest, np.uint64(0))
    padded = np.concatenate([np.zeros(window - 1, np.uint64), smallest, np.zeros(window - 1, np.uint64)])
    highest = sliding(padded, window, np.maximum)  # over the windows that hold token i
    node = np.flatnonzero((highest == h[: len(highest)]) & (highest > 0))
    text = np.searchsorted(bounds, node, side="right") - 1
    cuts = np.flatnonzero(np.diff(text)) + 1
    lefts, rights = [], []
    hashes, places = h[node].tolist(), node.tolist()
    for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(node)]):
        if i < j:
            t = text[i]
            low, high = tree_extents(hashes[i:j], int(bounds[t]), int(bounds[t + 1]) - gram, places[i:j])
            lefts += low
            rights += high
    room = lambda x: np.minimum(x, window - 1).astype(np.int32)
    rooms = room(node - np.array(lefts, np.int64)) * 256 + room(np.array(rights, np.int64) - node)
    beside = (gram_hashes(letters, side) >> np.uint64(33)).astype(np.int32)
    contexts = []
    for at in (node - side, node + gram):  # beyond the ends of a text there is nothing, -1
        within = (at >= bounds[text]) & (at + side <= bounds[text + 1])
        contexts.append(np.where(within, beside[np.where(within, at, 0)], -1).astype(np.int32))
    return text, h[node], rooms, *contexts


LETTERS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


_COLUMNS = ["c1", "c2", "hash", "rooms", "before", "behind"]


def _fingerprints(batches: Iterator[pa.RecordBatch], span: int, gram: int) -> Iterator[pa.RecordBatch]:
    seen: set[tuple] = set()
    for batch in batches:
        # Copies that a task meets again add nothing; which of them it remembers bounds its memory only.
        if len(seen) > 500_000:
            seen.clear()
        fresh = []
        for k, c in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
            if c not in seen:
                seen.add(c)
                fresh.append(k)
        batch = batch.take(pa.array(fresh, pa.int64()))
        data, bounds = text_bytes(batch.column(2))
        i = 0
        while i < len(bounds) - 1:
            j = max(int(np.searchsorted(bounds, bounds[i] + BLOCK, side="right")) - 1, i + 1)
            text, h, *rest = compact_windows(data[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], span, gram)
            rows = pa.array(text + i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(h.view(np.int64)), *map(pa.array, rest)], names=_COLUMNS)
            i = j


def fingerprints(classes: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """The compact windows of texts given as (c1, c2, text), by hash; (c1, c2) is the class of a text."""
    out = classes.mapInArrow(partial(_fingerprints, span=span, gram=gram), "c1 bigint, c2 bigint, hash bigint, rooms int, before int, behind int")
    return out.repartition("hash")


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def common_ranges(a: np.ndarray, b: np.ndarray, span: int = SPAN) -> tuple[list, list]:
    """The maximal ranges (start, end) of ``a`` and of ``b`` that are covered by common spans, by code points."""
    letters = lambda x: _mix(x.astype(np.uint64) + np.uint64(1))
    ha, hb = gram_hashes(letters(a), span), gram_hashes(letters(b), span)
    common, ia, ib = np.intersect1d(ha, hb, return_indices=True)
    keep = [bool((a[i : i + span] == b[j : j + span]).all()) for i, j in zip(ia.tolist(), ib.tolist())]
    common = common[np.array(keep, bool)] if len(common) else common
    found = []
    for h in (ha, hb):
        at = np.flatnonzero(np.isin(h, common))
        if not len(at):
            return [], []
        new = np.flatnonzero(np.diff(at) > span) + 1
        found.append([(int(x[0]), int(x[-1]) + span) for x in np.split(at, new)])
    return found[0], found[1]


def _verify(batches: Iterator[pa.RecordBatch], span: int) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        keep, left, right = [], [], []
        for k, (x, y) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            ra, rb = common_ranges(_points(x), _points(y), span)
            if ra:
                keep.append(k)
                left.append([{"start": s, "end": e} for s, e in ra])
                right.append([{"start": s, "end": e} for s, e in rb])
        rows = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(rows), batch.column(1).take(rows), pa.array(left, kind), pa.array(right, kind)], names=["class_a", "class_b", "ranges_a", "ranges_b"]
        )


def text_class(text) -> tuple:
    """The class of a text: 128 bits of hashes, as two columns."""
    return F.xxhash64(text).alias("c1"), F.xxhash64(F.lit(1), text).alias("c2")


def with_class(docs: DataFrame, key: str, text: str, span: int = SPAN) -> DataFrame:
    """(key, class, text) of texts that can hold a span."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.length("text") >= span)
    return rows.select("key", F.struct(*text_class(F.col("text"))).alias("class"), "text")


def shared_classes(classed: DataFrame, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(class_a, class_b, ranges_a, ranges_b): pairs of different texts with a common span, class_a < class_b."""
    prints = fingerprints(classed.select("class.c1", "class.c2", "text"), span, gram)
    # All columns are asked for, and an inner join with distinct hashes is no semi join that would be pushed below the
    # repartitioning, so that both readers of the fingerprints share one exchange.
    ends = [f(c).alias(f"{c}_{n}") for c in ("c1", "c2") for n, f in (("low", F.min), ("high", F.max))]
    repeated = prints.groupBy("hash").agg(*ends, F.coalesce(F.max("rooms"), F.max("before"), F.max("behind")).alias("x"))
    repeated = repeated.filter("(c1_low < c1_high OR c2_low < c2_high) AND x IS NOT NULL").select("hash")
    rows = prints.join(repeated, "hash").select("hash", F.struct("c1", "c2").alias("class"), "rooms", "before", "behind")
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(c).alias("beside")) for i, c in enumerate(("before", "behind"))])
    rows = cut(rows.withColumn("s", F.explode(sides)).filter("s.beside <> -1").select("hash", "s.side", "s.beside", "class", "rooms").distinct())
    met = group_pairs(rows, ["hash", "side", "beside"], "class")
    room = lambda s: (F.floor(F.col(f"rooms_{s}") / 256), F.col(f"rooms_{s}") % 256)
    (la, ra), (lb, rb) = room("a"), room("b")
    pairs = cut(met.filter(F.least(la, lb) + F.least(ra, rb) + 1 >= span - gram + 1).select("class_a", "class_b").distinct())
    needed = cut(pairs.select(F.col("class_a").alias("class")).union(pairs.select(F.col("class_b"))).distinct())
    texts = cut(semi_join(classed.select("class", "text"), needed, "class").groupBy("class").agg(F.first("text").alias("text")))
    joined = pairs.join(texts.select(F.col("class").alias("class_a"), F.col("text").alias("text_a")), "class_a").join(
        texts.select(F.col("class").alias("class_b"), F.col("text").alias("text_b")), "class_b"
    )
    kind, pair = "array<struct<start: int, end: int>>", "struct<c1: bigint, c2: bigint>"
    return joined.select("class_a", "class_b", "text_a", "text_b").mapInArrow(partial(_verify, span=span), f"class_a {pair}, class_b {pair}, ranges_a {kind}, ranges_b {kind}")


def shared_pairs(docs: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key_a, key_b), key_a < key_b: two records with a common verbatim span of ``span`` code points or more.

    Null texts and those shorter than ``span`` share nothing. Rows of one key are one record.
    """
    classed = with_class(docs, key, text, span)
    members = cut(classed.select("class", "key").filter("key IS NOT NULL").distinct())
    different = shared_classes(classed, span, gram).select("class_a", "class_b")
    same = members.groupBy("class").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("class").alias("class_a"), F.col("class").alias("class_b"))
    both = member_pairs(cut(different.union(same)), members, "class", "key")
    # Of a class with itself each pair of records comes both ways.
    both = both.filter((F.col("class_a") != F.col("class_b")) | (F.col("key_a") < F.col("key_b"))).filter("key_a <> key_b")
    return both.select(F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def shared_report(docs: DataFrame, key: str, text: str, span: int = SPAN, gram: int = GRAM) -> DataFrame:
    """(key, n_chars, ranges, shared_chars, shared_ratio) of every record; ranges are those found elsewhere.

    A text that another record has as a whole is shared in full. Null and short texts have no ranges and ratio 0.
    """
    classed = with_class(docs, key, text, span)
    pairs = cut(shared_classes(classed, span, gram))
    sides = pairs.select(F.col("class_a").alias("class"), F.explode("ranges_a").alias("r")).union(pairs.select("class_b", F.explode("ranges_b")))
    copied = classed.groupBy("class").agg(F.min("key").alias("x"), F.max("key").alias("y"), F.max(F.length("text")).alias("n")).filter("x < y")
    sides = sides.union(copied.select("class", F.struct(F.lit(0).alias("start"), F.col("n").alias("end"))))
    # Distinct ranges of a text in order of their starts; one that begins behind all ends so far opens a new part.
    in_order = Window.partitionBy("class").orderBy("start", "end")
    ranges = sides.select("class", "r.start", "r.end").distinct()
    ranges = ranges.withColumn("far", F.max("end").over(in_order.rowsBetween(Window.unboundedPreceding, -1)))
    ranges = ranges.withColumn("part", F.sum((F.col("far").isNull() | (F.col("far") < F.col("start"))).cast("int")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    parts = ranges.groupBy("class", "part").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    merged = parts.groupBy("class").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))  # apart, so at most one for each span of the text
    every = docs.select(F.col(key).alias("key"), F.coalesce(F.length(text), F.lit(0)).alias("n_chars"), F.struct(*text_class(F.col(text))).alias("class"))
    chars = F.coalesce(F.expr("aggregate(ranges, 0, (acc, r) -> acc + r.end - r.start)"), F.lit(0))
    counts = every.groupBy("class").agg(F.count("*").alias("n"))
    return hot_lookup_join(every, merged, ["class"], counts).select(
        "key", "n_chars", F.coalesce("ranges", F.expr("cast(array() as array<struct<start: int, end: int>>)")).alias("ranges"),
        chars.alias("shared_chars"), F.coalesce(F.try_divide(chars, F.col("n_chars")), F.lit(0.0)).alias("shared_ratio"),
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents with a common span."""
    pairs = shared_pairs(table(spark, d, "documents"), "doc_id", "text")
    return pairs.select(F.col("key_a").alias("doc_id_a"), F.col("key_b").alias("doc_id_b"))


def p10_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shared spans of each document and their share of its text."""
    return shared_report(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")
