"""Joins whose keys may be very unevenly spread."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut

#: Rows of the lookup side that are broadcast for the most frequent keys. The bound holds at any size.
HOT_KEYS = 512


def hot_lookup_join(
    facts: DataFrame, lookup: DataFrame, keys: list[str], counts: DataFrame, hot_keys: int = HOT_KEYS
) -> DataFrame:
    """Left join of ``facts`` to ``lookup`` (one row a key) that no hot key can stall.

    ``counts`` has ``keys`` and ``n``, the fact rows of each key. The lookup rows of the ``hot_keys`` most
    frequent keys, at most that many rows, are broadcast, so their facts stay where they are; all other facts
    take a shuffled join. Both ways are exact, and every fact row comes out once. Null keys match nothing.
    """
    extra = [c for c in lookup.columns if c not in keys]
    head = F.broadcast(counts.orderBy(F.desc("n"), *keys).limit(hot_keys).select(*keys))
    hot_rows = F.broadcast(lookup.join(head, keys, "left_semi").limit(hot_keys).withColumn("_hot", F.lit(True)))
    marked = facts.join(head.withColumn("_is_hot", F.lit(True)), keys, "left")
    hot = marked.filter("_is_hot").drop("_is_hot").join(hot_rows, keys, "left").drop("_hot")
    cold = marked.filter("_is_hot IS NULL").drop("_is_hot").join(lookup, keys, "left")
    return hot.select(*facts.columns, *extra).unionByName(cold.select(*facts.columns, *extra))


#: Rows of a table up to which it is broadcast, after it was counted; members of a group that one task pairs at most.
BROADCAST_ROWS, BLOCK_MEMBERS = 200_000, 1024


def counted(small: DataFrame) -> DataFrame:
    """``small``, a table that was cut, for a join: it is counted, and broadcast up to `BROADCAST_ROWS` rows only."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _blocks(rows: DataFrame, group: list[str], most: int) -> DataFrame:
    """(group, blocks) of groups with more than ``most`` rows; there is at most one for each ``most`` rows."""
    counts = rows.groupBy(*group).agg(F.count("*").alias("_n")).filter(F.col("_n") > most)
    return counted(cut(counts.select(*group, F.ceil(F.col("_n") / most).cast("int").alias("_blocks"))))


def group_pairs(rows: DataFrame, group: list[str], item: str, most: int = BLOCK_MEMBERS) -> DataFrame:
    """Pairs of rows of one group whose ``item`` differs, the smaller item first: the group, and ``x_a`` and ``x_b`` of each other column x.

    ``rows`` was cut, and its groups are not null. A group of more than ``most`` rows is split into blocks by its items, and each two blocks meet in a
    cell of their own, so no task has a whole group. Each pair of rows comes out once.
    """
    rest = [c for c in rows.columns if c not in group]
    blocks = F.coalesce("_blocks", F.lit(1))
    split = rows.join(_blocks(rows, group, most), group, "left").select(*group, *rest, blocks.alias("_blocks"), F.pmod(F.xxhash64(item), blocks).cast("int").alias("_own"))
    cells = split.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cells = cells.select(*group, F.least("_own", "_other").alias("_low"), F.greatest("_own", "_other").alias("_high"), "_own", *rest)
    a, b = (cells.select(*group, "_low", "_high", *[F.col(c).alias(f"{c}_{s}") for c in ("_own", *rest)]) for s in "ab")
    met = a.join(b, [*group, "_low", "_high"]).filter(F.col(f"{item}_a") < F.col(f"{item}_b"))
    met = met.filter((F.col("_low") == F.col("_high")) | (F.col("_own_a") != F.col("_own_b")))
    return met.select(*group, *[f"{c}_{s}" for s in "ab" for c in rest])


def member_pairs(pairs: DataFrame, members: DataFrame, group: str, key: str, most: int = BLOCK_MEMBERS) -> DataFrame:
    """``pairs`` of groups (``group_a``, ``group_b`` and others) with ``key_a`` and ``key_b``, for every member of the one and of the other.

    ``pairs`` and ``members`` (group, key) were cut. Members of a group beyond ``most`` are split into blocks, and each two blocks
    meet in a cell of their own, so a task makes ``most`` times ``most`` rows for two groups of any size.
    """
    big = _blocks(members, [group], most)
    blocks = lambda c: F.coalesce(c, F.lit(1))
    own = members.join(big, group, "left").select(group, key, F.pmod(F.xxhash64(key), blocks("_blocks")).cast("int").alias("_block"))
    cells, rest = pairs, list(pairs.columns)
    for s in "ab":
        cells = cells.join(big.select(F.col(group).alias(f"{group}_{s}"), F.col("_blocks").alias(f"_blocks_{s}")), f"{group}_{s}", "left")
    for s in "ab":
        cells = cells.withColumn(f"_block_{s}", F.explode(F.sequence(F.lit(0), blocks(f"_blocks_{s}") - 1)))
    cells = cells.select(*rest, "_block_a", "_block_b")
    a, b = (own.select(F.col(group).alias(f"{group}_{s}"), F.col("_block").alias(f"_block_{s}"), F.col(key).alias(f"{key}_{s}")) for s in "ab")
    cell = [f"{group}_a", f"{group}_b", "_block_a", "_block_b"]
    left = cells.join(a, [f"{group}_a", "_block_a"])
    right = cells.select(*cell).distinct().join(b, [f"{group}_b", "_block_b"]).select(*cell, f"{key}_b")
    return left.join(right, cell).select(*rest, f"{key}_a", f"{key}_b")
