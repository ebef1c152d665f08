"""Ranks within groups of any size, without a window over a whole group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut


def value_ranks(df: DataFrame, groups: list[str], value: str, weight: str | None = None) -> DataFrame:
    """One row for each group and distinct value: n (its weight), below (the weight of smaller values in the group).

    Rows are counted by value before anything moves. The values are then sorted by range over all tasks; of a
    group that spans several tasks each knows its own part, and the parts' totals, one row a task and
    group, are added up. A group of any size is so spread over many tasks. NaN is the largest value; nulls are left out.
    """
    n = F.sum(weight) if weight else F.count("*")
    cells = df.filter(F.col(value).isNotNull()).groupBy(*groups, value).agg(n.alias("n"))
    parts = cut(cells.repartitionByRange(*groups, value).withColumn("_part", F.spark_partition_id()))
    totals = parts.groupBy("_part", *groups).agg(F.sum("n").alias("_n"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*groups)
    totals = totals.select("_part", *groups, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("total"))
    own = Window.partitionBy("_part", *groups).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranked = parts.withColumn("_own", F.coalesce(F.sum("n").over(own), F.lit(0)))
    same = [ranked["_part"] == totals["_part"], *[ranked[g].eqNullSafe(totals[g]) for g in groups]]
    return ranked.join(totals, same).select(*[ranked[g] for g in groups], ranked[value], "n", (F.col("_before") + F.col("_own")).alias("below"), "total")
