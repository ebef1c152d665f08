"""Mixing sources to target weights by pivotal dependent rounding.

Every record of a source gets the same expected number of copies, target tokens over tokens there are, at most
``max_repeats``. The whole part is given; the rest, a probability, is rounded in pairs: mass (probability times
tokens) moves at random from one record to the other until one of them is 0 or 1, which keeps the source's tokens and
every record's expectation. Within a group of records of a source, large ones are paired first: a large one that is
left over takes up smaller ones until it is settled, so that what stays fractional in the end is small. The one
fractional record that each group leaves goes on to the next level of a tree, until one is left per source, which a coin
decides. So a source misses its target by less than that record's tokens unless its cap stops it.

Random numbers come from hashes of record keys and the seed: a task that runs again decides the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.skew import hot_lookup_join
from ..sources.tables import table
from .encoding import VOCABULARY, count_tokens

#: Records of a group on the first level, and residuals of a group on each further one.
GROUP = 20_000
#: Share of a target by which the selected tokens may miss it and count as having reached it.
TOLERANCE = 0.01
SCHEMA = "key bigint, source string, n_tokens bigint, whole int, p double, node bigint"


def _uniform(keys: np.ndarray, seed: int, level: int) -> np.ndarray:
    """Numbers in [0, 1) from keys."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.int64).view(np.uint64) + np.uint64((seed * 1_000_003 + level) * 0x9E3779B97F4A7C15 % (1 << 64))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    return (x >> np.uint64(11)).astype(np.float64) / (1 << 53)


def pivot(keys: np.ndarray, size: np.ndarray, p: np.ndarray, seed: int) -> np.ndarray:
    """Rounds ``p`` in pairs from the largest record to the smallest, keeping the sum of size * p; at most one value stays fractional."""
    p, eps = p.astype(np.float64).copy(), 1e-12
    live = np.flatnonzero((p > eps) & (p < 1 - eps))
    live = live[np.lexsort((keys[live], _uniform(keys[live], seed, 0), -size[live]))]
    sizes, shares, chance = size[live].tolist(), p[live].tolist(), _uniform(keys[live], seed, 1).tolist()
    held = None  # the one before that is fractional still
    for i, (w, x, u) in enumerate(zip(sizes, shares, chance)):
        if held is None:
            held = i
            continue
        v, y = sizes[held], shares[held]
        up, down = min((1 - y) * v, x * w), min(y * v, (1 - x) * w)
        gain = up if u * (up + down) < down else -down
        y, x = y + gain / v, x - gain / w
        settled = min(y, 1 - y) <= min(x, 1 - x)  # the held one, or this one
        if settled:
            y = float(round(y))
        else:
            x = float(round(x))
        shares[held], shares[i] = y, x
        open_ = i if settled else held
        held = open_ if eps < shares[open_] < 1 - eps else None
        if held is None:
            shares[open_] = float(round(shares[open_]))
    p[live] = shares
    return p


def _round_group(seed: int, last: bool):
    def rounded(pdf: pd.DataFrame) -> pd.DataFrame:
        keys = pdf["key"].to_numpy()
        p = pivot(keys, pdf["n_tokens"].to_numpy(np.float64), pdf["p"].to_numpy(), seed)
        if last:
            p = np.where((p > 0) & (p < 1), _uniform(keys, seed, 99) < p, p)
        return pdf.assign(p=p)

    return rounded


def source_plan(sized: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """One row a target: tokens there are, tokens wanted, copies a record may expect.

    ``total_tokens`` is the size of the mix; unset, the tokens of all records that have a target. Repeated rows of a
    target count once; of different ones for a source the greatest weight holds; null or negative weights and
    repeats are 0. Weights are used in proportion to their sum.
    """
    there = sized.filter("n_tokens > 0").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"), F.count("*").alias("n_records"))
    wanted = (
        targets.filter("source IS NOT NULL")
        .groupBy("source")
        .agg(F.max(F.struct(F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0)), F.greatest(F.coalesce("max_repeats", F.lit(0)), F.lit(0)))).alias("t"))
        .select("source", F.col("t.col1").alias("weight"), F.col("t.col2").alias("max_repeats"))
    )
    joined = cut(wanted.join(there, "source", "left").na.fill(0, ["available_tokens", "n_records"]))
    weights, tokens = joined.agg(F.sum("weight"), F.sum("available_tokens")).first()
    share = F.coalesce(F.try_divide(F.col("weight"), F.lit(weights or 0.0)), F.lit(0.0))
    total = float((tokens or 0) if total_tokens is None else total_tokens)
    return joined.select(
        "source", "weight", "max_repeats", "available_tokens", "n_records", share.alias("target_share"), (share * total).alias("target_tokens")
    ).withColumn("expected_copies", F.least(F.coalesce(F.try_divide(F.col("target_tokens"), F.col("available_tokens")), F.lit(0.0)), F.col("max_repeats").cast("double")))


def select_mix(sized: DataFrame, plan: DataFrame, seed: int = 7, group: int = GROUP) -> DataFrame:
    """(key, source, n_tokens, copies) of every record that is used at least once.

    ``sized`` has key, source and n_tokens. Records without tokens, without a source, or of a source without a target
    are not used. Repeated keys are records of their own.
    """
    levels, width = 1, plan.agg(F.max("n_records")).first()[0] or 0
    while width > group:
        levels, width = levels + 1, -(-width // group)
    counts = plan.select("source", F.col("n_records").alias("n"))
    rows = hot_lookup_join(sized.filter("n_tokens > 0 AND source IS NOT NULL"), plan.select("source", "expected_copies", "n_records"), ["source"], counts)
    copies = F.col("expected_copies")
    rows = rows.filter("expected_copies > 0").select(
        "key", "source", "n_tokens", F.floor(copies).cast("int").alias("whole"), (copies - F.floor(copies)).alias("p"),
        F.pmod(F.xxhash64("key", F.lit(seed)), F.greatest(F.ceil(F.col("n_records") / group), F.lit(1))).alias("node"),
    )
    done = None
    for level in range(levels):
        last = level == levels - 1
        rounded = cut(rows.groupBy("source", "node").applyInPandas(_round_group(seed + level, last), SCHEMA))
        whole = rounded.filter("p = 0 OR p = 1")
        done = whole if done is None else done.unionByName(whole)
        rows = rounded.filter("p > 0 AND p < 1").withColumn("node", F.floor(F.col("node") / group))
    return done.select("key", "source", "n_tokens", (F.col("whole") + F.col("p").cast("int")).alias("copies")).filter("copies > 0")


def mix_report(selection: DataFrame, plan: DataFrame) -> DataFrame:
    """Target and actual shares of every source. ``reached``: the tokens that were selected are within `TOLERANCE` of the target.

    It is false where the cap stopped a source, where nothing is there, and where its records are too long to come that near.
    """
    used = selection.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"), F.sum("copies").alias("n_copies"), F.max("copies").alias("most_copies")
    )
    joined = plan.join(used, "source", "left").na.fill(0, ["actual_tokens", "n_copies", "most_copies"])
    total = float(used.agg(F.sum("actual_tokens")).first()[0] or 0)
    return joined.select(
        "source", "target_share", F.col("target_tokens").cast("bigint").alias("target_tokens"), "available_tokens", "max_repeats", "actual_tokens",
        F.coalesce(F.try_divide("actual_tokens", F.lit(total)), F.lit(0.0)).alias("actual_share"), "n_copies", "most_copies",
        ((F.col("actual_tokens") > 0) & (F.abs(F.col("actual_tokens") - F.col("target_tokens")) <= TOLERANCE * F.col("target_tokens"))).alias("reached"),
    )


def sized_documents(spark: SparkSession, d: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, source, n_tokens) of all documents, counted once and kept in the shared folder."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source", "text")
    return cut(count_tokens(docs, ["key", "source"], "text", vocabulary))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    sized = sized_documents(spark, d)
    plan = source_plan(sized, table(spark, d, "mix_targets"))
    return select_mix(sized, plan), plan


def p9_selection(spark: SparkSession, d: str) -> DataFrame:
    """How many times each document is used."""
    return _mix(spark, d)[0].withColumnRenamed("key", "doc_id")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share that each source was to have, and has."""
    return mix_report(*_mix(spark, d))
