"""One ranking from differently scaled scores: the first principal component of rank-transformed scores.

Within its group each score becomes its mean rank as a share, so neither range nor distribution of a scorer
matters; groups of any size are ranked in parts. The correlation matrix of the scorers is made from sums that the
tasks keep over items that both scorers rated. The loadings of its first component, their signs set to the declared
directions, weigh the standardised shares; an item's projection orders it. An item that a scorer didn't rate lies below
all that it did rate.

Defined results: null, NaN and infinite scores, and null groups, items and scorers are no ratings. Of several ratings
of an item by a scorer the best counts. Items that are given apart from the ratings and have none come last, with no scorers. Equal scores get equal shares; equal projections are ordered by item.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranking import value_ranks
from ..plans.skew import hot_lookup_join
from ..sources.tables import table

#: The retrievers of a knowledge base, and the direction in which each one's score is better.
DIRECTIONS = {"lexical.chunk": 1, "lexical.entity": 1, "vector.chunk": 1, "graph.one-hop": 1}


def rank_shares(ratings: DataFrame, directions: dict[str, int]) -> DataFrame:
    """(grp, item, scorer, share): shares in (0, 1) that grow with how good the score is; spellings of scorers joined.

    ``ratings`` has grp, item, scorer and score.
    """
    scorer = F.lower(F.trim(F.regexp_replace("scorer", r"\s+", " ")))
    sign = F.element_at(F.create_map(*[F.lit(x) for pair in directions.items() for x in pair]), F.col("scorer"))
    rows = ratings.select("grp", "item", scorer.alias("scorer"), "score").filter(F.col("scorer").isin(list(directions)))
    rows = rows.filter("grp IS NOT NULL AND item IS NOT NULL AND score IS NOT NULL AND NOT isnan(score) AND abs(score) < double('infinity')")
    best = cut(rows.groupBy("grp", "item", "scorer").agg(F.max(F.col("score") * sign).alias("score")))
    keys = ["grp", "scorer", "score"]
    ranks = cut(value_ranks(best, ["grp", "scorer"], "score"))
    shares = ranks.select(*keys, ((F.col("below") + (F.col("n") / 2)) / F.col("total")).alias("share"))
    return hot_lookup_join(best, shares, keys, ranks.select(*keys, "n")).select("grp", "item", "scorer", "share")


def component(wide: DataFrame, scorers: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loadings of the first component of the correlation matrix, and each scorer's mean and deviation of shares.

    ``wide`` has a column c0, c1, ... a scorer, null where it rated nothing, its shares turned to the declared direction.
    Correlations are over items that both rated. The component is turned as a whole, to the side on which most of it agrees
    with the directions; a loading that is still negative contradicts its own and counts as 0, and `p2_loadings` reports
    it. A scorer whose shares don't vary with any other's gets the mean of the others; with no correlation at all,
    all weigh the same.
    """
    n = len(scorers)
    pairs = [(i, j) for i in range(n) for j in range(i + 1, n)]
    each = [f(f"c{i}").alias(f"{name}{i}") for i in range(n) for name, f in (("m", F.avg), ("s", F.stddev_pop))]
    sums = wide.agg(F.count("*"), *each, *[F.corr(f"c{i}", f"c{j}").alias(f"r{i}_{j}") for i, j in pairs]).first()  # one row
    value = lambda name, other: other if sums[name] is None or not np.isfinite(sums[name]) else sums[name]
    matrix = np.eye(n)
    for i, j in pairs:
        matrix[i, j] = matrix[j, i] = value(f"r{i}_{j}", 0.0)
    mean, deviation = (np.array([value(f"{name}{i}", other) for i in range(n)], float) for name, other in (("m", 0.5), ("s", 1.0)))
    deviation[deviation < 1e-9] = 1.0
    if not n or np.allclose(matrix, np.eye(n)):
        return np.ones(n), mean, deviation
    first = np.linalg.eigh(matrix)[1][:, -1]
    first = first if first.sum() >= 0 else -first
    lonely = (np.abs(matrix - np.eye(n)) < 1e-9).all(axis=1)
    first[lonely] = np.abs(first[~lonely]).mean()
    return first, mean, deviation


def one_ranking(ratings: DataFrame, directions: dict[str, int], listed: DataFrame | None = None) -> DataFrame:
    """(grp, item, rank, projection, n_scorers) of every rated item, best first within its group.

    ``listed`` (grp, item) has items that are ranked even if no scorer rated them.
    """
    scorers = list(directions)
    wide = _wide(ratings, directions)
    first, mean, deviation = component(wide, scorers)
    weights = np.maximum(first, 0)
    weights = weights / weights.sum() if weights.sum() > 0 else np.ones(len(scorers))
    if listed is not None:
        unrated = listed.select("grp", "item").filter("grp IS NOT NULL AND item IS NOT NULL").distinct().join(wide.select("grp", "item"), ["grp", "item"], "left_anti")
        wide = wide.unionByName(unrated, allowMissingColumns=True)
    columns = [F.col(f"c{i}") for i in range(len(scorers))]
    standard = [(F.coalesce(c, F.lit(0.0)) - float(m)) / float(s) for c, m, s in zip(columns, mean, deviation)]
    projection = sum((z * float(w) for z, w in zip(standard, weights)), F.lit(0.0))
    rated = sum((c.isNotNull().cast("int") for c in columns), F.lit(0))
    items = wide.select("grp", "item", F.round(projection, 12).alias("projection"), rated.alias("n_scorers"))
    # Items by falling projection, equal ones by name.
    order = F.struct((-F.col("projection")).alias("p"), "item")
    keyed = cut(items.withColumn("place", order))
    ranks = value_ranks(keyed, ["grp"], "place").select("grp", "place", (F.col("below") + 1).alias("rank"))
    return keyed.join(ranks, ["grp", "place"]).select("grp", "item", "rank", "projection", "n_scorers")


def _wide(ratings: DataFrame, directions: dict[str, int]) -> DataFrame:
    """(grp, item, c0, c1, ...): the shares of each item, a column a scorer."""
    shares = rank_shares(ratings, directions)
    return cut(shares.groupBy("grp", "item").agg(*[F.max(F.when(F.col("scorer") == s, F.col("share"))).alias(f"c{i}") for i, s in enumerate(directions)]))


def _ratings(spark: SparkSession, d: str) -> DataFrame:
    packets = table(spark, d, "evidence_packets")
    return packets.select(F.col("query_id").alias("grp"), F.col("entity_path").alias("item"), F.col("retriever").alias("scorer"), "score")


def p2_ranking(spark: SparkSession, d: str) -> DataFrame:
    """The entities of each query in one ranking, those of its packets without a usable score last."""
    ratings = _ratings(spark, d)
    return one_ranking(ratings, DIRECTIONS, ratings).select(F.col("grp").alias("query_id"), F.col("item").alias("entity_path"), "rank", "projection", "n_scorers")


def p2_quality(spark: SparkSession, d: str) -> DataFrame:
    """Recall at 5 and mean reciprocal rank of the ranking over the evaluation cases."""
    cases = table(spark, d, "eval_cases").groupBy("query_id").agg(F.first("expected_json").alias("expected_json"))
    expected = cases.select("query_id", F.explode(F.array_distinct(F.from_json("expected_json", "array<string>"))).alias("entity_path"))
    hits = expected.join(p2_ranking(spark, d), ["query_id", "entity_path"], "left")
    each = hits.groupBy("query_id").agg(F.avg((F.coalesce("rank", F.lit(1 << 30)) <= 5).cast("double")).alias("recall"), F.coalesce(1 / F.min("rank"), F.lit(0.0)).alias("reciprocal"))
    return each.agg(F.count("*").alias("n_cases"), F.round(F.avg("recall"), 6).alias("recall_at_5"), F.round(F.avg("reciprocal"), 6).alias("mrr"))


def p2_loadings(spark: SparkSession, d: str) -> DataFrame:
    """The loading of each retriever on the first component, and whether its sign is that of the declared direction."""
    first, mean, deviation = component(_wide(_ratings(spark, d), DIRECTIONS), list(DIRECTIONS))
    rows = [(s, x, float(v), bool(v >= 0), float(m), float(w)) for (s, x), v, m, w in zip(DIRECTIONS.items(), first, mean, deviation)]
    return spark.createDataFrame(rows, "scorer string, direction int, loading double, sign_matches boolean, mean_share double, deviation double")
