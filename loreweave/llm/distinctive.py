"""How distinctive a term is of a record, by hypergeometric enrichment.

With N term occurrences in the collection, K of them of the term, and n in the record, the number k of the term in
the record has, if terms fell at random, a hypergeometric distribution. The upper tail P(X >= k) is exact: the
first summand from log-gamma sums, the further ones from the ratio of neighbours. It is computed once for each different
(k, n, K) in vectorised functions. The negative decimal logarithm of the Benjamini-Hochberg adjusted probability over all
(record, term) pairs of a kind is the score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.lineage import cut
from ..plans.ranking import value_ranks
from ..plans.skew import hot_lookup_join
from ..sources.tables import table

#: Records that may hold a rare term.
RARE = 3


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln(gamma(x)) for x > 0, by Stirling's series after shifting small arguments up."""
    x = np.asarray(x, np.float64)
    product, y = np.ones_like(x), x.copy()
    for _ in range(10):
        small = y < 10
        product = np.where(small, product * y, product)
        y = np.where(small, y + 1, y)
    z = 1 / (y * y)
    series = (1 / 12 - z * (1 / 360 - z * (1 / 1260 - z * (1 / 1680 - z / 1188)))) / y
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - np.log(product)


def log_tail(k: np.ndarray, n: np.ndarray, big_k: np.ndarray, big_n: np.ndarray) -> np.ndarray:
    """ln P(X >= k) for a hypergeometric X: n draws from N things of which K count."""
    k, n, big_k, big_n = (np.asarray(a, np.float64) for a in (k, n, big_k, big_n))
    lowest = np.maximum(0, n + big_k - big_n)
    k = np.maximum(k, lowest)
    most = np.minimum(n, big_k)
    choose = lambda a, b: log_gamma(a + 1) - log_gamma(b + 1) - log_gamma(a - b + 1)
    first = choose(big_k, k) + choose(big_n - big_k, n - k) - choose(big_n, n)
    total, term, i = np.ones_like(first), np.ones_like(first), k.copy()
    live = i < most
    while live.any():
        ratio = np.where(live, (big_k - i) * (n - i) / ((i + 1) * np.maximum(big_n - big_k - n + i + 1, 1)), 0)
        term = term * ratio
        total = total + term
        i = i + 1
        live = live & (i < most) & (term > total * 1e-17)
    tail = first + np.log(total)
    return np.where(k <= lowest, 0.0, np.minimum(tail, 0.0))


def _tails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield b.assign(ln_p=log_tail(b["k"], b["n"], b["big_k"], b["big_n"]))


def term_counts(fields: DataFrame, grams: DataFrame) -> DataFrame:
    """(kind, record_id, term, k): how many of a record's field values hold the term.

    kind is gram or value. Repeated rows count once, empty terms and those of fields that are gone don't count.
    """
    fields = fields.filter("record_id IS NOT NULL AND field_id IS NOT NULL").select("field_id", "record_id", "normalized_value").distinct()
    owners = fields.groupBy("field_id").agg(F.min("record_id").alias("record_id"))
    held = grams.filter("gram <> ''").select("field_id", "gram").distinct().join(owners, "field_id")
    values = fields.filter("normalized_value <> ''")
    return (
        held.select(F.lit("gram").alias("kind"), "record_id", F.col("gram").alias("term"))
        .unionByName(values.select(F.lit("value").alias("kind"), "record_id", F.col("normalized_value").alias("term")))
        .groupBy("kind", "record_id", "term")
        .agg(F.count("*").alias("k"))
    )


def enrichment(counts: DataFrame) -> DataFrame:
    """(kind, record_id, term, k, n_records, p_value, q_value, score) of every term of every record."""
    counts = cut(counts)
    terms = cut(counts.groupBy("kind", "term").agg(F.sum("k").alias("big_k"), F.count("*").alias("n_records")))
    records = cut(counts.groupBy("kind", "record_id").agg(F.sum("k").alias("n")))
    totals = {r[0]: int(r[1]) for r in terms.groupBy("kind").agg(F.sum("big_k")).collect()}  # two rows
    size = F.lit(None).cast("bigint")
    for kind, total in totals.items():
        size = F.when(F.col("kind") == kind, F.lit(total).cast("bigint")).otherwise(size)
    keys = ["kind", "term"]
    owned = hot_lookup_join(counts, records, ["kind", "record_id"], records)
    full = hot_lookup_join(owned, terms, keys, terms.select(*keys, F.col("n_records").alias("n"))).withColumn("big_n", size)
    full = cut(full)
    cells = full.groupBy("kind", "k", "n", "big_k", "big_n").agg(F.count("*").alias("tests"))
    schema = "kind string, k bigint, n bigint, big_k bigint, big_n bigint, tests bigint, ln_p double"
    cells = cut(cells.mapInPandas(_tails, schema))
    # Adjusted: the least p * m / rank over all tests with a p that is at least as large.
    ranked = value_ranks(cells, ["kind"], "ln_p", "tests").withColumn("raw", F.col("ln_p") + F.log(F.col("total")) - F.log(F.col("below") + F.col("n")))
    adjusted = suffix_minimum(ranked, "kind", "ln_p", "raw").withColumn("ln_q", F.least("least", F.lit(0.0))).select("kind", "ln_p", "ln_q")
    scored = cells.join(adjusted, ["kind", "ln_p"]).select("kind", "k", "n", "big_k", "ln_p", "ln_q")
    ten = F.log(F.lit(10.0))
    cell = F.struct("k", "n", "big_k").alias("cell")
    hits = hot_lookup_join(
        full.withColumn("cell", cell), scored.select("kind", cell, "ln_p", "ln_q"), ["kind", "cell"], cells.select("kind", cell, F.col("tests").alias("n"))
    )
    return hits.select(
        "kind", "record_id", "term", "k", "n_records", F.exp("ln_p").alias("p_value"), F.exp("ln_q").alias("q_value"), F.abs(F.col("ln_q") / F.log(F.lit(10.0))).alias("score")
    )


def suffix_minimum(df: DataFrame, group: str, order: str, value: str) -> DataFrame:
    """``df`` with ``least``, the minimum of ``value`` over rows of the group from this one on in ``order``.

    Parts of a range sort keep their own minima; what later parts of the group add is one row a part.
    """
    parts = cut(df.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    # From the far end: frames that grow by a row are folded once, shrinking ones anew for every row.
    later = Window.partitionBy(group).orderBy(F.desc("_part")).rowsBetween(Window.unboundedPreceding, -1)
    tails = parts.groupBy("_part", group).agg(F.min(value).alias("_m")).select("_part", group, F.min("_m").over(later).alias("_after"))
    own = Window.partitionBy("_part", group).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("_own", F.min(value).over(own)).join(tails, ["_part", group]).withColumn("least", F.least("_own", "_after")).drop("_part", "_own", "_after")


def _counts(spark: SparkSession, d: str) -> DataFrame:
    return term_counts(table(spark, d, "lexical_fields"), table(spark, d, "lexical_ngrams"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of records that share a gram which at most 3 records hold.

    The grams and the number of records that hold each are those of `enrichment`; which of them are rare is a matter of that
    number alone, whatever the score.
    """
    rare = cut(enrichment(_counts(spark, d)).filter(f"kind = 'gram' AND n_records BETWEEN 2 AND {RARE}").select("term", "record_id", "score"))
    a, b = (rare.select("term", F.col("record_id").alias(f"record_id_{s}")) for s in "ab")
    return a.join(b, "term").filter("record_id_a < record_id_b").select("record_id_a", "record_id_b").distinct()


def p6_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every gram and value of every record."""
    return enrichment(_counts(spark, d)).withColumns({c: F.round(c, 6) for c in ("p_value", "q_value", "score")})
