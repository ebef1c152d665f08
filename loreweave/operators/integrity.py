"""Checks of a knowledge base: keys, claim forms, and agreement of two sets of edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The key of each table, and the tables that a manifest counts.
KEYS = {"entities": "entity_path", "chunks": "chunk_id", "claims": "claim_key", "relations": "relation_id", "kb_references": "reference_id"}
TABLES = (*KEYS, "lexical_fields", "lexical_ngrams", "vectors")


def duplicate_keys(tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """(table_name, record_key, n) of keys that stand in several rows."""
    parts = [
        df.filter(F.col(k).isNotNull()).groupBy(F.lit(n).alias("table_name"), F.col(k).cast("string").alias("record_key")).agg(F.count("*").alias("n")).filter("n > 1")
        for n, (df, k) in tables.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def claim_forms(claims: DataFrame) -> DataFrame:
    """``claims`` with form: relation, value, both (which isn't legal), or statement."""
    relation = F.col("subject").isNotNull() & F.col("predicate").isNotNull() & F.col("target").isNotNull()
    value = F.col("subject").isNotNull() & F.col("property").isNotNull()
    return claims.withColumn("form", F.when(relation & value, "both").when(relation, "relation").when(value, "value").otherwise("statement"))


def edge_differences(declared: DataFrame, derived: DataFrame) -> DataFrame:
    """(source, predicate, target, difference): edges of relations that no claim states (missing), and the reverse (extra)."""
    a = declared.select(F.col("source_path").alias("source"), "predicate", "target").dropna().distinct().withColumn("a", F.lit(1))
    b = derived.select(F.col("subject").alias("source"), "predicate", "target").dropna().distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["source", "predicate", "target"], "full").filter("a IS NULL OR b IS NULL")
    return both.select("source", "predicate", "target", F.when(F.col("b").isNull(), "missing").otherwise("extra").alias("difference"))


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n_rows) of each table."""
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table_name"), "n_rows") for n, df in tables.items()])
