"""The rows of a knowledge base that hold now: the newest version of each key, deletions left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def newest(df: DataFrame, key: str) -> DataFrame:
    """The newest row of each key by ``loaded_at``, versions combined before the shuffle; null keys are left out.

    Where the table has ``deleted_at``, keys whose newest row is a deletion are gone; on a tie the deletion is newest.
    """
    deletes = "deleted_at" in df.columns
    order = [F.coalesce("loaded_at", F.lit("0001-01-01").cast("timestamp"))] + ([F.col("deleted_at").isNotNull()] if deletes else [])
    rest = [c for c in df.columns if c != key]
    kept = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, *[F.xxhash64(c) for c in rest[:1]])).alias("_r"))
    kept = kept.select(key, "_r.*").select(*df.columns)
    return kept.filter("deleted_at IS NULL").drop("deleted_at") if deletes else kept
