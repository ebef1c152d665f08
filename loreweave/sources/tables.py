"""Parquet tables of a knowledge base, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``: one Parquet file or a directory of them."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
