"""Keeping postings up to date from a stream of chunks.

The reference behaviour is a rebuild when hashes differ. For a stream, each micro-batch replaces the postings of the chunks
it brings: they go into a folder of their own batch, so that a batch that runs again overwrites what it wrote, and readers
take of each chunk the newest batch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ids import json_strings
from ..functions.text import character_ngrams
from ..operators import lexical
from ..operators.current import newest


def chunk_postings(chunks: DataFrame, n: int = 2) -> DataFrame:
    """(record_id, field_name, field_ordinal, normalized_value, gram) of chunks; a chunk without fields has one row of nulls."""
    rows = chunks.filter("chunk_id IS NOT NULL").withColumn("tags", json_strings(F.col("tags_json")))
    fields = lexical.field_rows(rows, "chunk_id", lexical.CHUNK_WEIGHTS)
    full = fields.select("record_id", "field_name", "field_ordinal", "normalized_value", F.explode_outer(character_ngrams(F.col("normalized_value"), n)).alias("gram"))
    bare = rows.select(F.col("chunk_id").alias("record_id")).distinct()
    return bare.join(full, "record_id", "left")


def write_postings(stream: DataFrame, path: str, checkpoint: str, n: int = 2, **trigger) -> StreamingQuery:
    """Starts a query that writes the postings of each micro-batch of chunks below ``path``."""

    def write(batch: DataFrame, number: int) -> None:
        # Of several versions of a chunk in one batch the newest holds.
        chunk_postings(newest(batch, "chunk_id") if "loaded_at" in batch.columns else batch.dropDuplicates(["chunk_id"]), n).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """The postings of the newest batch of each chunk."""
    rows = spark.read.parquet(path)
    newest = rows.groupBy("record_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["record_id", "batch"]).filter("gram IS NOT NULL").drop("batch")
