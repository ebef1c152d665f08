"""Canonical exports: one line a chunk or vector, the same for the same content wherever it is made."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_COLUMNS = ("chunk_id", "content_hash", "entity_path", "entity_type", "heading", "metadata_json", "ordinal", "source_ids_json", "tags_json", "text", "title")


def duplicate_ordinals(chunks: DataFrame) -> DataFrame:
    """(entity_path, ordinal, n) of ordinals that an entity has twice; a canonical export needs this to be empty."""
    return chunks.groupBy("entity_path", "ordinal").agg(F.count("*").alias("n")).filter("n > 1")


def chunk_lines(chunks: DataFrame, strict: bool = False) -> DataFrame:
    """(line): JSON of each chunk with sorted keys and explicit nulls, in the order of path, ordinal and id over all files.

    With ``strict``, an ordinal that an entity has twice is an error.
    """
    if strict and (twice := duplicate_ordinals(chunks).first()):
        raise ValueError(f"{twice.entity_path} has ordinal {twice.ordinal} {twice.n} times")
    ordered = chunks.repartitionByRange("entity_path", "ordinal", "chunk_id").sortWithinPartitions("entity_path", "ordinal", "chunk_id")
    return ordered.select(F.to_json(F.struct(*CHUNK_COLUMNS), {"ignoreNullFields": "false"}).alias("line"))


def _hex(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        codes = [None if v is None else np.array(v, ">f8").tobytes().hex() for v in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(codes, pa.string())], names=["chunk_id", "content_hash", "vector_hex"])


def vector_lines(vectors: DataFrame) -> DataFrame:
    """(line): JSON of each vector in the order of chunk ids, its components as hexadecimal big-endian doubles."""
    rows = vectors.select("chunk_id", "content_hash", "vector").mapInArrow(_hex, "chunk_id string, content_hash string, vector_hex string")
    ordered = rows.repartitionByRange("chunk_id").sortWithinPartitions("chunk_id")
    return ordered.select(F.to_json(F.struct("chunk_id", "content_hash", "vector_hex"), {"ignoreNullFields": "false"}).alias("line"))
