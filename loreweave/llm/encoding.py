"""Encoding of a text column with a public byte-level BPE vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table
from .arrow import text_bytes
from .byte_bpe import encoder

#: Where the vocabulary lies on every executor.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"


def _encode(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        ids, offsets = own.encode(*text_bytes(batch.column(1)))
        lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["key", "ids"])


def _count(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    own = encoder(path)
    for batch in batches:
        n = own.counts(*text_bytes(batch.column(batch.num_columns - 1)))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n, pa.int64())], names=[*batch.schema.names[:-1], "n_tokens"])


def encode_texts(df: DataFrame, key: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, ids): the ids of every row's text, without special tokens.

    Strings that look like special tokens are ordinary text. Null and empty texts give an empty list; rows with a
    null or repeated key are encoded like all others. Other columns of ``df`` are not read. No shuffle.
    """
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    kind = source.schema["key"].dataType.simpleString()
    out = source.mapInArrow(partial(_encode, path=vocabulary), f"key {kind}, ids array<int>")
    return out.withColumnRenamed("key", key)


def count_tokens(df: DataFrame, keep: list[str], text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns ``keep`` and n_tokens of ``text``; 0 for null and empty texts. No shuffle."""
    source = df.select(*keep, F.col(text).alias("_text"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return source.mapInArrow(partial(_count, path=vocabulary), f"{fields}, n_tokens bigint")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """The ids of every document."""
    return encode_texts(table(spark, d, "documents"), "doc_id", "text")
