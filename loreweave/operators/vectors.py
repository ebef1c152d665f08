"""Exact vector search in blocks, and the checks of a vector table against its chunks."""

from __future__ import annotations


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import VectorRetrievalError
from .lexical import positive_integer

COSINE, DOT = "cosine", "dot"


def similarity(a, b, metric: str = COSINE):
    """Dot product or cosine of two array columns; a cosine with a zero vector is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    if metric == DOT:
        return dot(a, b)
    if metric != COSINE:
        raise VectorRetrievalError(f"unsupported similarity metric {metric!r}")
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def _matrix(column) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _block(vectors: pa.Table, queries: pa.Table, k: int, metric: str) -> pa.Table:
    schema = pa.schema([("query_id", queries.schema.field("query_id").type), ("key", vectors.schema.field("key").type), ("score", pa.float64())])
    if not vectors.num_rows or not queries.num_rows:
        return schema.empty_table()
    x, q = _matrix(vectors["vector"]), _matrix(queries["vector"])
    if metric == COSINE:
        x, q = (m / np.where((n := np.linalg.norm(m, axis=1, keepdims=True)) > 0, n, 1) for m in (x, q))
    take = min(k, len(x))
    keys, owners, scores = [], [], []
    step = max(1, 4_000_000 // len(x))
    for lo in range(0, len(q), step):
        s = np.round(q[lo : lo + step] @ x.T, 9)
        least = -np.sort(-np.partition(s, len(x) - take, axis=1)[:, len(x) - take :], axis=1)[:, take - 1]
        i, j = np.nonzero(s >= least[:, None])  # ties with the k-th best all stay; the merge orders them
        owners.append(i + lo)
        keys.append(j)
        scores.append(s[i, j])
    owner, key = pa.array(np.concatenate(owners)), pa.array(np.concatenate(keys))
    return pa.table({"query_id": queries["query_id"].take(owner), "key": vectors["key"].take(key), "score": np.concatenate(scores)}, schema=schema)


#: Vectors of a block, at most on average.
BLOCK_ROWS = 100_000


def exact_top_k(queries: DataFrame, vectors: DataFrame, k: int, metric: str = COSINE, blocks: int | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k most similar vectors of every query vector, ties by key.

    ``queries`` has query_id and vector, ``vectors`` key and vector, all of one length. The vectors are spread over
    blocks, each of which sees all queries and keeps k of each; nothing is broadcast. There are ``blocks`` of them, or unset as many as `BLOCK_ROWS` asks for by
    the number of vectors, and at least one for each two cores.
    """
    positive_integer("k", k)
    if metric not in (COSINE, DOT):
        raise VectorRetrievalError(f"unsupported similarity metric {metric!r}")
    if blocks is None:
        blocks = max(-(-vectors.count() // BLOCK_ROWS), vectors.sparkSession.sparkContext.defaultParallelism // 2, 1)
    spread = vectors.select("key", "vector", F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"))
    asked = queries.select("query_id", "vector", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("block"))
    types = dict(queries.dtypes)["query_id"], dict(vectors.dtypes)["key"]
    run = lambda v, q: _block(v, q, k, metric)
    found = spread.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(run, f"query_id {types[0]}, key {types[1]}, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "key")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compatibility(vectors: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, problem): chunks without a vector, vectors without a chunk, and vectors of another text."""
    v = vectors.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("content_hash").alias("vector_hash"), F.lit(True).alias("has_vector"))
    c = chunks.filter("chunk_id IS NOT NULL").groupBy("chunk_id").agg(F.max("content_hash").alias("chunk_hash"), F.lit(True).alias("has_chunk"))
    problem = F.when(F.col("has_vector").isNull(), "missing").when(F.col("has_chunk").isNull(), "extra").when(~F.col("vector_hash").eqNullSafe(F.col("chunk_hash")), "stale")
    return v.join(c, "chunk_id", "full").select("chunk_id", problem.alias("problem")).filter("problem IS NOT NULL")


def unusable(vectors: DataFrame, dimension: int) -> DataFrame:
    """(chunk_id, problem) of vectors that can't be searched: null, of another length, not finite, or all zero."""
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    problem = (
        F.when(F.col("vector").isNull(), "null").when(F.size("vector") != dimension, "dimension").when(bad, "not finite").when(~F.exists("vector", lambda x: x != 0), "zero")
    )
    return vectors.select("chunk_id", problem.alias("problem")).filter("problem IS NOT NULL").distinct()
