"""Embedders, their identity, and the vectors they give."""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..diagnostics import EmbeddingError


def digest(value: dict) -> str:
    """SHA-256 of canonical JSON."""
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()).hexdigest()


@dataclass(frozen=True)
class EmbeddingConfig:
    """What identifies an embedder."""

    implementation: str
    model: str
    dimension: int
    revision: str | None = None
    document_task: str | None = None
    query_task: str | None = None
    tokenizer: str | None = None
    preprocessing: dict = field(default_factory=dict)
    pooling: str | None = None
    normalization: str | None = None

    def __post_init__(self) -> None:
        if isinstance(self.dimension, bool) or not isinstance(self.dimension, int) or self.dimension < 1:
            raise ValueError("dimension must be a positive integer")

    @property
    def fingerprint(self) -> str:
        return digest(asdict(self))


@dataclass(frozen=True)
class VectorIndexConfig:
    """What identifies a vector index."""

    embedding: EmbeddingConfig
    similarity_metric: str = "cosine"
    format_version: int = 1

    @property
    def fingerprint(self) -> str:
        return digest({"embedding_fingerprint": self.embedding.fingerprint, "format_version": self.format_version, "similarity_metric": self.similarity_metric.casefold()})


class HashEmbedder:
    """Vectors from hashes of the text and the embedder's identity: the same everywhere, and without meaning."""

    def __init__(self, config: EmbeddingConfig):
        self.config = config

    def embed(self, texts: list[str], role: str) -> list[list[float]]:
        out, d = [], self.config.dimension
        for text in texts:
            seed = json.dumps({"embedding_fingerprint": self.config.fingerprint, "role": role, "text": text}, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()
            blocks = b"".join(hashlib.sha256(seed + i.to_bytes(8, "big")).digest() for i in range(-(-d // 8)))
            out.append([int.from_bytes(blocks[4 * i : 4 * i + 4], "big") / (2**32 - 1) * 2 - 1 for i in range(d)])
        return out


class InjectedEmbedder:
    """Functions of the caller: texts in, one vector each out."""

    def __init__(self, config: EmbeddingConfig, documents: Callable, queries: Callable):
        self.config, self.functions = config, {"document": documents, "query": queries}

    def embed(self, texts: list[str], role: str) -> list[list[float]]:
        return self.functions[role](texts)


def checked(vectors, n: int, dimension: int, ids: list | None = None) -> list[list[float]]:
    """The vectors as floats; another number of them, another length, or what is no finite number is an error.

    An embedder may give pairs of an id and a vector instead: then the ids must be ``ids``, each once and in their order.
    """
    vectors = list(vectors)
    if len(vectors) != n:
        raise EmbeddingError(f"expected {n} vectors, got {len(vectors)}")
    if ids is not None and vectors and all(isinstance(v, tuple) and len(v) == 2 and not isinstance(v[0], (int, float)) for v in vectors):
        found = [i for i, _ in vectors]
        if len(set(found)) != len(set(ids)):
            raise EmbeddingError("an id stands twice among the vectors, or is missing")
        if found != list(ids):
            raise EmbeddingError("the ids of the vectors aren't those of the documents, in their order")
        vectors = [v for _, v in vectors]
    for v in vectors:
        if isinstance(v, (str, bytes)) or len(v) != dimension or any(isinstance(x, bool) or not isinstance(x, (int, float)) or not math.isfinite(x) for x in v):
            raise EmbeddingError(f"a vector must be {dimension} finite numbers")
    return [[float(x) for x in v] for v in vectors]


def embedded(embedder, texts: list[str], role: str, ids: list | None = None) -> list[list[float]]:
    """The checked vectors of texts. No texts don't reach the embedder; what it raises is the cause of an `EmbeddingError`."""
    if not texts:
        return []
    try:
        found = embedder.embed(texts, role)
    except EmbeddingError:
        raise
    except Exception as e:
        raise EmbeddingError(f"the embedder failed on {len(texts)} texts: {e}") from e
    return checked(found, len(texts), embedder.config.dimension, ids)


def embed_column(df: DataFrame, keep: list[str], text: str, embedder, role: str) -> DataFrame:
    """``keep`` and ``vector``, a batch of texts at a time."""
    rows = df.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b["_text"].tolist()
            yield b.drop(columns="_text").assign(vector=embedded(embedder, texts, role, b[keep[0]].tolist()))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInPandas(run, f"{fields}, vector array<double>")
