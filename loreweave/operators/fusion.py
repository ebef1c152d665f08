"""Reciprocal rank fusion of several backends' rankings into one per query."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import FusionError
from .lexical import positive_integer


@dataclass(frozen=True)
class RRFConfig:
    """How backends are fused: score = sum of weight / (constant + rank)."""

    constant: float = 60.0
    backend_weights: dict = field(default_factory=dict)
    backend_cutoffs: dict = field(default_factory=dict)
    passage_precedence: tuple = ()

    def __post_init__(self) -> None:
        if isinstance(self.constant, bool) or not 0 < self.constant < float("inf"):
            raise FusionError("constant must be positive and finite")
        if any(not 0 <= w < float("inf") for w in self.backend_weights.values()):
            raise FusionError("backend weights must be non-negative and finite")
        if any(isinstance(c, bool) or not isinstance(c, int) or c < 1 for c in self.backend_cutoffs.values()):
            raise FusionError("backend cutoffs must be positive integers")


def best_hits(hits: DataFrame, config: RRFConfig = RRFConfig()) -> DataFrame:
    """The best hit of each (query, backend, entity) within its backend's cutoff.

    ``hits`` has query_id, backend, rank, entity_path, chunk_id, section and text, at least. Ties in rank go by
    chunk id, section and text.
    """
    cutoff = F.lit(None).cast("int")
    for backend, n in config.backend_cutoffs.items():
        cutoff = F.when(F.col("backend") == backend, n).otherwise(cutoff)
    order = F.struct("rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_id", "section", "text")])
    rest = [c for c in hits.columns if c not in ("query_id", "backend", "entity_path")]
    kept = hits.filter(cutoff.isNull() | (F.col("rank") <= cutoff))
    return kept.groupBy("query_id", "backend", "entity_path").agg(F.min_by(F.struct(*rest), order).alias("_h")).select("query_id", "backend", "entity_path", "_h.*")


#: Columns of hits that are united over all hits of an entity rather than chosen with its passage.
UNITED = ("relation_source_ids", "claim_source_ids")


def _rank_columns(backends: Sequence[str]) -> list:
    return [F.min(F.when(F.col("backend") == b, F.col("rank"))).alias(f"rank_{i}") for i, b in enumerate(backends)]


def _score(backends: Sequence[str], config: RRFConfig):
    terms = [F.coalesce(F.lit(float(config.backend_weights.get(b, 1.0))) / (F.lit(float(config.constant)) + F.col(f"rank_{i}")), F.lit(0.0)) for i, b in enumerate(backends)]
    return sum(terms, F.lit(0.0))


def rrf_scores(best: DataFrame, backends: Sequence[str], config: RRFConfig = RRFConfig()) -> DataFrame:
    """(query_id, entity_path, score, backend ranks): weights over ranks, added in the order of ``backends``."""
    return best.groupBy("query_id", "entity_path").agg(*_rank_columns(backends)).withColumn("score", _score(backends, config))


def _passage_order(backends: Sequence[str], config: RRFConfig):
    precedence = list(config.passage_precedence or backends)
    place = F.lit(len(precedence))
    for i, b in enumerate(precedence):
        place = F.when(F.col("backend") == b, i).otherwise(place)
    return F.struct(F.col("chunk_id").isNull().alias("none"), place.alias("place"), "rank", *[F.coalesce(c, F.lit("")).alias(c) for c in ("chunk_id", "section", "text")], "backend")


def _passage(backends: Sequence[str], config: RRFConfig):
    return F.min_by(F.struct("backend", "chunk_id", "section", "text", "source_ids"), _passage_order(backends, config)).alias("p")


def chosen_passages(best: DataFrame, backends: Sequence[str], config: RRFConfig = RRFConfig()) -> DataFrame:
    """The passage of each (query, entity): of the hits with a chunk id the first by precedence, rank and identity."""
    return best.groupBy("query_id", "entity_path").agg(_passage(backends, config)).select("query_id", "entity_path", "p.*")


def fallback_passages(chunks: DataFrame, columns: tuple = ("chunk_id", "heading", "text")) -> DataFrame:
    """The first chunk of each entity (``columns`` of it), by ordinal and id, for entities that no hit gave a passage."""
    order = F.struct("ordinal", "chunk_id")
    return chunks.groupBy("entity_path").agg(F.min_by(F.struct(*columns), order).alias("c")).select("entity_path", "c.*")


def fuse(hits: DataFrame, backends: Sequence[str], top_k: int | None = None, config: RRFConfig = RRFConfig()) -> DataFrame:
    """(query_id, entity_path, score, rank and the chosen passage), by falling score (12 decimals) and path.

    Where hits carry source ids of assertions and whether to hedge, these are united over the best hits of an entity, one a backend, in
    the order in which passages are chosen; a fused hit is to be hedged if one of them is.
    """
    best = best_hits(hits, config)
    united = [c for c in UNITED if c in hits.columns]
    order = _passage_order(backends, config)
    more = [F.array_sort(F.collect_list(F.struct(order.alias("o"), *united, *([F.col("requires_hedging")] if "requires_hedging" in hits.columns else [])))).alias("_all")] if united else []
    # One aggregation gives scores, passages and what is united.
    wide = best.groupBy("query_id", "entity_path").agg(*_rank_columns(backends), _passage(backends, config), *more).withColumn("score", _score(backends, config))
    for c in united:
        wide = wide.withColumn(c, F.array_distinct(F.flatten(F.array_compact(F.col(f"_all.{c}")))))
    if united and "requires_hedging" in hits.columns:
        wide = wide.withColumn("requires_hedging", F.exists("_all.requires_hedging", lambda x: F.coalesce(x, F.lit(False))))
    places = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 12)), "entity_path")
    ranked = wide.drop("_all").withColumn("rank", F.row_number().over(places))
    if top_k is not None:
        ranked = ranked.filter(F.col("rank") <= positive_integer("top_k", top_k))
    return ranked.select(*[c for c in ranked.columns if c != "p"], "p.*")
