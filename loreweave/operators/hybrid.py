"""Search over an open index in one of three modes, with opt-in graph expansion, for any number of queries."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..diagnostics import RetrievalError
from ..functions.text import fallback_text
from ..plans.lineage import cut, sweep
from ..sources.store import Index
from . import fusion, graph, lexical, vectors
from .embedding import embed_column

MODES = ("lexical", "vector", "hybrid")
PASSAGE, ENTITY, VECTOR = "lexical.passage", "lexical.entity", "vector"


@dataclass(frozen=True)
class RetrievalConfig:
    """What is searched, and how much."""

    mode: str = "lexical"
    top_k: int = 5
    backend_cutoffs: dict = field(default_factory=dict)
    rrf: fusion.RRFConfig = fusion.RRFConfig()
    graph: graph.GraphExpansionConfig = graph.GraphExpansionConfig()

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}")
        if isinstance(self.top_k, bool) or not isinstance(self.top_k, int) or self.top_k < 1:
            raise ValueError("top_k must be a positive integer")

    def cutoffs(self) -> dict[str, int]:
        """How many hits each backend of the mode gives; more of them when they are seeds of an expansion."""
        pool = self.top_k * (self.graph.seed_pool_factor if self.graph.enabled else 1)
        names = {"lexical": (PASSAGE,), "vector": (VECTOR,), "hybrid": (PASSAGE, ENTITY, VECTOR)}[self.mode]
        return {n: self.backend_cutoffs.get(n, pool) for n in names}

    def policy(self) -> dict:
        g = self.graph
        return {
            "mode": self.mode, "top_k": self.top_k, "backend_cutoffs": self.cutoffs(),
            "rrf": {"constant": self.rrf.constant, "backend_weights": dict(self.rrf.backend_weights), "backend_cutoffs": dict(self.rrf.backend_cutoffs), "passage_precedence": list(self.rrf.passage_precedence)},
            "graph": {
                "enabled": g.enabled, "predicates": None if g.predicates is None else list(g.predicates), "include_rejected": g.include_rejected, "include_unknown": g.include_unknown, "decay": g.decay, "claim_decay": g.claim_decay,
                "confidence_weights": dict(g.confidence_weights), "seed_pool_factor": g.seed_pool_factor, "expanded_result_limit": g.expanded_result_limit or max(1, (self.top_k + 1) // 2),
            },
        }


def chunk_hits(queries: DataFrame, index: Index, k: int) -> DataFrame:
    return _lexical(queries, index, "chunk", lexical.CHUNK_WEIGHTS, k).withColumnRenamed("record_id", "chunk_id").join(_passages(index), "chunk_id")


def entity_hits(queries: DataFrame, index: Index, k: int) -> DataFrame:
    top = _lexical(queries, index, "entity", lexical.ENTITY_WEIGHTS, k).withColumnRenamed("record_id", "entity_path")
    return top.join(_entity_texts(index), "entity_path").withColumns({"chunk_id": F.lit(None).cast("string"), "section": F.lit(None).cast("string")})


def _entity_texts(index: Index) -> DataFrame:
    return index.tables["entities"].select("entity_path", fallback_text(F.col("content"), F.col("description"), F.col("title")).alias("text"), graph.bare_ids(F.col("source_ids_json")).alias("source_ids"))


def _lexical(queries: DataFrame, index: Index, kind: str, weights: dict, k: int) -> DataFrame:
    fields = index.tables["lexical_fields"].filter(F.col("record_kind") == kind)
    return lexical.field_top_k(lexical.prepared_queries(queries), fields, weights, k, n=index.manifest["ngram_size"])


def _passages(index: Index) -> DataFrame:
    return index.tables["chunks"].select("chunk_id", "entity_path", F.col("heading").alias("section"), "text", graph.bare_ids(F.col("source_ids_json")).alias("source_ids"))


def vector_hits(queries: DataFrame, index: Index, stored: DataFrame, embedder, metric: str, k: int) -> DataFrame:
    asked = embed_column(queries.filter("trim(query_text) <> ''").select("query_id", "query_text"), ["query_id"], "query_text", embedder, "query")
    top = vectors.exact_top_k(asked, stored.select(F.col("chunk_id").alias("key"), "vector"), k, metric)
    return top.withColumnRenamed("key", "chunk_id").join(_passages(index), "chunk_id")


#: What is asserted of a hit's entity.
ASSERTED = ("relation_source_ids", "claim_source_ids", "requires_hedging")


def _unasserted(hits: DataFrame) -> DataFrame:
    none = F.lit(None).cast("array<string>")
    return hits.withColumns({"relation_source_ids": none, "claim_source_ids": none, "requires_hedging": F.lit(False)})


def search(queries: DataFrame, index: Index, config: RetrievalConfig = RetrievalConfig(), stored: DataFrame | None = None, embedder=None, metric: str = vectors.COSINE) -> DataFrame:
    """Hits of ``queries`` (query_id, query_text): query_id, rank, score, retriever, entity_path, chunk_id, section, text,
    source_ids, and of what the graph gave its claim, confidence, direction, predicate and sources; of vector and fused hits the source ids of
    what is asserted of their entity. ``graph_expansion`` is the graph policy of the search, as JSON, on every hit.

    Queries that are blank give no hits.
    """
    policy = F.lit(json.dumps(config.policy()["graph"], sort_keys=True))
    return _search(queries, index, config, stored, embedder, metric).withColumn("graph_expansion", policy)


def _search(queries: DataFrame, index: Index, config: RetrievalConfig, stored: DataFrame | None, embedder, metric: str) -> DataFrame:
    if config.mode != "lexical" and (stored is None or embedder is None):
        raise RetrievalError(f"retrieval mode {config.mode!r} needs a vector index and its embedder")
    most = config.cutoffs()
    columns = ["query_id", "rank", "score", "entity_path", "chunk_id", "section", "text", "source_ids", *ASSERTED]
    t = index.tables
    origins = graph.provenance(t["relations"], t["claims"], t["entities"]) if config.mode != "lexical" else None
    if config.mode == "lexical":
        direct = _unasserted(chunk_hits(queries, index, most[PASSAGE])).select(*columns, F.lit("lexical.chunk").alias("retriever"))
    elif config.mode == "vector":
        direct = graph.with_provenance(vector_hits(queries, index, stored, embedder, metric, most[VECTOR]), origins).select(*columns, F.lit("vector.chunk").alias("retriever"))
    else:
        # Texts, sources and what is asserted are joined to the fused hits only: the backends' hits are many more, and ranks decide between them.
        parts = {PASSAGE: chunk_hits(queries, index, most[PASSAGE]), ENTITY: entity_hits(queries, index, most[ENTITY]), VECTOR: vector_hits(queries, index, stored, embedder, metric, most[VECTOR])}
        hits = None
        for name, h in parts.items():
            h = h.select("query_id", "rank", "entity_path", "chunk_id", "section", F.lit(None).cast("string").alias("text"), F.lit(None).cast("array<string>").alias("source_ids"), F.lit(name).alias("backend"))
            hits = h if hits is None else hits.unionByName(h)
        pool = config.top_k * (config.graph.seed_pool_factor if config.graph.enabled else 1)
        fused = fusion.fuse(hits, (PASSAGE, ENTITY, VECTOR), pool, config.rrf)
        spare = fusion.fallback_passages(t["chunks"], ("chunk_id", "heading")).select("entity_path", F.col("chunk_id").alias("c2"), F.col("heading").alias("s2"))
        other = F.col("chunk_id").isNull() & F.col("c2").isNotNull()
        pick = lambda a, b: F.when(other, F.col(b)).otherwise(F.col(a)).alias(a)
        by_vector = F.col("rank_2").isNotNull()
        fused = fused.join(spare, "entity_path", "left").select("query_id", "rank", "score", "entity_path", pick("chunk_id", "c2"), pick("section", "s2"), F.col("chunk_id").isNotNull().alias("_own"), by_vector.alias("_by_vector"))
        passages = _passages(index).select("chunk_id", F.col("text").alias("_text"), F.col("source_ids").alias("_ids"))
        whole = _entity_texts(index).select("entity_path", F.col("text").alias("_e_text"), F.col("source_ids").alias("_e_ids"))
        told = graph.with_provenance(fused.join(passages, "chunk_id", "left").join(whole, "entity_path", "left"), origins)
        none = F.array().cast("array<string>")
        told = told.withColumns({"relation_source_ids": F.when(F.col("_by_vector"), F.col("relation_source_ids")).otherwise(none), "claim_source_ids": F.when(F.col("_by_vector"), F.col("claim_source_ids")).otherwise(none), "requires_hedging": F.col("_by_vector") & F.col("requires_hedging")})
        told = told.withColumns({"text": F.when(F.col("chunk_id").isNotNull(), F.col("_text")).otherwise(F.col("_e_text")), "source_ids": F.when(F.col("_own"), F.col("_ids")).otherwise(F.col("_e_ids"))})
        direct = told.select(*columns, F.lit("rrf.entity").alias("retriever"))
    none = {"claim_path": "string", "confidence": "string", "direction": "string", "predicate": "string", "affirmative": "boolean"}
    if not config.graph.enabled:
        ranked = lexical.top_k(direct.withColumn("_tie", F.concat_ws("\x00", "entity_path", "retriever", F.lpad(F.col("rank").cast("string"), 10, "0"))).drop("rank"), config.top_k, "_tie").drop("_tie")
        return ranked.withColumns({c: F.lit(None).cast(t) for c, t in none.items()})
    return expanded(direct, index, config)


def expanded(direct: DataFrame, index: Index, config: RetrievalConfig) -> DataFrame:
    """Direct hits as seeds, their neighbours, and a choice of both."""
    t, direct = index.tables, cut(direct)
    sweep(direct.sparkSession)
    types = t["entities"].select("entity_path", "entity_type")
    first = direct.groupBy("query_id", "entity_path").agg(F.min_by(F.struct("score", "rank", "chunk_id", "section", "text", "source_ids", "retriever", *ASSERTED), F.struct("rank", (-F.col("score")).alias("m"))).alias("h")).select("query_id", "entity_path", "h.*")
    seeds = graph.distinct_seeds(first)
    admitted = graph.with_policy(graph.edges(t["relations"], t["claims"], t["entities"]), config.graph)
    found = graph.expand(seeds, admitted, config.graph)
    found = found.join(types.toDF("seed", "_a"), "seed").join(types.toDF("neighbor", "_b"), "neighbor").withColumn("same_type", F.col("_a").eqNullSafe(F.col("_b")))
    chosen = graph.diverse(first.select("query_id", "entity_path", "retriever", "score", "rank"), found, config.top_k, config.graph, keep=("confidence", "direction", "predicate", "source_ids", "affirmative", "requires_hedging"))
    own = t["entities"].select("entity_path", fallback_text(F.col("content"), F.col("description"), F.col("title")).alias("e_text"), graph.bare_ids(F.col("source_ids_json")).alias("e_ids"))
    passage = first.select("query_id", "entity_path", "chunk_id", "section", "text", F.col("source_ids").alias("p_ids"), *[F.col(c).alias(f"p_{c}") for c in ASSERTED])
    joined = chosen.withColumnRenamed("source_ids", "relation_source_ids").join(passage, ["query_id", "entity_path"], "left").join(own, "entity_path", "left")
    by_graph = F.col("retriever") == "graph.one-hop"
    return joined.select(
        "query_id", "rank", "score", "entity_path", F.when(~by_graph, F.col("chunk_id")).alias("chunk_id"), F.when(~by_graph, F.col("section")).alias("section"), F.when(by_graph, F.col("e_text")).otherwise(F.col("text")).alias("text"),
        F.when(by_graph, F.col("e_ids")).otherwise(F.col("p_ids")).alias("source_ids"), "retriever", "claim_path", "confidence", "direction", "predicate", "affirmative",
        *[F.when(by_graph, F.col(c) if c != "claim_source_ids" else F.when(F.col("claim_path").isNotNull(), F.col("relation_source_ids"))).otherwise(F.col(f"p_{c}")).alias(c) for c in ASSERTED],
    )
