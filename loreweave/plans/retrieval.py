"""Registered queries of the retrieval operators over the tables of a knowledge base, with their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import bare_source_id, json_strings
from ..functions.text import character_ngrams, fallback_text, normalize_text
from ..operators import canonical, chunking, context, current, embedding, evaluation, fusion, graph, hybrid, integrity, lexical, vectors
from ..sources import knowledge, store
from ..sources.tables import table
from .lineage import cut, shared_dir, sweep

RETRIEVERS = ("lexical.chunk", "lexical.entity", "vector.chunk", "graph.one-hop")
BACKENDS = RETRIEVERS[:3]
DIMENSION, TOP = 48, 5


def _now(spark, d, name, key):
    return current.newest(table(spark, d, name), key)


def entities(spark, d):
    return _now(spark, d, "entities", "entity_path")


def chunks(spark, d):
    return _now(spark, d, "chunks", "chunk_id")


def relations(spark, d):
    return _now(spark, d, "relations", "relation_id")


def claims(spark, d):
    return _now(spark, d, "claims", "claim_key")


def references(spark, d):
    return _now(spark, d, "kb_references", "reference_id")


def cases(spark, d):
    return _now(spark, d, "eval_cases", "query_id")


def packets(spark, d):
    """Packets once each, with the plain spelling of their retriever."""
    return _now(spark, d, "evidence_packets", "packet_id").withColumn("retriever", F.lower(F.trim("retriever")))


def _hits(spark, d):
    return packets(spark, d).select("query_id", F.col("retriever").alias("backend"), "rank", "entity_path", F.lit(None).cast("string").alias("chunk_id"), "section", "text", "source_ids")


def _lexical_index(spark, d):
    return table(spark, d, "lexical_fields").filter("field_id IS NOT NULL").distinct(), table(spark, d, "lexical_ngrams").filter("field_id IS NOT NULL")


_INDEX_WEIGHTS = {f: lexical.ENTITY_WEIGHTS[f] for f in ("title", "aliases", "tags", "entity_type")}


def _queries(spark, d):
    return lexical.prepared_queries(cases(spark, d))


# Projections and functions


def entity_fallback_text(spark: SparkSession, d: str) -> DataFrame:
    text = fallback_text(F.col("content"), F.col("description"), F.col("title"))
    return entities(spark, d).select("entity_path", F.sha2(text, 256).alias("text_hash"), F.length(text).alias("n_chars"))


def normalized_titles(spark: SparkSession, d: str) -> DataFrame:
    return entities(spark, d).select("entity_path", normalize_text("title").alias("normalized_title"))


def char_ngrams(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "lexical_fields").filter("field_id IS NOT NULL").select("field_id", "normalized_value").distinct()
    return f.select("field_id", F.explode(character_ngrams(F.col("normalized_value"))).alias("gram")).distinct()


def gram_document_frequency(spark: SparkSession, d: str) -> DataFrame:
    fields, grams = _lexical_index(spark, d)
    held = grams.distinct().join(fields.select("field_id", "record_id").distinct(), "field_id").select("gram", "record_id").distinct()
    return held.groupBy("gram").agg(F.count("*").alias("n_records"))


def content_hash_mismatches(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    return c.filter("chunk_id IS NOT NULL").select("chunk_id", F.sha2("text", 256).alias("hash"), "content_hash").distinct().filter(~F.col("hash").eqNullSafe(F.col("content_hash"))).select("chunk_id")


def source_id_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = entities(spark, d).select("entity_path", F.posexplode(json_strings(F.col("source_ids_json"))).alias("position", "raw"))
    return raw.select("entity_path", "position", bare_source_id(F.col("raw")).alias("source_id")).filter("source_id <> ''")


def confidence_weights(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("confidence")
    return claims(spark, d).groupBy("confidence").agg(F.count("*").alias("n")).select("confidence", graph.confidence_weight(c).alias("weight"), graph.requires_hedging(c).alias("requires_hedging"), "n")


def claim_forms(spark: SparkSession, d: str) -> DataFrame:
    return integrity.claim_forms(claims(spark, d)).groupBy("form").agg(F.count("*").alias("n"))


# Lexical


def postings_candidates(spark: SparkSession, d: str) -> DataFrame:
    fields, grams = _lexical_index(spark, d)
    return lexical.candidates(_queries(spark, d), fields, grams)


def lexical_field_scores(spark: SparkSession, d: str) -> DataFrame:
    fields, grams = _lexical_index(spark, d)
    return lexical.field_shares(_queries(spark, d), fields, grams)


def lexical_entity_topk(spark: SparkSession, d: str) -> DataFrame:
    fields, grams = _lexical_index(spark, d)
    top = lexical.field_top_k(_queries(spark, d), fields, _INDEX_WEIGHTS, TOP, grams)
    return top.select("query_id", "rank", F.col("record_id").alias("entity_path"), F.round("score", 9).alias("score"))


def lexical_chunk_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = chunks(spark, d).withColumn("tags", json_strings(F.col("tags_json")))
    asked = cases(spark, d).select("query_id", "query_text")
    return lexical.scan_top_k(asked, rows, "chunk_id", lexical.CHUNK_WEIGHTS, TOP).select("query_id", "rank", F.col("record_id").alias("chunk_id"), F.round("score", 9).alias("score"))


# Chunks


def chunk_entities(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_entities(entities(spark, d)).select("chunk_id", "entity_path", "ordinal", "heading", "content_hash")


def chunk_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return chunks(spark, d).groupBy("entity_path").agg(F.count("*").alias("n"), F.min("ordinal").alias("first"), F.max("ordinal").alias("last"))


# Vectors


def _vector_search(spark: SparkSession, d: str, metric: str) -> DataFrame:
    rows = table(spark, d, "embeddings").filter("vec_id IS NOT NULL AND embedding IS NOT NULL").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("vector"))
    asked = rows.filter("key % 100 = 0").withColumnRenamed("key", "query_id")
    found = vectors.exact_top_k(asked, rows, 10, metric)
    return found.select("query_id", "rank", F.col("key").alias("vec_id"), F.round("score", 6).alias("score"))


def vector_cosine_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_search(spark, d, vectors.COSINE)


def vector_dot_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vector_search(spark, d, vectors.DOT)


def vector_compatibility(spark: SparkSession, d: str) -> DataFrame:
    return vectors.compatibility(table(spark, d, "vectors"), table(spark, d, "chunks"))


def vector_unusable(spark: SparkSession, d: str) -> DataFrame:
    return vectors.unusable(table(spark, d, "vectors").filter("chunk_id IS NOT NULL"), DIMENSION)


# Fusion


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_hits(spark, d), BACKENDS, 10).select("query_id", "rank", "entity_path", F.round("score", 12).alias("score"))


def rrf_weighted_cutoff(spark: SparkSession, d: str) -> DataFrame:
    config = fusion.RRFConfig(constant=30.0, backend_weights={"vector.chunk": 2.0, "lexical.entity": 0.0}, backend_cutoffs={"lexical.chunk": 5})
    return fusion.fuse(_hits(spark, d), BACKENDS, 10, config).select("query_id", "rank", "entity_path", F.round("score", 12).alias("score"))


def rrf_passage_choice(spark: SparkSession, d: str) -> DataFrame:
    return fusion.chosen_passages(fusion.best_hits(_hits(spark, d)), BACKENDS).select("query_id", "entity_path", "backend", "section", F.md5("text").alias("text_md5"))


def fallback_passages(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fallback_passages(chunks(spark, d)).select("entity_path", "chunk_id")


# Graph


def relation_merge(spark: SparkSession, d: str) -> DataFrame:
    m = graph.merged_relations(relations(spark, d))
    return m.select("source", "target", "predicate", "confidence", F.array_join("source_ids", "|").alias("source_ids"), "n")


def claim_merge(spark: SparkSession, d: str) -> DataFrame:
    return graph.merged_claims(table(spark, d, "claims").filter("claim_key IS NOT NULL").drop("loaded_at").distinct()).withColumn("source_ids", F.array_join("source_ids", "|"))


def _edges(spark, d, now=None):
    return graph.edges(relations(spark, d), claims(spark, d), entities(spark, d) if now is None else now)


def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("source", "target", "predicate", "kind", "is_value", "claim_ref", "status", "confidence")


def _policy(spark, d, config):
    p = graph.with_policy(_edges(spark, d), config)
    return p.select("source", "target", "predicate", "kind", "claim_ref", "confidence", F.round("factor", 9).alias("factor"), "affirmative", "requires_hedging")


def claim_policy(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, graph.GraphExpansionConfig())


def claim_opt_in(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, graph.GraphExpansionConfig(include_rejected=True, include_unknown=True))


def graph_predicate_filter(spark: SparkSession, d: str) -> DataFrame:
    return _policy(spark, d, graph.GraphExpansionConfig(predicates=("Cites", " related-to ")))


def seed_dedup(spark: SparkSession, d: str) -> DataFrame:
    hits = packets(spark, d).filter("score IS NOT NULL AND NOT isnan(score)").select("query_id", "entity_path", "rank", "score")
    return graph.distinct_seeds(hits).select("query_id", "entity_path", "rank", F.round("score", 9).alias("score"))


def _expanded(spark, d, k=TOP):
    config = graph.GraphExpansionConfig(enabled=True)
    now = entities(spark, d).select("entity_path", "entity_type")
    seeds = cut(fusion.fuse(_hits(spark, d), BACKENDS, k * config.seed_pool_factor).join(now, "entity_path"))
    found = graph.expand(graph.distinct_seeds(seeds), graph.with_policy(_edges(spark, d, now), config), config)
    types = now
    same = found.join(types.select(F.col("entity_path").alias("seed"), F.col("entity_type").alias("seed_type")), "seed").join(types.select(F.col("entity_path").alias("neighbor"), F.col("entity_type").alias("own_type")), "neighbor")
    return seeds, same.withColumn("same_type", F.col("seed_type").eqNullSafe(F.col("own_type"))), config


def graph_expand_one_hop(spark: SparkSession, d: str) -> DataFrame:
    found = _expanded(spark, d)[1]
    return found.select("query_id", "seed", "neighbor", "direction", "predicate", "kind", "claim_ref", F.array_join("source_ids", "|").alias("source_ids"), F.round("score", 9).alias("score"))


def value_claim_assertion(spark: SparkSession, d: str) -> DataFrame:
    return _expanded(spark, d)[1].filter("direction = 'assertion'").select("query_id", "neighbor", "predicate", "claim_ref", F.round("score", 9).alias("score"))


def diverse_select(spark: SparkSession, d: str) -> DataFrame:
    seeds, found, config = _expanded(spark, d)
    direct = seeds.select("query_id", "entity_path", F.lit("rrf.entity").alias("retriever"), "score", "rank")
    return graph.diverse(direct, found, TOP, config).select("query_id", "rank", "entity_path", "retriever", "claim_path", F.round("score", 9).alias("score"))


def applicable_assertions(spark: SparkSession, d: str) -> DataFrame:
    a = graph.assertions(relations(spark, d), claims(spark, d), entities(spark, d))
    return a.withColumn("source_ids", F.array_join("source_ids", "|"))


# Context


def _origins(spark, d):
    return graph.provenance(relations(spark, d), claims(spark, d), entities(spark, d))


def _joined(df):
    return df.withColumns({c: F.array_join(c, "|") for c in ("relation_source_ids", "claim_source_ids")})


def hit_assertions(spark: SparkSession, d: str) -> DataFrame:
    """Vector hits with what is asserted of their entities."""
    hits = packets(spark, d).filter("retriever = 'vector.chunk'").select("packet_id", "entity_path")
    return _joined(graph.with_provenance(hits, _origins(spark, d)))


def fused_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Fused hits with the source ids of the assertions that their vector hits carry."""
    hits, own = _hits(spark, d), _origins(spark, d)
    vector = F.col("backend") == "vector.chunk"
    both = graph.with_provenance(hits, own)
    none = F.array().cast("array<string>")
    both = both.withColumns({"relation_source_ids": F.when(vector, F.col("relation_source_ids")).otherwise(none), "claim_source_ids": F.when(vector, F.col("claim_source_ids")).otherwise(none), "requires_hedging": vector & F.col("requires_hedging")})
    return _joined(fusion.fuse(both, BACKENDS, 10).select("query_id", "rank", "entity_path", "relation_source_ids", "claim_source_ids", "requires_hedging"))


def context_packets(spark: SparkSession, d: str) -> DataFrame:
    """The packets of each query in order, with resolved references."""
    rows = packets(spark, d).filter("query_id IS NOT NULL").withColumn("requires_hedging", F.coalesce("requires_hedging", F.lit(False)))
    out = context.evidence_packets(rows, references(spark, d), strict=False)
    ids = F.array_join(F.transform("references", lambda r: F.concat(r["source_id"], F.when(r["resolved"], "+").otherwise("-"))), "|")
    return out.select("query_id", "position", "packet_id", "rank", "retriever", "entity_path", "section", F.md5("text").alias("text_md5"), ids.alias("references"), "confidence", "confidence_weight", "requires_hedging")


def context_references(spark: SparkSession, d: str) -> DataFrame:
    return context.resolved_sources(packets(spark, d), references(spark, d)).select("packet_id", "source_id", "title", "year", "resolved")


def context_unresolved(spark: SparkSession, d: str) -> DataFrame:
    return context.unresolved(packets(spark, d), references(spark, d))


def context_dedup(spark: SparkSession, d: str) -> DataFrame:
    return context.distinct_packets(packets(spark, d)).select("query_id", "packet_id", "entity_path", "rank")


# Evaluation


def _fused_hits(spark, d, retrievers):
    return fusion.fuse(_hits(spark, d), retrievers).select("query_id", "entity_path", "rank")


def _results(spark, d, retrievers=BACKENDS):
    hits = _hits(spark, d).filter(F.col("backend").isin(list(retrievers)))
    return evaluation.case_results(cases(spark, d), fusion.fuse(hits, retrievers).select("query_id", "entity_path", "rank"), TOP)


def eval_recall_mrr(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d)
    return r.select("query_id", F.round("recall_at_k", 9).alias("recall_at_k"), F.round("reciprocal_rank", 9).alias("reciprocal_rank"), "success", "n_missing")


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("recall_at_k", "mrr")})


def eval_totals(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.totals(_results(spark, d)))


def eval_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(evaluation.totals(_results(spark, d), ["kind"]))


def eval_compare(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.compare(_results(spark, d, ("lexical.chunk",)), _results(spark, d))


# All backends together


def _index(spark, d):
    """An index over the present rows, not stored."""
    tables = {"entities": entities(spark, d), "chunks": chunks(spark, d), "relations": relations(spark, d), "claims": claims(spark, d), "kb_references": references(spark, d)}
    tables = {n: cut(t) for n, t in tables.items()}
    arrays = {x.removesuffix("_json"): json_strings(F.col(x)) for x in ("tags_json", "aliases_json")}
    fields = lexical.field_values(tables["entities"].withColumns(arrays), "entity_path", "entity", lexical.ENTITY_WEIGHTS)
    tables["lexical_fields"] = fields.unionByName(lexical.field_values(tables["chunks"].withColumn("tags", arrays["tags"]), "chunk_id", "chunk", lexical.CHUNK_WEIGHTS))
    sweep(spark)
    tables["lexical_ngrams"] = lexical.postings(tables["lexical_fields"])  # searches take the grams of the fields themselves
    return store.Index(tables, {"ngram_size": 2})


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    """The evaluation queries through passages, entities and vectors, fused and expanded by one hop."""
    index = _index(spark, d)
    embedder = embedding.HashEmbedder(embedding.EmbeddingConfig("hash-embedder", "sha256", 8))
    stored = cut(embedding.embed_column(index.tables["chunks"], ["chunk_id", "content_hash"], "text", embedder, "document"))
    config = hybrid.RetrievalConfig("hybrid", TOP, graph=graph.GraphExpansionConfig(enabled=True))
    hits = hybrid.search(cases(spark, d).select("query_id", "query_text"), index, config, stored, embedder)
    return hits.select("query_id", "rank", "entity_path", "retriever", "chunk_id", "claim_path", F.round("score", 9).alias("score"))


# Sources and sinks


def parsed_documents(spark: SparkSession, d: str) -> DataFrame:
    """Entities and the claims with a path as Markdown documents, parsed again: what each document is, and what is wrong with it."""
    e = entities(spark, d)
    names = {"type": "entity_type", "title": "title", "description": "description", "timestamp": "timestamp"}
    lists = {"tags": "tags_json", "aliases": "aliases_json"}
    own = knowledge.document_text([*[F.col(c).alias(n) for n, c in names.items()], *[json_strings(F.col(c)).alias(n) for n, c in lists.items()]], F.col("content"))
    c = claims(spark, d).filter("claim_path IS NOT NULL")
    same = ("statement", "status", "confidence", "subject", "predicate", "target", "property", "value_json")
    stated = knowledge.document_text([F.lit("Claim").alias("type"), json_strings(F.col("source_ids_json")).alias("sources"), *[F.col(x).alias(x.removesuffix("_json")) for x in same]], F.lit(""))
    parsed = knowledge.parse_documents(e.select(F.col("entity_path").alias("path"), own.alias("text")).union(c.select("claim_path", stated)))
    kind = F.when(F.col("problem").isNotNull(), "problem").when(F.col("entity").isNotNull(), "entity").when(F.size("claims") > 0, "claim").otherwise("index")
    return parsed.select("path", kind.alias("kind"), F.col("entity.entity_type").alias("entity_type"), F.col("entity.title").alias("title"), F.size(json_strings(F.col("entity.tags_json"))).alias("n_tags"), F.md5("entity.content").alias("content_md5"))


def _stored(spark, d):
    """An index of the present rows, stored in the shared folder and opened again."""
    e, c = entities(spark, d), chunks(spark, d)
    snapshot = knowledge.Snapshot(e, relations(spark, d), claims(spark, d), references(spark, d), c)
    path = f"{shared_dir(spark).rstrip('/')}/loreweave/index-{uuid.uuid4().hex}"
    store.build_index(spark, snapshot, path)
    return store.open_index(spark, path), path


def stored_index(spark: SparkSession, d: str) -> DataFrame:
    """Rows and different keys of each table of a stored index."""
    index, _ = _stored(spark, d)
    keys = {**integrity.KEYS, "lexical_fields": "field_id", "lexical_ngrams": "gram"}
    parts = [index.tables[n].agg(F.count("*").alias("n_rows"), F.count_distinct(k).alias("n_keys")).select(F.lit(n).alias("table_name"), "n_rows", "n_keys") for n, k in keys.items()]
    return reduce(DataFrame.unionByName, parts)


#: The embedder of the query of stored vectors.
EMBEDDING = embedding.EmbeddingConfig("hash-embedder", "sha256", 8)


def stored_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of all chunks by the hash embedder, stored beside their index and opened again."""
    index, path = _stored(spark, d)
    config = embedding.VectorIndexConfig(EMBEDDING)
    found = embedding.embed_column(index.tables["chunks"], ["chunk_id", "content_hash"], "text", embedding.HashEmbedder(EMBEDDING), "document")
    store.build_vectors(spark, found, f"{path}-vectors", config, index)
    vectors_, _, _ = store.open_vectors(spark, f"{path}-vectors", index)
    return vectors_.select("chunk_id", "content_hash", *[F.round(F.col("vector")[i], 9).alias(f"v{i}") for i in range(EMBEDDING.dimension)])


# Integrity and manifests


def integrity_duplicates(spark: SparkSession, d: str) -> DataFrame:
    return integrity.duplicate_keys({n: (table(spark, d, n), k) for n, k in integrity.KEYS.items()})


def edge_sync_diff(spark: SparkSession, d: str) -> DataFrame:
    return integrity.edge_differences(relations(spark, d), claims(spark, d))


def manifest_counts(spark: SparkSession, d: str) -> DataFrame:
    return integrity.table_counts({n: table(spark, d, n) for n in integrity.TABLES})


def canonical_chunks(spark: SparkSession, d: str) -> DataFrame:
    return canonical.chunk_lines(chunks(spark, d))


def canonical_vectors(spark: SparkSession, d: str) -> DataFrame:
    return canonical.vector_lines(current.newest(table(spark, d, "vectors").withColumn("loaded_at", F.lit(None).cast("timestamp")), "chunk_id").drop("loaded_at"))


def inspect_entity(spark: SparkSession, d: str) -> DataFrame:
    """Each entity with the numbers of what refers to it."""
    own = entities(spark, d).select("entity_path", "entity_type")
    parts = chunks(spark, d).groupBy("entity_path").agg(F.count("*").alias("n_chunks"))
    out = relations(spark, d).filter("source_path IS NOT NULL").groupBy(F.col("source_path").alias("entity_path")).agg(F.count("*").alias("n_out"))
    back = relations(spark, d).filter("target IS NOT NULL").groupBy(F.col("target").alias("entity_path")).agg(F.count("*").alias("n_in"))
    stated = claims(spark, d).filter("subject IS NOT NULL").groupBy(F.col("subject").alias("entity_path")).agg(F.count("*").alias("n_claims"))
    for other in (parts, out, back, stated):
        own = own.join(other, "entity_path", "left")
    return own.na.fill(0)


NAMES = (
    "entity_fallback_text normalized_titles char_ngrams gram_document_frequency content_hash_mismatches source_id_normalize confidence_weights claim_forms "
    "postings_candidates lexical_field_scores lexical_entity_topk lexical_chunk_topk chunk_entities chunk_ordinals vector_cosine_topk vector_dot_topk "
    "vector_compatibility vector_unusable rrf_fuse rrf_weighted_cutoff rrf_passage_choice fallback_passages relation_merge claim_merge graph_edges claim_policy claim_opt_in "
    "graph_predicate_filter seed_dedup graph_expand_one_hop value_claim_assertion diverse_select hit_assertions fused_provenance context_packets context_references context_unresolved context_dedup "
    "eval_recall_mrr eval_totals eval_by_kind eval_compare integrity_duplicates edge_sync_diff manifest_counts inspect_entity hybrid_search applicable_assertions canonical_chunks canonical_vectors "
    "parsed_documents stored_index stored_vectors"
).split()


def queries() -> dict:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    from .retrieval_sql import SQL, folded_sql

    return SQL | folded_sql()
