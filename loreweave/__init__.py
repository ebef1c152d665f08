"""Loreweave: retrieval analytics over knowledge-base tables, written for Spark DataFrames."""

from importlib import import_module

__version__ = "0.1.0"

#: Public names by the module that has them; a module is imported when one of its names is asked for.
_NAMES = {
    "session": "local_session ship",
    "sources.knowledge": "Snapshot load_snapshot load_references load_cases markdown_documents parse_documents graph_tables snapshot_problems",
    "sources.store": "Index build_index open_index needs_rebuild build_vectors open_vectors vectors_match",
    "functions.text": "normalize_text normalize_value character_ngrams fallback_text",
    "functions.ids": "bare_source_id json_strings",
    "operators.chunking": "chunk_entities sections chunk_names",
    "operators.lexical": "field_values postings prepared_queries lexical_scores top_k scan_top_k",
    "operators.vectors": "exact_top_k compatibility unusable similarity",
    "operators.embedding": "EmbeddingConfig VectorIndexConfig HashEmbedder InjectedEmbedder embed_column",
    "operators.fusion": "RRFConfig fuse fallback_passages",
    "operators.graph": "GraphExpansionConfig edges with_policy expand diverse distinct_seeds assertions provenance with_provenance merged_relations",
    "operators.hybrid": "RetrievalConfig search",
    "operators.context": "ContextAssemblyError assemble evidence_packets distinct_packets unresolved",
    "operators.evaluation": "EvaluationProfile case_results evaluate totals compare admission",
    "operators.canonical": "chunk_lines vector_lines duplicate_ordinals",
    "operators.integrity": "duplicate_keys claim_forms edge_differences table_counts",
    "operators.orphans": "ForeignKey orphan_references orphan_report",
    "streaming.postings": "chunk_postings write_postings read_postings",
    "diagnostics": "SnapshotLoadError StoredIndexError VectorIndexError RetrievalError EvaluationLoadError EmbeddingError FusionError EvaluationError VectorRetrievalError UsageError diagnostic_code",
    "plans.lineage": "release",
}
_WHERE = {name: module for module, names in _NAMES.items() for name in names.split()}
__all__ = ["__version__", *sorted(_WHERE)]


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
