"""Command line: build, vector-build, search, context, inspect, eval. JSON out; exit code 0, or 2 with JSON on stderr."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from . import __version__
from .diagnostics import UsageError, diagnostic_code
from .operators import context, evaluation, hybrid
from .operators.embedding import EmbeddingConfig, HashEmbedder, VectorIndexConfig, digest, embed_column
from .operators.graph import GraphExpansionConfig
from .session import local_session, ship
from .sources import knowledge, store

SCHEMA_VERSION = 1


class Parser(argparse.ArgumentParser):
    def error(self, message: str):
        raise UsageError(message)


def parser() -> argparse.ArgumentParser:
    p = Parser(prog="loreweave", description="Retrieval over a knowledge base")
    commands = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple, searches: bool = False) -> None:
        c = commands.add_parser(name)
        c.add_argument("--index", "--index-dir", dest="index", required=True)
        c.add_argument("--pretty", action="store_true")
        for flags, settings in options:
            c.add_argument(*flags, **settings)
        if searches:
            c.add_argument("--mode", choices=hybrid.MODES, default="lexical")
            c.add_argument("--vector-index")
            c.add_argument("--top-k", "--k", dest="top_k", type=int, default=5)
            c.add_argument("--expand-graph", action="store_true")
            c.add_argument("--graph-predicate", action="append")
            c.add_argument("--include-rejected-claims", action="store_true")
            c.add_argument("--include-unknown-claims", action="store_true")

    command(
        "build", (["--content-root"], {"required": True}), (["--graph", "--graph-path"], {"dest": "graph", "required": True}), (["--references", "--references-path"], {"dest": "references", "required": True}),
        (["--eval", "--eval-path"], {"dest": "eval"}), (["--ngram-size"], {"type": int, "default": 2}),
    )
    command("vector-build", (["--vector-index"], {"required": True}), (["--dimension"], {"type": int, "default": 8}), (["--metric"], {"choices": ("cosine", "dot"), "default": "cosine"}))
    command("search", (["query"], {}), searches=True)
    command("context", (["query"], {}), (["--non-strict"], {"action": "store_true"}), searches=True)
    command("inspect", (["entity_path"], {}), (["--vector-index"], {}))
    command("eval", (["--eval", "--eval-path"], {"dest": "eval"}), searches=True)
    return p


def _config(args) -> hybrid.RetrievalConfig:
    predicates = tuple(args.graph_predicate) if args.graph_predicate else None
    g = GraphExpansionConfig(args.expand_graph, predicates, args.include_rejected_claims, args.include_unknown_claims)
    return hybrid.RetrievalConfig(args.mode, args.top_k, graph=g)


def _search(spark, args, index: store.Index, rows: list[tuple]):
    queries = spark.createDataFrame(rows, "query_id string, query_text string")
    config = _config(args)
    if config.mode == "lexical":
        return hybrid.search(queries, index, config), config, None
    if not args.vector_index:
        raise UsageError(f"mode {config.mode} needs --vector-index")
    stored, manifest, own = store.open_vectors(spark, args.vector_index, index)
    return hybrid.search(queries, index, config, stored, HashEmbedder(own.embedding), own.similarity_metric), config, manifest


def run(args, spark) -> dict:
    if args.command == "build":
        snapshot = knowledge.load_snapshot(spark, args.content_root, args.graph, args.references, args.eval)
        return {"index": args.index, "manifest": store.build_index(spark, snapshot, args.index, args.ngram_size)}
    index = store.open_index(spark, args.index)
    if args.command == "vector-build":
        config = VectorIndexConfig(EmbeddingConfig("hash-embedder", "sha256", args.dimension), args.metric)
        vectors = embed_column(index.tables["chunks"], ["chunk_id", "content_hash"], "text", HashEmbedder(config.embedding), "document")
        return {"vector_index": args.vector_index, "manifest": store.build_vectors(spark, vectors, args.vector_index, config, index)}
    if args.command == "inspect":
        own = index.tables["entities"].filter(F.col("entity_path") == args.entity_path).drop("loaded_at", "deleted_at").first()
        if own is None:
            raise LookupError(f"no entity {args.entity_path!r}")
        parts = index.tables["chunks"].filter(F.col("entity_path") == args.entity_path).drop("loaded_at").orderBy("ordinal")
        out = {"entity": own.asDict(True), "chunks": [r.asDict(True) for r in parts.collect()]}
        return out | ({"vector_manifest": store.open_vectors(spark, args.vector_index, index)[1]} if args.vector_index else {})
    if args.command == "eval":
        path = args.eval or index.manifest["source_metadata"].get("eval_path")
        if not path:
            raise UsageError("eval needs --eval")
        rows = knowledge.load_cases(path)
        hits, config, manifest = _search(spark, args, index, [(r["query_id"], r["query_text"]) for r in rows])
        cases = spark.createDataFrame([(r["query_id"], r["expected_json"], r["kind"], r["gap"]) for r in rows], "query_id string, expected_json string, kind string, gap boolean")
        results = evaluation.case_results(cases, evaluation.evidence_paths(evaluation.ranked_again(hits, args.top_k)), args.top_k).cache()
        total = evaluation.totals(results).first()
        by_kind = {r.kind: {"count": r.n_cases, "recall_at_k": r.recall_at_k, "mrr": r.mrr, "successes": r.n_success} for r in evaluation.totals(results, ["kind"]).collect()}
        out = {
            "k": args.top_k, "recall_at_k": total.recall_at_k, "mrr": total.mrr, "successes": total.n_success, "by_kind": by_kind, "results": [r.asDict(True) for r in results.orderBy("query_id").collect()], "retrieval_mode": config.mode,
            "fusion_config": config.policy(), "evaluation_case_hash": digest({"cases": rows}), "snapshot_hash": index.manifest["source_hash"], "package_identity": f"loreweave {__version__}",
        }
        return out | ({k: manifest[k] for k in ("embedding_fingerprint", "vector_index_fingerprint")} if manifest else {})
    if not args.query.strip():
        raise UsageError("query must not be empty")
    hits, config, _ = _search(spark, args, index, [("q", args.query)])
    if args.command == "search":
        return {"query": args.query, "results": [r.asDict(True) for r in hits.drop("query_id").orderBy("rank").collect()]}
    packets = context.evidence_packets(hits.withColumn("packet_id", F.col("rank")), index.tables["kb_references"], strict=not args.non_strict)
    rows = [r.asDict(True) for r in packets.drop("query_id", "packet_id").orderBy("position").collect()]
    missing = sorted({s["source_id"] for r in rows for s in r["references"] if not s["resolved"]})
    return {"query": args.query, "packets": rows} | ({"unresolved": missing} if args.non_strict else {})


def migrate(payload: dict) -> dict:
    """A payload of an earlier schema in the present one."""
    version = payload.get("schema_version", 0)
    if version not in (0, SCHEMA_VERSION):
        raise ValueError(f"unknown schema version {version!r}")
    return {**payload, "schema_version": SCHEMA_VERSION}


def main(argv: list[str] | None = None, spark=None) -> int:
    pretty = 2 if "--pretty" in (argv or sys.argv) else None
    try:
        args = parser().parse_args(argv)
        spark = spark or local_session()
        ship(spark)
        out = {"schema_version": SCHEMA_VERSION, "command": args.command, **run(args, spark)}
        print(json.dumps(out, ensure_ascii=False, sort_keys=True, indent=pretty, default=str))
        return 0
    except Exception as e:  # every failure has a code
        error = {"schema_version": SCHEMA_VERSION, "error": {"code": diagnostic_code(e), "message": str(e).splitlines()[0] if str(e) else type(e).__name__}}
        print(json.dumps(error, ensure_ascii=False, sort_keys=True, indent=pretty), file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
