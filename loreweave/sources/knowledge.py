"""A knowledge base from its source files: Markdown with front matter, an exported graph, references, evaluation cases.

The Markdown tree is read and parsed by all executors; only the files of configuration size (references and cases) are parsed
on the driver. What comes out are tables of the same columns as the stored ones, with problems as rows of their own.
"""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import EvaluationLoadError, SnapshotLoadError
from ..plans.lineage import cut

ENTITY = "entity_path string, entity_type string, title string, description string, tags_json string, aliases_json string, source_ids_json string, content string, timestamp string, metadata_json string"
RELATION = "predicate string, target string, source_ids_json string, source_path string, metadata_json string, confidence string, owner_source_ids_json string"
CLAIM = "claim_id string, statement string, status string, confidence string, source_ids_json string, subject string, predicate string, target string, metadata_json string, claim_path string, property string, value_json string"
PARSED = f"path string, problem string, entity struct<{ENTITY.replace(' string', ': string')}>, relations array<struct<{RELATION.replace(' string', ': string')}>>, claims array<struct<{CLAIM.replace(' string', ': string')}>>"
TIMES = {"loaded_at": "timestamp", "deleted_at": "timestamp"}


@dataclass
class Snapshot:
    """The tables of a knowledge base."""

    entities: DataFrame
    relations: DataFrame
    claims: DataFrame
    kb_references: DataFrame
    chunks: DataFrame | None = None
    metadata: dict = field(default_factory=dict)

    def tables(self) -> dict[str, DataFrame]:
        names = ("entities", "chunks", "relations", "claims", "kb_references")
        return {n: getattr(self, n) for n in names if getattr(self, n) is not None}


def canonical(value) -> str:
    """Canonical JSON: sorted keys, no spaces; dates as ISO text, UTC as Z, sets sorted. Infinite numbers are errors."""

    def plain(x):
        if isinstance(x, dict):
            if any(not isinstance(k, str) for k in x):
                raise ValueError("keys must be strings")
            return {k: plain(v) for k, v in x.items()}
        if isinstance(x, (list, tuple)):
            return [plain(v) for v in x]
        if isinstance(x, (set, frozenset)):
            return sorted((plain(v) for v in x), key=canonical)
        if isinstance(x, dt.datetime):
            return x.isoformat().replace("+00:00", "Z")
        if isinstance(x, dt.date):
            return x.isoformat()
        return x.as_posix() if isinstance(x, Path) else x

    return json.dumps(plain(value), ensure_ascii=False, sort_keys=True, separators=(",", ":"), allow_nan=False)


def front_matter(text: str) -> tuple[dict, str]:
    """The mapping between the first two fence lines of a document, and its body."""
    lines = text.removeprefix("﻿").splitlines()
    if not lines or lines[0].strip() != "---":
        raise ValueError("missing front matter")
    end = next((i for i, line in enumerate(lines[1:], 1) if line.strip() in ("---", "...")), None)
    if end is None:
        raise ValueError("unclosed front matter")
    data = yaml.safe_load("\n".join(lines[1:end]))
    if not isinstance(data, dict):
        raise ValueError("front matter must be a mapping")
    return data, "\n".join(lines[end + 1 :]) + ("\n" if text.endswith("\n") and lines[end + 1 :] else "")


def _first(record: dict, *names: str, required: bool = False, what: str = ""):
    """The value of the first name that is there; those that disagree are an error, as is a blank one that is required."""
    present = [record[n] for n in names if n in record]
    if any(v != present[0] for v in present[1:]):
        raise ValueError(f"conflicting values of {', '.join(names)}")
    value = present[0] if present else None
    if required and (not isinstance(value, str) or not value.strip()):
        raise ValueError(f"{what or names[0]} must be a non-empty string")
    return value


def _strings(value, what: str) -> list[str]:
    if value is None:
        return []
    if not isinstance(value, (list, tuple)) or any(not isinstance(x, str) for x in value):
        raise ValueError(f"{what} must be a list of strings")
    return list(value)


def bare(source_id: str) -> str:
    """A source id without its prefix and white space; an empty one is an error."""
    s = source_id.strip()
    s = s[4:].strip() if s[:4].casefold() == "ref:" else s
    if not s:
        raise ValueError("source id must not be empty")
    return s


def _sources(record: dict) -> list[str]:
    return [bare(x) for x in _strings(_first(record, "sources", "source_ids"), "sources")]


def _rest(record: dict, *known: str) -> str:
    return canonical({k: v for k, v in record.items() if k not in known})


def relation_row(record: dict, owner: str | None, owner_sources: list[str]) -> dict:
    if not isinstance(record, dict):
        raise ValueError("relations must contain mappings")
    source = _first(record, "source", "source_path", "from")
    if owner is not None and source not in (None, owner):
        raise ValueError(f"relation source {source!r} is not its owner")
    confidence = record.get("confidence")
    if confidence is not None and (not isinstance(confidence, str) or not confidence.strip()):
        raise ValueError("confidence must be a non-empty string")
    names = ("predicate", "relation", "type", "target", "to", "source", "source_path", "from", "source_ids", "sources", "owner_source_ids", "confidence")
    return {
        "predicate": _first(record, "predicate", "relation", "type", required=True), "target": _first(record, "target", "to", required=True), "source_ids_json": canonical(_sources(record)),
        "source_path": owner or source, "metadata_json": _rest(record, *names), "confidence": confidence, "owner_source_ids_json": canonical(owner_sources),
    }


def claim_row(record: dict, path: str | None, exported: bool) -> dict:
    """A claim; one with a file of its own (``exported``) needs path, status, confidence and sources."""
    if not isinstance(record, dict):
        raise ValueError("claims must contain mappings")
    path = _first(record, "path", "claim_path") or path
    sources = _sources(record)
    if exported:
        for name in ("status", "confidence"):
            _first(record, name, required=True)
        if not str(path).startswith("/") or not sources:
            raise ValueError("a claim needs a path from the root and sources")
    target = _first(record, "object", "target")
    relation = record.get("predicate") is not None and target is not None
    value = record.get("property") is not None
    if relation and value or (not relation and record.get("predicate") is not None) or (not value and record.get("value") is not None):
        raise ValueError("a claim has a predicate and an object, or a property and a value")
    if (relation or value) and not record.get("subject"):
        raise ValueError("a claim with a relation or a value needs a subject")
    names = ("path", "claim_path", "id", "claim_id", "statement", "status", "confidence", "sources", "source_ids", "subject", "predicate", "object", "target", "property", "value")
    return {
        "claim_id": _first(record, "claim_id", "id"), "statement": record.get("statement"), "status": record.get("status"), "confidence": record.get("confidence"), "source_ids_json": canonical(sources),
        "subject": record.get("subject"), "predicate": record.get("predicate"), "target": target, "metadata_json": _rest(record, *names), "claim_path": path, "property": record.get("property"),
        "value_json": None if record.get("value") is None else canonical(record["value"]),
    }


def parse_document(path: str, text: str) -> dict:
    """The entity with its relations and claims, or the claim, of one Markdown file; an index page has neither."""
    data, body = front_matter(text)
    kind = _first(data, "type", "entity_type", required=True)
    if kind == "Index":
        return {"path": path}
    if kind == "Claim":
        return {"path": path, "claims": [claim_row({**data, "path": path}, path, True)]}
    if _first(data, "path", "entity_path") not in (None, path):
        raise ValueError("declared path differs from the file's")
    for name in ("tags", "timestamp"):
        if name not in data:
            raise ValueError(f"{name} is missing")
    sources = _sources(data)
    names = ("type", "entity_type", "title", "description", "tags", "sources", "source_ids", "aliases", "relations", "claims", "path", "entity_path", "timestamp")
    stamp = canonical(data["timestamp"])
    entity = {
        "entity_path": path, "entity_type": kind, "title": _first(data, "title", required=True), "description": _first(data, "description", required=True), "tags_json": canonical(_strings(data["tags"], "tags")),
        "aliases_json": canonical(_strings(data.get("aliases"), "aliases")), "source_ids_json": canonical(sources), "content": body, "timestamp": json.loads(stamp) if stamp.startswith('"') else stamp, "metadata_json": _rest(data, *names),
    }
    relations, claims = (data.get(n) or [] for n in ("relations", "claims"))
    if not isinstance(relations, list) or not isinstance(claims, list):
        raise ValueError("relations and claims must be lists")
    return {"path": path, "entity": entity, "relations": [relation_row(r, path, sources) for r in relations], "claims": [claim_row(c, path, False) for c in claims]}


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for path, text in zip(b["path"], b["text"]):
            try:
                rows.append(json.dumps(parse_document(path, text), ensure_ascii=False))
            except (ValueError, TypeError, yaml.YAMLError) as e:
                rows.append(json.dumps({"path": path, "problem": str(e).splitlines()[0]}, ensure_ascii=False))
        yield pd.DataFrame({"json": rows})


def markdown_documents(spark: SparkSession, root: str | Path) -> DataFrame:
    """One parsed row a Markdown file below ``root``; its path is the one from there, with a leading slash."""
    base = Path(root).resolve().as_uri() if "://" not in str(root) else str(root).rstrip("/")
    files = spark.read.text(base, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    # Both are URIs: the root's part is cut off and escapes are undone.
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B"))
    files = files.select(F.regexp_replace(name, f"^.*?\\Q{base.partition('://')[2]}\\E", "").alias("path"), F.col("value").alias("text"))
    return parse_documents(files)


def parse_documents(files: DataFrame) -> DataFrame:
    """(path, problem, entity, relations, claims) of each Markdown file (path, text). No shuffle."""
    return files.select("path", "text").mapInPandas(_parse, "json string").select(F.from_json("json", PARSED).alias("d")).select("d.*")


def document_text(fields: list, body) -> Column:
    """A Markdown document of front matter and body. The front matter is JSON, which YAML contains; null fields are left out."""
    return F.concat(F.lit("---\n"), F.to_json(F.struct(*fields)), F.lit("\n---\n"), F.coalesce(body, F.lit("")))


def load_references(path: str | Path) -> list[dict]:
    """Rows of a references file, by id: a mapping of ids, or one of that name in a wrapper."""
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if isinstance(value, dict) and set(value) == {"references"}:
        value = value["references"]
    if not isinstance(value, dict):
        raise SnapshotLoadError(f"{path}: references must be a mapping of ids")
    rows = []
    for key, record in sorted(value.items(), key=lambda kv: str(kv[0])):
        try:
            if not isinstance(key, str) or not isinstance(record, dict):
                raise ValueError("ids must be strings, and records mappings")
            kind = _first(record, "type", required=True)
            authors = record.get("authors") or []
            authors = [authors] if isinstance(authors, str) else _strings(authors, "authors")
            author, year, url = record.get("author"), record.get("year"), record.get("url")
            if author is not None and authors and authors != [author]:
                raise ValueError("author and authors disagree")
            if isinstance(year, bool) or not (year is None or isinstance(year, int) or (isinstance(year, str) and year.isascii() and year.isdecimal())):
                raise ValueError("year must be a whole number")
            if kind.casefold() == "web" and not url:
                raise ValueError("a web reference needs a url")
            rows.append({"reference_id": bare(key), "title": _first(record, "title", required=True), "authors_json": canonical(authors or ([author] if author else [])), "year": None if year is None else int(year), "url": url, "metadata_json": _rest(record, "title", "author", "authors", "year", "url"), "author": author})
        except ValueError as e:
            raise SnapshotLoadError(f"{path}: reference {key!r}: {e}") from e
    if len({r["reference_id"] for r in rows}) != len(rows):
        raise SnapshotLoadError(f"{path}: two references have the same id")
    return rows


def load_cases(path: str | Path) -> list[dict]:
    """Rows of an evaluation file: a list, or one in a wrapper."""
    value = yaml.safe_load(Path(path).read_text(encoding="utf-8-sig"))
    if isinstance(value, dict):
        wrappers = [k for k in ("cases", "evals", "queries") if k in value]
        value = value[wrappers[0]] if len(wrappers) == 1 else None
    if not isinstance(value, list) or not value:
        raise EvaluationLoadError(f"{path}: evaluation cases must be a list that isn't empty")
    rows = []
    for i, record in enumerate(value):
        try:
            if not isinstance(record, dict):
                raise ValueError("must be a mapping")
            evidence = _strings(_first(record, "evidence", "expected_paths", "expected_evidence_paths", "expected_entities", "evidence_paths"), "evidence")
            known = ("id", "case_id", "name", "query", "question", "expected", "evidence", "expected_paths", "expected_evidence_paths", "expected_entities", "evidence_paths", "history", "kind", "query_kind", "gap")
            rows.append({"query_id": _first(record, "id", "case_id", "name", required=True), "query_text": _first(record, "query", "question", required=True), "expected_json": canonical(evidence), "answer": _first(record, "expected", required=True), "kind": _first(record, "kind", "query_kind"), "gap": record.get("gap") not in (None, False), "history_json": canonical(record.get("history") or []), "metadata_json": _rest(record, *known)})
        except ValueError as e:
            raise EvaluationLoadError(f"{path}: case {i}: {e}") from e
    if len({r["query_id"] for r in rows}) != len(rows):
        raise EvaluationLoadError(f"{path}: two cases have the same id")
    return rows


#: The parts of an exported graph that must be there, and those that may.
GRAPH_PARTS, OTHER_PARTS = {"nodes": "array<string>", "edges": "array<string>", "claims": "array<string>"}, {"views": "array<string>", "predicates": "map<string, string>"}


def _rows_of(make, schema: str):
    """A function for mapInPandas that makes one row of each JSON text, or a row with what is wrong with it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for text in b["part"]:
                try:
                    out.append(json.dumps({"row": make(json.loads(text))}, ensure_ascii=False))
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    out.append(json.dumps({"problem": f"{type(e).__name__}: {e}"}))
            yield pd.DataFrame({"json": out})

    return run


def _node_row(n: dict) -> dict:
    return {"entity_path": n["path"], "entity_type": n["type"], "title": n["title"], "description": n.get("description"), "tags_json": canonical(n.get("tags") or [])}


def graph_tables(spark: SparkSession, path: str | Path) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, relations and claims of an exported graph, which executors read and parse; the driver sees the names of its parts only."""
    where = str(path) if "://" in str(path) else Path(path).resolve().as_uri()
    file = spark.read.text(where, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("value"))
    shape = ", ".join(f"{k} {t}" for k, t in (GRAPH_PARTS | OTHER_PARTS).items())
    parts = cut(file.select(F.json_object_keys("value").alias("names"), F.from_json("value", shape).alias("g")))
    checks = [F.col(f"g.{k}").isNotNull() | ~F.array_contains("names", k) for k in (*GRAPH_PARTS, *OTHER_PARTS)]
    first = parts.select("names", *[c.alias(f"fits_{i}") for i, c in enumerate(checks)]).first()
    if first is None or first.names is None or not set(GRAPH_PARTS) <= set(first.names) <= {*GRAPH_PARTS, *OTHER_PARTS}:
        raise SnapshotLoadError(f"{path}: a graph has nodes, edges and claims")
    if not all(first[f"fits_{i}"] for i in range(len(checks))):
        raise SnapshotLoadError(f"{path}: a part of the graph has the wrong shape")
    node = "entity_path string, entity_type string, title string, description string, tags_json string"
    out = []
    for part, schema, make in (("nodes", node, _node_row), ("edges", RELATION, lambda r: relation_row(r, None, [])), ("claims", CLAIM, lambda c: claim_row(c, None, True))):
        rows = parts.select(F.explode(f"g.{part}").alias("part")).repartition(spark.sparkContext.defaultParallelism).mapInPandas(_rows_of(make, schema), "json string")
        rows = cut(rows.select(F.from_json("json", f"problem string, row struct<{schema.replace(' string', ': string')}>").alias("d")).select("d.*"))
        if bad := rows.filter("problem IS NOT NULL").first():
            raise SnapshotLoadError(f"{path}: {part}: {bad.problem}")
        out.append(rows.select("row.*"))
    return tuple(out)


def snapshot_problems(entities: DataFrame, relations: DataFrame, claims: DataFrame, nodes: DataFrame, graph_relations: DataFrame, graph_claims: DataFrame) -> DataFrame:
    """(path, problem): where the graph and the Markdown disagree, keys repeat, or references lead nowhere."""
    own = ["entity_type", "title", "description", "tags_json"]
    both = nodes.alias("n").join(entities.alias("e"), "entity_path", "left")
    differs = F.greatest(*[(~F.col(f"n.{c}").eqNullSafe(F.col(f"e.{c}"))).cast("int") for c in own]) == 1
    found = [both.filter(differs).select("entity_path", F.when(F.col("e.title").isNull(), "graph node without a document").otherwise("graph node differs from its document"))]
    found.append(nodes.groupBy("entity_path").count().filter("count > 1").select("entity_path", F.lit("graph node stands twice")))
    key = ["source_path", "predicate", "target", "confidence"]
    for name, rows in (("document", relations), ("graph", graph_relations)):
        found.append(rows.groupBy(*key[:3]).count().filter("count > 1").select("source_path", F.lit(f"{name} relation stands twice")))
    ca, cb = (r.select(*key).exceptAll(s.select(*key)) for r, s in ((relations, graph_relations), (graph_relations, relations)))
    found += [ca.select("source_path", F.lit("relation is missing in the graph")), cb.select("source_path", F.lit("graph relation is in no document"))]
    key = ["claim_path", "subject", "status", "confidence", "source_ids_json", "predicate", "target", "property", "value_json"]
    ca, cb = (r.select(*key).exceptAll(s.select(*key)) for r, s in ((claims, graph_claims), (graph_claims, claims)))
    found += [ca.select("claim_path", F.lit("claim is missing in the graph")), cb.select("claim_path", F.lit("graph claim is in no document"))]
    paths = entities.select(F.col("entity_path").alias("p"))
    for rows, column, path in ((relations, "target", "source_path"), (claims, "subject", "claim_path"), (claims, "target", "claim_path")):
        found.append(rows.filter(F.col(column).startswith("/")).join(paths, F.col(column) == F.col("p"), "left_anti").select(path, F.lit(f"{column} is no entity")))
    out = found[0].toDF("path", "problem")
    for f in found[1:]:
        out = out.union(f.toDF("path", "problem"))
    return out


def load_snapshot(spark: SparkSession, content_root, graph_path, references_path, eval_path=None) -> Snapshot:
    """The snapshot of a knowledge base; the first problem in path order is a `SnapshotLoadError`."""
    parsed = cut(markdown_documents(spark, content_root))  # not cached: the files may change
    bad = parsed.filter("problem IS NOT NULL").orderBy("path").first()
    if bad:
        raise SnapshotLoadError(f"{bad.path}: {bad.problem}")
    entities = parsed.filter("entity IS NOT NULL").select("entity.*")
    if entities.isEmpty():
        raise SnapshotLoadError(f"{content_root}: no entities")
    relations = parsed.select(F.explode("relations").alias("r")).select("r.*")
    exported = parsed.filter("entity IS NULL").select(F.explode("claims").alias("c")).select("c.*")
    nested = parsed.filter("entity IS NOT NULL").select(F.explode("claims").alias("c")).select("c.*")
    nodes, graph_relations, graph_claims = graph_tables(spark, graph_path)
    bad = snapshot_problems(entities, relations, exported, nodes, graph_relations, graph_claims).orderBy("path", "problem").first()
    if bad:
        raise SnapshotLoadError(f"{bad.path}: {bad.problem}")
    refs = spark.createDataFrame(load_references(references_path), "reference_id string, title string, authors_json string, year int, url string, metadata_json string, author string")
    never = {c: F.lit(None).cast(t) for c, t in TIMES.items()}
    loaded = {"loaded_at": never["loaded_at"]}
    identity = F.xxhash64("source_path", "predicate", "target", F.coalesce("confidence", F.lit("")), "source_ids_json")
    claims = exported.unionByName(nested)
    return Snapshot(
        entities.withColumns(never), relations.withColumn("relation_id", identity).withColumns(loaded),
        claims.withColumn("claim_key", F.concat_ws("|", "claim_path", "claim_id", "subject", F.coalesce("predicate", "property"), "target")).withColumns(loaded),
        refs.withColumns(never), metadata={} if eval_path is None else {"eval_path": str(eval_path)},
    )
