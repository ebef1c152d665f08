"""Stored indexes: Parquet tables in a new version folder, a manifest, and a pointer that is moved last.

A build that fails leaves the version that the pointer names, so what was readable stays readable.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..diagnostics import StoredIndexError, VectorIndexError
from ..functions.ids import json_strings
from ..operators import chunking, lexical
from ..operators.embedding import EmbeddingConfig, VectorIndexConfig, digest
from .knowledge import Snapshot

FORMAT, VERSION = "loreweave-index", 1
VECTOR_FORMAT = "loreweave-vectors"
TABLES = ("entities", "chunks", "relations", "claims", "kb_references", "lexical_fields", "lexical_ngrams")


def _file(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _file(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Writes beside the file and renames, so that a reader sees the old text or the new."""
    fs, p = _file(spark, path)
    beside = _file(spark, f"{path}.{uuid.uuid4().hex}")[1]
    stream = fs.create(beside, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    context = spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename"), 1)
    options[0] = getattr(spark.sparkContext._jvm.org.apache.hadoop.fs, "Options$Rename").OVERWRITE
    context.rename(beside, p, options)


def content_digest(df: DataFrame) -> str:
    """A digest of all rows that doesn't depend on their order: row hashes added up in parts by the tasks."""
    row = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in range(4)]
    sums = df.select(row.alias("h")).agg(F.count("*").alias("n"), *parts).first()
    return digest({k: str(v) for k, v in sums.asDict().items()})


@dataclass
class Index:
    """An open index: its tables and its manifest."""

    tables: dict[str, DataFrame]
    manifest: dict


def prepared(snapshot: Snapshot) -> dict[str, DataFrame]:
    """The tables of a snapshot, chunked from its entities if it has no chunks."""
    tables = snapshot.tables()
    if "chunks" not in tables:
        own = snapshot.entities.select("entity_path", "entity_type", "title", "tags_json", "source_ids_json", "content")
        tables["chunks"] = chunking.chunk_entities(own).withColumns({"metadata_json": F.lit("{}"), "loaded_at": F.lit(None).cast("timestamp")})
    return tables


def identities(tables: dict[str, DataFrame]) -> dict[str, str]:
    """source_hash and chunk_hash of the tables of a snapshot."""
    sources = {n: content_digest(tables[n]) for n in ("entities", "relations", "claims", "kb_references")}
    return {"source_hash": digest(sources), "chunk_hash": content_digest(tables["chunks"])}


def _save(spark: SparkSession, path: str, tables: dict[str, DataFrame], manifest: dict, sort: dict[str, list[str]]) -> dict:
    version = f"{path.rstrip('/')}/versions/{uuid.uuid4().hex}"
    counts = {}
    for name, df in tables.items():
        (df.sortWithinPartitions(*sort[name]) if name in sort else df).write.parquet(f"{version}/{name}.parquet")
        counts[name] = spark.read.parquet(f"{version}/{name}.parquet").count()
    manifest = {**manifest, "counts": counts}
    _write(spark, f"{version}/manifest.json", json.dumps(manifest, ensure_ascii=False, sort_keys=True))
    _write(spark, f"{path.rstrip('/')}/CURRENT", version)
    return manifest


def _open(spark: SparkSession, path: str, wanted: str, error: type[ValueError]) -> tuple[str, dict]:
    version = _read(spark, f"{path.rstrip('/')}/CURRENT")
    manifest = json.loads(_read(spark, f"{version}/manifest.json") or "null") if version else None
    if not manifest:
        raise error(f"{path}: there is no index")
    if manifest.get("format") != wanted or manifest.get("version") != VERSION:
        raise error(f"{path}: format {manifest.get('format')!r} {manifest.get('version')!r} isn't {wanted!r} {VERSION}")
    for name, n in manifest["counts"].items():
        if _read_count(spark, f"{version}/{name}.parquet") != n:
            raise error(f"{path}: {name} doesn't have the {n} rows of its manifest")
    return version, manifest


def _read_count(spark: SparkSession, path: str) -> int | None:
    fs, p = _file(spark, path)
    return spark.read.parquet(path).count() if fs.exists(p) else None


def build_index(spark: SparkSession, snapshot: Snapshot, path: str, ngram_size: int = 2) -> dict:
    """Writes all tables and the postings of chunk and entity fields, sorted by gram in each file; the manifest."""
    tables = prepared(snapshot)
    ids = identities(tables)
    lists = {c.removesuffix("_json"): json_strings(F.col(c)) for c in ("tags_json", "aliases_json")}
    entity_fields = lexical.field_values(tables["entities"].withColumns(lists), "entity_path", "entity", lexical.ENTITY_WEIGHTS)
    chunk_fields = lexical.field_values(tables["chunks"].withColumn("tags", lists["tags"]), "chunk_id", "chunk", lexical.CHUNK_WEIGHTS)
    fields = entity_fields.unionByName(chunk_fields)
    tables |= {"lexical_fields": fields, "lexical_ngrams": lexical.postings(fields, ngram_size)}
    manifest = {"format": FORMAT, "version": VERSION, "ngram_size": ngram_size, **ids, "source_metadata": snapshot.metadata}
    return _save(spark, path, tables, manifest, {"lexical_ngrams": ["gram"]})


def open_index(spark: SparkSession, path: str, verify: bool = False) -> Index:
    """An index whose format and row counts are as its manifest says; with ``verify``, its contents too."""
    version, manifest = _open(spark, path, FORMAT, StoredIndexError)
    index = Index({n: spark.read.parquet(f"{version}/{n}.parquet") for n in TABLES}, manifest)
    if verify and any(manifest[k] != v for k, v in identities(index.tables).items()):
        raise StoredIndexError(f"{path}: the tables aren't those of the manifest")
    return index


def needs_rebuild(spark: SparkSession, snapshot: Snapshot, path: str) -> bool:
    """Does the stored index differ from the snapshot, or is there none?"""
    try:
        manifest = open_index(spark, path).manifest
    except StoredIndexError:
        return True
    ids = identities(prepared(snapshot))
    return any(manifest[k] != v for k, v in ids.items())


def build_vectors(spark: SparkSession, vectors: DataFrame, path: str, config: VectorIndexConfig, index: Index) -> dict:
    """Writes (chunk_id, content_hash, vector), each chunk once and all of the embedder's dimension."""
    bad = _unusable(vectors, config.embedding.dimension).first()
    twice = vectors.groupBy("chunk_id").count().filter("count > 1").first()
    if bad or twice:
        raise VectorIndexError(f"chunk {(bad or twice).chunk_id!r} has an unusable vector or two of them")
    manifest = {
        "format": VECTOR_FORMAT, "version": VERSION, "embedding_fingerprint": config.embedding.fingerprint, "vector_index_fingerprint": config.fingerprint, "similarity_metric": config.similarity_metric.casefold(),
        "dimension": config.embedding.dimension, "source_hash": index.manifest["source_hash"], "chunk_hash": index.manifest["chunk_hash"],
        "embedding": {k: getattr(config.embedding, k) for k in ("implementation", "model", "dimension", "revision", "document_task", "query_task", "tokenizer", "preprocessing", "pooling", "normalization")},
    }
    return _save(spark, path, {"vectors": vectors.select("chunk_id", "content_hash", "vector")}, manifest, {"vectors": ["chunk_id"]})


def _unusable(vectors: DataFrame, dimension: int) -> DataFrame:
    bad = F.exists("vector", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("chunk_id").isNull() | F.col("vector").isNull() | (F.size("vector") != dimension) | bad)


def vectors_match(manifest: dict, config: VectorIndexConfig, index: Index) -> bool:
    """Is a stored vector index of this embedder, metric, format and snapshot, so that it needn't be built again?"""
    wanted = {
        "version": VERSION, "embedding_fingerprint": config.embedding.fingerprint, "vector_index_fingerprint": config.fingerprint, "similarity_metric": config.similarity_metric.casefold(), "dimension": config.embedding.dimension,
        "source_hash": index.manifest["source_hash"], "chunk_hash": index.manifest["chunk_hash"],
    }
    return all(manifest.get(k) == v for k, v in wanted.items())


def open_vectors(spark: SparkSession, path: str, index: Index) -> tuple[DataFrame, dict, VectorIndexConfig]:
    """A vector index that belongs to ``index``, chunk by chunk."""
    version, manifest = _open(spark, path, VECTOR_FORMAT, VectorIndexError)
    config = VectorIndexConfig(EmbeddingConfig(**manifest["embedding"]), manifest["similarity_metric"], manifest["version"])
    if config.fingerprint != manifest["vector_index_fingerprint"]:
        raise VectorIndexError(f"{path}: the manifest doesn't agree with itself")
    if any(manifest[k] != index.manifest[k] for k in ("source_hash", "chunk_hash")):
        raise VectorIndexError(f"{path}: the vectors are of another snapshot")
    vectors = spark.read.parquet(f"{version}/vectors.parquet")
    if bad := _unusable(vectors, config.embedding.dimension).first():
        raise VectorIndexError(f"{path}: chunk {bad.chunk_id!r} has an unusable vector")
    keys = ["chunk_id", "content_hash"]
    if vectors.select(*keys).exceptAll(index.tables["chunks"].select(*keys)).first() or index.tables["chunks"].select(*keys).exceptAll(vectors.select(*keys)).first():
        raise VectorIndexError(f"{path}: the vectors are of other chunks")
    return vectors, manifest, config
