"""Evidence with its references resolved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import bare_source_id


class ContextAssemblyError(ValueError):
    """A source id has no reference, and the context was asked to be strict."""


def packet_sources(packets: DataFrame, key: str = "packet_id") -> DataFrame:
    """(key, position, source_id): the distinct bare source ids of each packet, in order."""
    ids = F.array_distinct(F.filter(F.transform("source_ids", bare_source_id), lambda x: x.isNotNull() & (x != "")))
    return packets.select(key, F.posexplode(ids).alias("position", "source_id"))


def resolved_sources(packets: DataFrame, references: DataFrame, key: str = "packet_id") -> DataFrame:
    """(key, position, source_id, title, year, url, resolved) of each source of each packet."""
    known = references.select(F.col("reference_id").alias("source_id"), "title", "year", "url", F.lit(True).alias("resolved"))
    return packet_sources(packets, key).join(known, "source_id", "left").select(key, "position", "source_id", "title", "year", "url", F.coalesce("resolved", F.lit(False)).alias("resolved"))


def assemble(packets: DataFrame, references: DataFrame, strict: bool = True, key: str = "packet_id") -> DataFrame:
    """``packets`` with ``references``, an array of resolved sources in order.

    With ``strict``, a source id without a reference is an error; else it stays with ``resolved`` false.
    """
    found = resolved_sources(packets, references, key)
    if strict and (missing := found.filter("NOT resolved").select("source_id").first()):
        raise ContextAssemblyError(f"missing reference for source ID {missing[0]!r}")
    lists = found.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("position", "source_id", "title", "year", "url", "resolved"))).alias("references"))
    empty = F.array().cast(dict(lists.dtypes)["references"])
    return packets.join(lists, key, "left").withColumn("references", F.coalesce("references", empty))


#: The fields of an evidence packet, and the types of those that hits may lack.
PACKET_FIELDS = {
    "rank": "int", "score": "double", "retriever": "string", "entity_path": "string", "section": "string", "text": "string", "source_ids": "array<string>", "passage_source_ids": "array<string>", "relation_source_ids": "array<string>",
    "references": None, "claim_status": "string", "confidence": "string", "confidence_weight": "double", "claim_id": "string", "claim_path": "string", "property": "string", "value_json": "string", "affirmative": "boolean",
    "requires_hedging": "boolean", "relation": "struct<predicate: string, direction: string, source_path: string, target_path: string>", "metadata_json": "string",
}
#: What tells packets of a query apart; rank and score do not.
IDENTITY = ("entity_path", "section", "text", "source_ids", "relation_source_ids", "retriever", "metadata_json")


def evidence_packets(hits: DataFrame, references: DataFrame, strict: bool = True, deduplicate: bool = True, key: str = "packet_id") -> DataFrame:
    """(key, query_id, position, and the `PACKET_FIELDS`): the packets of each query's hits, in order.

    ``hits`` has key, query_id, rank, score, retriever, entity_path, section, text and source_ids, and of the other fields what there is. The order is by rank, falling score,
    path, retriever, section, text and key; a score that is null or NaN is lowest. Of packets of one identity the first stays. References are those of a
    passage and then of its assertions. With ``strict``, a source id without a reference is an error; else it stays with ``resolved`` false.
    """
    missing = {c: F.lit(None).cast(t) for c, t in PACKET_FIELDS.items() if c not in hits.columns and c != "references"}
    ids = lambda c: F.array_distinct(F.filter(F.transform(F.coalesce(c, F.array().cast("array<string>")), bare_source_id), lambda x: x.isNotNull() & (x != "")))
    rows = hits.withColumns(missing) if missing else hits
    rows = rows.withColumns({"source_ids": ids(F.coalesce("passage_source_ids", "source_ids")), "relation_source_ids": ids(F.col("relation_source_ids")), "requires_hedging": F.coalesce("requires_hedging", F.lit(False))})
    rows = rows.withColumn("passage_source_ids", F.col("source_ids")).withColumn("metadata_json", F.coalesce("metadata_json", F.lit("{}")))
    score = F.when(F.col("score").isNull() | F.isnan("score"), float("-inf")).otherwise(F.col("score"))
    place = F.struct("rank", (-score).alias("minus"), "entity_path", "retriever", F.coalesce("section", F.lit("")).alias("section"), "text", key)
    rest = [c for c in (key, *PACKET_FIELDS) if c not in IDENTITY and c != "references"]
    rows = rows.select("query_id", *IDENTITY, *rest, place.alias("_place"))
    if deduplicate:
        rows = rows.groupBy("query_id", *IDENTITY).agg(F.min_by(F.struct(*rest, "_place"), "_place").alias("_p")).select("query_id", *IDENTITY, "_p.*")
    found = assemble(rows.withColumn("source_ids", F.array_distinct(F.concat("source_ids", "relation_source_ids"))), references, strict, key)
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("_place"))
    return found.withColumn("source_ids", F.col("passage_source_ids")).select(key, "query_id", position.alias("position"), *PACKET_FIELDS)


def distinct_packets(packets: DataFrame) -> DataFrame:
    """One packet of each content within its query: first by rank, score, and id. Rank and score don't tell packets apart."""
    same = ["query_id", *[c for c in IDENTITY if c in packets.columns]]
    rest = [c for c in packets.columns if c not in same]
    order = F.struct("rank", (-F.coalesce("score", F.lit(float("-inf")))).alias("minus"), "packet_id")
    return packets.groupBy(*same).agg(F.min_by(F.struct(*rest), order).alias("_p")).select(*same, "_p.*").select(*packets.columns)


def unresolved(packets: DataFrame, references: DataFrame) -> DataFrame:
    """(source_id, n_packets) of source ids without a reference."""
    return resolved_sources(packets, references).filter("NOT resolved").groupBy("source_id").agg(F.count_distinct("packet_id").alias("n_packets"))
