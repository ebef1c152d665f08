"""Edges from relations and claims, and opt-in expansion by one hop."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import bare_source_id, json_strings
from ..functions.text import normalize_text, normalize_value
from ..plans.skew import counted

#: Weights of confidences, of any other one, and the known statuses of claims.
CONFIDENCE_WEIGHTS = {"A": 1.0, "B": 0.75, "C": 0.5, "D": 0.25}
OTHER_CONFIDENCE = 0.5
STATUSES = ("accepted", "proposed", "disputed", "rejected")


@dataclass(frozen=True)
class GraphExpansionConfig:
    """Whether and how seeds are expanded."""

    enabled: bool = False
    predicates: tuple | None = None
    include_rejected: bool = False
    include_unknown: bool = False
    seed_pool_factor: int = 4
    expanded_result_limit: int | None = None
    decay: float = 0.75
    claim_decay: float = 0.5
    confidence_weights: dict = field(default_factory=lambda: dict(CONFIDENCE_WEIGHTS))

    def __post_init__(self) -> None:
        if any(isinstance(w, bool) or not 0 <= w <= 1 for w in self.confidence_weights.values()):
            raise ValueError("confidence weights must be from 0 to 1")
        if any(not 0 < x <= 1 for x in (self.decay, self.claim_decay)):
            raise ValueError("decays must be above 0 and at most 1")
        if any(x is not None and (isinstance(x, bool) or x < 1) for x in (self.seed_pool_factor, self.expanded_result_limit)):
            raise ValueError("seed_pool_factor and expanded_result_limit must be positive integers")
        if self.predicates is not None and any(not p.strip() for p in self.predicates):
            raise ValueError("predicates must not be empty")


def bare_ids(c: Column) -> Column:
    """Distinct bare ids of a JSON array of source ids, in order; an empty array for null."""
    ids = F.filter(F.transform(json_strings(c), bare_source_id), lambda x: x.isNotNull() & (x != ""))
    return F.array_distinct(F.coalesce(ids, F.array().cast("array<string>")))


def confidence_weight(c: Column, weights: dict | None = None) -> Column:
    """The weight of a confidence; the default for other and missing ones."""
    weights = CONFIDENCE_WEIGHTS if weights is None else weights
    known = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, float(w))]) if weights else F.expr("cast(map() as map<string, double>)")
    return F.coalesce(F.element_at(known, F.coalesce(c, F.lit(""))), F.lit(OTHER_CONFIDENCE))


def requires_hedging(c: Column) -> Column:
    return F.coalesce(c.isin("C", "D"), F.lit(False))


def merged_relations(relations: DataFrame) -> DataFrame:
    """(source, target, predicate, confidence, source_ids, n): relations that differ in sources only, as one.

    A relation without sources of its own has its owner's. The sources are in the order of relation ids.
    """
    own = bare_ids(F.col("source_ids_json"))
    ids = F.when(F.size(own) > 0, own).otherwise(bare_ids(F.col("owner_source_ids_json")))
    rows = relations.filter("source_path IS NOT NULL AND target IS NOT NULL AND predicate IS NOT NULL").withColumn("ids", ids)
    # Equal lists of ids are combined before the shuffle, so that a hot edge moves its different lists only.
    lists = rows.groupBy("source_path", "target", "predicate", "confidence", "ids").agg(F.min("relation_id").alias("first"), F.count("*").alias("n"))
    merged = lists.groupBy(F.col("source_path").alias("source"), "target", "predicate", "confidence").agg(
        F.array_sort(F.collect_list(F.struct("first", "ids"))).alias("all"), F.sum("n").alias("n")
    )
    return merged.select("source", "target", "predicate", "confidence", F.array_distinct(F.flatten("all.ids")).alias("source_ids"), "n")


def claim_edges(claims: DataFrame) -> DataFrame:
    """(source, target, predicate, is_value, claim_key, claim_ref, status, confidence, source_ids) of claims that make edges.

    A relation form goes from subject to target; a value form is an assertion of the subject about itself. Of claims
    with one source, target, predicate and claim path or id the first by key stays.
    """
    relation = F.col("predicate").isNotNull() & F.col("target").isNotNull()
    rows = claims.filter(F.col("subject").isNotNull() & (relation | F.col("property").isNotNull())).select(
        F.col("subject").alias("source"),
        F.when(relation, F.col("target")).otherwise(F.col("subject")).alias("target"),
        F.when(relation, F.col("predicate")).otherwise(F.col("property")).alias("predicate"),
        F.col("property").isNotNull().alias("is_value"),
        "claim_key", "claim_path", F.coalesce("claim_path", "claim_id").alias("claim_ref"), "status", "confidence", bare_ids(F.col("source_ids_json")).alias("source_ids"),
    )
    keys = ["source", "target", "predicate", "claim_ref"]
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), "claim_key").alias("_c")).select(*keys, "_c.*")


def merged_claims(claims: DataFrame) -> DataFrame:
    """One row a claim (claim_ref: its path, else its id, else its key): the first value of each field that isn't empty, and all source ids.

    First is by claim key; n counts the rows that were merged.
    """
    fields = ("claim_id", "claim_path", "statement", "status", "confidence", "subject", "predicate", "target", "property", "value_json")
    some = lambda c: F.nullif(F.col(c), F.lit(""))
    rows = claims.withColumn("claim_ref", F.coalesce(some("claim_path"), some("claim_id"), F.col("claim_key"))).withColumn("ids", bare_ids(F.col("source_ids_json")))
    first = rows.groupBy("claim_ref").agg(*[F.min_by(some(c), F.when(some(c).isNotNull(), F.col("claim_key"))).alias(c) for c in fields], F.count("*").alias("n"))
    each = rows.select("claim_ref", "claim_key", F.posexplode("ids").alias("i", "id")).groupBy("claim_ref", "id").agg(F.min(F.struct("claim_key", "i")).alias("place"))
    lists = each.groupBy("claim_ref").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "id"))), lambda x: x["id"]).alias("source_ids"))
    return first.join(lists, "claim_ref", "left").withColumn("source_ids", F.coalesce("source_ids", F.array().cast("array<string>")))


def edges(relations: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """All edges between entities that exist, relations and claims apart (``kind``)."""
    r = merged_relations(relations).select("source", "target", "predicate", F.lit("relation").alias("kind"), F.lit(False).alias("is_value"), F.lit(None).cast("string").alias("claim_ref"), F.lit(None).cast("string").alias("claim_path"), F.lit(None).cast("string").alias("status"), "confidence", "source_ids")
    c = claim_edges(claims).select("source", "target", "predicate", F.lit("claim").alias("kind"), "is_value", "claim_ref", "claim_path", "status", "confidence", "source_ids")
    paths = entities.select("entity_path").distinct()
    return r.unionByName(c).join(paths.withColumnRenamed("entity_path", "source"), "source", "left_semi").join(paths.withColumnRenamed("entity_path", "target"), "target", "left_semi")


def with_policy(all_edges: DataFrame, config: GraphExpansionConfig = GraphExpansionConfig()) -> DataFrame:
    """Edges that the policy admits, with factor, affirmative and requires_hedging."""
    status = F.lower(F.coalesce("status", F.lit("")))
    claim = F.col("kind") == "claim"
    admitted = ~claim | ((F.lit(config.include_rejected) | (status != "rejected")) & (F.lit(config.include_unknown) | status.isin(*STATUSES)))
    weight = F.when(~claim & F.col("confidence").isNull(), 1.0).otherwise(confidence_weight(F.col("confidence"), config.confidence_weights))
    factor = weight * F.when(claim & (status != "accepted"), config.claim_decay).otherwise(1.0)
    kept = all_edges.filter(admitted)
    if config.predicates is not None:
        kept = kept.filter(normalize_text("predicate").isin([normalize_value(p) for p in config.predicates]))
    return kept.select(
        "*", weight.alias("confidence_weight"), factor.alias("factor"), (~claim | (status == "accepted")).alias("affirmative"), requires_hedging(F.col("confidence")).alias("requires_hedging")
    )


def distinct_seeds(hits: DataFrame) -> DataFrame:
    """(query_id, entity_path, score, rank): the best hit of each entity, ranked again from 1."""
    best = hits.groupBy("query_id", "entity_path").agg(F.min(F.struct("rank", (-F.col("score")).alias("minus"))).alias("b"))
    order = Window.partitionBy("query_id").orderBy("b.rank", "b.minus", "entity_path")
    return best.select("query_id", "entity_path", (-F.col("b.minus")).alias("score"), F.row_number().over(order).alias("rank"))


def expand(seeds: DataFrame, admitted: DataFrame, config: GraphExpansionConfig = GraphExpansionConfig()) -> DataFrame:
    """(query_id, neighbor, direction, seed, edge columns, score): one hop from the seeds, the first seed winning.

    ``seeds`` as from `distinct_seeds` of a table that was cut (they are counted), ``admitted`` as from `with_policy`. Value claims come back to their subject as
    assertions. What two seeds reach by one edge in one direction counts for the one with the better rank.
    """
    way = lambda seed, direction, neighbor: F.struct(F.col(seed).alias("seed"), direction.alias("direction"), F.col(neighbor).alias("neighbor"))
    out = F.when(F.col("is_value"), way("source", F.lit("assertion"), "source")).otherwise(way("source", F.lit("outgoing"), "target"))
    back = F.when(F.col("source") != F.col("target"), F.array(out, way("target", F.lit("incoming"), "source"))).otherwise(F.array(out))
    both = admitted.withColumn("_way", F.explode(back)).select("*", "_way.*").drop("_way")
    # Seeds are few, unless queries are very many: where they can be broadcast, an entity with a large share of all edges moves nothing.
    own = counted(seeds.select("query_id", F.col("entity_path").alias("seed"), F.col("score").alias("seed_score"), F.col("rank").alias("seed_rank")))
    reached = both.join(own, "seed")
    keys = ["query_id", "neighbor", "direction", "source", "target", "predicate", "kind", "claim_ref", "source_ids"]
    rest = [c for c in reached.columns if c not in keys]
    order = F.struct("seed_rank", "seed", F.coalesce("confidence", F.lit("")), F.coalesce("status", F.lit("")))
    first = reached.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_e")).select(*keys, "_e.*")
    return first.withColumn("score", F.col("seed_score") * config.decay * F.col("factor"))


def diverse(direct: DataFrame, expanded: DataFrame, top_k: int, config: GraphExpansionConfig = GraphExpansionConfig(), keep: tuple = ()) -> DataFrame:
    """(query_id, entity_path, retriever, claim_path, score, rank): direct hits and some from the graph.

    ``direct`` has query_id, entity_path, retriever, score and rank; ``expanded`` is as from `expand` with
    ``same_type``. Of the graph's share, one place is a relation's if there is one (same type first), the others go to different claims, and
    what is left to further relations. ``keep`` names more columns of ``expanded``, null for direct hits.
    """
    budget = min(config.expanded_result_limit or max(1, (top_k + 1) // 2), top_k)
    hits = expanded.select(
        "query_id", F.col("neighbor").alias("entity_path"), F.lit("graph.one-hop").alias("retriever"), "claim_path", "score", "same_type",
        F.concat_ws(":", "direction", "predicate", F.coalesce("claim_ref", F.lit("")), F.to_json("source_ids"), F.coalesce("confidence", F.lit(""))).alias("tag"), *keep,
    )
    rows = hits.unionByName(direct.select("query_id", "entity_path", "retriever", F.lit(None).cast("string").alias("claim_path"), "score", F.lit(None).cast("boolean").alias("same_type"), F.lit("").alias("tag")), allowMissingColumns=True)
    by_query = Window.partitionBy("query_id")
    graph = F.col("retriever") == "graph.one-hop"
    rows = rows.withColumn("kind", F.when(~graph, "direct").when(F.col("claim_path").isNull(), "relation").otherwise("claim"))
    rows = rows.withColumn("place", F.struct((-F.round("score", 9)).alias("minus"), "entity_path", "retriever", "tag"))
    # The best hit of each claim, combined before anything moves; then no more of each kind than a query can use, limited in each task first.
    rest = [c for c in rows.columns if c not in ("query_id", "kind", "claim_path")]
    claims = rows.filter("kind = 'claim'").groupBy("query_id", "kind", "claim_path").agg(F.min_by(F.struct(*rest), "place").alias("_b")).select("query_id", "kind", "claim_path", "_b.*")
    rows = rows.filter("kind <> 'claim'").unionByName(claims)
    other_type = F.when(F.col("kind") == "relation", ~F.coalesce("same_type", F.lit(False))).otherwise(False)
    nth = F.row_number().over(Window.partitionBy("query_id", "kind").orderBy(other_type, "place"))
    rows = rows.withColumn("nth", nth).filter(F.col("nth") <= top_k)
    count = lambda k: F.sum((F.col("kind") == k).cast("int")).over(by_query)
    rows = rows.withColumn("n_r", count("relation")).withColumn("n_c", count("claim"))
    first = F.least(F.lit(1), F.col("n_r"))
    claims = F.least(F.col("n_c"), budget - first)
    relations = first + F.greatest(F.lit(0), F.least(F.col("n_r") - first, budget - first - claims))
    room = F.when(F.col("kind") == "claim", claims).when(F.col("kind") == "relation", relations).otherwise(top_k - relations - claims)
    chosen = rows.filter(F.col("nth") <= room)
    return chosen.select("query_id", "entity_path", "retriever", "claim_path", "score", *keep, F.row_number().over(by_query.orderBy("place")).alias("rank"))


def assertions(relations: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_path, kind, predicate, target, status, confidence, confidence_weight, affirmative, source_ids): all that is
    asserted of each entity, one row each: the relations that leave it and the claims about it, repeated ones once.

    Rows rather than an array for each entity, as one entity may hold a large share of all of them.
    """
    r = merged_relations(relations).select(
        F.col("source").alias("entity_path"), F.lit("relation").alias("kind"), "predicate", "target", F.lit(None).cast("string").alias("claim_ref"), F.lit(None).cast("string").alias("status"), "confidence",
        F.when(F.col("confidence").isNull(), 1.0).otherwise(confidence_weight(F.col("confidence"))).alias("confidence_weight"), F.lit(True).alias("affirmative"), "source_ids",
    )
    status = F.lower("status")
    c = claims.filter("subject IS NOT NULL").select(
        F.col("subject").alias("entity_path"), F.lit("claim").alias("kind"), F.coalesce("predicate", "property").alias("predicate"), "target", F.coalesce("claim_path", "claim_id").alias("claim_ref"), status.alias("status"), "confidence",
        confidence_weight(F.col("confidence")).alias("confidence_weight"), (status == "accepted").alias("affirmative"), bare_ids(F.col("source_ids_json")).alias("source_ids"),
    )
    return r.unionByName(c.distinct()).join(entities.select("entity_path").distinct(), "entity_path", "left_semi")


def provenance(relations: DataFrame, claims: DataFrame, entities: DataFrame) -> DataFrame:
    """(entity_path, relation_source_ids, claim_source_ids, requires_hedging, n_assertions) of entities that something is asserted of.

    Relations that leave an entity without sources of their own or of an owner have the entity's. ``relation_source_ids`` are
    those of its relations, in the order of relation ids, and then of its claims, in that of claim keys; each id once.
    """
    own = entities.select("entity_path", F.col("source_ids_json").alias("_own"))
    r = relations.filter("source_path IS NOT NULL AND target IS NOT NULL AND predicate IS NOT NULL").withColumnRenamed("source_path", "entity_path").join(own, "entity_path")
    ids = [bare_ids(F.col(c)) for c in ("source_ids_json", "owner_source_ids_json", "_own")]
    r = r.select("entity_path", F.lit(0).alias("part"), F.col("relation_id").cast("string").alias("key"), F.lpad(F.col("relation_id").cast("string"), 20, "0").alias("at"), "confidence", F.when(F.size(ids[0]) > 0, ids[0]).when(F.size(ids[1]) > 0, ids[1]).otherwise(ids[2]).alias("ids"))
    c = claims.filter("subject IS NOT NULL").withColumnRenamed("subject", "entity_path").join(own, "entity_path", "left_semi")
    c = c.select("entity_path", F.lit(1).alias("part"), F.col("claim_key").alias("key"), F.col("claim_key").alias("at"), "confidence", bare_ids(F.col("source_ids_json")).alias("ids"))
    rows = r.unionByName(c)
    # Each id of an entity once, with its first place, before the lists are made: they are as long as an entity has different sources.
    each = rows.select("entity_path", "part", "at", F.posexplode("ids").alias("i", "id")).groupBy("entity_path", "id").agg(
        F.min(F.struct("part", "at", "i")).alias("p"), F.min(F.when(F.col("part") == 1, F.struct("at", "i"))).alias("c")
    )
    in_order = lambda place: F.transform(F.array_sort(F.collect_list(F.when(place.isNotNull(), F.struct(place.alias("place"), "id")))), lambda x: x["id"])
    lists = each.groupBy("entity_path").agg(in_order(F.col("p")).alias("relation_source_ids"), in_order(F.col("c")).alias("claim_source_ids"))
    flags = rows.groupBy("entity_path").agg(F.max(requires_hedging(F.col("confidence"))).alias("requires_hedging"), F.count("*").alias("n_assertions"))
    empty = F.array().cast("array<string>")
    return flags.join(lists, "entity_path", "left").select("entity_path", F.coalesce("relation_source_ids", empty).alias("relation_source_ids"), F.coalesce("claim_source_ids", empty).alias("claim_source_ids"), "requires_hedging", "n_assertions")


def with_provenance(hits: DataFrame, origins: DataFrame) -> DataFrame:
    """``hits`` with what is asserted of their entities: source ids of relations and claims, whether to hedge, and the number of assertions.

    ``origins`` is as from `provenance`, one row an entity, so no hit is repeated.
    """
    empty = F.array().cast("array<string>")
    names = ("relation_source_ids", "claim_source_ids", "requires_hedging", "n_assertions")
    joined = hits.drop(*names).join(origins, "entity_path", "left")
    return joined.withColumns({"relation_source_ids": F.coalesce("relation_source_ids", empty), "claim_source_ids": F.coalesce("claim_source_ids", empty), "requires_hedging": F.coalesce("requires_hedging", F.lit(False)), "n_assertions": F.coalesce("n_assertions", F.lit(0))})
