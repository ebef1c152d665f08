"""References to records that do not exist: missing, deleted or loaded later than the record.

Method: distributed left anti-join of the distinct non-null foreign keys against the parent keys, joined back
for the references themselves and for counts per table and period. Keys that a large share of the rows use are
routed around the shuffle (`hot_lookup_join`).

Defined results: null keys, empty keys, null arrays and JSON that is no array are no references. A record that
was delivered several times counts once, from its smallest ``loaded_at``. Of parent rows tied for the greatest
``loaded_at``, a deletion wins. A null ``loaded_at`` is older than any other for "greatest" and is left out of
"smallest". Empty tables give no rows. Further columns of the inputs are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ids import bare_source_id, json_strings
from ..plans.lineage import cut
from ..plans.skew import hot_lookup_join

REFERENCE, ENTITY = "reference", "entity"


@dataclass(frozen=True)
class ForeignKey:
    """Where a table keeps its references, and in which parent they are looked up."""

    table_name: str
    record_key: str
    column: str
    parent: str


#: The foreign keys of a knowledge base that are checked.
FOREIGN_KEYS = (
    ForeignKey("entities", "entity_path", "source_ids_json", REFERENCE),
    ForeignKey("claims", "claim_key", "source_ids_json", REFERENCE),
    ForeignKey("relations", "relation_id", "target", ENTITY),
)


def parent_state(parent: DataFrame, key: str, space: str) -> DataFrame:
    """One row a parent key: is its newest row a deletion, and when was it first loaded."""
    newest = F.max(
        F.struct(
            F.coalesce(F.col("loaded_at"), F.lit("0001-01-01").cast("timestamp")).alias("at"),
            F.col("deleted_at").isNotNull().alias("deleted"),
        )
    )
    return (
        parent.filter(F.col(key).isNotNull())
        .groupBy(F.lit(space).alias("space"), F.col(key).alias("ref_key"))
        .agg(newest["deleted"].alias("deleted"), F.min("loaded_at").alias("parent_first"))
    )


def references_of(tables: dict[str, DataFrame], foreign_keys=FOREIGN_KEYS) -> DataFrame:
    """Distinct (table_name, record_key, ref_key) with the space looked up in and the record's first load."""
    parts = []
    for fk in foreign_keys:
        parts.append(
            tables[fk.table_name].select(
                F.lit(fk.table_name).alias("table_name"),
                F.lit(fk.parent).alias("space"),
                F.col(fk.record_key).cast("string").alias("record_key"),
                F.col(fk.column).alias("raw"),
                "loaded_at",
            )
        )
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    # One shuffle by record gives its first load and its distinct raw values, deliveries combined before it.
    records = (
        rows.filter(F.col("record_key").isNotNull())
        .groupBy("table_name", "space", "record_key")
        .agg(F.min("loaded_at").alias("record_first"), F.collect_set("raw").alias("raws"))
    )
    keys = F.array_distinct(
        F.flatten(
            F.transform(
                "raws",
                lambda raw: F.when(
                    F.col("space") == ENTITY,
                    F.when(raw.startswith("/"), F.array(raw)).otherwise(F.array().cast("array<string>")),
                ).otherwise(
                    F.coalesce(
                        F.filter(
                            F.transform(json_strings(raw), bare_source_id), lambda x: x.isNotNull() & (x != "")
                        ),
                        F.array().cast("array<string>"),
                    )
                ),
            )
        )
    )
    return records.select("table_name", "space", "record_key", "record_first", F.explode(keys).alias("ref_key"))


def orphan_references(tables: dict[str, DataFrame], foreign_keys=FOREIGN_KEYS) -> DataFrame:
    """Every reference to an absent, deleted or later parent.

    ``tables`` has the referencing tables by name and the parents ``kb_references`` and ``entities``.
    Columns: table_name, record_key, ref_key, reason (missing, deleted or late), record_first.
    """
    refs = cut(references_of(tables, foreign_keys))  # read by each of the joins below
    parents = parent_state(tables["kb_references"], "reference_id", REFERENCE).unionByName(
        parent_state(tables["entities"], "entity_path", ENTITY)
    )
    counts = refs.groupBy("space", "ref_key").agg(F.count("*").alias("n"), F.min("record_first").alias("oldest"))
    # Distinct foreign keys against the parents that are there and in time for all of their records; what
    # is left over carries its reason, or for late ones the time to compare with, back to the references.
    missing = counts.join(parents, ["space", "ref_key"], "left_anti").select(
        "space", "ref_key", "n", F.lit("missing").alias("state"), F.lit(None).cast("timestamp").alias("parent_first")
    )
    troubled = (
        counts.join(parents, ["space", "ref_key"])
        .filter("deleted OR parent_first > oldest")
        .select(
            "space", "ref_key", "n", F.when(F.col("deleted"), "deleted").otherwise("late").alias("state"), "parent_first"
        )
    )
    suspects = cut(missing.unionByName(troubled))
    joined = hot_lookup_join(refs, suspects.drop("n"), ["space", "ref_key"], suspects.select("space", "ref_key", "n"))
    return joined.filter("state IN ('missing', 'deleted') OR (state = 'late' AND parent_first > record_first)").select(
        "table_name", "record_key", "ref_key", F.col("state").alias("reason"), "record_first"
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month of the record's first load, and reason; period is null where no load time is."""
    return (
        orphans.withColumn("period", F.date_format("record_first", "yyyy-MM"))
        .groupBy("table_name", "period", "reason")
        .agg(F.count("*").alias("n_references"))
    )
