"""Recall and reciprocal rank over all cases at once, and the comparison of two runs."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..diagnostics import EvaluationError
from ..functions.ids import json_strings


#: Names of the metrics that may decide, and the columns that have them.
METRICS = {"recall_at_k": "recall_at_k", "mrr": "reciprocal_rank"}


@dataclass(frozen=True)
class EvaluationProfile:
    """What a candidate must reach to be admitted."""

    primary_metric: str = "recall_at_k"
    minimum_improvement: float = 0.0
    maximum_mrr_regression: float = 0.0
    maximum_per_query_regressions: int = 0
    require_lexical_gap_success: bool = True
    require_reproducible_metadata: bool = True

    def __post_init__(self) -> None:
        if self.primary_metric not in METRICS:
            raise EvaluationError(f"primary_metric must be one of {', '.join(METRICS)}")


def case_results(cases: DataFrame, hits: DataFrame, k: int = 5) -> DataFrame:
    """(query_id, kind, gap, recall_at_k, reciprocal_rank, success, n_missing) of each case, also of those without hits.

    ``cases`` has query_id, expected_json, kind and gap; ``hits`` query_id, entity_path and rank. Only ranks up to k count.
    """
    expected = cases.select("query_id", F.explode(F.array_distinct(json_strings(F.col("expected_json")))).alias("entity_path"))
    best = hits.filter(F.col("rank") <= k).groupBy("query_id", "entity_path").agg(F.min("rank").alias("rank"))
    found = expected.join(best, ["query_id", "entity_path"], "left").groupBy("query_id").agg(F.count("*").alias("n"), F.count("rank").alias("hit"), F.min("rank").alias("first"))
    wide = cases.select("query_id", "kind", "gap").join(found, "query_id", "left")
    return wide.select(
        "query_id", "kind", "gap", F.coalesce(F.try_divide("hit", "n"), F.lit(0.0)).alias("recall_at_k"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
        F.coalesce(F.col("hit") == F.col("n"), F.lit(False)).alias("success"), F.coalesce(F.col("n") - F.col("hit"), F.lit(0)).alias("n_missing"),
    )


def totals(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_cases, recall_at_k, mrr and n_success, over all or by columns; rows with a null in them are left out."""
    rows = results.dropna(subset=by) if by else results
    return rows.groupBy(*(by or [])).agg(
        F.count("*").alias("n_cases"), F.avg("recall_at_k").alias("recall_at_k"), F.avg("reciprocal_rank").alias("mrr"), F.coalesce(F.sum(F.col("success").cast("int")), F.lit(0)).alias("n_success")
    )


def ranked_again(hits: DataFrame, k: int) -> DataFrame:
    """``hits`` within rank k, numbered again from 1 in each query, by rank, falling score and path."""
    order = Window.partitionBy("query_id").orderBy("rank", F.desc("score"), "entity_path")
    return hits.filter(F.col("rank") <= k).withColumn("rank", F.row_number().over(order))


def evidence_paths(hits: DataFrame) -> DataFrame:
    """(query_id, entity_path, rank): what each hit is evidence of, its entity and, where it is a path, its claim."""
    claim = F.when(F.col("claim_path").startswith("/"), F.col("claim_path"))
    return hits.select("query_id", F.explode(F.array_distinct(F.array_compact(F.array("entity_path", claim)))).alias("entity_path"), "rank")


def evaluate(cases: DataFrame, retriever: Callable, k: int = 5) -> DataFrame:
    """`case_results` of any retriever: a function of queries (query_id, query_text) and k that returns ranked hits of all of them.

    The hits have query_id, rank, score, entity_path and, if they like, claim_path.
    """
    hits = retriever(cases.select("query_id", "query_text"), k)
    if "claim_path" not in hits.columns:
        hits = hits.withColumn("claim_path", F.lit(None).cast("string"))
    return case_results(cases, evidence_paths(ranked_again(hits, k)), k)


def compare(baseline: DataFrame, candidate: DataFrame, profile: EvaluationProfile = EvaluationProfile()) -> DataFrame:
    """One row: improvement, mrr_delta, regressions, gap_fixed, unmatched and admitted of a candidate's results over a baseline's.

    Averages are over the cases that both sides have; ``unmatched`` counts those that one side lacks, and none may be for a candidate to be admitted.
    """
    b = baseline.select("query_id", F.col("recall_at_k").alias("rb"), F.col("reciprocal_rank").alias("mb"), F.col("success").alias("sb"), F.col("gap").alias("gap_b"), F.lit(True).alias("in_b"))
    c = candidate.select("query_id", F.col("recall_at_k").alias("rc"), F.col("reciprocal_rank").alias("mc"), F.col("success").alias("sc"), F.lit(True).alias("in_c"))
    rows = b.join(c, "query_id", "full")
    both = F.col("in_b") & F.col("in_c")
    change = {"recall_at_k": F.col("rc") - F.col("rb"), "reciprocal_rank": F.col("mc") - F.col("mb")}
    row = rows.agg(
        F.round(F.avg(F.when(both, change[METRICS[profile.primary_metric]])), 9).alias("improvement"), F.round(F.avg(F.when(both, change["reciprocal_rank"])), 9).alias("mrr_delta"),
        F.coalesce(F.sum((both & (F.col("rc") < F.col("rb"))).cast("int")), F.lit(0)).alias("regressions"),
        F.coalesce(F.bool_or(both & F.coalesce("gap_b", F.lit(False)) & ~F.col("sb") & F.col("sc")), F.lit(False)).alias("gap_fixed"),
        F.count_if(F.col("in_b").isNull() | F.col("in_c").isNull()).alias("unmatched"),
    )
    limits = [c for *_, c in _limits(profile)]
    return row.withColumn("admitted", F.coalesce(reduce(lambda x, y: x & y, limits), F.lit(False)))


def _limits(profile: EvaluationProfile) -> list[tuple[str, str, object, Column]]:
    """(check, what is measured, its limit, whether it holds) of each measured condition."""
    n = lambda c: F.col(c)
    out = [
        ("improvement of the primary metric", "improvement", profile.minimum_improvement, n("improvement") >= profile.minimum_improvement),
        ("change of MRR", "mrr_delta", -profile.maximum_mrr_regression, n("mrr_delta") >= -profile.maximum_mrr_regression),
        ("cases with lower recall", "regressions", profile.maximum_per_query_regressions, n("regressions") <= profile.maximum_per_query_regressions),
        ("cases of one side only", "unmatched", 0, n("unmatched") == 0),
    ]
    return out + ([("a gap case is solved", "gap_fixed", True, n("gap_fixed"))] if profile.require_lexical_gap_success else [])


#: Fields of a report that both sides must share, and fields that a side must have, by the modes of its search.
SHARED_FIELDS = ("k", "evaluation_case_hash", "snapshot_hash")
NEEDED_FIELDS = {
    "both": ("evaluation_case_hash", "snapshot_hash", "retrieval_mode", "package_identity"),
    "vectors": ("embedding_fingerprint", "vector_index_fingerprint", "fusion_config"),
}


def admission(baseline: dict, candidate: dict, compared: DataFrame, profile: EvaluationProfile = EvaluationProfile()) -> DataFrame:
    """(check, side, value, limit, ok): every condition of admitting a candidate, one a row; it is admitted if all are ok.

    ``baseline`` and ``candidate`` are reports as the command line writes them, ``compared`` is the row of `compare`.
    """
    spark = compared.sparkSession
    reports = {"baseline": baseline, "candidate": candidate}
    facts = spark.createDataFrame([(s, f, None if v in (None, "", {}, []) else json.dumps(v, sort_keys=True, default=str)) for s, r in reports.items() for f, v in r.items()] or [("", "", None)], "side string, field string, value string")
    wanted = [(s, f) for s in reports for f in NEEDED_FIELDS["both"]] if profile.require_reproducible_metadata else []
    if profile.require_reproducible_metadata and candidate.get("retrieval_mode") in ("vector", "hybrid"):
        wanted += [("candidate", f) for f in NEEDED_FIELDS["vectors"]]
    shared = spark.createDataFrame([(f,) for f in SHARED_FIELDS], "field string").join(facts, "field", "left").groupBy("field")
    same = shared.agg(F.max(F.when(F.col("side") == "baseline", F.col("value"))).alias("limit"), F.max(F.when(F.col("side") == "candidate", F.col("value"))).alias("value"))
    same = same.select(F.concat(F.lit("same "), "field").alias("check"), F.lit("candidate").alias("side"), "value", "limit", F.col("value").eqNullSafe(F.col("limit")).alias("ok"))
    there = spark.createDataFrame(wanted, "side string, field string").join(facts, ["side", "field"], "left")
    there = there.select(F.concat(F.lit("has "), "field").alias("check"), "side", "value", F.lit(None).cast("string").alias("limit"), F.col("value").isNotNull().alias("ok"))
    measured = [F.struct(F.lit(name).alias("check"), F.lit("candidate").alias("side"), F.col(c).cast("string").alias("value"), F.lit(str(limit)).alias("limit"), F.coalesce(ok, F.lit(False)).alias("ok")) for name, c, limit, ok in _limits(profile)]
    return same.unionByName(there).unionByName(compared.select(F.inline(F.array(*measured))))
