import math
import random

import pytest

from loreweave.functions.ids import bare_source_id
from loreweave.functions.text import character_ngrams, normalize_text, normalize_value
from loreweave.operators import canonical, chunking, context, current, evaluation, fusion, graph, integrity, lexical, vectors
from pyspark.sql import functions as F


def test_normalisation_and_grams(spark):
    assert normalize_value(" ＡＢＣ　\n") == "abc" and normalize_value("Straße ﬁ x") == "strassefix" and normalize_value(None) is None
    df = spark.createDataFrame([("abcab",), ("a",), ("",), ("😀é日",), (None,)], "v string").select(normalize_text("v").alias("v"))
    got = {r.v: r.g and sorted(r.g) for r in df.select("v", character_ngrams(F.col("v")).alias("g")).collect()}
    assert got["abcab"] == ["ab", "bc", "ca"] and got["a"] == ["a"] and got[""] == [] and got["😀é日"] == sorted(["😀é", "é日"])
    with pytest.raises(ValueError):
        character_ngrams(F.col("v"), True)


def test_source_ids(spark):
    df = spark.createDataFrame([(x,) for x in (" ref: a ", "REF:ref:b", "\tref:\tc\n", "d", "ref:", " ")], "s string")
    assert [r[0] for r in df.select(bare_source_id(F.col("s"))).collect()] == ["a", "ref:b", "c", "d", "", ""]


def brute_score(q, values, weights, n=2):
    grams = lambda s: {s} if 0 < len(s) <= n else {s[i : i + n] for i in range(len(s) - n + 1)}
    total = 0.0
    for f, w in weights.items():
        best = 0.0
        for v in values.get(f, []):
            cover = 1.0 if v and q in v else len(grams(q) & grams(v)) / len(grams(q)) if v else 0
            if cover:
                best = max(best, cover + (2.0 if q == v else 0.5 if q in v else 0))
        total += w * best
    return total


def test_lexical_scores_lose_nothing(spark, monkeypatch):
    r = random.Random(7)
    word = lambda k: "".join(r.choice("abcd 日") for _ in range(k))
    records = [(f"/r{i}", word(8), [word(5) for _ in range(r.randint(0, 3))], word(60), "T" if i % 2 else None) for i in range(60)]
    df = spark.createDataFrame(records, "p string, title string, aliases array<string>, content string, entity_type string")
    fields = lexical.field_values(df, "p", "entity", lexical.ENTITY_WEIGHTS)
    queries = [(f"q{i}", word(k)) for i, k in enumerate([1, 1, 2, 3, 5, 9, 30])] + [("same", records[3][1]), ("blank", "  ")]
    asked = lexical.prepared_queries(spark.createDataFrame(queries, "query_id string, query_text string"))
    got = {(x.query_id, x.record_id): x.score for x in lexical.lexical_scores(asked, fields, lexical.postings(fields), lexical.ENTITY_WEIGHTS).collect()}
    want = {}
    for k, text in queries:
        q = normalize_value(text)
        for p, title, aliases, content, kind in records:
            values = {"title": [title], "aliases": aliases, "content": [content], "entity_type": [kind] if kind else []}
            if q and (s := brute_score(q, {f: [normalize_value(v) for v in vs] for f, vs in values.items()}, lexical.ENTITY_WEIGHTS)):
                want[k, p] = s
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)
    texts = spark.createDataFrame(queries, "query_id string, query_text string")
    best = sorted((x.query_id, x["rank"], x.record_id, round(x.score, 9)) for x in lexical.top_k(lexical.lexical_scores(asked, fields, lexical.postings(fields), lexical.ENTITY_WEIGHTS), 7).collect())
    for most in (2048, 3):
        monkeypatch.setattr(lexical, "SCAN_QUERIES", most)
        scanned = lexical.scan_top_k(texts, df, "p", lexical.ENTITY_WEIGHTS, 7)
        assert sorted((x.query_id, x["rank"], x.record_id, round(x.score, 9)) for x in scanned.collect()) == best
    top = lexical.top_k(spark.createDataFrame([("q", "b", 1.0), ("q", "a", 1.0), ("q", "c", 2.0)], "query_id string, record_id string, score double"), 2).collect()
    assert [(x.record_id, x["rank"]) for x in top] == [("c", 1), ("a", 2)]


def test_sections_and_names(spark):
    text = "intro\n\n# One #\na\n```\n# no\n~~~\n```\n   ## Two\n\n#\nb\n# One\nc\n    # four\n# \n## \n\n# Last\n \n"
    assert chunking.sections(text) == [(None, "intro"), ("One", "a\n```\n# no\n~~~\n```"), ("Two", "#\nb"), ("One", "c\n    # four\n# \n##")]
    assert chunking.chunk_names("/p", [None, "One", "Two", "One", "One-2", "preamble"]) == ["/p#preamble", "/p#One", "/p#Two", "/p#One-2", "/p#One-2-2", "/p#preamble-2"]
    df = spark.createDataFrame([("/p", text, "T"), ("/q", None, "T"), ("/r", " \n", "T")], "entity_path string, content string, title string")
    rows = sorted(chunking.chunk_entities(df).collect(), key=lambda r: r.ordinal)
    assert [(r.chunk_id, r.ordinal, r.title) for r in rows] == [("/p#preamble", 0, "T"), ("/p#One", 1, "T"), ("/p#Two", 2, "T"), ("/p#One-2", 3, "T")]


def test_vectors(spark, rows):
    v = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 0.0]), ("d", [-1.0, 1.0])], "key string, vector array<double>")
    q = spark.createDataFrame([(1, [3.0, 0.0]), (2, [0.0, 0.0])], "query_id int, vector array<double>")
    for blocks in (1, 5):
        got = sorted(tuple(r) for r in vectors.exact_top_k(q, v, 3, blocks=blocks).select("query_id", "rank", "key", "score").collect())
        assert got[:3] == [(1, 1, "a", 1.0), (1, 2, "b", 1.0), (1, 3, "c", 0.0)] and [g[2] for g in got[3:]] == ["a", "b", "c"]
    assert [r.key for r in vectors.exact_top_k(q.filter("query_id = 1"), v, 2, "dot").orderBy("rank").collect()] == ["a", "b"]
    assert vectors.exact_top_k(q.limit(0), v, 2).count() == 0
    with pytest.raises(ValueError):
        vectors.exact_top_k(q, v, 1, "euclid")
    s = q.crossJoin(v.withColumnRenamed("vector", "w")).select(vectors.similarity(F.col("vector"), F.col("w")).alias("s")).collect()
    assert {round(r.s, 6) for r in s} == {1.0, 0.0, -0.707107}
    chunks = spark.createDataFrame([("x", "h1"), ("y", "h2")], "chunk_id string, content_hash string")
    stored = spark.createDataFrame([("x", "h0", [1.0]), ("z", "h", None)], "chunk_id string, content_hash string, vector array<double>")
    assert rows(vectors.compatibility(stored, chunks)) == [("x", "stale"), ("y", "missing"), ("z", "extra")]
    assert rows(vectors.unusable(stored, 2)) == [("x", "dimension"), ("z", "null")]


HIT = "query_id string, backend string, rank int, entity_path string, chunk_id string, section string, text string, source_ids array<string>"


def test_fusion(spark):
    hits = [("q", "a", 1, "/x", None, None, "t", []), ("q", "b", 2, "/x", "x#1", None, "u", []), ("q", "c", 1, "/x", "x#2", None, "v", []), ("q", "a", 2, "/y", None, None, "t", []), ("q", "a", 2, "/z", None, None, "t", []), ("q", "a", 9, "/x", "x#0", None, "t", [])]
    df = spark.createDataFrame(hits, HIT)
    got = {r.entity_path: r for r in fusion.fuse(df, ("a", "b", "c")).collect()}
    assert got["/x"].score == 1 / 61 + 1 / 62 + 1 / 61 and (got["/y"]["rank"], got["/z"]["rank"]) == (2, 3)
    assert got["/x"].chunk_id == "x#1"
    config = fusion.RRFConfig(backend_weights={"a": 0.0}, backend_cutoffs={"b": 1}, passage_precedence=("c",))
    got = {r.entity_path: r for r in fusion.fuse(df, ("a", "b", "c"), config=config).collect()}
    assert got["/x"].score == 1 / 61 and got["/x"].chunk_id == "x#2" and got["/y"].score == 0.0
    with pytest.raises(ValueError):
        fusion.RRFConfig(constant=0)


@pytest.fixture
def graph_tables(spark):
    e = spark.createDataFrame([("/a",), ("/b",), ("/c",)], "entity_path string")
    rel = "relation_id bigint, source_path string, predicate string, target string, confidence string, source_ids_json string, owner_source_ids_json string"
    r = spark.createDataFrame([(1, "/a", "knows", "/b", "B", '["ref:s1"]', "[]"), (2, "/a", "knows", "/b", "B", '["s2", "s1"]', None), (3, "/b", "knows", "/c", None, "[]", '["own"]'), (4, "/a", "cites", "/gone", None, None, None), (5, None, "cites", "/a", None, None, None), (6, "/c", "self", "/c", "X", None, None)], rel)
    cl = "claim_key string, claim_id string, status string, confidence string, source_ids_json string, subject string, predicate string, target string, claim_path string, property string"
    c = spark.createDataFrame([("k1", "1", "Accepted", "A", "[]", "/a", "taught", "/c", "/k1", None), ("k2", "2", "proposed", "D", "[]", "/a", "taught", "/b", "/k2", None), ("k3", "3", "rejected", "A", "[]", "/a", "taught", "/b", "/k3", None), ("k4", "4", None, "A", "[]", "/a", "taught", "/b", "/k4", None), ("k5", "5", "accepted", None, '["v"]', "/a", None, None, "/k5", "born")], cl)
    return e, r, c


def test_edges_policy_expansion(spark, graph_tables, rows):
    e, r, c = graph_tables
    merged = {(x.source, x.target, x.predicate): list(x.source_ids) for x in graph.merged_relations(r).collect()}
    assert merged["/a", "/b", "knows"] == ["s1", "s2"] and merged["/b", "/c", "knows"] == ["own"]
    edges = graph.edges(r, c, e)
    assert edges.count() == 8 and edges.filter("target = '/gone'").count() == 0
    policy = {(x.predicate, x.claim_ref, x.source): x for x in graph.with_policy(edges).collect()}
    assert {k[1] for k in policy if k[1]} == {"/k1", "/k2", "/k5"}
    assert [policy[k].factor for k in (("knows", None, "/a"), ("knows", None, "/b"), ("self", None, "/c"), ("taught", "/k1", "/a"), ("taught", "/k2", "/a"), ("born", "/k5", "/a"))] == [0.75, 1.0, 0.5, 1.0, 0.125, 0.5]
    assert policy["taught", "/k2", "/a"].requires_hedging and not policy["taught", "/k2", "/a"].affirmative
    everything = graph.GraphExpansionConfig(include_rejected=True, include_unknown=True, predicates=(" TAUGHT",))
    assert graph.with_policy(edges, everything).count() == 4
    seeds = graph.distinct_seeds(spark.createDataFrame([("q", "/b", 4.0, 2), ("q", "/a", 2.0, 1), ("q", "/a", 9.0, 3)], "query_id string, entity_path string, score double, rank int"))
    assert rows(seeds, "entity_path", "score", "rank") == [("/a", 2.0, 1), ("/b", 4.0, 2)]
    got = {(x.neighbor, x.direction, x.predicate, x.claim_ref): round(x.score, 6) for x in graph.expand(seeds, graph.with_policy(edges)).collect()}
    assert got == {
        ("/b", "outgoing", "knows", None): 1.125, ("/c", "outgoing", "taught", "/k1"): 1.5, ("/b", "outgoing", "taught", "/k2"): 0.1875, ("/a", "assertion", "born", "/k5"): 0.75,
        ("/c", "outgoing", "knows", None): 3.0, ("/a", "incoming", "knows", None): 2.25, ("/a", "incoming", "taught", "/k2"): 0.375,
    }
    for bad in ({"decay": 0}, {"seed_pool_factor": 0}, {"predicates": (" ",)}):
        with pytest.raises(ValueError):
            graph.GraphExpansionConfig(**bad)


@pytest.mark.parametrize("k,limit", [(1, None), (5, None), (5, 1), (5, 4)])
def test_budget_of_diverse_results(spark, k, limit):
    sizes = {f"{r}-{c}": (r, c) for r in (0, 1, 4) for c in (0, 2, 5)}
    ex = [(q, f"/r{i}", "outgoing", "p", None, [], None, 9.0 - i, i % 2 == 1) for q, (n, _) in sizes.items() for i in range(n)]
    ex += [(q, f"/c{i}", "outgoing", "p", f"/k{i}", [], None, 5.0 - i, False) for q, (_, n) in sizes.items() for i in range(n)]
    expanded = spark.createDataFrame(ex, "query_id string, neighbor string, direction string, predicate string, claim_path string, source_ids array<string>, confidence string, score double, same_type boolean").withColumn("claim_ref", F.col("claim_path"))
    direct = spark.createDataFrame([(q, f"/d{i}", "x", 1.0 - i / 10, i + 1) for q in sizes for i in range(6)], "query_id string, entity_path string, retriever string, score double, rank int")
    found = graph.diverse(direct, expanded, k, graph.GraphExpansionConfig(expanded_result_limit=limit)).orderBy("query_id", "rank").collect()
    budget = min(limit or max(1, (k + 1) // 2), k)
    for q, (n_r, n_c) in sizes.items():
        got = [x for x in found if x.query_id == q]
        one = min(1, n_r)
        claims = min(n_c, budget - one)
        relations = one + max(0, min(n_r - one, budget - one - claims))
        kinds = [x.entity_path[1] for x in got]
        assert (kinds.count("r"), kinds.count("c"), kinds.count("d")) == (relations, claims, min(6, k - relations - claims))
        if relations == 1 and n_r > 1:
            assert "/r1" in {x.entity_path for x in got}
        assert [x["rank"] for x in got] == list(range(1, len(got) + 1)) and [x.score for x in got] == sorted((x.score for x in got), reverse=True)


def test_context(spark, rows):
    p = spark.createDataFrame([(1, "q", 2, 1.0, "r", "/a", None, "t", ["ref:x", "y", "x", " "]), (2, "q", 1, 0.5, "r", "/a", None, "t", ["ref:x", "y", "x", " "]), (3, "q", 1, None, "s", "/a", None, "t", [])], "packet_id bigint, query_id string, rank int, score double, retriever string, entity_path string, section string, text string, source_ids array<string>")
    refs = spark.createDataFrame([("x", "X", 1999, None)], "reference_id string, title string, year int, url string")
    assert rows(context.distinct_packets(p), "packet_id") == [(2,), (3,)]
    assert rows(context.unresolved(p, refs)) == [("y", 2)]
    out = {r.packet_id: [(x.source_id, x.resolved) for x in r.references] for r in context.assemble(p, refs, strict=False).collect()}
    assert out == {1: [("x", True), ("y", False)], 2: [("x", True), ("y", False)], 3: []}
    with pytest.raises(context.ContextAssemblyError):
        context.assemble(p, refs)


def test_evaluation(spark):
    cases = spark.createDataFrame([("1", '["/a", "/b", "/a"]', "k", True), ("2", '["/c"]', None, False), ("3", "[]", "k", False)], "query_id string, expected_json string, kind string, gap boolean")
    hit = "query_id string, entity_path string, rank int"
    base = evaluation.case_results(cases, spark.createDataFrame([("1", "/b", 2), ("1", "/a", 6), ("2", "/c", 1)], hit))
    new = evaluation.case_results(cases, spark.createDataFrame([("1", "/b", 2), ("1", "/a", 1), ("2", "/x", 1)], hit))
    got = {r.query_id: (r.recall_at_k, r.reciprocal_rank, r.success, r.n_missing) for r in base.collect()}
    assert got == {"1": (0.5, 0.5, False, 1), "2": (1.0, 1.0, True, 0), "3": (0.0, 0.0, False, 0)}
    assert [(r.kind, r.n_cases) for r in evaluation.totals(base, ["kind"]).collect()] == [("k", 2)]
    c = evaluation.compare(base, new).first()
    assert (c.improvement, c.regressions, c.gap_fixed, c.admitted) == (round(-0.5 / 3, 9), 1, True, False)
    assert evaluation.compare(base, new, evaluation.EvaluationProfile(minimum_improvement=-1, maximum_mrr_regression=1, maximum_per_query_regressions=1)).first().admitted


def test_integrity_and_newest(spark, rows):
    import datetime as dt

    t = lambda n: dt.datetime(2024, 1, n)
    df = spark.createDataFrame([("a", "x", t(1), None), ("a", "x", t(2), t(2)), ("b", "y", t(1), t(1)), ("b", "y", t(3), None), (None, "z", t(1), None), ("c", "w", None, None)], "k string, v string, loaded_at timestamp, deleted_at timestamp")
    assert rows(current.newest(df, "k"), "k", "v") == [("b", "y"), ("c", "w")]
    assert rows(integrity.duplicate_keys({"t": (df, "k")})) == [("t", "a", 2), ("t", "b", 2)]
    assert current.newest(df.limit(0), "k").count() == 0


def test_canonical_lines(spark):
    import json
    import struct

    cols = ", ".join(f"{c} {'int' if c == 'ordinal' else 'string'}" for c in (*canonical.CHUNK_COLUMNS, "loaded_at"))
    row = lambda path, n, i: tuple({"chunk_id": i, "entity_path": path, "ordinal": n, "heading": None}.get(c, 0 if c == "ordinal" else "é") for c in (*canonical.CHUNK_COLUMNS, "loaded_at"))
    df = spark.createDataFrame([row("/b", 0, "b0"), row("/a", 1, "a1"), row("/a", 0, "a0")], cols)
    lines = [json.loads(r.line) for r in canonical.chunk_lines(df).collect()]
    assert [x["chunk_id"] for x in lines] == ["a0", "a1", "b0"] and all(list(x) == sorted(x) and x["heading"] is None for x in lines)
    assert canonical.duplicate_ordinals(df.union(df.limit(1))).count() == 1
    v = spark.createDataFrame([("b", "h", [1.5, -0.0]), ("a", "h", [2.0])], "chunk_id string, content_hash string, vector array<double>")
    got = [json.loads(r.line) for r in canonical.vector_lines(v).collect()]
    assert [x["chunk_id"] for x in got] == ["a", "b"] and got[1]["vector_hex"] == struct.pack(">2d", 1.5, -0.0).hex()


def test_admission(spark):
    report = {"k": 5, "evaluation_case_hash": "c", "snapshot_hash": "s", "retrieval_mode": "lexical", "package_identity": "p"}
    row = spark.createDataFrame([(0.1, -0.2, 1, False, 0)], "improvement double, mrr_delta double, regressions int, gap_fixed boolean, unmatched int")
    profile = evaluation.EvaluationProfile(maximum_mrr_regression=0.3, maximum_per_query_regressions=1, require_lexical_gap_success=False)
    checks = evaluation.admission(report, report, row, profile)
    assert checks.columns == ["check", "side", "value", "limit", "ok"] and checks.count() == 15 and checks.filter("NOT ok").count() == 0
    strict = evaluation.EvaluationProfile(minimum_improvement=0.2)
    failed = {(r.check, r.side) for r in evaluation.admission(report, {**report, "k": 3, "retrieval_mode": "hybrid", "snapshot_hash": ""}, row, strict).filter("NOT ok").collect()}
    assert failed == {
        ("same k", "candidate"), ("same snapshot_hash", "candidate"), ("has snapshot_hash", "candidate"), ("has embedding_fingerprint", "candidate"), ("has vector_index_fingerprint", "candidate"), ("has fusion_config", "candidate"),
        ("improvement of the primary metric", "candidate"), ("change of MRR", "candidate"), ("cases with lower recall", "candidate"), ("a gap case is solved", "candidate"),
    }
    assert evaluation.admission({}, {}, row, strict).filter("check LIKE 'has %' AND NOT ok").count() == 8
    with pytest.raises(ValueError):
        evaluation.EvaluationProfile(primary_metric="precision")


def test_any_retriever_can_be_evaluated(spark):
    cases = spark.createDataFrame([("1", "x", '["/a", "/claims/c"]', "k", True), ("2", "y", '["/z"]', None, False)], "query_id string, query_text string, expected_json string, kind string, gap boolean")
    hits = [("1", 2, 0.5, "/q", None), ("1", 4, 0.4, "/a", "/claims/c"), ("1", 9, 0.1, "/z", None), ("2", 1, 1.0, "/y", "no path")]
    found = evaluation.evaluate(cases, lambda q, k: spark.createDataFrame(hits, "query_id string, rank int, score double, entity_path string, claim_path string").join(q.select("query_id"), "query_id"), 5)
    assert {r.query_id: (r.recall_at_k, r.reciprocal_rank) for r in found.collect()} == {"1": (1.0, 0.5), "2": (0.0, 0.0)}
    bare = evaluation.evaluate(cases, lambda q, k: spark.createDataFrame([("2", 1, 1.0, "/z")], "query_id string, rank int, score double, entity_path string"))
    assert {r.query_id: r.success for r in bare.collect()} == {"1": False, "2": True}


def test_cases_of_one_side_are_counted(spark):
    cases = spark.createDataFrame([("1", '["/a"]', None, False), ("2", '["/b"]', None, False)], "query_id string, expected_json string, kind string, gap boolean")
    hits = spark.createDataFrame([("1", "/a", 1), ("2", "/b", 1)], "query_id string, entity_path string, rank int")
    both = evaluation.case_results(cases, hits)
    profile = evaluation.EvaluationProfile(require_lexical_gap_success=False)
    assert evaluation.compare(both, both, profile).first().admitted
    for b, c in ((both, both.filter("query_id = '1'")), (both.filter("query_id = '1'"), both)):
        row = evaluation.compare(b, c, profile).first()
        assert row.unmatched == 1 and row.improvement == 0 and not row.admitted


def test_provenance_of_hits(spark, graph_tables):
    e, r, c = graph_tables
    e = e.withColumn("source_ids_json", F.lit('["ref: own"]'))
    origins = graph.provenance(r, c, e)
    got = {x.entity_path: x for x in origins.collect()}
    assert set(got) == {x.entity_path for x in graph.assertions(r, c, e).collect()}
    for x in got.values():
        assert len(set(x.relation_source_ids)) == len(x.relation_source_ids) and set(x.claim_source_ids) <= set(x.relation_source_ids)
    hits = spark.createDataFrame([("q", "vector", 1, "/a", "c1", None, "t", []), ("q", "lexical", 1, "/a", "c2", None, "u", []), ("q", "lexical", 2, "/none", "c3", None, "v", [])], "query_id string, backend string, rank int, entity_path string, chunk_id string, section string, text string, source_ids array<string>")
    with_ids = graph.with_provenance(hits.filter("backend = 'vector'"), origins).unionByName(graph.with_provenance(hits.filter("backend <> 'vector'"), origins.limit(0)))
    fused = {x.entity_path: x for x in fusion.fuse(with_ids, ("lexical", "vector"), 5).collect()}
    assert fused["/a"].chunk_id == "c2" and fused["/a"].relation_source_ids == got["/a"].relation_source_ids and fused["/a"].requires_hedging == got["/a"].requires_hedging
    assert fused["/none"].relation_source_ids == [] and not fused["/none"].requires_hedging
    assert graph.provenance(r.limit(0), c.limit(0), e).count() == 0


def test_packets_in_order(spark):
    schema = "packet_id bigint, query_id string, rank int, score double, retriever string, entity_path string, section string, text string, source_ids array<string>, relation_source_ids array<string>, metadata_json string, extra int"
    data = [
        (1, "q", 2, 0.5, "r", "/b", None, "t", ["ref:x"], ["y", "x"], None, 1), (2, "q", 1, None, "r", "/a", None, "t", [], None, None, 1), (3, "q", 1, 0.1, "r", "/c", "s", "t", [], None, None, 1),
        (4, "q", 3, 9.0, "r", "/b", None, "t", ["x"], ["y", "x"], None, 1), (5, "q", 3, 9.0, "r", "/b", None, "t", ["x"], ["y", "x"], '{"a": 1}', 1), (6, "p", 1, 1.0, "r", "/b", None, "t", ["x"], [], None, 1),
    ]
    refs = spark.createDataFrame([("x", "X", 1999, None)], "reference_id string, title string, year int, url string")
    out = context.evidence_packets(spark.createDataFrame(data, schema), refs, strict=False)
    assert set(context.PACKET_FIELDS) < set(out.columns) and len(context.PACKET_FIELDS) == 21 and "extra" not in out.columns
    rows = sorted(out.collect(), key=lambda r: (r.query_id, r.position))
    assert [(r.query_id, r.position, r.packet_id) for r in rows] == [("p", 1, 6), ("q", 1, 3), ("q", 2, 2), ("q", 3, 1), ("q", 4, 5)]
    assert [(x.source_id, x.resolved) for x in rows[3].references] == [("x", True), ("y", False)] and rows[3].source_ids == ["x"]
    assert context.evidence_packets(spark.createDataFrame(data, schema), refs, strict=False, deduplicate=False).count() == 6
    with pytest.raises(context.ContextAssemblyError):
        context.evidence_packets(spark.createDataFrame(data, schema), refs)
    assert context.evidence_packets(spark.createDataFrame([], schema), refs).count() == 0


def test_own_confidence_weights(spark, graph_tables):
    e, r, c = graph_tables
    config = graph.GraphExpansionConfig(confidence_weights={"A": 0.2})
    got = {x.confidence: x.confidence_weight for x in graph.with_policy(graph.edges(r, c, e), config).filter("kind = 'claim'").collect()}
    assert got.get("A", 0.2) == 0.2 and all(w == 0.5 for k, w in got.items() if k not in ("A", None))
    with pytest.raises(ValueError):
        graph.GraphExpansionConfig(confidence_weights={"A": 2})


def test_both_forms_of_the_gram_join_and_the_scan_agree(spark, rows, monkeypatch):
    from loreweave.plans import skew

    records = spark.createDataFrame([(f"/r{i}", f"alpha beta {i}", ["x", f"gamma{i % 3}"]) for i in range(30)] + [("/n", None, [])], "entity_path string, title string, tags array<string>")
    queries = spark.createDataFrame([(f"q{i}", t) for i, t in enumerate(["alpha", "beta 3", "gamma1", "x", "zz", "  ", "alpha beta 7"])], "query_id string, query_text string")
    weights = {"title": 8.0, "tags": 2.0}
    found = []
    for limit in (200_000, 0):
        monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
        fields = lexical.field_values(records, "entity_path", "entity", weights)
        found.append(rows(lexical.top_k(lexical.lexical_scores(lexical.prepared_queries(queries), fields, lexical.postings(fields), weights), 5), "query_id", "record_id", "score", "rank"))
    for limit in (2048, 6, 5, 1):  # there are six queries
        monkeypatch.setattr(lexical, "SCAN_QUERIES", limit)
        found.append(rows(lexical.scan_top_k(queries, records, "entity_path", weights, 5), "query_id", "record_id", "score", "rank"))
    assert all(f == found[0] for f in found) and len(found[0]) > 12
    for bad in (0, True, 1.5):
        with pytest.raises(ValueError):
            lexical.scan_top_k(queries, records, "entity_path", weights, bad)


def test_field_ids_are_unique(spark):
    records = spark.createDataFrame([(f"/r{i}", "t", ["a", "a"]) for i in range(50)], "entity_path string, title string, tags array<string>").repartition(5)
    e = lexical.field_values(records, "entity_path", "entity", {"title": 1.0, "tags": 1.0})
    c = lexical.field_values(records, "entity_path", "chunk", {"title": 1.0, "tags": 1.0})
    both = e.union(c)
    assert both.count() == 300 == both.select("field_id").distinct().count() and both.filter("field_id < 0").count() == 0


def test_content_hashes_that_differ(spark, tmp_path, rows):
    import hashlib

    from loreweave.plans import retrieval

    good = hashlib.sha256(b"t").hexdigest()
    spark.createDataFrame([("a", "t", good), ("b", "t", "0" * 64), ("c", None, good), ("d", "", None), ("b", "t", "0" * 64), (None, "t", "x"), ("e", None, None)], "chunk_id string, text string, content_hash string").write.parquet(str(tmp_path / "chunks.parquet"))
    assert rows(retrieval.content_hash_mismatches(spark, str(tmp_path))) == [("b",), ("c",), ("d",)]


@pytest.mark.parametrize("line,title", [("# A", "A"), ("   ###### A b ##", "A b"), ("    # A", ""), ("\t# A", "A"), ("####### A", ""), ("#A", ""), ("# ", ""), ("#", ""), ("# ##", ""), ("# A#", "A#"), ("# A # #", "A #"), ("#\tA", "A"), ("text # A", ""), ("", "")])
def test_heading_lines(line, title):
    assert chunking.heading_title(line) == title


@pytest.mark.parametrize("line,fence", [("```", ("```", "")), ("  ~~~~ py", ("~~~~", "py")), ("\t```x", ("```", "x")), ("``", ("", "")), ("    ```", ("", "")), ("a ```", ("", ""))])
def test_fence_lines(line, fence):
    assert chunking.fence_of(line) == fence


def test_assertions(spark, graph_tables):
    e, r, c = graph_tables
    got = {(x.entity_path, x.kind, x.predicate, x.claim_ref): (x.confidence_weight, x.affirmative) for x in graph.assertions(r, c, e).collect()}
    assert len(got) == 9 and got["/b", "relation", "knows", None] == (1.0, True) and got["/a", "claim", "taught", "/k2"] == (0.25, False) and got["/a", "claim", "taught", "/k4"] == (1.0, None)


def test_claims_of_one_reference_merge(spark):
    schema = "claim_key string, claim_id string, claim_path string, statement string, status string, confidence string, subject string, predicate string, target string, property string, value_json string, source_ids_json string, n int"
    data = [("k2", "i", "/c", "late", "", "B", "/a", None, None, None, None, '["y", "ref: x"]', 9), ("k1", None, "/c", "early", "", None, "/b", None, None, None, None, '["x", "z"]', 9), ("k3", "j", None, None, None, None, None, None, None, None, None, None, 9), ("k4", "j", "", "s", None, None, None, None, None, None, None, "[]", 9)]
    got = {r.claim_ref: r for r in graph.merged_claims(spark.createDataFrame(data, schema)).collect()}
    assert set(got) == {"/c", "j"} and got["/c"].statement == "early" and got["/c"].claim_id == "i" and got["/c"].confidence == "B" and got["/c"].status is None
    assert got["/c"].source_ids == ["x", "z", "y"] and (got["/c"].n, got["j"].n) == (2, 2) and got["j"].source_ids == [] and got["j"].statement == "s"
