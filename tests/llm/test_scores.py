import math
from fractions import Fraction

import numpy as np

from loreweave.llm.distinctive import enrichment, log_gamma, log_tail, term_counts
from loreweave.llm.rank_fusion import DIRECTIONS, one_ranking, rank_shares


def test_log_gamma_and_tails():
    x = np.array([0.5, 1, 2, 3.7, 12, 400, 1e6])
    assert np.allclose(log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)
    for N in (9, 30, 120):
        for K in (1, 2, N // 3, N):
            for n in (1, 4, N // 2):
                for k in range(0, min(n, K) + 1):
                    exact = sum(Fraction(math.comb(K, i) * math.comb(N - K, n - i), math.comb(N, n)) for i in range(k, min(n, K) + 1))
                    assert math.isclose(float(log_tail([k], [n], [K], [N])[0]), math.log(exact), rel_tol=1e-9, abs_tol=1e-9)


def test_enrichment_and_adjustment(spark):
    fields = spark.createDataFrame([(1, "/a", "ab"), (2, "/a", "b"), (3, "/b", "ab"), (4, "/c", ""), (1, "/a", "ab"), (5, "/c", "zz"), (6, None, "q")], "field_id bigint, record_id string, normalized_value string")
    grams = spark.createDataFrame([(1, "ab"), (2, "b"), (3, "ab"), (1, "ab"), (5, "zz"), (9, "lost"), (4, ""), (None, "x")], "field_id bigint, gram string")
    counts = term_counts(fields, grams)
    got = {(r.kind, r.record_id, r.term): r for r in enrichment(counts).collect()}
    assert {k[1:] for k in got if k[0] == "gram"} == {("/a", "ab"), ("/a", "b"), ("/b", "ab"), ("/c", "zz")}
    assert got["gram", "/a", "ab"].n_records == 2 and got["gram", "/c", "zz"].n_records == 1
    assert got["gram", "/c", "zz"].score > got["gram", "/a", "ab"].score
    for kind in ("gram", "value"):
        own = sorted((r.p_value, r.q_value) for (k, _, _), r in got.items() if k == kind)
        want = [min(p2 * len(own) / sum(p <= p2 for p, _ in own) for p2, _ in own[i:]) for i in range(len(own))]
        assert np.allclose([q for _, q in own], np.minimum(want, 1))
    assert enrichment(counts.limit(0)).collect() == []


def test_rank_shares_and_ranking(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, "x", "Vector.Chunk ", 0.9), (1, "x", "vector.chunk", 0.1), (1, "y", "vector.chunk", 0.5), (1, "z", "vector.chunk", 0.5), (1, "w", "vector.chunk", nan), (1, "x", "lexical.entity", 1e9), (1, "y", "lexical.entity", None), (1, "q", "lexical.entity", 5.0), (1, "q", "lexical.entity", inf), (None, "q", "lexical.entity", 5.0), (1, "y", "unknown", 3.0), (2, "y", "graph.one-hop", 3.0)]
    df = spark.createDataFrame(data, "grp bigint, item string, scorer string, score double")
    shares = {(r.grp, r.item, r.scorer): r.share for r in rank_shares(df, DIRECTIONS).collect()}
    assert shares == {(1, "x", "vector.chunk"): 2.5 / 3, (1, "y", "vector.chunk"): 1 / 3, (1, "z", "vector.chunk"): 1 / 3, (1, "x", "lexical.entity"): 0.75, (1, "q", "lexical.entity"): 0.25, (2, "y", "graph.one-hop"): 0.5}
    got = {(r.grp, r.item): r["rank"] for r in one_ranking(df, DIRECTIONS).collect()}
    assert got[1, "x"] == 1 and got[1, "y"] < got[1, "z"] and got[2, "y"] == 1 and sorted(v for k, v in got.items() if k[0] == 1) == [1, 2, 3, 4]
    assert one_ranking(df.limit(0), DIRECTIONS).collect() == []


def test_listed_items_without_ratings_come_last(spark):
    data = [("1", "x", "vector.chunk", 0.9), ("1", "b", "vector.chunk", float("nan")), ("1", "a", "lexical.chunk", None), ("1", "a", "unknown", 3.0), ("1", "y", "vector.chunk", 0.1), ("2", "z", "vector.chunk", float("inf")), ("2", None, "vector.chunk", 1.0), (None, "z", "vector.chunk", 1.0)]
    df = spark.createDataFrame(data, "grp string, item string, scorer string, score double")
    got = sorted((r.grp, r["rank"], r.item, r.n_scorers) for r in one_ranking(df, DIRECTIONS, df).collect())
    assert got == [("1", 1, "x", 1), ("1", 2, "y", 1), ("1", 3, "a", 0), ("1", 4, "b", 0), ("2", 1, "z", 0)]


def test_no_scorer_wins_by_its_range(spark):
    rng = np.random.default_rng(3)
    data = []
    for q in range(40):
        truth = rng.random(12)
        for i, t in enumerate(truth):
            data += [(q, f"i{i:02}", "vector.chunk", float(0.7 + 0.1 * t + 0.01 * rng.random())), (q, f"i{i:02}", "lexical.chunk", float(10 * t + rng.random())), (q, f"i{i:02}", "lexical.entity", float(1e6 * rng.random()))]
    got = {}
    for r in one_ranking(spark.createDataFrame(data, "grp bigint, item string, scorer string, score double"), DIRECTIONS).collect():
        got[r.grp, r.item] = r["rank"]
    by_entity = sum(got[q, i] == 1 for q in range(40) for _, i in [max((s, i) for p, i, n, s in data if p == q and n == "lexical.entity")])
    by_vector = sum(got[q, i] == 1 for q in range(40) for _, i in [max((s, i) for p, i, n, s in data if p == q and n == "vector.chunk")])
    assert by_vector > 2 * by_entity


def test_clashing_columns_and_a_hot_record(spark):
    grams = [(i % 40, f"g{i}") for i in range(400)]
    fields = spark.createDataFrame([(i, "/hot" if i < 30 else f"/r{i}", f"v{i}", 1, "x") for i in range(40)], "field_id bigint, record_id string, normalized_value string, k int, term string")
    got = enrichment(term_counts(fields, spark.createDataFrame([(a, b, 3) for a, b in grams], "field_id bigint, gram string, n int"))).collect()
    assert len(got) == 440 and all(0 < r.p_value <= 1 and r.p_value <= r.q_value <= 1 for r in got)
    df = spark.createDataFrame([(1, "x", "vector.chunk", 0.9, 5, 6.0)], "grp bigint, item string, scorer string, score double, rank int, share double")
    assert [(r["rank"], r.n_scorers) for r in one_ranking(df, DIRECTIONS).collect()] == [(1, 1)]
