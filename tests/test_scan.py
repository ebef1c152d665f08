"""Scans of values for many queries at once, held against the joins of postings."""

import random

import pytest
from pyspark.sql import functions as F

from loreweave.operators import hybrid, lexical
from loreweave.sources.store import Index

WEIGHTS = {"title": 8.0, "aliases": 7.0, "tags": 2.0}


@pytest.fixture(scope="module")
def dirty(spark):
    """Queries, fields and postings with ties, repeated rows, fields without postings or with some missing, postings without a field, and null and empty values."""
    r = random.Random(5)
    word = lambda k: "".join(r.choice("abcdé日") for _ in range(k))
    values = [(i, f"/r{i // 3}", ("title", "aliases", "tags", "other")[i % 4], r.choice([word(r.randint(1, 9)), "abcab", ""])) for i in range(240)]
    values += [(240, "/null", "title", None), (241, "/none", "title", "abcd"), (242, "/part", "title", "abcdabc"), *values[:9]]
    fields = spark.createDataFrame(values, "field_id bigint, record_id string, field_name string, normalized_value string")
    posted = lexical.postings(fields.filter("field_id < 241")).union(spark.createDataFrame([(240, "ab"), (242, "ab"), (242, "zz"), (999, "ab"), (3, "ab")], "field_id bigint, gram string"))
    texts = [word(k) for k in (1, 1, 2, 3, 3, 5, 8, 13)] + ["abcd", "abcab", "a", "xyz", "  ", values[0][3] or "ab", "".join(map(chr, range(0x4E00, 0x4E00 + 300))) + "ab"]
    queries = lexical.prepared_queries(spark.createDataFrame(list(enumerate(texts)), "query_id bigint, query_text string"))
    return queries, fields, posted


@pytest.fixture(params=[(16_384, 256), (3, 256), (16_384, 1), (4, 2)])
def limits(request, monkeypatch):
    """Several passes, and grams that are rows of the matrix or lists."""
    monkeypatch.setattr(lexical, "SCAN_QUERIES", request.param[0])
    monkeypatch.setattr(lexical, "DENSE", request.param[1])


def rounded(df):
    return sorted((x.query_id, x["rank"], x.record_id or "", round(x.score, 9)) for x in df.collect())


def test_search_reads_no_postings(spark):
    """what a search finds comes from the fields; a posting for each gram of each text is not made, nor moved for each query."""
    e = spark.createDataFrame([("/a", "note", "alpha", "alpha text", None, '["s1"]', "[]", None), ("/b", "note", "beta", "beta alpha", None, "[]", "[]", None)], "entity_path string, entity_type string, title string, content string, description string, source_ids_json string, tags_json string, aliases_json string")
    c = spark.createDataFrame([("/a#0", "/a", 0, None, "alpha text", "alpha", "[]"), ("/b#0", "/b", 0, "h", "beta alpha", "beta", "[]")], "chunk_id string, entity_path string, ordinal int, heading string, text string, title string, source_ids_json string")
    fields = lexical.field_values(e, "entity_path", "entity", lexical.ENTITY_WEIGHTS).unionByName(lexical.field_values(c, "chunk_id", "chunk", lexical.CHUNK_WEIGHTS))
    read = spark.range(3).select(F.col("id").alias("field_id"), F.raise_error(F.lit("postings were read")).cast("string").alias("gram"))
    index = Index({"entities": e, "chunks": c, "lexical_fields": fields, "lexical_ngrams": read}, {"ngram_size": 2})
    asked = spark.createDataFrame([("q1", "alpha"), ("q2", " "), ("q3", "beta")], "query_id string, query_text string")
    assert [(x.query_id, x.chunk_id) for x in hybrid.chunk_hits(asked, index, 1).orderBy("query_id").collect()] == [("q1", "/a#0"), ("q3", "/b#0")]
    assert [(x.query_id, x.entity_path) for x in hybrid.entity_hits(asked, index, 1).orderBy("query_id").collect()] == [("q1", "/a"), ("q3", "/b")]


def test_best_records_of_fields(dirty, limits):
    """the scan of fields gives what the join of postings does."""
    queries, fields, posted = dirty
    for k in (1, 4, 500):
        want = rounded(lexical.top_k(lexical.lexical_scores(queries, fields, posted, WEIGHTS), k))
        assert rounded(lexical.field_top_k(queries, fields, WEIGHTS, k, posted)) == want and len(want) > 10
    whole = lexical.postings(fields)
    assert rounded(lexical.field_top_k(queries, fields, WEIGHTS, 4)) == rounded(lexical.top_k(lexical.lexical_scores(queries, fields, whole, WEIGHTS), 4))


def test_candidates(dirty, limits, rows):
    """each candidate record of a query once, without a row for each shared gram."""
    queries, fields, posted = dirty
    found = lexical.candidates(queries, fields, posted)
    assert rows(found) == rows(lexical.field_matches(queries, fields, posted).select("query_id", "record_id").distinct())
    assert found.count() > 500


def test_many_queries_need_no_postings(spark, monkeypatch):
    """beyond `SCAN_QUERIES` queries there are more passes, and no join of postings."""
    monkeypatch.setattr(lexical, "SCAN_QUERIES", 2)
    monkeypatch.setattr(lexical, "lexical_scores", None)
    records = spark.createDataFrame([(f"/r{i}", f"alpha {i}", ["x", None]) for i in range(20)] + [("/n", None, None), (None, "alpha", [])], "p string, title string, tags array<string>")
    queries = spark.createDataFrame([(i, f"alpha {i}") for i in range(7)], "query_id bigint, query_text string")
    found = rounded(lexical.scan_top_k(queries, records, "p", WEIGHTS, 1))
    assert found == [(i, 1, f"/r{i}", 24.0) for i in range(7)]


def test_shares_of_fields(dirty, limits, rows):
    """what each candidate field shares with each query, counted in place of a row for each shared gram."""
    queries, fields, posted = dirty
    inside = F.col("normalized_value").contains(F.col("q"))
    share = F.when(inside, 1.0).otherwise(F.round(F.col("shared") / F.col("n_grams"), 9))
    want = lexical.field_matches(queries, fields, posted).select("query_id", "field_id", "shared", inside.alias("inside"), share.alias("coverage"))
    found = lexical.field_shares(queries, fields, posted)
    assert found.dtypes == want.dtypes and rows(found) == rows(want)
    assert found.filter("inside IS NULL").count() > 0


def test_shares_round_as_in_sql(spark):
    pairs = [(i, n) for n in range(1, 64) for i in range(n + 1)] + [(1, 1024), (3, 1024)]
    got = spark.createDataFrame(pairs, "a int, n int").select("a", "n", F.round(F.col("a") / F.col("n"), 9).alias("r")).collect()
    assert all(lexical.rounded_share(x.a, x.n) == x.r for x in got)
