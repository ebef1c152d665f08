import datetime as dt

import pytest

from loreweave.operators.orphans import orphan_references, orphan_report

REC = "entity_path string, source_ids_json string, loaded_at timestamp, deleted_at timestamp"
CLAIM = "claim_key string, source_ids_json string, loaded_at timestamp"
REL = "relation_id bigint, target string, loaded_at timestamp"
REF = "reference_id string, loaded_at timestamp, deleted_at timestamp, extra string"


def day(n):
    return dt.datetime(2024, 1 + n // 28, 1 + n % 28)


@pytest.fixture
def tables(spark):
    return {
        "entities": spark.createDataFrame(
            [
                ("/a", '["ref: x", " REF:gone ", "late", ""]', day(5), None),
                ("/a", '["ref: x", " REF:gone ", "late", ""]', day(3), None),
                ("/b", None, day(1), None),
                ("/b", None, day(2), day(2)),
                ("/c", "not json", day(40), None),
            ],
            REC,
        ),
        "claims": spark.createDataFrame([("k1", '["late", null, "x", "X"]', day(50)), (None, '["gone"]', day(1))], CLAIM),
        "relations": spark.createDataFrame([(1, "/a", day(1)), (2, "/b", day(9)), (3, "term", day(9)), (4, "/zz", day(9)), (5, None, day(9)), (4, "/zz", day(10))], REL),
        "kb_references": spark.createDataFrame([("x", day(0), None, "e"), ("dead", day(0), None, "e"), ("late", day(10), None, "e")], REF),
    }


def test_reasons(tables, rows):
    got = rows(orphan_references(tables), "table_name", "record_key", "ref_key", "reason")
    assert got == sorted(
        [
            ("entities", "/a", "gone", "missing"),
            ("entities", "/a", "late", "late"),
            ("claims", "k1", "X", "missing"),
            ("relations", "1", "/a", "late"),
            ("relations", "2", "/b", "deleted"),
            ("relations", "4", "/zz", "missing"),
        ],
        key=repr,
    )


def test_report_by_month(tables, rows):
    got = rows(orphan_report(orphan_references(tables)), "table_name", "period", "reason", "n_references")
    assert ("claims", "2024-02", "missing", 1) in got and ("entities", "2024-01", "late", 1) in got
    assert sum(r[3] for r in got) == 6


def test_hot_key_and_empty(tables, spark, rows):
    many = [(i, "/hot", day(9)) for i in range(3000)] + [(5000 + i, f"/t{i}", day(9)) for i in range(900)]
    tables["relations"] = spark.createDataFrame(many, REL)
    got = rows(orphan_references(tables).filter("table_name = 'relations'"), "record_key", "reason")
    assert len(got) == 3900 and {r[1] for r in got} == {"missing"}
    empty = {n: t.limit(0) for n, t in tables.items()}
    assert rows(orphan_references(empty)) == []
