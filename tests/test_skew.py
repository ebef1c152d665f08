from itertools import combinations, product
from pathlib import Path

import pytest

from loreweave.plans import skew
from loreweave.plans.lineage import cut, release, shared_dir
from loreweave.plans.skew import group_pairs, member_pairs


@pytest.mark.parametrize("most,limit", [(1024, 200_000), (7, 200_000), (7, 0)])
def test_pairs_of_a_hot_group_come_out_once(spark, rows, monkeypatch, most, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    data = [("hot", i, i % 5) for i in range(120)] + [("cold", 1, 0), ("cold", 2, 0), ("lone", 3, 0), ("hot", 4, 9)]
    df = spark.createDataFrame(data, "g string, item int, room int")
    want = [(a[0], *a[1:], *b[1:]) for x, y in combinations(data, 2) for a, b in [sorted((x, y), key=lambda r: r[1])] if a[0] == b[0] and a[1] != b[1]]
    got = group_pairs(df, ["g"], "item", most)
    assert got.columns == ["g", "item_a", "room_a", "item_b", "room_b"] and rows(got) == sorted(want, key=repr)
    assert rows(group_pairs(df.limit(0), ["g"], "item", most)) == []


@pytest.mark.parametrize("most,limit", [(1024, 200_000), (7, 200_000), (7, 0)])
def test_members_of_hot_groups_are_paired_once(spark, rows, monkeypatch, most, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    own = {"a": list(range(60)), "b": list(range(100, 145)), "c": [7], "d": []}
    members = spark.createDataFrame([(g, k) for g, ks in own.items() for k in ks], "c string, key int")
    pairs = [("a", "b", 1), ("a", "c", 2), ("c", "d", 3), ("a", "a", 4), ("c", "c", 5)]
    got = member_pairs(spark.createDataFrame(pairs, "c_a string, c_b string, x int"), members, "c", "key", most)
    assert rows(got) == sorted([(*p, i, j) for p in pairs for i, j in product(own[p[0]], own[p[1]])], key=repr)
    assert rows(member_pairs(spark.createDataFrame([], "c_a string, c_b string"), members, "c", "key", most)) == []


def test_cut_tables_can_be_released(spark):
    folder = Path(shared_dir(spark).removeprefix("file:").replace("//", "/"), "loreweave")
    before = {p.name for p in folder.glob("*")}
    df = cut(spark.range(5))
    (own,) = {p.name for p in folder.iterdir()} - before
    assert df.count() == 5 and release(spark) >= 1
    assert not (folder / own).exists() and release(spark) == 0
