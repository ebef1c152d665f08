import random

from loreweave.plans.lineage import cut, semi_join
from loreweave.plans.ranking import value_ranks


def test_ranks_over_parts(spark):
    r = random.Random(1)
    data = [(r.choice("aaab"), r.randint(0, 40)) for _ in range(2000)] + [("c", None), (None, 3)]
    df = spark.createDataFrame(data, "g string, v int")
    got = {(x.g, x.v): (x.n, x.below, x.total) for x in value_ranks(df, ["g"], "v").collect()}
    for g, v in {d for d in data if d[1] is not None}:
        own = [x for h, x in data if h == g and x is not None]
        assert got[g, v] == (own.count(v), sum(x < v for x in own), len(own))
    assert len(got) == len({d for d in data if d[1] is not None})


def test_cut_and_semi_join(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    kept = cut(df)
    assert rows(kept) == rows(df) and kept.schema.simpleString() == df.schema.simpleString()
    for most in (0, 10):
        assert rows(semi_join(df, cut(df.filter("v = 'b'").select("k")), "k", most)) == [(2, "b")]
