import numpy as np

from loreweave.llm.mixing import mix_report, pivot, select_mix, source_plan


def test_pivot_keeps_the_sum_and_the_expectation():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 500, 301).astype(float)
    p = rng.random(301)
    mean = np.zeros(301)
    for seed in range(300):
        out = pivot(np.arange(301), size, p, seed)
        assert abs((out * size).sum() - (p * size).sum()) < 1e-6
        assert ((out == 0) | (out == 1)).sum() >= 300
        mean += out / 300
    assert np.abs(mean - p).max() < 0.15 and abs((mean - p).mean()) < 0.01


def test_shares_caps_and_levels(spark):
    data = [(i, "big", 10 + i % 7) for i in range(5000)] + [(10_000 + i, "small", 20) for i in range(30)] + [(20_000, "tiny", 50), (20_001, None, 5), (20_002, "other", 9), (20_003, "small", 0)]
    sized = spark.createDataFrame(data, "key bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.3, 100), ("tiny", 0.1, 3), ("none", 0.1, 3), ("small", 0.3, 100), (None, 1.0, 1)], "source string, weight double, max_repeats int")
    plan = source_plan(sized, targets, 20_000)
    for group in (100, 100_000):
        chosen = select_mix(sized, plan, group=group)
        rows = chosen.collect()
        assert len({r.key for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "small", "tiny"}
        report = {r.source: r for r in mix_report(chosen, plan).collect()}
        assert abs(report["big"].actual_tokens - 10_000) <= 16 and abs(report["small"].actual_tokens - 6000) <= 20
        assert report["tiny"].actual_tokens == 150 and report["tiny"].most_copies == 3 and not report["tiny"].reached
        assert report["none"].actual_tokens == 0 and not report["none"].reached and report["big"].reached
        assert all(report[s].most_copies <= m for s, m in (("big", 2), ("small", 100)))
        assert abs(sum(r.actual_share for r in report.values()) - 1) < 1e-9


def test_same_seed_same_selection_and_empty(spark, rows):
    sized = spark.createDataFrame([(i, "a", 7) for i in range(200)], "key bigint, source string, n_tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, weight double, max_repeats int")
    plan = source_plan(sized, targets, 700)
    assert rows(select_mix(sized, plan)) == rows(select_mix(sized.repartition(3), plan))
    assert select_mix(sized.limit(0), source_plan(sized.limit(0), targets)).count() == 0
