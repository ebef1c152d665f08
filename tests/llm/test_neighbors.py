import threading
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from loreweave.llm import neighbors
from loreweave.llm.neighbors import encode, estimate, nearest, usable_vectors
from loreweave.plans import lineage

DIM = 24


def frame(spark, vectors):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(x) for x in v], 1) for k, v in vectors], "id string, vector array<double>, v int")


def data(n, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((9, DIM))
    x = centres[rng.integers(0, 9, n)] + 0.7 * rng.standard_normal((n, DIM))
    return x * rng.uniform(0.01, 50, (n, 1))


@pytest.mark.parametrize("block,queries", [(8192, 65_536), (150, 400)])
def test_recall(spark, monkeypatch, block, queries):
    monkeypatch.setattr(neighbors, "BLOCK", block)
    monkeypatch.setattr(neighbors, "QUERIES", queries)
    x = data(3000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {f"k{i}": {f"k{j}" for j in np.argsort(-r)[:10]} for i, r in enumerate(s)}
    got = {r.key: [h.key for h in r.hits] for r in nearest(usable_vectors(frame(spark, [(f"k{i}", v) for i, v in enumerate(x)]), "id", "vector", DIM), DIM, list_size=300).collect()}
    assert set(got) == set(want) and all(len(v) == 10 == len(set(v)) for v in got.values())
    assert np.mean([len(want[k] & set(v)) / 10 for k, v in got.items()]) >= 0.95


@pytest.mark.parametrize("recall,least", [(neighbors.RECALL, 0.98), (1.0, 0.995)])
def test_recall_with_500_lists(spark, monkeypatch, recall, least):
    """Against brute force, by queries of which most had no part in fitting the lists that are searched."""
    monkeypatch.setattr(neighbors, "TWO_LEVELS", 100)
    monkeypatch.setattr(neighbors, "CALIBRATION", 200)
    x = data(5000)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    want = {f"k{i}": {f"k{j}" for j in np.argsort(-r)[:10]} for i, r in enumerate(s)}
    units = usable_vectors(frame(spark, [(f"k{i}", v) for i, v in enumerate(x)]), "id", "vector", DIM)
    got = {r.key: {h.key for h in r.hits} for r in nearest(units, DIM, list_size=10, recall=recall).collect()}
    assert set(got) == set(want) and np.mean([len(want[k] & v) / 10 for k, v in got.items()]) >= least


def test_two_levels_make_as_many_lists():
    x = data(20_000).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = neighbors.fit_lists(x, 2000)
    assert 1900 < len(c) < 2100 and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-4)


def test_lists_out_of_reach_hold_nothing_better():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((6, DIM)), 50, axis=0) + 0.1 * rng.standard_normal((300, DIM))
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    c = neighbors.fit_centroids(x, 12)
    s = x @ c.T
    own = s.argmax(axis=1)
    radius = np.array([np.arccos(np.clip(s[own == i, i].min(initial=1), -1, 1)) for i in range(12)])
    floor = np.sort(x @ x.T, axis=1)[:, -11]
    may = neighbors.within_reach(x, floor, c, radius)
    assert may[np.arange(300)[:, None], own[np.argsort(-(x @ x.T), axis=1)[:, :11]]].all() and may.mean() < 0.5
    assert neighbors.within_reach(x, np.full(300, -2, np.float32), c, radius).all()  # fewer than k so far


def test_estimates_stay_within_their_bounds():
    x = data(500).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    c = x.mean(axis=0)
    value, error = estimate(x[:100], c, encode(x, c), DIM)
    off = value - x[:100] @ x.T
    assert (np.abs(off) <= error + 1e-5).mean() > 0.9 and abs(off.mean()) < 0.02


def test_unusable_and_equal_vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.standard_normal(DIM)
    rows = [(f"same{i:02}", v) for i in range(30)] + [("near", v + 0.01 * rng.standard_normal(DIM)), ("far", -v), ("near", v + 1)]
    rows += [("null", None), ("empty", []), ("short", v[:5]), ("zero", v * 0), ("nan", [float("nan")] * DIM), ("gap", [None, *v[1:]]), (None, v), ("inf", [float("inf"), *v[1:]])]
    got = {r.key: [(h.key, round(h.similarity, 4)) for h in r.hits] for r in nearest(usable_vectors(frame(spark, rows), "id", "vector", DIM), DIM).collect()}
    assert set(got) == {f"same{i:02}" for i in range(30)} | {"near", "far"}
    assert [k for k, _ in got["same00"]] == [f"same{i:02}" for i in range(1, 11)] and [k for k, _ in got["same20"]] == [f"same{i:02}" for i in range(10)]
    assert {s for _, s in got["same05"]} == {1.0} and len(got["far"]) == 10
    assert nearest(usable_vectors(frame(spark, rows).limit(0), "id", "vector", DIM), DIM).collect() == []
    assert [list(r.hits) for r in nearest(usable_vectors(frame(spark, rows[:1]), "id", "vector", DIM), DIM).collect()] == [[]]


def test_best_first_and_ties_by_key():
    rng = np.random.default_rng(6)
    i, score = rng.integers(0, 9, 500), rng.choice(np.array([-1, -0.5, 0, 0.25, 0.5, 1.0000001], np.float32), 500) + rng.choice(np.array([0, 0.125], np.float32), 500)
    names = pa.array([f"n{x}" for x in rng.permutation(500)])
    got = neighbors._ranked(i, np.arange(500), score, names, np.full(9, 20))
    want = sorted(range(500), key=lambda x: (i[x], -score[x], names[x].as_py()))
    assert got[1].tolist() == [x for q in range(9) for x in [w for w in want if i[w] == q][:20]]


def test_lists_of_one_cell_are_few_enough():
    rng = np.random.default_rng(7)
    size = rng.integers(0, 50, 200)
    size[17] = 900
    cell = neighbors.cells_of(rng.standard_normal((200, DIM)).astype(np.float32), size, 300)
    members = np.bincount(cell, weights=size)
    assert set(cell) == set(range(len(members))) and sorted(members)[-2] <= 300 and len(members) < 60


def on_disk(spark):
    """Bytes of shuffles and of tables that were cut."""
    folders = [*spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString(), lineage.shared_dir(spark).removeprefix("file:") + "/loreweave"]
    total = 0
    for p in (p for f in folders for p in Path(f).rglob("*")):
        try:
            total += p.stat().st_size
        except OSError:
            pass  # deleted meanwhile
    return total


def test_disk_follows_the_vectors_and_not_the_lists_searched(spark, monkeypatch):
    """3,000 queries that search most of 300 lists, in several waves: the vectors take 0.3 MB, and once a query and list 80 MB or so."""
    monkeypatch.setattr(neighbors, "LEAST_WAVE", 1, raising=False)
    x = np.random.default_rng(8).standard_normal((3000, DIM))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    units = usable_vectors(frame(spark, [(f"k{i}", v) for i, v in enumerate(x)] + [("copy", x[5])]), "id", "vector", DIM)
    before, peak, ended = on_disk(spark), [0], threading.Event()

    def watch():
        while not ended.wait(0.1):
            peak[0] = max(peak[0], on_disk(spark))

    thread = threading.Thread(target=watch)
    thread.start()
    try:
        got = {r.key: [h.key for h in r.hits] for r in nearest(units, DIM, list_size=10, recall=1.0).collect()}
    finally:
        ended.set()
        thread.join()
    assert set(got) == {f"k{i}" for i in range(3000)} | {"copy"} and all(len(v) == 10 == len(set(v)) for v in got.values())
    assert got["copy"][0] == "k5" and got["k5"][0] == "copy" and got["copy"][1:] == got["k5"][1:]
    assert np.mean([len({f"k{j}" for j in np.argsort(-r)[:10]} & set(got[f"k{i}"])) / 10 for i, r in enumerate(s)]) >= 0.99
    assert peak[0] - before < 20e6
