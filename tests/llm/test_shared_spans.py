import random

import numpy as np

from loreweave.llm.shared_spans import common_ranges, compact_windows, shared_pairs, shared_report, tree_extents


def brute(texts, span):
    windows = {}
    for k, t in texts:
        for i in range(len(t or "") - span + 1):
            windows.setdefault(t[i : i + span], set()).add(k)
    return {(a, b) for ks in windows.values() for a in ks for b in ks if a < b}


def corpus(seed):
    r = random.Random(seed)
    word = lambda n, a="abcdefghij klmnop": "".join(r.choice(a) for _ in range(n))
    texts = [word(r.randint(0, 400)) for _ in range(40)]
    for _ in range(25):  # spans of lengths around the limit, also of wide letters
        s = word(r.randint(110, 135), r.choice(["abcdefgh", "日本語の文字列", "aé日😀"]))
        for _ in range(2):
            i = r.randrange(len(texts))
            at = r.randint(0, len(texts[i]))
            texts[i] = texts[i][:at] + s + texts[i][at:]
    texts += [texts[0] + word(200), texts[1], texts[1], None, "", "x" * 119, "-" * 300, "a" + "-" * 200]
    return list(enumerate(texts))


def test_pairs_as_by_brute_force(spark):
    for seed in (1, 2):
        data = corpus(seed)
        df = spark.createDataFrame([(k, t, "c") for k, t in data], "doc_id bigint, text string, class string")
        got = {tuple(r) for r in shared_pairs(df, "doc_id", "text").collect()}
        assert got == brute(data, 120)


def test_report(spark):
    s = "".join(chr(97 + (i * i * 7 + i) % 26) for i in range(150))
    df = spark.createDataFrame([(1, "x" * 50 + s), (2, s + "y" * 50), (3, None), (4, "short"), (5, "z" * 130), (6, "z" * 130)], "id bigint, text string")
    got = {r.key: r for r in shared_report(df, "id", "text").collect()}
    assert [tuple(x) for x in got[1].ranges] == [(50, 200)] and [tuple(x) for x in got[2].ranges] == [(0, 150)]
    assert got[1].shared_ratio == 0.75 and got[3].shared_chars == 0 and got[4].n_chars == 5
    assert got[5].shared_ratio == 1.0 and got[6].shared_ratio == 1.0
    assert shared_pairs(df.limit(0), "id", "text").collect() == []


def test_tree_and_windows_cover_every_window():
    h = [5, 3, 9, 3, 1, 7]
    left, right = tree_extents(h, 0, 5, list(range(6)))
    assert list(zip(left, right)) == [(0, 0), (0, 3), (2, 2), (2, 3), (0, 5), (5, 5)]
    r = random.Random(3)
    data = np.frombuffer(bytes(r.choice(b"abc") for _ in range(900)), np.uint8)
    text, h, rooms, _, _ = compact_windows(data, np.array([0, 100, 500, 900]), 120, 56)
    assert set(text.tolist()) == {1, 2} and (rooms // 256 + rooms % 256 + 1 >= 65).all()


def test_common_ranges():
    a = np.frombuffer(("q" * 10 + "abcdefghij" * 13).encode("utf-32-le"), np.uint32)
    b = np.frombuffer(("abcdefghij" * 13 + "r" * 10).encode("utf-32-le"), np.uint32)
    assert common_ranges(a, b) == ([(10, 140)], [(0, 130)])
    assert common_ranges(a[:50], b) == ([], [])


def test_one_gram_in_many_texts(spark, monkeypatch):
    """Spans that a great many texts share, and texts of a great many records, in blocks of a few."""
    from loreweave.plans import skew

    monkeypatch.setattr(skew.group_pairs, "__defaults__", (8,))
    monkeypatch.setattr(skew.member_pairs, "__defaults__", (8,))
    r = random.Random(5)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    common, short = word(130), word(115)
    texts = [word(20) + (common if i % 2 else short) + word(30) for i in range(90)] + [common] * 40 + [word(140)] * 25
    got = {tuple(x) for x in shared_pairs(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()}
    assert got == brute(enumerate(texts), 120) and len(got) > 3000
    report = {x.key: x for x in shared_report(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string"), "id", "text").collect()}
    ((start, end),) = report[1].ranges  # letters beside may be alike by chance
    assert 15 <= start <= 20 and 150 <= end <= 155 and report[90].shared_ratio == 1.0


def test_ranges_merge_where_they_touch(spark):
    r = random.Random(6)
    word = lambda n: "".join(r.choice("abcdefghijklmnop") for _ in range(n))
    a, b, c = word(125), word(130), word(140)
    data = [(1, a + b + "#" * 10 + c), (2, a), (3, b + "!"), (4, "?" + c), (5, c[:121])]
    got = {x.key: [tuple(y) for y in x.ranges] for x in shared_report(spark.createDataFrame(data, "id bigint, text string"), "id", "text").collect()}
    assert got[1] == [(0, 255), (265, 405)] or got[1] == [(0, 255), (264, 405)] and got[2] == [(0, 125)] and got[5] == [(0, 121)]
