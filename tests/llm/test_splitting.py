import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm.splitting import cut_all, split_texts


def check(texts, limit, overlap):
    cuts, starts, _ = cut_all(texts, limit, overlap)
    for t, c, s in zip(texts, cuts, starts):
        assert c[0] == 0 and c[-1] == len(t) and (c[1:] > c[:-1]).all()
        assert (c[1:] - s <= limit).all() and (c[:-1] - s <= overlap).all() and s[0] == 0 and (s[1:] >= s[:-1]).all()
        assert "".join(t[a:b] for a, b in zip(c, c[1:])) == t
    return cuts


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab. \n#`|。é"), min_size=1, max_size=400), min_size=1, max_size=4))
def test_nothing_is_lost(texts):
    check(texts, 40, 8)


def test_boundaries_are_preferred_in_order():
    paragraph = "One sentence here. " * 60
    text = paragraph + "\n\n" + paragraph
    assert check([text], 2000, 200)[0].tolist()[1] == len(paragraph) + 2
    assert text[check(["word " * 900], 2000, 200)[0][1] - 1] != "x"
    code = "Intro.\n\n```\n" + "x = 1\n" * 200 + "```\n\n" + "Tail sentence. " * 90
    first = check([code], 2000, 200)[0][1]
    assert code[:first].rstrip().endswith("```")
    assert check(["x" * 5000], 2000, 200)[0].tolist() == [0, 2000, 3800, 5000]


def test_headings_positions_and_odd_rows(spark):
    body = "Sentence number one. " * 70
    text = f"# First\n\n{body}\n\n## Second\n\n{body}"
    df = spark.createDataFrame(
        [("t", "a", "outer", text), ("t", "b", "outer", "y " * 1500), ("t", "c", None, None), ("t", "d", None, ""), ("t", "e", None, "z" * 2000), ("t", "f", None, "😀" * 2001)],
        "table_name string, record_key string, heading string, text string",
    )
    got = {}
    for r in sorted(split_texts(df).collect(), key=lambda r: (r.record_key, r.ordinal)):
        got.setdefault(r.record_key, []).append(r)
    assert set(got) == {"a", "b", "f"}
    assert [r.heading for r in got["a"]] == ["First", "Second"] and {r.heading for r in got["b"]} == {"outer"}
    for k, t in (("a", text), ("b", "y " * 1500), ("f", "😀" * 2001)):
        assert "".join(r.piece[r.fresh - r.start :] for r in got[k]) == t
        assert all(len(r.piece) <= 2000 for r in got[k]) and all(t[r.start : r.end] == r.piece for r in got[k])


def test_empty_table_and_clashing_columns(spark):
    df = spark.createDataFrame([("t", "a", None, "y " * 1500, 7, "p")], "table_name string, record_key string, heading string, text string, ordinal int, piece string")
    assert [r.ordinal for r in split_texts(df).orderBy("ordinal").collect()] == [0, 1] and split_texts(df.limit(0)).collect() == []


def test_bad_overlap():
    with pytest.raises(ValueError):
        cut_all(["a"], 100, 50)


def test_random_texts():
    r = random.Random(5)
    check(["".join(r.choice("ab \n.#`~") for _ in range(9000)) for _ in range(5)] + ["\n" * 5000, "```\n" * 2000], 2000, 200)
