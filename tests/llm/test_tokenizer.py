import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loreweave.llm.arrow import text_bytes
from loreweave.llm.byte_bpe import Encoder, RankQueue, same_bytes
from loreweave.llm.encoding import VOCABULARY, count_tokens, encode_texts

tokenizers = pytest.importorskip("tokenizers")
OWN = Encoder(VOCABULARY)
PUBLIC = tokenizers.Tokenizer.from_file(VOCABULARY)
PUBLIC.encode_special_tokens = True


def encode(texts):
    ids, offsets = OWN.encode(*text_bytes(pa.array(texts, pa.string())))
    return [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


def public(texts):
    return [x.ids for x in PUBLIC.encode_batch(texts, add_special_tokens=False)]


FIXED = ["", "a", " ", "don't y'all've 's's ''s", "'ll x 'llama I'm'", "   a  \n b\n\n", "a" * 77, "日本語 テキスト　x", "é\x1c \x85 x\xa0y", "<|endoftext|>", "²³ Ⅷ 12", "\t\tx", "😀😀"]


def test_fixed_texts():
    assert encode(FIXED) == public(FIXED)


def test_a_very_long_pretoken():
    r = random.Random(4)
    texts = ["".join(r.choice("abcdet") for _ in range(60_000)), "ab" * 40_000]
    assert encode(texts) == public(texts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("abst'rvlme \n\t　.1é日²"), max_size=40), min_size=1, max_size=20))
def test_any_text(texts):
    assert encode(texts) == public(texts)


def test_queue_pops_in_rank_order():
    q = RankQueue(50_000)
    ranks = np.array([49_999, 3, 64, 63, 4096, 3])
    q.push(ranks, np.arange(6))
    out = []
    while (x := q.pop()) is not None:
        out.append((x[0], x[1].tolist()))
    assert out == [(3, [1, 5]), (63, [3]), (64, [2]), (4096, [4]), (49_999, [0])]


def test_null_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "hello  world", "k"), (3, "hello  world", "k")], "doc_id bigint, text string, key string")
    got = sorted((r.doc_id, list(r.ids)) for r in encode_texts(df, "doc_id", "text").collect())
    assert got == [(1, []), (2, []), (3, public(["hello  world"])[0]), (3, public(["hello  world"])[0])]
    assert sorted(r.n_tokens for r in count_tokens(df, ["doc_id"], "text").collect()) == [0, 0, len(got[2][1]), len(got[2][1])]
    assert encode_texts(df.limit(0), "doc_id", "text").collect() == []


@pytest.mark.parametrize("n", [512, 1024, 2048, 4096])
def test_words_of_one_hash_are_told_apart(n):
    """Thue-Morse words and their complements have equal polynomial hashes modulo 2**64."""
    word = "".join("ab"[i.bit_count() & 1] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    assert encode([word, other, f"{other} {word}", word]) == public([word, other, f"{other} {word}", word])
    fresh = Encoder(VOCABULARY)
    for texts in ([word], [other], [other, word]):  # also from the cache
        ids, offsets = fresh.encode(*text_bytes(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == public(texts)


def test_bytes_are_compared_whole():
    a = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    b = np.frombuffer(b"abcdefghijklmnopqrstuvwxyZ", np.uint8)
    assert same_bytes(a, np.array([0, 0, 25, 3, 9]), b, np.array([0, 0, 25, 3, 10]), np.array([25, 26, 1, 0, 16])).tolist() == [True, False, False, True, False]
