import pytest

from loreweave.llm.visual import confusable_tokens, field_values, look_alikes, resolve, visual_form, visual_forms

SAME = [("Cаfé", "Café"), ("ＡＢＣ　x", "ABC x"), ("ﬁsh", "fish"), ("a‑b", "a-b"), ("саре", "cape"), ("карта", "кapта"), ("φа1", "φa1"), ("ｶﾞ", "ガ"), ("U\u200d\u0308ber", "Über"), ("x\u2009y", "x\xa0y"), ("ⅾօɡ", "dog"), ("ӓ", "ä"), ("νalley", "valley"), ("А", "A"), ("a\u00adb", "ab")]
SAME += [(x, y) for other, latin in (("ραυοϜͿ", "pauoFJ"), ("ЬӀԌѵ", "bIGv"), ("ոցզսհ", "ngquh"), ("ՍՏ", "US"), ("ᎠᏚᏀᏌᎡᎽ", "DSGURY"), ("ꮯꮪꮩꮃꮓ", "csvwz"), ("ⲞⲥⲢⲎ", "OcPH"), ("ꓐꓑꓓꓴꓬ", "BPDUY"), ("ɑᴄᴏᴠ", "acov")) for x, y in zip(other, latin)]
SAME += [("ꓡꓲꓢꓴ", "LISU"), ("ᎠaᎡ", "DaR"), ("ԱՍ", "ԱU")]
OTHER = [("x²", "x2"), ("Cafe", "Café"), ("a-b", "a b"), ("ABC", "abc"), ("и", "u"), ("þ", "p"), ("ø", "o"), ("ł", "l"), ("a  b", "a b"), ("ß", "ss"), ("–", "-"), ("σ", "o"), ("ω", "w"), ("я", "R"), ("ь", "b"), ("ꓤ", "R"), ("η", "n"), ("ᴀ", "A"), ("Ⲁ", "A"), ("π", "n")]


@pytest.mark.parametrize("a,b", SAME)
def test_same(a, b):
    assert visual_form(a) == visual_form(b)
    assert visual_form(visual_form(a)) == visual_form(a)


@pytest.mark.parametrize("a,b", OTHER)
def test_different(a, b):
    assert visual_form(a) != visual_form(b)


def test_scripts_of_tokens():
    assert resolve("саре") == ("cape", "whole") and resolve("кapта") == ("карта", "mixed") and resolve("карта") == ("карта", "")
    assert confusable_tokens("die Каrte карта") == [("Каrte", "Karte", "mixed")]
    assert visual_form(None) is None and visual_form("") == ""


def test_pairs(spark, rows):
    ent = spark.createDataFrame(
        [("/a", "Café", '["x\\u2009y", null]', 1), ("/b", "Cаfé", '["x y", "q"]', 1), ("/c", "Café", None, 1), ("/a", "Café", '["x\\u2009y"]', 2), ("/d", None, "[]", 1), ("/e", "", "[]", 1)],
        "entity_path string, title string, aliases_json string, value int",
    )
    chunks = spark.createDataFrame([("c1", "ab"), ("c2", "a\u200bb"), ("c3", "a\u200db"), ("c2", "a\u200bb"), (None, "ab")], "chunk_id string, text string")
    values = field_values(ent, chunks)
    assert rows(look_alikes(values)) == sorted(
        [("entities.title", "/a", "/b"), ("entities.title", "/b", "/c"), ("entities.aliases_json", "/a", "/b"), ("chunks.text", "c1", "c2"), ("chunks.text", "c1", "c3"), ("chunks.text", "c2", "c3")], key=repr
    )
    assert {r.form for r in visual_forms(values).filter("field_name = 'chunks.text'").collect()} == {"ab"}
    assert rows(look_alikes(values.limit(0))) == []


def test_a_title_of_many_records(spark, rows, monkeypatch):
    from loreweave.plans import skew

    monkeypatch.setattr(skew.member_pairs, "__defaults__", (16,))
    monkeypatch.setattr(skew.group_pairs, "__defaults__", (2,))
    titles = [(f"/{i:04}", "Caf\u00e9 one" if i else "C\u0430f\u00e9 one") for i in range(400)] + [(f"/x{i}", f"Caf\u00e9{' ' * 1}{c}ne") for i, c in enumerate("\u043e\u03bf\u0585")]
    df = spark.createDataFrame([("entities.title", k, v) for k, v in titles], "field_name string, key string, value string")
    want = {(a, b) for a, x in titles for b, y in titles if a < b and x != y}
    assert {tuple(r)[1:] for r in look_alikes(df).collect()} == want and len(want) == 399 + 3 * 400 + 3
