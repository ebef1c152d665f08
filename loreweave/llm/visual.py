"""One form for text that looks the same but is written with different characters.

Per text: canonical decomposition; width variants, kinds of space, hyphens, ligatures and letter-like numerals to their
plain form; characters without ink removed; then, token by token (runs of letters of alphabets that share shapes),
the sets of scripts in which each letter's shape exists are intersected. A token that some script can spell as a
whole is written in the first such script, in the order of `SCRIPTS`: that settles mixed-script tokens as well as
tokens that consist wholly of another script's look-alikes. A token that no script spells alone takes for each shape the first
script that has it. Canonical composition ends it. The form depends on the shapes only, so texts that look the same
become equal; case, accents, raised digits and letters of other shapes are kept.

Null stays null and empty stays empty. The form of a form is itself.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import json_strings
from ..plans.lineage import cut
from ..plans.skew import group_pairs, member_pairs
from ..sources.tables import table

LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU = "Latin", "Cyrillic", "Greek", "Armenian", "Cherokee", "Coptic", "Lisu"
SCRIPTS = (LATIN, CYRILLIC, GREEK, ARMENIAN, CHEROKEE, COPTIC, LISU)
#: Letters that have the shape of the Latin letter at the same place. Those of Cyrillic, Greek, Armenian and Lisu are the letters whose outline is the
#: Latin letter's own in the DejaVu typefaces, with those that common typefaces draw alike besides (Cyrillic Ь Ԍ Ѵ ѵ, Greek ρ υ α ν, Armenian զ Տ); Cherokee and
#: Coptic, which DejaVu lacks, are by sight of the code charts. Of several letters of a script with one shape the first is the one that is written.
SHAPES = {
    CYRILLIC: ("aceijopsxyhdqwlvABCEHIJKMOPSTXYQWIbGV", "асеіјорѕхуһԁԛԝӏѵАВСЕНІЈКМОРЅТХҮԚԜӀЬԌѴ"),
    GREEK: ("ovcjpuaABEZHIKMNOPTYXCJF", "ονϲϳρυαΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿϜ"),
    ARMENIAN: ("oOuhngqUS", "օՕսհոցզՍՏ"),
    CHEROKEE: ("ABCDEGHJKLMPRSTUVWYZhbdcsvwzRGSWY", "ᎪᏴᏟᎠᎬᏀᎻᎫᏦᏞᎷᏢᏒᏚᎢᏌᏙᎳᎩᏃᏂᏏᏧꮯꮪꮩꮃꮓᎡᏳᏕᏔᎽ"),
    COPTIC: ("HIKMNOPCTYXopc", "ⲎⲒⲔⲘⲚⲞⲢⲤⲦⲨⲬⲟⲣⲥ"),
    LISU: ("BPDTGKCZFMNLSRVHWXYAEIOU", "ꓐꓑꓓꓔꓖꓗꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ"),
}
#: Hyphens, and letters of the same script with the same shape.
SAME = {0x2010: "-", 0x2011: "-", 0x2043: "-", 0xFE63: "-", 0x0251: "a", 0x0261: "g", 0x1D04: "c", 0x1D0F: "o", 0x1D20: "v", 0x1D21: "w", 0x1D22: "z", 0xA731: "s"}
#: Without ink though no format character; format characters that have ink.
INKLESS = (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0))
INKED_FORMAT = (*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD)
#: Digraph letters, which are ligatures though not named so; and Roman numerals.
DIGRAPHS, NUMERALS = (*range(0x01C4, 0x01CD), *range(0x01F1, 0x01F4)), range(0x2160, 0x2180)


@lru_cache(maxsize=1)
def plain_forms() -> dict[int, str]:
    """What single code points become, by rule from the Unicode database and the fixed values above."""
    out = {}
    for i in range(0x110000):
        c = chr(i)
        kind = unicodedata.category(c)
        if kind == "Cn" or kind == "Co" or kind == "Cs":
            continue
        if (kind == "Cf" and i not in INKED_FORMAT) or (kind == "Cc" and c not in "\t\n\x0b\x0c\r\x85"):
            out[i] = ""
        elif kind == "Zs" and i not in (0x20, 0x1680):
            out[i] = " "
        else:
            how, _, what = unicodedata.decomposition(c).partition(" ")
            wide = how in ("<wide>", "<narrow>")
            joined = how == "<compat>" and ("LIGATURE" in unicodedata.name(c, "") or i in DIGRAPHS or i in NUMERALS)
            if wide or joined:
                out[i] = "".join(chr(int(x, 16)) for x in what.split())
    out |= dict.fromkeys(INKLESS, "") | SAME
    for i, s in list(out.items()):  # a form may hold code points that have forms, as a wide hyphen may
        out[i] = unicodedata.normalize("NFD", "".join(out.get(ord(x), x) for x in s))
    return out


@lru_cache(maxsize=1)
def letter_shapes() -> tuple[dict[str, str], dict[str, dict[str, str]]]:
    """The Latin shape of each letter that shares one; and for each shape its letter by script."""
    shape, letters = {}, {}
    for script, (latin, other) in SHAPES.items():
        for a, b in zip(latin, other):
            shape[b] = a
            letters.setdefault(a, {LATIN: a}).setdefault(script, b)
    return shape, letters


def _script(c: str) -> str:
    first = unicodedata.name(c, "").partition(" ")[0].title()
    return first if first in SCRIPTS else ""


@lru_cache(maxsize=200_000)
def resolve(token: str) -> tuple[str, str]:
    """The consistent spelling of a token, and what was found: "" (as it should be), mixed or whole."""
    shape, letters = letter_shapes()
    marks = unicodedata.combining
    shapes = [shape.get(c, c) for c in token]
    possible, seen = set(SCRIPTS), set()
    for c, s in zip(token, shapes):
        if marks(c):
            continue
        seen.add(_script(c))
        possible &= set(letters[s]) if s in letters else {_script(s)}
    script = next((x for x in SCRIPTS if x in possible), None)
    if script:
        spelled = "".join(letters[s][script] if s in letters else s for s in shapes)
    else:
        spelled = "".join(shapes)
    return spelled, "" if spelled == token else "mixed" if len(seen) > 1 else "whole"


#: Letters of the alphabets in `SCRIPTS` that aren't Latin, and tokens that hold one. Marks belong to their letters.
FOREIGN = "Ͱ-ͳͶͷͿΆΈ-ԯԱ-Ֆա-ևᎠ-ᏽᲀ-ᲊἀ-῿Ⲁ-ⳳꓐ-ꓷꭰ-ꮿ"
ALPHABET = f"A-Za-zªºÀ-ÖØ-öø-ʯḀ-ỿ{FOREIGN}"
TOKEN = re.compile(f"[{ALPHABET}̀-ͯ]*[{FOREIGN}][{ALPHABET}̀-ͯ]*")


@lru_cache(maxsize=1)
def suspect() -> re.Pattern:
    """Finds a code point that may have to change."""
    points, parts = sorted(plain_forms()), []
    for i in points:
        if parts and parts[-1][1] == i - 1:
            parts[-1][1] = i
        else:
            parts.append([i, i])
    return re.compile(f"[{FOREIGN}" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in parts) + "]")


def visual_form(text: str | None) -> str | None:
    """The one form of all texts that look like this one."""
    if not text:
        return text
    if not suspect().search(text):
        return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(plain_forms()))
    return unicodedata.normalize("NFC", TOKEN.sub(lambda m: resolve(m.group())[0], plain))


def confusable_tokens(text: str | None) -> list[tuple[str, str, str]]:
    """(token, spelling, kind) of tokens that aren't written in one consistent script."""
    if not text or not suspect().search(text):
        return []
    plain = unicodedata.normalize("NFD", unicodedata.normalize("NFD", text).translate(plain_forms()))
    found = ((m.group(), *resolve(m.group())) for m in TOKEN.finditer(plain))
    return [tuple(unicodedata.normalize("NFC", x) for x in row) for row in found if row[2]]


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        forms = [visual_form(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forms, pa.string())], names=[*b.schema.names, "form"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = lambda s: hashlib.md5(s.encode(), usedforsecurity=False).digest()
    for b in batches:
        texts = b.column(2).to_pylist()
        forms = [visual_form(x) for x in texts]
        raw = [digest(x) for x in texts]
        own = [r if f == x else digest(f) for f, x, r in zip(forms, texts, raw)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(own, pa.binary()), pa.array(raw, pa.binary())], names=["field_name", "key", "form", "raw"])


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["field_name", "key", "token", "spelling", "kind"]
    for b in batches:
        rows = [(f, k, *t) for f, k, x in zip(*(c.to_pylist() for c in b.columns[:3])) for t in confusable_tokens(x)]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()) for c in (zip(*rows) if rows else [[]] * 5)], names=names)


def field_values(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(field_name, key, value) of the titles, each alias, and the chunk texts; null and empty ones left out."""
    titles = entities.select(F.lit("entities.title").alias("field_name"), F.col("entity_path").alias("key"), F.col("title").alias("value"))
    aliases = entities.select(F.lit("entities.aliases_json"), "entity_path", F.explode(json_strings(F.col("aliases_json"))))
    texts = chunks.select(F.lit("chunks.text"), "chunk_id", "text")
    return titles.union(aliases).union(texts).filter("key IS NOT NULL AND value IS NOT NULL AND value <> ''")


def visual_forms(values: DataFrame) -> DataFrame:
    """``values`` with ``form``, the one form of each value. No shuffle."""
    kept = values.select("field_name", "key", "value")
    return kept.mapInArrow(_forms, "field_name string, key string, value string, form string")


def look_alikes(values: DataFrame) -> DataFrame:
    """(field_name, key_a, key_b), key_a < key_b: records with values that have one form and different characters.

    Different spellings of a form are paired first, each once whatever number of records has it; records follow from
    that, in cells of bounded size for texts that many records have. Records with the very same value are no pair by it.
    """
    rows = values.select("field_name", "key", "value").mapInArrow(_digests, "field_name string, key string, form binary, raw binary").distinct()
    varied = rows.groupBy("field_name", "form").agg(F.min("raw").alias("low"), F.max("raw").alias("high")).filter("low < high").select("field_name", "form")
    rows = cut(rows.join(varied, ["field_name", "form"], "left_semi"))
    spellings = cut(rows.select("field_name", "form", "raw").distinct())
    text = lambda s: F.struct("field_name", F.col(f"raw{s}").alias("raw")).alias(f"text{s}")
    pairs = cut(group_pairs(spellings, ["field_name", "form"], "raw").select(text("_a"), text("_b")))
    members = cut(rows.select(text(""), "key").distinct())
    both = member_pairs(pairs, members, "text", "key").filter("key_a <> key_b")
    return both.select("text_a.field_name", F.least("key_a", "key_b").alias("key_a"), F.greatest("key_a", "key_b").alias("key_b")).distinct()


def _values(spark: SparkSession, d: str) -> DataFrame:
    return field_values(table(spark, d, "entities"), table(spark, d, "chunks"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that look the same in a field and differ in its characters."""
    return look_alikes(_values(spark, d))


def p1_forms(spark: SparkSession, d: str) -> DataFrame:
    """The one form of every title, alias and chunk text."""
    return visual_forms(_values(spark, d)).distinct()


def p1_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that mix scripts, or consist of another script's look-alikes, and their spelling."""
    return _values(spark, d).mapInArrow(_tokens, "field_name string, key string, token string, spelling string, kind string").distinct()
