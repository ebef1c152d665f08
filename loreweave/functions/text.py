"""Text normalisation and character grams."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the code points that count as white space, as a character class.
WHITE_SPACE = r"[\u0009-\u000D\u001C- \u0085   -     　]"


def normalize_value(text: str | None) -> str | None:
    """Compatibility form, case folded, without white space."""
    return None if text is None else "".join(unicodedata.normalize("NFKC", text).casefold().split())


@F.pandas_udf(T.StringType())
def normalize_text(values: pd.Series) -> pd.Series:
    """`normalize_value` of a column, a batch at a time."""
    return values.map(normalize_value, na_action="ignore")


def character_ngrams(value: Column, n: int = 2) -> Column:
    """The distinct overlapping n-grams of a normalised value; a shorter value is its own gram, an empty one has none."""
    if isinstance(n, bool) or not isinstance(n, int) or n < 1:
        raise ValueError("n must be a positive integer")
    found = F.array_distinct(F.regexp_extract_all(value, F.lit(f"(?s)(?=(.{{{n}}})).") , F.lit(1)))
    empty = F.array().cast("array<string>")
    return F.when(F.length(value) == 0, empty).when(F.length(value) <= n, F.array(value)).otherwise(found)


def strip(c: Column) -> Column:
    """``c`` without white space of any kind at its ends."""
    return F.regexp_replace(c, rf"^{WHITE_SPACE}+|{WHITE_SPACE}+\z", "")


def fallback_text(content: Column, description: Column, title: Column) -> Column:
    """The stripped content, or else the description, or else the title."""
    return F.coalesce(F.nullif(strip(content), F.lit("")), F.nullif(description, F.lit("")), title)
