"""Source ids and JSON arrays of strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: ASCII white space as a character class.
ASCII_SPACE = r"[ \t\n\x0B\f\r]"


def strip_ascii(c: Column) -> Column:
    """``c`` without ASCII white space at its ends."""
    return F.regexp_replace(c, rf"^{ASCII_SPACE}+|{ASCII_SPACE}+\z", "")


def bare_source_id(c: Column) -> Column:
    """A source id in bare form: trimmed, one leading ``ref:`` in any case removed, trimmed again.

    Null stays null; what is empty after that is returned empty, and callers drop it.
    """
    return F.regexp_replace(c, rf"^{ASCII_SPACE}*(?:(?i:ref:){ASCII_SPACE}*)?|{ASCII_SPACE}+\z", "")


def json_strings(c: Column) -> Column:
    """The array of strings in a JSON column; null for null and for what is no array."""
    return F.from_json(c, "array<string>")
