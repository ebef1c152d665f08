"""Splitting oversized texts at natural boundaries, all cuts at once by pointer doubling.

Every position of a text has a farthest legal successor: the end of the piece that would follow a cut there, counted
from the overlap before the cut. It is the last boundary of the strongest kind that lies in the second half of the
room. Successor tables are then squared, and each squaring doubles the number of cuts known, so a text of n pieces takes
log n rounds; all long texts of a batch take part in the same rounds.

Kinds of boundary, strongest first: the end of a paragraph or code block, or the place before a heading; the end of
a line; the end of a sentence; the end of a line of code or of a word; any position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

#: Most code points of a piece, and of what it repeats of its predecessor.
LIMIT, OVERLAP = 2000, 200

_LINES = re.compile(r"^ {0,3}(?:(`{3,}|~{3,})([^\n]*)|(#{1,6})(?:[ \t]+([^\n]*?))?[ \t]*\r?$)|^(={2,6})[ \t]*([^\n=][^\n]*?)[ \t]*\5[ \t]*\r?$", re.M)
_PARAGRAPHS = re.compile(r"\n(?:[ \t]*\r?\n)+")
_SENTENCES = re.compile(r"[.!?…][\"')\]”’»]*(?=\s)|[。！？][」』）]*")
_WORDS = re.compile(r"\s+")


def structure(text: str) -> tuple[list[np.ndarray], list[tuple[int, str]]]:
    """Positions of the four kinds of boundary, and (position, heading) of every heading."""
    blocks, headings, fence = [], [], None
    for m in _LINES.finditer(text):
        if m[1]:
            if fence is None:
                if m[1][0] == "~" or "`" not in m[2]:
                    fence = (m.start(), m[1])
            elif m[1][0] == fence[1][0] and len(m[1]) >= len(fence[1]) and not m[2].strip():
                blocks.append((fence[0], m.end()))
                fence = None
        elif fence is None:
            title = m[6] or re.sub(r"(?:^|[ \t]+)#+$", "", m[4] or "")
            if title.strip():
                headings.append((m.start(), title.strip()))
    if fence:
        blocks.append((fence[0], len(text)))
    ends = lambda r: np.array([m.end() for m in r.finditer(text)], np.int64)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    lines = np.flatnonzero(points == 10) + 1
    strong = np.concatenate([ends(_PARAGRAPHS), np.array([p for p, _ in headings], np.int64), np.array([x for s, e in blocks for x in (s, min(e + 1, len(text)))], np.int64)])
    words = ends(_WORDS)
    kinds = [strong.astype(np.int64), lines, ends(_SENTENCES), np.concatenate([lines, words])]
    for s, e in blocks:  # within a block of code only its lines and words are places to cut
        kinds[:3] = [k[(k <= s) | (k >= e)] for k in kinds[:3]]
    return kinds, headings


def cut_all(texts: list[str], limit: int = LIMIT, overlap: int = OVERLAP) -> tuple[list[np.ndarray], list[np.ndarray], list[list]]:
    """For each text the cuts from 0 to its length, the starts of its pieces, and its headings."""
    if not 0 <= overlap < limit / 4:
        raise ValueError("overlap must be at least 0 and below a quarter of the limit")
    if not texts:
        return [], [], []
    sizes = np.array([len(t) for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(sizes + 1)])
    n = int(base[-1])
    last = np.full((4, n), -1, np.int64)  # then: the last boundary of each kind at or before a position
    headings = []
    for i, t in enumerate(texts):
        kinds, own = structure(t)
        headings.append(own)
        for k, at in enumerate(kinds):
            last[k, base[i] + at] = base[i] + at
    after = np.full(n, n, np.int64)  # the first place at or after a position where an overlap may begin
    marks = np.flatnonzero((last >= 0).any(axis=0))
    after[marks] = marks
    after = np.minimum.accumulate(after[::-1])[::-1]
    last = np.maximum.accumulate(last, axis=1)
    here = np.arange(n)
    first, end = np.repeat(base[:-1], sizes + 1), np.repeat(base[:-1] + sizes, sizes + 1)
    back = np.maximum(here - overlap, first)
    start = np.where(after[back] < here, after[back], back)
    start = np.where(here == first, first, start)
    room = np.minimum(start + limit, end)
    # Of CR and LF, and of a letter and its marks, nothing is known here: a cut of the weakest kind may part them.
    step, settled = room.copy(), room == end
    for k in range(4):
        at = last[k, room]
        fits = ~settled & (at > start + limit // 2)
        step[fits] = at[fits]
        settled |= fits
    cuts, known = base[:-1].copy(), 0
    while len(cuts) > known:
        known, cuts = len(cuts), np.unique(np.concatenate([cuts, step[cuts]]))
        step = step[step]
    bounds = np.searchsorted(cuts, base[:-1])
    parts = np.split(cuts, bounds[1:])
    return [p - b for p, b in zip(parts, base)], [start[p[:-1]] - b for p, b in zip(parts, base)], headings


def _split(batches: Iterator[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    names = ["table_name", "record_key", "ordinal", "start", "fresh", "end", "heading", "piece"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    for b in batches:
        for lo in range(0, b.num_rows, 256):
            tables, keys, outer, texts = (c.to_pylist() for c in b.slice(lo, 256).columns)
            cuts, starts, headings = cut_all(texts, limit, overlap)
            rows = []
            for name, key, above, text, cut, start, own in zip(tables, keys, outer, texts, cuts, starts, headings):
                places = np.array([p for p, _ in own], np.int64)
                current = np.searchsorted(places, cut[:-1], side="right") - 1
                for i, (s, fresh, e, h) in enumerate(zip(start.tolist(), cut[:-1].tolist(), cut[1:].tolist(), current.tolist())):
                    rows.append((name, key, i, s, fresh, e, own[h][1] if h >= 0 else above, text[s:e]))
            columns = list(zip(*rows)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=names)


def split_texts(values: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Pieces of at most ``limit`` code points of all longer texts in ``values`` (table_name, record_key, heading, text).

    Columns: table_name, record_key, ordinal, start and end in the text, fresh (where what no earlier piece has begins),
    heading (the one in force at ``fresh``, else the given one), piece. Pieces from ``fresh`` to ``end`` put together are the text. Null,
    empty and short texts give no rows; each row of a repeated record gives its own. No shuffle.
    """
    long = values.select("table_name", "record_key", "heading", "text").filter(F.length("text") > limit)
    schema = "table_name string, record_key string, ordinal int, start int, fresh int, end int, heading string, piece string"
    return long.mapInArrow(partial(_split, limit=limit, overlap=overlap), schema)


def long_fields(entities: DataFrame, chunks: DataFrame) -> DataFrame:
    """(table_name, record_key, heading, text) of entity contents and chunk texts."""
    own = entities.select(F.lit("entities").alias("table_name"), F.col("entity_path").alias("record_key"), F.lit(None).cast("string").alias("heading"), F.col("content").alias("text"))
    return own.union(chunks.select(F.lit("chunks"), "chunk_id", "heading", "text"))


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return split_texts(long_fields(table(spark, d, "entities"), table(spark, d, "chunks")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Records that were split."""
    return _pieces(spark, d).filter("ordinal = 0").select("table_name", "record_key").distinct()


def p7_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The pieces of every split record, each once for records delivered again."""
    keys = ["table_name", "record_key", "ordinal", "start", "fresh", "end", "heading"]
    pieces = _pieces(spark, d).withColumn("digest", F.md5("piece"))
    return pieces.groupBy(*keys, "digest").agg(F.first("piece").alias("piece")).drop("digest")
