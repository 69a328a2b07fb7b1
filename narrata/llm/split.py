"""Problem 1: cut oversized items into pieces at natural boundaries."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.common import sliced

PIECE_SCHEMA = "item_kind string, item_id string, chunk_index int, start_pos int, end_pos int, text string"

#: Section: a form feed, three line breaks, or a blank line before a one-line heading.
_SECTION = re.compile(r"\f|\r?\n(?:[ \t]*\r?\n){2,}|\r?\n[ \t]*\r?\n(?=[^\n]{1,60}[^\n.!?,;:。！？।\"”»]\r?\n[ \t]*\r?\n)")
_PARAGRAPH = re.compile(r"\r?\n[ \t]*\r?\n")
_SENTENCE = re.compile(r"[.!?…।]+[\"'”’»)\]]*\s+|[。！？]+[”’」』）]*\s*|\r?\n")
_WORD = re.compile(r"\s+")
_LEVELS = (_SECTION, _PARAGRAPH, _SENTENCE, _WORD)


def _glued(text: str, i: int) -> bool:
    """Whether a cut before ``text[i]`` would tear a visible character apart."""
    a, b = text[i - 1], text[i]
    return unicodedata.combining(b) != 0 or unicodedata.category(b) in ("Mn", "Mc", "Me") or b in "\u200d\ufe0f" or a == "\u200d" or (a == "\r" and b == "\n")


def _units(text: str, start: int, end: int, limit: int, level: int) -> Iterator[tuple[int, int]]:
    """Units of at most ``limit`` characters that cover ``text[start:end]``."""
    if end - start <= limit:
        yield start, end
    elif level == len(_LEVELS):
        # Small units, so that packing can fill a piece.
        while end - start > (size := min(limit, 16)):
            cut = start + size
            while cut > start + 1 and _glued(text, cut):
                cut -= 1
            if _glued(text, cut):
                cut = start + size
            yield start, cut
            start = cut
        yield start, end
    else:
        at = start
        for m in _LEVELS[level].finditer(text, start, end):
            if m.end() > at and m.end() < end:
                yield from _units(text, at, m.end(), limit, level + 1)
                at = m.end()
        yield from _units(text, at, end, limit, level + 1)


def cut_points(text: str, max_chars: int, overlap_chars: int) -> list[tuple[int, int]]:
    """``[(start, end)]`` of the pieces of ``text``.

    Every piece has at most ``max_chars`` characters; each but the first starts
    ``overlap_chars`` before the end of the one before it, so dropping that many
    leading characters and joining gives the text back. An overlap outside
    ``0..max_chars - 1`` is moved into it.
    """
    overlap = min(max(overlap_chars, 0), max_chars - 1)
    if len(text) <= max_chars:
        return [(0, len(text))]
    pieces, begin, upto = [], 0, 0
    for _, e in _units(text, 0, len(text), max_chars - overlap, 0):
        if e - begin > max_chars:
            pieces.append((begin, upto))
            begin = upto - overlap
        upto = e
    pieces.append((begin, upto))
    return pieces


def _split_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(batches, 2):
        out: list[list] = [[], [], [], [], [], []]
        for kind, key, text, most, overlap in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
            for n, (s, e) in enumerate(cut_points(text, most, overlap)):
                for col, v in zip(out, (kind, key, n, s, e, text[s:e]), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays(
            [pa.array(v, t) for v, t in zip(out, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)],
            names=["item_kind", "item_id", "chunk_index", "start_pos", "end_pos", "text"],
        )


def split_oversized(items: DataFrame, limits: DataFrame, *, item_kind: str, id_col: str, text_col: str = "text", model_col: str | None = None, max_limits: int = 10_000) -> DataFrame:
    """Pieces of every item longer than its limit.

    ``limits(item_kind, embedding_model, max_chars, overlap_chars)`` holds one
    row per kind and, where ``model_col`` is given, per model. The length test
    runs in the JVM, so only oversized text reaches Python, where sections,
    paragraphs, sentences, words and at last characters are tried in turn.

    Result: ``item_kind, item_id, chunk_index (from 0), start_pos, end_pos, text``.
    Null text, null ids, a null or non-positive ``max_chars`` and items without a
    limits row give no pieces; a null overlap counts as 0. Copies of an item
    (same id, text and limit) are cut once; other texts of an id are cut too. Other columns of ``items`` are not read. ``limits``
    is broadcast only up to ``max_limits`` rows, else joined by shuffle.
    """
    lim = limits.where((F.col("item_kind") == item_kind) & (F.col("max_chars") > 0)).select(
        F.col("embedding_model").alias("__m"), F.col("max_chars").cast("int").alias("__max"), F.coalesce(F.col("overlap_chars").cast("int"), F.lit(0)).alias("__ov")
    )
    lim = lim.groupBy("__m").agg(F.min("__max").alias("__max"), F.min_by("__ov", "__max").alias("__ov"))
    if lim.limit(max_limits + 1).count() <= max_limits:
        lim = F.broadcast(lim)
    model: Column = F.col(model_col) if model_col else F.lit(None).cast("string")
    rows = items.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).alias("__t"), model.alias("__im"))
    big = rows.join(lim, F.col("__im").eqNullSafe(F.col("__m"))).where(F.col("__id").isNotNull() & (F.length("__t") > F.col("__max")))
    one = big.select(F.lit(item_kind).alias("item_kind"), "__id", "__t", "__max", "__ov").withColumn("__h", F.md5("__t")).dropDuplicates(["__id", "__max", "__h"]).drop("__h")
    return one.mapInArrow(_split_batches, PIECE_SCHEMA)
