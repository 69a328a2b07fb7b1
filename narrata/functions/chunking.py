"""Chunkers: sentence-like units, greedy packing, and overlapping windows."""

from __future__ import annotations

import textwrap
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions.rules import SQUEEZE, STRIP, WS, chain

_CUT = chain((rf"([.!?;:])[{WS}]+", "$1\x01"), (rf"[{WS}]+[—–-][{WS}]+", "\x01"))


def sentence_units(paragraph: Column) -> Column:
    """Pieces between sentence ends, clause marks and dashes, stripped, without empty ones."""
    return F.filter(F.transform(F.split(_CUT(STRIP(paragraph)), "\x01"), STRIP), lambda x: x != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n\n"), STRIP), lambda x: x != "")


def packed(units: Column, most: int, soft: int) -> Column:
    """Units joined greedily: up to ``soft``, or up to ``most`` while the buffer is short. One fold, no UDF."""
    low = max(140, soft // 2)
    start = F.struct(F.lit("").alias("buf"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, u: Column) -> Column:
        both = F.concat(acc["buf"], F.lit(" "), u)
        fits = (F.length(both) <= soft) | ((F.length(both) <= most) & (F.length(acc["buf"]) < low))
        return (
            F.when(acc["buf"] == "", F.struct(u.alias("buf"), acc["out"].alias("out")))
            .when(fits, F.struct(both.alias("buf"), acc["out"].alias("out")))
            .otherwise(F.struct(u.alias("buf"), F.array_append(acc["out"], acc["buf"]).alias("out")))
        )

    return F.aggregate(units, start, step, lambda acc: F.when(acc["buf"] == "", acc["out"]).otherwise(F.array_append(acc["out"], acc["buf"])))


def soft_limit(most: int) -> int:
    return min(360, max(220, int(most * 0.55)))


def chunks(text: Column, most: int = 1200) -> Column:
    """Narration chunks of a normalised text: paragraph by paragraph, units packed greedily."""
    return F.flatten(F.transform(paragraphs(text), lambda p: packed(sentence_units(p), most, min(most, soft_limit(most)))))


def merged_tiny(pieces: Column, least: int = 80) -> Column:
    """Pieces shorter than ``least`` join the one before them."""
    start = F.array().cast("array<string>")
    clean = F.filter(F.transform(pieces, STRIP), lambda x: x != "")

    def step(out: Column, p: Column) -> Column:
        n = F.size(out)
        joined = F.concat(F.slice(out, 1, F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(out, F.greatest(n, F.lit(1))), F.lit(" "), p)))
        return F.when((F.length(p) < least) & (n > 0), joined).otherwise(F.array_append(out, p))

    return F.aggregate(clean, start, step)


def window_pieces(text: str, most: int, overlap: int, least: int = 80) -> list[str]:
    """Windows of at most ``most`` characters, ending at a blank near their end if there is one; each starts ``overlap`` before the end of the last."""
    n, at, out = len(text), 0, list[str]()
    if n <= most:
        return [text] if text else []
    while True:
        end = min(at + most, n)
        if end < n:
            blank = text.rfind(" ", at + max(0, end - at - max(80, most // 5)), end)
            if blank - at >= most // 4:
                end = blank
        if piece := text[at:end].strip():
            if len(piece) < least and out:
                out[-1] = f"{out[-1]} {piece}".strip()
            else:
                out.append(piece)
        if end >= n:
            return out
        at = end - overlap if end - overlap > at else end


def overlapping(df: DataFrame, text_col: str, most: int = 1200, overlap: int = 150) -> DataFrame:
    """``df`` with one row a window: ``chunk_index`` (from 0) and ``piece``. White space is squeezed in the JVM; the data-dependent walk runs on Arrow batches."""

    @F.pandas_udf("array<string>")
    def cut(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(lambda t: window_pieces(t or "", most, overlap))

    out = df.withColumn("__w", cut(SQUEEZE(F.col(text_col))))
    return out.select(*[c for c in df.columns if c not in ("chunk_index", "piece")], F.posexplode("__w").alias("chunk_index", "piece"))


def wrapped(df: DataFrame, text_col: str, width: int) -> DataFrame:
    """``df`` with one row a line: ``n`` (from 0) and ``line`` of at most ``width`` characters, unless one word is longer."""

    @F.pandas_udf("array<string>")
    def cut(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in s:
            yield x.map(lambda t: [t] if len(t) <= width else [p.strip() for p in textwrap.wrap(t, width=width, break_long_words=False, break_on_hyphens=False) if p.strip()] or [t])

    # Only units longer than a line go to Python.
    long = F.length(text_col) > width
    lines = F.coalesce(cut(F.coalesce(F.when(long, F.col(text_col)), F.lit(""))), F.array())
    return df.withColumn("__w", F.when(long, lines).otherwise(F.array(F.col(text_col)))).select(*[c for c in df.columns if c not in ("n", "line")], F.posexplode("__w").alias("n", "line"))
