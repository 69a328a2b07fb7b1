"""Saved insights and citations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.rules import STRIP

# Where a memory can come from.
SOURCES = ("user", "assistant", "insight")
_TEXTS = ("passage_id", "chapter", "snippet", "source", "href")


def clean_citations(citations: Column) -> Column:
    """Trimmed citations without empty ones; snippets cut to 1,000 characters; null where none is left."""
    text = lambda c, k: F.nullif(STRIP(c[k]), F.lit(""))
    one = lambda c: F.struct(*[(F.substring(text(c, k), 1, 1000) if k == "snippet" else text(c, k)).alias(k) for k in _TEXTS], c["chapter_index"].alias("chapter_index"), c["chunk_index"].alias("chunk_index"))
    some = lambda c: F.coalesce(*[c[k].cast("string") for k in (*_TEXTS, "chapter_index", "chunk_index")]).isNotNull()
    kept = F.filter(F.transform(citations, one), some)
    return F.when(F.size(kept) > 0, kept)


def saved(memories: DataFrame) -> DataFrame:
    """Memories fit to be stored: known source, text not blank, optional fields trimmed to null, citations cleaned."""
    opt = lambda c: F.nullif(STRIP(F.col(c)), F.lit(""))
    m = memories.where(F.col("source").isin(*SOURCES) & (STRIP(F.coalesce("text", F.lit(""))) != ""))
    return m.withColumns({"text": STRIP(F.col("text")), "title": opt("title"), "question": opt("question"), "action": opt("action"), "citations": clean_citations(F.col("citations"))})


def display_title(title: Column, question: Column, text: Column, action: Column) -> Column:
    preview = F.regexp_replace(STRIP(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\t-\r\x20\xa0]+", " ")), "^$", "Saved Book Insight")
    cut = F.when(F.length(preview) <= 56, preview).otherwise(F.concat(STRIP(F.substring(preview, 1, 53)), F.lit("…")))
    return F.coalesce(F.nullif(title, F.lit("")), F.when(F.coalesce(question, F.lit("")) != "", T.insight_title(question, text, action)), cut)


def exported(memories: DataFrame) -> DataFrame:
    """``markdown`` of each book's insights, newest first (a book's saved insights are a bounded list)."""
    when = F.coalesce("created_at", F.lit(""))
    part = F.concat(F.lit("## "), display_title(F.col("title"), F.col("question"), F.col("text"), F.col("action")), F.lit("\n_"), when, F.lit("_\n\n"), F.when(F.coalesce("question", F.lit("")) != "", F.concat(F.lit("> "), F.col("question"), F.lit("\n\n"))).otherwise(""), F.coalesce("text", F.lit("")))
    rows = memories.select("book_id", when.alias("w"), "memory_id", part.alias("p"))
    # Ascending order of the complement is not at hand for strings, so the list is turned round.
    got = rows.groupBy("book_id").agg(F.reverse(F.array_sort(F.collect_list(F.struct("w", "memory_id", "p")))).alias("l"))
    return got.select("book_id", F.array_join(F.transform("l", lambda x: x["p"]), "\n\n---\n\n").alias("markdown"))
