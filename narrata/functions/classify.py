"""Heuristic classes of documents and chunks, as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.rules import STRIP, WORD, WS, let


def _lines(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"), STRIP), lambda x: x != "")


def is_contents_page(title: Column, source: Column, text: Column) -> Column:
    """Whether a document is a table of contents: by title, source name, first words, or the share of contents-like lines."""
    name, src, body = F.lower(T.normalize_text(F.coalesce(title, F.lit("")))), F.lower(STRIP(F.coalesce(source, F.lit("")))), T.CLEANUP(F.coalesce(text, F.lit("")))
    blanks = rf"[{WS}]"
    like = lambda x: x.rlike(rf"\.{{2,}}{blanks}*\p{{Nd}}+$") | x.rlike(r"(?i)^(chapter|part|introduction|preface|appendix)([^\p{L}\p{N}_].*)?\p{Nd}$") | (x.rlike(rf"^\p{{Nd}}+[.)]?{blanks}+.") & (F.size(F.split(x, f"{blanks}+")) <= 14))
    full = lambda n, hits: (n > 0) & (hits >= F.greatest(F.lit(3), F.floor(n / 2)))
    return let(body, lambda b: (
        name.isin("contents", "table of contents", "toc")
        | src.rlike("toc|contents|nav|ncx")
        | F.lower(b).startswith("table of contents")
        | (F.lower(b) == "contents")
        | let(_lines(b), lambda lines: full(F.size(lines), F.size(F.filter(F.slice(lines, 1, 80), like))))
    ))


def is_heading_or_fragment(text: Column) -> Column:
    """Whether a chunk is too short or too title-like to be rewritten."""
    return F.coalesce(let(T.CLEANUP(text), _heading_like), F.lit(True))


def _heading_like(c: Column) -> Column:
    def by_words(words: Column) -> Column:
        n, alpha = F.size(words), F.filter(words, lambda w: w.rlike("[A-Za-z]"))
        upper = F.when(F.size(alpha) > 0, F.size(F.filter(alpha, lambda w: F.upper(w) == w)) / F.size(alpha)).otherwise(0.0)
        # Capital after anything that is no letter, lower case after a letter.
        titled = ~c.rlike(r"(^|[^\p{L}])\p{Ll}") & ~c.rlike(r"\p{L}\p{Lu}") & c.rlike(r"\p{L}")
        return ((n <= 12) & (upper >= 0.8)) | ((n <= 8) & (F.length(c) <= 80)) | ((n <= 4) & (F.length(c) <= 120)) | ((n <= 10) & titled & ~c.rlike("[.!?]$") & (F.size(_lines(c)) == 1))

    return (
        (c == "")
        | c.rlike(rf"^\p{{Nd}}+[.)]?[{WS}]+[A-Z0-9 ,;:'?!–—-]+$")
        | c.rlike(r"(?i)^(compare|describe|explain|list|summarize|outline|write|discuss|identify|consider)($|[^\p{L}\p{N}_])")
        | let(F.regexp_extract_all(c, F.lit(WORD), F.lit(0)), by_words)
    )


def rewrite_decision(text: Column) -> Column:
    """``struct<use_llm, reason>``: whether a chunk is worth a model's rewriting."""
    return let(T.NARRATION(F.coalesce(text, F.lit(""))), _decision)


def _decision(c: Column) -> Column:
    count = lambda ch: F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))

    def scored(facts: Column) -> Column:
        marks = [
            (F.length(c) >= 600, 1, "long_chunk"),
            (F.length(c) >= 900, 1, "very_long_chunk"),
            (facts["words"] >= 120, 1, "dense_chunk"),
            ((facts["breaks"] <= 1) & (F.length(c) >= 350), 2, "few_sentence_breaks"),
            (facts["low"], 2, "lowercase_after_sentence_end"),
            (facts["open"], 1, "unbalanced_parentheses"),
            (facts["quotes"], 1, "unbalanced_quotes"),
        ]
        score = sum((F.when(w, F.lit(n)).otherwise(0) for w, n, _ in marks), F.lit(0))
        why = F.concat_ws(",", *[F.when(w, F.lit(name)) for w, _, name in marks])
        return F.struct((score >= 2).alias("use_llm"), F.when(why == "", F.lit("deterministic_cleanup_only")).otherwise(why).alias("reason"))

    facts = F.struct(T.word_count(c).alias("words"), F.regexp_count(c, F.lit(rf"(^|[^\p{{Nd}}])[.!?]([{WS}]|$)")).alias("breaks"), c.rlike(rf"[.!?][{WS}]+[a-z]").alias("low"), (count("(") != count(")")).alias("open"), (count('"') % 2 == 1).alias("quotes"))
    no = lambda why: F.struct(F.lit(False).alias("use_llm"), F.lit(why).alias("reason"))
    return F.when(c == "", no("empty_after_cleanup")).when(is_heading_or_fragment(c), no("short_or_heading")).otherwise(let(facts, scored))


def rewrite_verdict(original: Column, rewritten: Column, finish_reason: Column | None = None) -> Column:
    """``ok``, or why a rewrite is rejected."""
    clean = lambda c: T.SANITIZE(F.coalesce(c, F.lit("")))
    cut = F.lit(False) if finish_reason is None else F.coalesce(F.lower(finish_reason).isin("length", "max_tokens"), F.lit(False))

    def verdict(x: Column) -> Column:
        a, b = x["a"], x["b"]
        short = lambda n: (n["a"] >= 40) & (n["b"] < F.greatest(F.lit(12), F.floor(n["a"] * 0.65)))
        return (
            F.when(b == "", "empty")
            .when(b.rlike("(?i)</?out>|</?text>"), "tag_leak")
            .when(cut, "truncated_by_token_limit")
            .when(let(F.struct(T.word_count(a).alias("a"), T.word_count(b).alias("b")), short), "too_short")
            .when((F.length(a) >= 300) & (F.length(b) < F.floor(F.length(a) * 0.45)), "too_short")
            .otherwise("ok")
        )

    return let(F.struct(clean(original).alias("a"), clean(rewritten).alias("b")), verdict)
