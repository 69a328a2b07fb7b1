"""Passages to answers: ranking, citations, prompts, drafts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions import vectors as V
from narrata.functions.rules import STRIP


def ranked(queries: DataFrame, passages: DataFrame, k: int = 3, max_queries: int = 100_000) -> DataFrame:
    """``query_id, rank, score`` and the passage: the k passages of the query's book nearest to it.

    ``queries(query_id, book_id, q)``, ``passages(book_id, pos, embedding, ...)``.
    Unusable vectors are left out, unequal lengths score 0, ties keep file
    order. Queries are a stated set: broadcast up to ``max_queries`` rows, joined
    by shuffle beyond; the book is an equality key. The norm of a passage is
    taken once, and ranking keeps k rows a query before the shuffle.
    """
    q = queries.select("query_id", "book_id", "q", V.norm(F.col("q")).alias("nq"))
    q = F.broadcast(q) if q.limit(max_queries + 1).count() <= max_queries else q
    p = passages.where(V.usable(F.col("embedding"))).withColumn("np", V.norm(F.col("embedding")))
    s = p.join(q, "book_id").withColumn("s", V.cosine(F.col("embedding"), F.col("q"), F.col("np"), F.col("nq")))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "pos", "id")
    k = min(max(k, 1), 20)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumn("score", F.round("s", 6)).drop("s", "np", "nq", "q", "embedding")


def searched(queries: DataFrame, rows: DataFrame, k: int = 3, block: int = 50_000, cells: int = 2_000_000) -> DataFrame:
    """``query_id, id, pos, s, rank``: for every query the k rows of its group nearest to it.

    ``queries(query_id, g, q)``, ``rows(id, g, pos, v)``, keys once. Every query
    meets every row of its group; similarities count to 12 places, ties go by
    pos and id; unusable vectors are left out, a zero norm or another length
    scores 0. Queries go to the rows in blocks of ``block``, a pass over the rows
    for each; a task multiplies at most ``cells`` pairs at a time and keeps k
    rows a query, so only hits are shuffled.
    """
    kind = dict(rows.dtypes)["id"]
    # Vectors are tested in the batches: a filter on one that is computed would compute it again.
    r = rows.select(F.col("g").cast("string"), F.col("id").cast("string"), F.col("pos").cast("long"), "v")
    q = queries.select(F.col("query_id").cast("string"), F.col("g").cast("string"), F.col("q").cast("array<double>"))
    out, held = None, []

    def passed(held: list) -> DataFrame:
        groups: dict[str, dict[int, list]] = {}
        for name, g, v in held:
            groups.setdefault(g, {}).setdefault(len(v), []).append((name, v))
        packed = {g: [([n for n, _ in x], _unit(np.array([v for _, v in x]))) for x in by.values()] for g, by in groups.items()}
        return r.mapInArrow(lambda batches: _best(batches, packed, k, cells), "query_id string, id string, pos long, s double")

    for x in q.toLocalIterator():
        if x["q"] and not any(y is None or np.isnan(y) for y in x["q"]):
            held.append(tuple(x))
        if len(held) == block:
            out = passed(held) if out is None else out.union(passed(held))
            held = []
    if held or out is None:
        out = passed(held) if out is None else out.union(passed(held))
    w = Window.partitionBy("query_id").orderBy(F.desc("s"), "pos", "id")
    hits = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return hits.withColumns({"query_id": F.col("query_id").cast(dict(queries.dtypes)["query_id"]), "id": F.col("id").cast(kind)})


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _best(batches: Iterator[pa.RecordBatch], packed: dict, k: int, cells: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of these batches for each query."""
    kept: dict[tuple[str, int], list] = {}  # of a group's queries of one length: (s, pos, id) arrays of a column a query
    for b in batches:
        g, ids, pos, vs = (b.column(i) for i in range(4))
        g, ids, pos = np.array(g.to_pylist(), object), np.array(ids.to_pylist(), object), np.array(pos.to_pylist(), np.int64)
        width, flat, at = np.diff(vs.offsets.to_numpy()), vs.values.to_numpy(zero_copy_only=False), vs.offsets.to_numpy()
        usable = width > 0
        usable[np.searchsorted(at, np.flatnonzero(np.isnan(flat)), "right") - 1] = False
        for name in dict.fromkeys(x for x in g if x in packed):
            mine = np.flatnonzero((g == name) & usable)
            mine = mine[np.lexsort((ids[mine].astype(str), pos[mine]))]
            for n, (names, q) in enumerate(packed[name]):
                for i in range(0, len(mine), step := max(1, cells // len(names))):
                    rows = mine[i : i + step]
                    s, fits = np.zeros((len(rows), len(names))), width[rows] == q.shape[1]
                    if fits.any():
                        s[fits] = _unit(np.array([flat[at[j] : at[j + 1]] for j in rows[fits]])) @ q.T
                    s = np.round(s, 12)
                    top = np.argsort(-s, axis=0, kind="stable")[:k]
                    kept.setdefault((name, n), []).append((np.take_along_axis(s, top, 0), pos[rows][top], ids[rows][top]))
                    if len(kept[name, n]) > 32:
                        kept[name, n] = [_merged(kept[name, n], k)]
    for (name, n), lists in kept.items():
        s, pos, ids = _merged(lists, k)
        asked = packed[name][n][0]
        yield pa.RecordBatch.from_arrays([pa.array(asked * len(s), pa.string()), pa.array(ids.ravel().tolist(), pa.string()), pa.array(pos.ravel()), pa.array(s.ravel())], names=["query_id", "id", "pos", "s"])


def _merged(lists: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    s, pos, ids = (np.vstack(x) for x in zip(*lists, strict=True))
    top = np.lexsort((ids.astype(str), pos, -s), axis=0)[:k]
    return np.take_along_axis(s, top, 0), np.take_along_axis(pos, top, 0), np.take_along_axis(ids, top, 0)


def with_citation(hits: DataFrame) -> DataFrame:
    c = F.struct(F.col("id").alias("passage_id"), F.col("chapter"), T.snippet(F.col("text")).alias("snippet"), F.nullif("source", F.lit("")).alias("source"), F.nullif("href", F.lit("")).alias("href"), "chapter_index", "chunk_index")
    return hits.withColumn("citation", c)


# What each kind of answer is asked to be.
INSTRUCTIONS = {
    "answer": "Use this structure:\nWhat the book says\nHow this may connect to your situation\nQuestions worth asking yourself\nOne small next step\nSources",
    "socratic": "Produce 6–8 Socratic questions grouped by theme. Avoid lecturing. Each question should be grounded in a cited passage when possible.",
    "challenge": "Identify 3–5 assumptions that may be worth testing. Include a kinder alternative interpretation. Cite passages.",
    "example": "Give one concrete realistic example scenario, then map it back to the passages. Cite sources.",
    "practice": "Give a 10–15 minute practice exercise with clear steps. Include what to say or do. Cite sources.",
    "explain": "Re-explain the book idea simply. Include a short analogy and citations.",
}
OPENING = (
    "You are a kind, direct, practical, and reflective book-reading companion.\nAnswer using ONLY the retrieved book passages below plus the user's question.\nDo not invent claims, quotes, or facts not supported by the passages.\n"
    "If the passages are insufficient, say so clearly.\nPreserve the user's real-world context when they ask personal or work questions, without claiming the book says things it does not.\n"
    "Include citations in your answer, preferably parenthetical source tags like [passage_...] or a final Sources section.\n\n"
)


def _hits(hits: DataFrame) -> DataFrame:
    """The ranked hits of each query as one short list (at most k entries)."""
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "chapter", "text"))).alias("h"))


def prompts(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """``prompt`` of each question, from its ranked passages."""
    j = queries.join(_hits(hits), "query_id", "left")
    action = T.answer_action(F.col("action"))
    block = lambda x: F.concat(F.lit("["), x["id"], F.lit("] ("), F.coalesce(x["chapter"], F.lit("None")), F.lit(")\n"), F.coalesce(x["text"], F.lit("")))
    body = F.when(F.size("h") > 0, F.array_join(F.transform("h", block), "\n\n")).otherwise("(No passages retrieved.)")
    say = F.coalesce(*[F.when(action == a, F.lit(t)) for a, t in INSTRUCTIONS.items()])
    return j.select("query_id", F.concat(F.lit(OPENING + "Answer mode: "), action, F.lit("\nMode instructions: "), say, F.lit("\n\n\nQuestion: "), STRIP(F.col("question")), F.lit("\n\nPassages:\n"), body).alias("prompt"))


# The lines of a draft, by kind of answer; {q} question, {c} chapter, {s} snippet, {s80} its start, {p} passage.
DRAFTS = {
    "socratic": ("Question: {q}", "", "Socratic questions to explore:", "- What does [{p}] suggest about your situation?", "- What might you be assuming about “{s80}…”?", "- How could you test one idea from {c} this week?"),
    "challenge": ("Question: {q}", "", "Assumptions worth testing:", "- You may be assuming the excerpt from {c} applies directly without context.", "- [{p}] may support a kinder read: “{s}”", "- Consider whether another interpretation fits your situation better."),
    "example": ("Question: {q}", "", "Example scenario (draft):", "A colleague faces a situation related to {c}. They notice: “{s}”", "Source: [{p}]"),
    "practice": ("Question: {q}", "", "10-minute practice (draft):", "1. Re-read the cited excerpt slowly.", "2. Write one sentence applying it to your situation (from [{p}]).", "3. Identify one small action for the next conversation.", "Grounding excerpt: “{s}”"),
    "explain": ("Question: {q}", "", "Simpler explanation from {c}:", "“{s}”", "Source: [{p}]"),
    "answer": ("Based on passages retrieved from {c}, here is a grounded draft answer.", "", "Question: {q}", "", "What the book says", "Most relevant excerpt: “{s}” [{p}]"),
}
NO_HITS = "I could not find relevant passages in this book for that question yet."
FALLBACK = "Retrieval fallback (model unavailable): grounded draft from indexed passages only.\n"


def drafts(queries: DataFrame, hits: DataFrame, fallback: bool = False) -> DataFrame:
    """``draft`` answer of each question, made from its passages alone."""
    j = queries.join(_hits(hits), "query_id", "left")
    action, lead = T.answer_action(F.col("action")), F.try_element_at("h", F.lit(1))
    snip = T.snippet(F.coalesce(lead["text"], F.lit("")))
    put = {"{q}": STRIP(F.col("question")), "{c}": F.coalesce(F.nullif(lead["chapter"], F.lit("")), F.lit("this book")), "{s80}": F.substring(snip, 1, 80), "{s}": snip, "{p}": F.coalesce(lead["id"], F.lit("passage"))}

    def filled(line: str) -> Column:
        out: list[Column | str] = [line]
        for mark, value in put.items():
            out = [y for x in out for y in (_cut(x, mark, value) if isinstance(x, str) else [x])]
        return F.concat(*[F.lit(x) if isinstance(x, str) else x for x in out])

    def draft(kind: str) -> Column:
        text = F.concat_ws("\n", F.lit(FALLBACK if fallback else ""), *[filled(x) for x in DRAFTS[kind]])
        if kind == "socratic":
            return F.concat(text, F.array_join(F.transform(F.slice("h", 2, 2), lambda x: F.concat(F.lit("\n- What would change if you applied ["), x["id"], F.lit("] differently?"))), ""))
        if kind == "answer":
            return F.concat(text, F.when(F.size("h") > 1, F.concat(F.lit("\n\n("), (F.size("h") - 1).cast("string"), F.lit(" additional passage(s) were retrieved for context.)"))).otherwise(""))
        return text

    return j.select("query_id", F.when(F.coalesce(F.size("h"), F.lit(0)) < 1, F.lit(NO_HITS)).otherwise(F.coalesce(*[F.when(action == a, draft(a)) for a in DRAFTS])).alias("draft"))


def _cut(text: str, mark: str, value: Column) -> list[Column | str]:
    parts: list[Column | str] = []
    for i, x in enumerate(text.split(mark)):
        parts += ([value] if i else []) + ([x] if x else [])
    return parts


def passage_index(rows: DataFrame, model: str = "hashvec-16", dim: int = 16) -> DataFrame:
    """Passages ready to store: blank ones dropped after numbering, ids by book and place, embedded in the JVM."""
    # Numbered in two steps, so that a large book is not one task: rows before a chapter, then within it.
    per = rows.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"))
    before = per.select("book_id", "chapter_index", (F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_index")) - F.col("n")).alias("__before"))
    w = Window.partitionBy("book_id", "chapter_index").orderBy("chunk_index", "chapter")
    r = rows.join(before, ["book_id", "chapter_index"]).withColumn("pos", (F.col("__before") + F.row_number().over(w) - 1).cast("long")).drop("__before").where(STRIP(F.coalesce("text", F.lit(""))) != "")
    return r.withColumns({"id": F.concat(F.lit("passage_"), F.col("book_id"), F.lit("_"), F.col("pos").cast("string")), "text": STRIP(F.col("text")), "embedding_model": F.lit(model), "embedding": V.hash_embedding(STRIP(F.col("text")), dim)})


def index_status(passages: DataFrame, default_model: str = "hashvec-16") -> DataFrame:
    """``book_id, indexed, passage_count, embedding_model`` (of the first passage)."""
    g = passages.groupBy("book_id").agg(F.count("*").alias("passage_count"), F.min_by("embedding_model", F.struct("pos", "id")).alias("m"))
    return g.select("book_id", (F.col("passage_count") > 0).alias("indexed"), "passage_count", F.coalesce("m", F.lit(default_model)).alias("embedding_model"))
