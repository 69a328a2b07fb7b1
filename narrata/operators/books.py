"""From EPUB documents to chapters, and from chapters to passages ready to store."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import chunking as K
from narrata.functions import classify as C
from narrata.functions import html as H
from narrata.functions import text as T
from narrata.functions import vectors as V
from narrata.functions.rules import SQUEEZE, STRIP


@dataclass(frozen=True)
class Embedder:
    """What makes vectors of texts: a name, their length, and a column expression.

    Any other model takes the default's place with :func:`embedder`.
    """

    model_name: str
    dimension: int
    embed: Callable[[Column], Column]


def hash_embedder(dimension: int = 16) -> Embedder:
    """The default: feature hashing in the JVM."""
    return Embedder(f"hashvec-{dimension}", dimension, lambda text: V.hash_embedding(text, dimension))


def embedder(model_name: str, dimension: int, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> Embedder:
    """A model in Python: ``load`` runs once a task and gives a function from a batch of texts to their vectors."""

    @F.pandas_udf("array<double>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in texts:
            yield pd.Series([list(map(float, v)) for v in model([t or "" for t in s])], dtype=object)

    return Embedder(model_name, dimension, run)


def extracted_chapters(documents: DataFrame) -> DataFrame:
    """``book_path, book_title, chapter_index, source, title, text`` of the chapters of EPUB documents.

    ``documents`` as the EPUB source gives them. Documents come in spine order,
    those the spine lacks after them; a title is the one in the table of
    contents (by full name, else by file name) unless the document's own is more
    than a packaging name; blank documents and tables of contents go, and the
    rest is numbered from 1.
    """
    d = documents.withColumn("x", H.document_text(F.col("html")))
    name = lambda c: F.substring_index(c, "/", -1)
    plain = lambda e: F.substring_index(e["href"], "#", 1)
    said = lambda e: SQUEEZE(F.coalesce(e["section_title"], e["label"]))
    full = F.filter("toc", lambda e: (plain(e) == F.col("href")) & (said(e) != ""))
    base = F.filter("toc", lambda e: (name(plain(e)) == name(F.col("href"))) & (said(e) != ""))
    entry = F.coalesce(F.try_element_at(full, F.lit(1)), F.try_element_at(base, F.lit(1)))
    own = H.chapter_title(F.col("x.headings"), F.col("x.title"), F.col("x.text"), F.col("item_pos") + 1)
    listed = F.coalesce(F.nullif(SQUEEZE(F.coalesce(entry["section_title"], entry["label"])), F.lit("")), F.when(~T.is_packaging_title(own), own), F.lit(None).cast("string"))
    d = d.select("book_path", "book_title", "href", "item_pos", "spine_pos", F.col("x.text").alias("text"), listed.alias("title"))
    kept = d.where((STRIP(F.coalesce("text", F.lit(""))) != "") & ~C.is_contents_page(F.coalesce("title", F.lit("")), F.col("href"), F.col("text")))
    # A book's documents are a bounded list; their order needs only keys.
    w = Window.partitionBy("book_path").orderBy(F.col("spine_pos").isNull(), "spine_pos", "item_pos")
    at = kept.select("book_path", "item_pos", F.row_number().over(w).alias("chapter_index"))
    c = kept.join(at, ["book_path", "item_pos"])
    return c.select("book_path", "book_title", "chapter_index", F.col("href").alias("source"), F.coalesce("title", F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string"))).alias("title"), "text")


def passages(chapters: DataFrame, model: Embedder | None = None, most: int = 1200, overlap: int = 150) -> DataFrame:
    """Passages of chapters, with what they need to be found and cited again.

    ``chapters(book_id, chapter_index, title, source, text)``; the result has
    ``id, book_id, chapter, source, href, chapter_index, chunk_index, pos, text,
    embedding_model, embedding``. Windows overlap within a chapter; ``pos``
    counts through the book in two steps (windows before a chapter, then within
    it), so that no book is one task. Null and blank texts give none.
    """
    model = model or hash_embedder()
    w = K.overlapping(chapters.where(F.col("text").isNotNull() & F.col("book_id").isNotNull()), "text", most, overlap).where(STRIP(F.col("piece")) != "")
    per = w.groupBy("book_id", "chapter_index").agg(F.count("*").alias("n"))
    before = per.select("book_id", "chapter_index", (F.sum("n").over(Window.partitionBy("book_id").orderBy("chapter_index")) - F.col("n")).alias("before"))
    p = w.join(before, ["book_id", "chapter_index"]).withColumn("pos", F.col("before") + F.col("chunk_index"))
    text = STRIP(F.col("piece"))
    return p.select(
        F.concat(F.lit("passage_"), "book_id", F.lit("_"), F.col("pos").cast("string")).alias("id"), "book_id", F.col("title").alias("chapter"), "source", F.col("source").alias("href"), "chapter_index", F.col("chunk_index").cast("int").alias("chunk_index"), "pos",
        text.alias("text"), F.lit(model.model_name).alias("embedding_model"), model.embed(text).alias("embedding"),
    )
