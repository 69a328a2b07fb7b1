"""Ordering, title, selection, resume and cache joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.rules import SQUEEZE


def last_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key: the one with the greatest ``order`` (which must be unique within a key)."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("__r")).select(*keys, *[F.col("__r")[c].alias(c) for c in rest])


def spine_order(items: DataFrame, spine: DataFrame, key: str, item_pos: str, spine_pos: str) -> DataFrame:
    """Items in spine order, then those the spine lacks in their own order; numbered from 1 within ``book_id``."""
    s = spine.select("book_id", key, F.col(spine_pos).alias("__p"))
    listed = items.join(s, ["book_id", key]).withColumn("__g", F.lit(0))
    loose = items.join(s, ["book_id", key], "left_anti").withColumn("__p", F.col(item_pos).cast(s.schema["__p"].dataType)).withColumn("__g", F.lit(1))
    w = Window.partitionBy("book_id").orderBy("__g", "__p", key)
    return listed.unionByName(loose).withColumn("position", F.row_number().over(w)).drop("__p", "__g")


def toc_entries(toc: DataFrame) -> DataFrame:
    """First title of each document: fragment stripped, section title before link title."""
    t = toc.select("book_id", "pos", F.substring_index("href", "#", 1).alias("href"), SQUEEZE(F.coalesce(F.col("section_title"), F.col("label"))).alias("title")).where("href <> '' AND title <> ''")
    return first_by(t, ["book_id", "href"], "pos").select("book_id", "href", "title")


def toc_titles(docs: DataFrame, toc: DataFrame) -> DataFrame:
    """``toc_title`` of each document: by full name, else by file name."""
    e = toc_entries(toc)
    full = e.select("book_id", F.col("href").alias("source"), F.col("title").alias("__full"))
    base = e.select("book_id", F.substring_index("href", "/", -1).alias("__base"), F.struct("href", "title").alias("x")).groupBy("book_id", "__base").agg(F.min("x")["title"].alias("__name"))
    out = docs.withColumn("__base", F.substring_index("source", "/", -1)).join(full, ["book_id", "source"], "left").join(base, ["book_id", "__base"], "left")
    return out.withColumn("toc_title", F.coalesce("__full", "__name")).drop("__full", "__name", "__base")


def display_titles(chapters: DataFrame, titles: DataFrame) -> DataFrame:
    """``display_title``: the first of a chapter's names that the title map knows, else its own title, else its number.

    ``titles(book_id, key, title)``; names are tried in order: source, file
    name, stem, title, slug and the slug's variants.
    """
    raw, src = F.trim(F.coalesce("title", F.lit(""))), F.coalesce("source", F.lit(""))
    name, slug = F.substring_index(src, "/", -1), F.coalesce("slug", F.lit(""))
    bare = F.regexp_replace(slug, r"^\d{3}-", "")
    names = F.array(src, name, F.regexp_replace(name, r"\.[^.]*$", ""), raw, slug, bare, F.replace(bare, F.lit("-"), F.lit("_")), F.concat(F.replace(bare, F.lit("-"), F.lit("_")), F.lit(".html")))
    tried = chapters.select("book_id", "chapter_id", F.posexplode(names).alias("__p", "key")).where("key <> ''")
    hit = tried.join(titles, ["book_id", "key"]).groupBy("book_id", "chapter_id").agg(F.min_by("title", "__p").alias("__hit"))
    own = F.when((raw != "") & ~T.is_packaging_title(raw), raw)
    return chapters.join(hit, ["book_id", "chapter_id"], "left").withColumn("display_title", F.coalesce("__hit", own, F.concat(F.lit("Chapter "), F.col("chapter_index").cast("string")), F.lit("Chapter"))).drop("__hit")


def selected_chapters(chapters: DataFrame, selection: str, index: str = "chapter_index") -> DataFrame:
    """Chapters named by a selection like ``5-12,1,3``; a reversed range counts as turned round."""
    spec = chapters.sparkSession.range(1).select(F.explode(F.split(F.lit(selection), ",")).alias("s")).select(F.trim("s").alias("s")).where("s <> ''")
    lo, hi = F.split("s", "-")[0].cast("int"), F.element_at(F.split("s", "-"), -1).cast("int")
    wanted = spec.select(F.explode(F.sequence(F.least(lo, hi), F.greatest(lo, hi))).alias(index)).distinct()
    return chapters.join(wanted, index, "left_semi")


def with_manifest(status: DataFrame, manifest: DataFrame) -> DataFrame:
    """Status rows with their manifest columns; of repeated manifest rows the last (by ``pos``) counts."""
    return status.join(last_by(manifest, ["book_id", "chapter_index"], "pos").drop("pos"), ["book_id", "chapter_index"], "left")


def resumable(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Chapters that need no work: every expected chunk file non-empty, and an audio file or playlist for the chapter.

    ``expected(book_id, chapter_index, slug, total_chunks)``, ``files(book_id, path, size)``.
    """
    # The number of chunk files is counted, not listed: one pass over the files, no explode.
    f = files.select("book_id", "size", F.regexp_extract("path", r"^chapters/([^/]+)/chunk-(\d{3,})\.wav$", 1).alias("slug"), F.regexp_extract("path", r"^chapters/([^/]+)/chunk-(\d{3,})\.wav$", 2).alias("n"), F.regexp_extract("path", r"^([^/]+)\.(?:wav|m4a)$", 1).alias("audio"), F.regexp_extract("path", r"^chapter-(\d+)\.m3u8$", 1).alias("list"))
    e = expected.where("total_chunks > 0")
    chunks = f.where("slug <> '' AND size > 0").select("book_id", "slug", F.col("n").cast("int").alias("n")).join(e.select("book_id", "slug", "chapter_index", "total_chunks"), ["book_id", "slug"]).where("n BETWEEN 1 AND total_chunks")
    done = chunks.groupBy("book_id", "chapter_index", "total_chunks").agg(F.count_distinct("n").alias("have")).where("have = total_chunks").select("book_id", "chapter_index")
    audio = f.where("audio <> '' AND size > 0").select("book_id", F.col("audio").alias("slug")).join(e.select("book_id", "slug", "chapter_index"), ["book_id", "slug"]).select("book_id", "chapter_index")
    lists = f.where("list <> '' AND size > 0").select("book_id", F.col("list").cast("int").alias("chapter_index"))
    return done.join(audio.unionByName(lists).distinct(), ["book_id", "chapter_index"], "left_semi")


def cache_lookup(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """``hit``: the cache holds a rewrite of this very text made under the same settings."""
    c = cache.where("rewritten_text <> ''").select("book_id", "chapter_index", "chunk_index", F.col("raw_sha256").alias("__sha"), F.col("settings").alias("__set"), "rewritten_text")
    j = chunks.withColumn("__own", F.sha2("text", 256)).join(c, ["book_id", "chapter_index", "chunk_index"], "left")
    hit = F.coalesce((F.col("__own") == F.col("__sha")) & F.col("settings").eqNullSafe(F.col("__set")), F.lit(False))
    return j.withColumn("hit", hit).withColumn("rewritten_text", F.when(F.col("hit"), F.col("rewritten_text"))).drop("__own", "__sha", "__set")


def citation_targets(citations: DataFrame, toc: DataFrame) -> DataFrame:
    """``toc_href`` of each citation: the first contents entry of its book whose label contains the chapter's or lies within it.

    The book is an equality key, so the containment test only meets entries of
    the same book; distinct labels are compared once.
    """
    want = citations.select("book_id", T.chapter_label(F.col("chapter")).alias("__l")).where("__l <> ''").distinct()
    have = toc.select("book_id", "pos", "href", T.chapter_label(F.col("label")).alias("__t")).where("__t <> ''")
    hit = want.join(have, (want.book_id == have.book_id) & (F.contains(have["__t"], want["__l"]) | F.contains(want["__l"], have["__t"])))
    first = hit.groupBy(want.book_id, "__l").agg(F.min_by("href", "pos").alias("toc_href"))
    return citations.withColumn("__l", T.chapter_label(F.col("chapter"))).join(first, ["book_id", "__l"], "left").drop("__l")


def process_matches(processes: DataFrame, runs: DataFrame, script: str, max_processes: int = 100_000) -> DataFrame:
    """``run, live, paused``: runs that a process names, by run folder or output folder.

    Processes of one host are a bounded list: they are broadcast up to
    ``max_processes`` rows, beyond that an error is raised.
    """
    p = processes.where(F.contains("cmdline", F.lit(script))).select("cmdline", "state")
    if p.limit(max_processes + 1).count() > max_processes:
        raise ValueError(f"more than {max_processes} processes")
    on = F.contains("cmdline", runs["run_dir"]) | F.contains("cmdline", runs["outdir"])
    hit = runs.join(F.broadcast(p), on, "left")
    stopped = F.col("state").startswith("T")
    return hit.groupBy("run_dir").agg(F.coalesce(F.bool_or(F.col("cmdline").isNotNull() & ~stopped), F.lit(False)).alias("live"), F.coalesce(F.bool_or(stopped), F.lit(False)).alias("paused"))


def retention_plan(files: DataFrame, keep: DataFrame) -> DataFrame:
    """Files to delete: work folders and intermediate suffixes, without those to keep."""
    work = F.col("path").rlike(r"^(chapters|chunks)/") | F.col("path").rlike(r"\.(wav|aac|txt|m3u8|json)$")
    return files.where(work).join(keep, ["book_id", "path"], "left_anti")
