"""Chapter timelines: offsets, lookups by time, and playlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Seconds of silence before the first chunk and between chunks.
LEAD_GAP, GAP = 1.75, 0.45


def timeline(chapters: DataFrame, order: str = "chapter_index") -> DataFrame:
    """``start_s, end_s`` by running totals; chapters without a valid duration take no time and have no offsets."""
    ok = F.col("duration_s").isNotNull() & ~F.isnan("duration_s") & (F.col("duration_s") >= 0)
    before = Window.partitionBy("book_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.when(ok, F.col("duration_s"))).over(before), F.lit(0.0))
    return chapters.withColumn("start_s", F.when(ok, F.round(start, 6))).withColumn("end_s", F.when(ok, F.round(start + F.col("duration_s"), 6)))


def client_timeline(chapters: DataFrame, order: str = "chapter_index") -> DataFrame:
    """``start_s, end_s`` with given offsets kept.

    The cursor mixes sums and maxima, so each book is one fold over its ordered
    chapters (a book's chapters are bounded; books spread over tasks).
    """
    row = F.struct(F.col(order).alias("o"), F.col("chapter_id").alias("id"), F.col("given_start_s").alias("s"), F.col("given_end_s").alias("e"), F.col("duration_s").alias("d"))
    books = chapters.groupBy("book_id").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    empty = F.array().cast("array<struct<id:bigint,s:double,e:double>>")

    def step(acc: Column, r: Column) -> Column:
        s, e, d = (F.when(~F.isnan(r[k]), r[k]) for k in "sed")
        explicit, long = (s.isNotNull() & e.isNotNull() & (e >= s)), (d > 0)
        start = F.when(explicit, s).when(long, F.coalesce(s, acc["t"])).otherwise(s)
        end = F.when(explicit, e).when(long, F.coalesce(s, acc["t"]) + d).otherwise(e)
        moved = F.coalesce(explicit | long, F.lit(False))
        return F.struct(F.when(moved, F.greatest(acc["t"], end)).otherwise(acc["t"]).alias("t"), F.array_append(acc["out"], F.struct(r["id"].alias("id"), start.alias("s"), end.alias("e"))).alias("out"))

    folded = books.select("book_id", F.explode(F.aggregate("rows", F.struct(F.lit(0.0).alias("t"), empty.alias("out")), step, lambda a: a["out"])).alias("x"))
    return folded.select("book_id", F.col("x.id").alias("chapter_id"), F.round("x.s", 6).alias("start_s"), F.round("x.e", 6).alias("end_s"))


def ffmetadata_marks(chapters: DataFrame, order: str = "chapter_index") -> DataFrame:
    """``start_ms, end_ms``: whole milliseconds, at least one a chapter."""
    ms = F.greatest(F.lit(1).cast("long"), F.floor(F.col("duration_s") * 1000).cast("long"))
    w = Window.partitionBy("book_id").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return chapters.withColumn("end_ms", F.sum(ms).over(w)).withColumn("start_ms", F.col("end_ms") - ms)


def chapter_at(points: DataFrame, marks: DataFrame) -> DataFrame:
    """``chapter_index, chapter_time_s`` of absolute times.

    The first interval that holds the time; past the end of the book's last
    chapter, that chapter's end. Intervals and points meet by book.
    """
    # A book's marks are one bounded list, so that a book with many points joins row to row and can be split.
    lists = marks.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "start_s", "end_s"))).alias("m"))
    j = points.select("point_id", "book_id", "abs_time_s").where("abs_time_s IS NOT NULL").join(lists, "book_id", "left")
    t = F.col("abs_time_s")
    j = j.withColumns({"h": F.try_element_at(F.filter("m", lambda x: (t >= x["start_s"]) & (t < x["end_s"])), F.lit(1)), "l": F.try_element_at("m", F.lit(-1))})
    clamp = F.col("l.start_s").isNotNull() & (t >= F.col("l.end_s"))
    return j.select("point_id", "book_id", "abs_time_s", F.coalesce("h.chapter_index", F.when(clamp, F.col("l.chapter_index"))).alias("chapter_index"), F.round(F.coalesce(t - F.col("h.start_s"), F.when(clamp, F.greatest(F.lit(0.0), F.col("l.end_s") - F.col("l.start_s")))), 6).alias("chapter_time_s"))


def absolute_times(points: DataFrame, marks: DataFrame) -> DataFrame:
    """``abs_time_s`` of a time within a chapter, by chapter index, else by place in the list (from 0)."""
    place = Window.partitionBy("book_id").orderBy("chapter_index")
    m = marks.withColumn("__n", F.row_number().over(place) - 1)
    by_index = m.select("book_id", F.col("chapter_index").alias("__i"), F.col("start_s").alias("__s1"), F.lit(True).alias("__has"))
    by_place = m.select("book_id", F.col("__n").alias("__i"), F.col("start_s").alias("__s2"))
    p = points.withColumn("__i", F.col("chapter_index"))
    j = p.join(by_index, ["book_id", "__i"], "left").join(by_place, ["book_id", "__i"], "left")
    start = F.when(F.col("__has"), F.col("__s1")).otherwise(F.col("__s2"))
    return j.withColumn("abs_time_s", F.round(start + F.greatest(F.lit(0.0), F.coalesce("chapter_time_s", F.lit(0.0))), 6)).drop("__i", "__s1", "__s2", "__has")


def neighbours(chapters: DataFrame, playable: Column, order: str = "chapter_index") -> DataFrame:
    """``next_playable, prev_playable``: the nearest later and earlier chapter that can be played."""
    w = Window.partitionBy("book_id").orderBy(order)
    at = F.when(playable, F.col(order))
    return chapters.withColumn("next_playable", F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))).withColumn("prev_playable", F.last(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))


def with_gaps(chunks: DataFrame) -> DataFrame:
    """Playlist entries: the lead gap, then each existing chunk and, but for the last, the gap after it.

    ``chunks(book_id, chapter_index, chunk_index, chunk_total, duration_s)``; a
    chunk that is missing (null duration) drops out with its gap.
    """
    name = lambda kind, i: F.format_string(f"chapter-%03d-{kind}-%03d.aac", "chapter_index", i)
    entry = lambda n, d, k: F.struct(n.alias("name"), d.alias("duration_s"), k.alias("pos"))
    chunk = entry(F.format_string("chunk-%03d.aac", "chunk_index"), F.col("duration_s"), F.col("chunk_index") * 2 - 1)
    gap = entry(name("gap", F.col("chunk_index")), F.lit(GAP), F.col("chunk_index") * 2)
    body = chunks.where("duration_s IS NOT NULL").select("book_id", "chapter_index", F.explode(F.when(F.col("chunk_index") < F.col("chunk_total"), F.array(chunk, gap)).otherwise(F.array(chunk))).alias("x"))
    lead = chunks.select("book_id", "chapter_index").distinct().select("book_id", "chapter_index", entry(name("gap", F.lit(0)), F.lit(LEAD_GAP), F.lit(0)).alias("x"))
    return body.unionByName(lead).select("book_id", "chapter_index", F.col("x.pos").alias("pos"), F.col("x.name").alias("name"), F.col("x.duration_s").alias("duration_s"))


def playlists(entries: DataFrame, keys: list[str], finished: bool = False) -> DataFrame:
    """``text`` of each playlist (a chapter's entries are a bounded list)."""
    g = entries.groupBy(*keys).agg(F.greatest(F.lit(1), F.max(F.ceil("duration_s"))).cast("long").alias("t"), F.array_sort(F.collect_list(F.struct("pos", "name", "duration_s"))).alias("e"))
    lines = F.array_join(F.transform("e", lambda x: F.concat(F.lit("#EXTINF:"), F.format_string("%.3f", x["duration_s"]), F.lit(",\n"), x["name"], F.lit("\n"))), "")
    head = F.concat(F.lit("#EXTM3U\n#EXT-X-VERSION:3\n#EXT-X-TARGETDURATION:"), F.col("t").cast("string"), F.lit("\n#EXT-X-PLAYLIST-TYPE:EVENT\n"))
    return g.select(*keys, F.concat(head, lines, F.lit("#EXT-X-ENDLIST\n" if finished else "")).alias("text"))


def running_targets(entries: DataFrame, keys: list[str]) -> DataFrame:
    """``target``: the target duration a playlist shows after each appended entry."""
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return entries.withColumn("target", F.greatest(F.lit(1), F.max(F.ceil("duration_s")).over(w)).cast("long"))


def finalized(playlist: Column) -> Column:
    return F.when(F.rtrim(F.regexp_replace(playlist, r"\s+$", "")).endswith("#EXT-X-ENDLIST"), playlist).otherwise(F.concat(playlist, F.lit("#EXT-X-ENDLIST\n")))
