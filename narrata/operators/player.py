"""What to play, from where, and when to save the place."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def media(chapters: DataFrame, prefer: Column) -> DataFrame:
    """``primary, transport`` of each chapter: live playlist while it runs, the book's file when done, else by preference.

    Columns used: ``status, hls_url, chapter_url, book_url``.
    """
    hls, own, book, done = F.col("hls_url"), F.col("chapter_url"), F.col("book_url"), F.col("status") == "completed"
    choice = lambda url, how: F.struct(url.alias("primary"), F.when(url.isNotNull(), F.lit(how)).alias("transport"))
    last = F.when(own.isNotNull(), choice(own, "chapter")).when(hls.isNotNull(), choice(hls, "hls")).otherwise(choice(book, "book"))
    pick = (
        F.when((F.col("status") == "running") & hls.isNotNull(), choice(hls, "hls"))
        .when(done & book.isNotNull(), choice(book, "book"))
        .when(done, choice(own, "chapter"))
        .when((prefer == "hls") & hls.isNotNull(), choice(hls, "hls"))
        .when((prefer == "final") & own.isNotNull(), choice(own, "chapter"))
        .when((prefer == "final") & book.isNotNull(), choice(book, "book"))
        .otherwise(last)
    )
    return chapters.withColumn("__m", pick).withColumns({"primary": F.col("__m.primary"), "transport": F.col("__m.transport")}).drop("__m")


def resume_times(points: DataFrame, at: DataFrame) -> DataFrame:
    """``resume_s``: where the player starts, for a whole book its absolute time, for a chapter its own.

    ``points(point_id, transport, chapter_index, abs_time_s, saved_chapter, saved_time_s, saved_abs_s)``;
    ``at`` is :func:`narrata.operators.timeline.chapter_at` of the points.
    """
    j = points.join(at.select("point_id", F.col("chapter_index").alias("__c"), F.col("chapter_time_s").alias("__t")), "point_id", "left")
    whole = F.col("transport") == "book"
    same = F.col("saved_chapter") == F.col("chapter_index")
    pos = F.when(whole, F.coalesce("abs_time_s", "saved_abs_s")).otherwise(F.coalesce(F.when(F.col("__c") == F.col("chapter_index"), F.col("__t")), F.when(same, F.col("saved_time_s"))))
    return j.withColumn("resume_s", F.when(pos.isNotNull(), F.greatest(F.lit(0.0), pos))).drop("__c", "__t")


def throttled(events: DataFrame, key: str, ts: str, every_ms: int = 5000, delay_ms: int = 2200) -> DataFrame:
    """``key, ts, saved_ms``: events that lead to a save, at most one in ``every_ms``, written ``delay_ms`` later.

    A save starts the interval anew when it is scheduled and when it is written,
    so which events count depends on those before: each key's events are read in
    order, in batches, and only the last time is carried.
    """
    rows = events.select(F.col(key).alias("k"), F.unix_millis(F.col(ts).cast("timestamp")).alias("ms"))
    parted = rows.repartition("k").sortWithinPartitions("k", "ms")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, last, due = None, None, None
        for b in batches:
            out = []
            for k, ms in zip(b["k"].tolist(), b["ms"].tolist(), strict=True):
                if k != who:
                    who, last, due = k, None, None
                # A pending save moves the mark to the time it is written, once that has come.
                if due is not None and ms >= due:
                    last, due = due, None
                if last is None or ms - last >= every_ms:
                    last, due = ms, ms + delay_ms
                    out.append((k, ms, due))
            yield pd.DataFrame(out, columns=["k", "ms", "saved_ms"])

    kind = rows.schema["k"].dataType.simpleString()
    return parted.mapInPandas(run, f"k {kind}, ms bigint, saved_ms bigint").select(F.col("k").alias(key), "ms", "saved_ms")


def covers(items: DataFrame) -> DataFrame:
    """The cover of each book: marked as cover, named by metadata, a large image with a telling name, else the largest image.

    ``items(book_id, item_pos, name, size, is_cover, is_meta_cover, is_image)``.
    """
    telling = F.lower("name").rlike("cover|front|title|jacket")
    rank = F.when(F.col("is_cover"), 0).when(F.col("is_meta_cover"), 1).when(F.col("is_image") & (F.col("size") > 5000) & telling, 2).when(F.col("is_image") & (F.col("size") > 0), 3)
    order = [F.col("rank"), F.when(F.col("rank") == 3, -F.col("size")).otherwise(0), F.col("item_pos")]
    w = Window.partitionBy("book_id").orderBy(*order)
    return items.withColumn("rank", rank).where("rank IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "rank")


def cache_sizes(entries: DataFrame) -> DataFrame:
    return entries.groupBy("cache").agg(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
