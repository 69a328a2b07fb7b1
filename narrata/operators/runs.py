"""Run folders and event logs: tails, counters, rollups, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Seconds without a sign of life after which a run counts as stalled.
STALE_S = 120


def last_events(events: DataFrame, key: str, order: str, fields: list[str]) -> DataFrame:
    """The last event of each run: one partial aggregate, no sort."""
    return events.groupBy(key).agg(F.max_by(F.struct(*fields), F.struct(order)).alias("e")).select(key, *[F.col("e")[f].alias(f) for f in fields])


def tail(events: DataFrame, key: str, order: list[Column], n: int = 40) -> DataFrame:
    """The last n lines of each run, with their place from the end."""
    w = Window.partitionBy(key).orderBy(*order)
    return events.withColumn("from_end", F.row_number().over(w)).where(F.col("from_end") <= n)


def tail_or_nothing(lines: DataFrame, key: str, pos: str, line: str, n: int = 40) -> DataFrame:
    """``events`` of the last n lines, in order; empty if any of them is no JSON object."""
    t = tail(lines, key, [F.desc(pos)], n)
    bad = F.col(line).isNull() | (F.trim(line) != "") & F.try_parse_json(F.col(line)).isNull()
    g = t.groupBy(key).agg(F.bool_or(bad).alias("bad"), F.array_sort(F.collect_list(F.struct(F.col(pos), F.col(line)))).alias("l"))
    return g.select(key, F.when(F.col("bad"), F.array().cast("array<string>")).otherwise(F.filter(F.transform("l", lambda x: x[line]), lambda x: F.trim(x) != "")).alias("events"))


def counters(events: DataFrame, keys: list[str], kinds: dict[str, str], kind: str = "event_type", value: str = "value") -> DataFrame:
    """Counts of each kind of event, and the sum of its values."""
    aggs = [F.count_if(F.col(kind) == k).alias(f"n_{n}") for n, k in kinds.items()] + [F.round(F.coalesce(F.sum(F.when(F.col(kind) == k, F.col(value))), F.lit(0.0)), 3).alias(f"sum_{n}") for n, k in kinds.items()]
    return events.groupBy(*keys).agg(F.count("*").alias("n_events"), *aggs)


def quiet_gaps(events: DataFrame, key: str, ts: str, quiet_s: int = STALE_S) -> DataFrame:
    """Gaps of more than ``quiet_s`` seconds between a run's events."""
    w = Window.partitionBy(key).orderBy(ts, "event_id")
    t = F.col(ts).cast("timestamp")
    gap = F.unix_micros(t) - F.unix_micros(F.lag(t).over(w))
    return events.withColumn("gap_s", gap / 1_000_000).where(F.col("gap_s") > quiet_s)


def staleness(events: DataFrame, key: str, ts: str, now: Column, quiet_s: int = STALE_S) -> DataFrame:
    g = events.groupBy(key).agg(F.max(ts).alias("last_ts"))
    return g.withColumn("stalled", (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_ts").cast("timestamp"))) > quiet_s * 1_000_000)


def rollup(files: DataFrame) -> DataFrame:
    """Chunk counts of each chapter folder by suffix, gaps left out, and the chapter's estimated total.

    ``files(book_id, chapter, name, size)``.
    """
    has = lambda s: F.col("name").endswith(s) & ~F.col("name").endswith("-gap" + s)
    g = files.groupBy("book_id", "chapter").agg(F.count_if(has(".txt")).alias("n_txt"), F.count_if(has(".wav")).alias("n_wav"), F.count_if(has(".json")).alias("n_cache"), F.count_if(has(".txt") & (F.col("size") == 0)).alias("n_empty"))
    return g.withColumn("n_total", F.greatest("n_txt", "n_wav", "n_cache"))


def first_open_chapter(chapters: DataFrame, done: Column) -> DataFrame:
    return chapters.groupBy("book_id").agg(F.min(F.when(~done, F.col("chapter_index"))).alias("first_open"))


def upsert_job(jobs: DataFrame, updates: DataFrame) -> DataFrame:
    """Jobs with their updates merged: given fields win, the percentage follows current and total."""
    fields = ["status", "stage", "message", "current", "total"]
    u = updates.select("book_id", *[F.col(f).alias(f"__{f}") for f in fields])
    j = jobs.join(u, "book_id", "full")
    m = j.select("book_id", *[F.coalesce(f"__{f}", f).alias(f) for f in fields])
    return m.withColumn("percent", F.when(F.col("total") <= 0, 0).otherwise(F.least(F.lit(100), F.floor(F.col("current") * 100 / F.col("total")))).cast("int"))
