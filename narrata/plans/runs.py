"""Event-log queries: a run is a user of the event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.operators import runs as R
from narrata.plans.common import CHAPTERS, chapters
from narrata.session import table
from narrata.streaming import events as S

QUERIES, ORACLES = {}, {}
KINDS = {"click": "click", "view": "view", "purchase": "purchase"}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def last_event(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_type", "event_id", F.struct("ts", "event_id").alias("o"))
    return e.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), "o").alias("x")).select("user_id", "x.event_type", "x.event_id")


@query("SELECT user_id, event_id, from_end::INTEGER AS from_end FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end FROM events) WHERE from_end <= 40")
def event_tail(spark: SparkSession, d: str) -> DataFrame:
    return R.tail(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "from_end")


@query("""WITH t AS (SELECT user_id, event_id, CASE WHEN event_id % 97 = 0 THEN '{bad' ELSE props END AS line, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, CASE WHEN bool_or(line = '{bad') THEN 0 ELSE count(*) END AS n_events, CASE WHEN bool_or(line = '{bad') THEN '' ELSE string_agg(line, '|' ORDER BY event_id) END AS lines FROM t WHERE r <= 40 GROUP BY user_id""")
def tail_or_nothing(spark: SparkSession, d: str) -> DataFrame:
    """Last 40 lines of each run; one broken line (here every 97th) empties the list."""
    e = table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 97 == 0, "{bad").otherwise(F.col("props")).alias("line"))
    t = R.tail_or_nothing(e, "user_id", "event_id", "line")
    return t.select("user_id", F.size("events").cast("long").alias("n_events"), F.array_join("events", "|").alias("lines"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n_{n}" for n, k in KINDS.items()) + ", " + ", ".join(f"round(coalesce(sum(value) FILTER (WHERE event_type = '{k}'), 0), 3) AS sum_{n}" for n, k in KINDS.items())


@query(f"SELECT user_id, count(*) AS n_events, {_COUNTS} FROM events GROUP BY user_id")
def event_counters(spark: SparkSession, d: str) -> DataFrame:
    return R.counters(table(spark, d, "events"), ["user_id"], KINDS)


@query(f"SELECT user_id, count(*) AS n_events, {_COUNTS} FROM events GROUP BY user_id")
def event_counters_stream(spark: SparkSession, d: str) -> DataFrame:
    """The same counters from a stream over the table's file."""
    e = S.stream(spark, f"{d}/events*.parquet")
    return S.run_to_end(S.live_counters(e, ["user_id"], KINDS), "event_counters_live", "complete")


@query("SELECT * FROM (SELECT user_id, event_id, round((epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1000000.0, 3)::DOUBLE AS gap_s FROM events) WHERE gap_s > 120")
def quiet_gaps(spark: SparkSession, d: str) -> DataFrame:
    return R.quiet_gaps(table(spark, d, "events").select("user_id", "event_id", "ts"), "user_id", "ts").select("user_id", "event_id", F.round("gap_s", 3).alias("gap_s"))


@query("WITH n AS (SELECT max(ts) AS now FROM events) SELECT user_id, max(ts) AS last_ts, epoch_us(any_value(now)) - epoch_us(max(ts)) > 86400000000 AS stalled FROM events, n GROUP BY user_id")
def stalled_runs(spark: SparkSession, d: str) -> DataFrame:
    """Runs silent for more than a day at the time of the log's last event (one value, fetched first)."""
    e = table(spark, d, "events").select("user_id", "ts")
    now = e.agg(F.max("ts").alias("now")).first()["now"]
    return R.staleness(e, "user_id", "ts", F.lit(now), 86_400)


def silence_stream(spark: SparkSession, d: str) -> DataFrame:
    """Silences of more than a day, by a stateful stream with timers."""
    return S.run_to_end(S.silences(S.stream(spark, f"{d}/events*.parquet"), quiet_s=86_400), "silences", "append")


QUERIES["silence_stream"] = silence_stream
# The stream ends at its last event, so a run is reported by timer if its silence ended ten minutes before that.
ORACLES["silence_stream"] = """WITH e AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events), n AS (SELECT max(ts) AS now FROM events)
    SELECT user_id, ts AS quiet_from, (epoch_us(nxt) - epoch_us(ts)) / 1000000.0::DOUBLE AS quiet_s FROM e WHERE epoch_us(nxt) - epoch_us(ts) > 86400000000
    UNION ALL SELECT user_id, ts, 86400.0 FROM e, n WHERE nxt IS NULL AND epoch_ms(ts) + 86400000 < epoch_ms(now) - 600000"""


@query("""WITH f AS (SELECT DISTINCT book_id, chapter_index AS chapter, chunk_index AS n, coalesce(length(text), 0) AS size FROM passages WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL)
    SELECT book_id, chapter, count(*) AS n_txt, count(*) FILTER (WHERE n % 2 = 0) AS n_wav, count(*) FILTER (WHERE n % 3 = 0) AS n_cache, count(*) FILTER (WHERE size = 0) AS n_empty, count(*) AS n_total FROM f GROUP BY ALL""")
def folder_rollup(spark: SparkSession, d: str) -> DataFrame:
    """File counts of each chapter folder (a listing made from the passages)."""
    p = table(spark, d, "passages").where("book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL").select("book_id", F.col("chapter_index").alias("chapter"), F.col("chunk_index").alias("n"), F.coalesce(F.length("text"), F.lit(0)).alias("size")).distinct()
    name = lambda s: F.format_string(f"chunk-%03d{s}", "n")
    files = p.select("book_id", "chapter", "size", F.explode(F.array_compact(F.array(name(".txt"), F.when(F.col("n") % 2 == 0, name(".wav")), F.when(F.col("n") % 3 == 0, name(".json")), name("-gap.wav")))).alias("name"))
    return R.rollup(files)


@query(f"SELECT book_id, min(chapter_index) FILTER (WHERE duration_s IS NULL OR duration_s <= 0) AS first_open FROM {CHAPTERS} WHERE book_id IS NOT NULL GROUP BY book_id")
def first_open_chapters(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "duration_s").where("book_id IS NOT NULL")
    return R.first_open_chapter(c, F.coalesce(F.col("duration_s") > 0, F.lit(False)))


@query("""WITH p AS (SELECT book_id, count(DISTINCT id) AS total FROM passages WHERE book_id IS NOT NULL GROUP BY ALL), u AS (SELECT book_id, count(DISTINCT memory_id) AS n FROM memories WHERE book_id IS NOT NULL GROUP BY ALL)
    SELECT coalesce(p.book_id, u.book_id) AS book_id, CASE WHEN u.book_id IS NOT NULL THEN 'running' ELSE 'idle' END AS status, coalesce(n, 0) AS current, total, CASE WHEN total <= 0 THEN 0 ELSE least(100, floor(coalesce(n, 0) * 100 / total)) END::INTEGER AS percent FROM p FULL JOIN u ON p.book_id = u.book_id""")
def job_updates(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where("book_id IS NOT NULL").groupBy("book_id").agg(F.count_distinct("id").alias("total"))
    u = table(spark, d, "memories").where("book_id IS NOT NULL").groupBy("book_id").agg(F.count_distinct("memory_id").alias("current"))
    jobs = p.select("book_id", F.lit("idle").alias("status"), F.lit("").alias("stage"), F.lit("").alias("message"), F.lit(0).cast("long").alias("current"), "total")
    new = u.select("book_id", F.lit("running").alias("status"), F.lit("embedding").alias("stage"), F.lit(None).cast("string").alias("message"), "current", F.lit(None).cast("long").alias("total"))
    return R.upsert_job(jobs, new).select("book_id", "status", "current", "total", "percent")


@query("SELECT doc_id, least(100, floor(n_chars * 100 / 5000))::INTEGER AS percent FROM documents WHERE n_chars IS NOT NULL")
def progress_percent(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars IS NOT NULL").select("doc_id", T.percent(F.col("n_chars"), F.lit(5000)).alias("percent"))
