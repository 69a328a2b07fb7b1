"""Queries over labels, playback and listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import chunking as K
from narrata.functions import labels as B
from narrata.functions import text as T
from narrata.functions.rules import STRIP, let
from narrata.operators import player as P
from narrata.operators import timeline as L
from narrata.plans.common import BOOKS, CHAPTERS, books, chapters
from narrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT id, CASE conversion_status {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in B.STATUS_LABELS.items())} ELSE conversion_status END AS label, CASE conversion_status {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {chr(39)}{v}{chr(39)}' for k, v in B.STATUS_CLASSES.items())} ELSE '' END AS class FROM {BOOKS}")
def status_labels(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d, "conversion_status").select("id", B.status_label(F.col("conversion_status")).alias("label"), B.status_class(F.col("conversion_status")).alias("class"))


def voices(spark: SparkSession, d: str) -> DataFrame:
    """The fixed list of voices."""
    return B.voices(spark)


QUERIES["voices"] = voices
ORACLES["voices"] = f"""WITH v AS (SELECT unnest([{', '.join(f"'{x}'" for x in B.VOICES)}]) AS id), n AS (SELECT id, {"CASE substring(id, 1, 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in B.LANGUAGES.items()) + " ELSE 'Unknown' END"} AS language, CASE WHEN substring(id, 2, 1) = 'f' THEN 'female' ELSE 'male' END AS gender FROM v)
    SELECT id, id AS name, language, gender, (SELECT string_agg(upper(w[1]) || lower(w[2:]), ' ') FROM (SELECT unnest(string_split(replace(id, '_', ' '), ' ')) AS w)) || ' — ' || language || ' · ' || upper(gender[1]) || gender[2:] AS label FROM n"""


@query(f"""SELECT chapter_id, concat_ws(' · ', coalesce(nullif({STRIP.sql('title')}, ''), 'Chapter ' || chapter_index), 'chunk ' || chapter_index || coalesce(' / ' || CASE WHEN chapter_index % 2 = 0 THEN 9 END, ''), CASE WHEN chapter_index % 3 = 0 THEN 'tts' END) AS position FROM {CHAPTERS}""")
def run_positions(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("chapter_index")
    return chapters(spark, d, "chapter_index", "title").select("chapter_id", B.position(F.col("title"), i, i, F.when(i % 2 == 0, 9), F.when(i % 3 == 0, "tts")).alias("position"))


@query(f"SELECT id, CASE WHEN favorite THEN 'hint' WHEN listen_abs_time_s IS NOT NULL THEN 'At ' || CASE WHEN floor(listen_abs_time_s / 3600) > 0 THEN floor(listen_abs_time_s / 3600)::BIGINT || ':' || lpad(floor((floor(listen_abs_time_s)::BIGINT % 3600) / 60)::BIGINT::VARCHAR, 2, '0') ELSE floor(listen_abs_time_s / 60)::BIGINT::VARCHAR END || ':' || lpad((floor(listen_abs_time_s)::BIGINT % 60)::VARCHAR, 2, '0') END AS label, CASE WHEN listen_abs_time_s IS NOT NULL THEN least(100, floor(listen_abs_time_s / 20000 * 100 + 0.5))::INTEGER END AS percent FROM {BOOKS}")
def progress_labels(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("listen_abs_time_s")
    return books(spark, d, "favorite", "listen_abs_time_s").select("id", B.progress(F.when(F.col("favorite"), "hint"), t, F.lit(None).cast("double")).alias("label"), B.percent_read(t, F.lit(20000.0)).alias("percent"))


def headless_texts(spark: SparkSession, d: str) -> DataFrame:
    """Chapters without a repeated heading."""
    return chapters(spark, d, "title", "text").where("text IS NOT NULL").select("chapter_id", T.without_heading(F.col("text"), F.col("title")).alias("text"))


QUERIES["headless_texts"] = headless_texts
_END = "regexp_replace({}, '[.:]+$', '')"
ORACLES["headless_texts"] = f"""WITH c AS (SELECT chapter_id, text, list_filter(list_transform(string_split(text, chr(10)), lambda x: {STRIP.sql('x')}), lambda x: x <> '') AS lines, lower({T.normalize_text_sql("coalesce(title, '')")}) AS name, {T.normalize_text_sql('text')} AS whole FROM {CHAPTERS} WHERE text IS NOT NULL),
    d AS (SELECT *, lower({T.normalize_text_sql("lines[1]")}) AS first, regexp_replace(substring(whole, length(name) + 1), '^[ .:\\n\\t]+', '') AS tail FROM c)
    SELECT chapter_id, CASE WHEN len(lines) = 0 OR name = '' THEN text WHEN first = name OR {_END.format('first')} = {_END.format('name')} THEN {STRIP.sql("array_to_string(lines[2:], chr(10) || chr(10))")} WHEN starts_with(lower(whole), name) AND tail <> '' THEN tail ELSE text END AS text FROM d"""


@query(f"""SELECT book_id, ';FFMETADATA1' || chr(10) || 'title=' || book_id || chr(10) || string_agg('[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || (e - ms)::BIGINT || chr(10) || 'END=' || e::BIGINT || chr(10) || 'title=' || replace(replace(replace(replace(coalesce(title, ''), '\\', '\\\\'), '=', '\\='), ';', '\\;'), '#', '\\#') || chr(10), '' ORDER BY chapter_index) AS text
    FROM (SELECT book_id, chapter_index, title, ms, sum(ms) OVER (PARTITION BY book_id ORDER BY chapter_index) AS e FROM (SELECT *, greatest(1, floor(duration_s * 1000))::BIGINT AS ms FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s >= 0)) GROUP BY book_id""")
def ffmetadata_texts(spark: SparkSession, d: str) -> DataFrame:
    """A metadata file for each book (its chapters are a bounded list)."""
    c = chapters(spark, d, "book_id", "chapter_index", "title", "duration_s").where(F.expr("book_id IS NOT NULL AND chapter_index IS NOT NULL AND duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s >= 0"))
    m = L.ffmetadata_marks(c).withColumn("title", T.ffmetadata_value(F.coalesce("title", F.lit(""))))
    mark = lambda x: F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), x["start_ms"].cast("string"), F.lit("\nEND="), x["end_ms"].cast("string"), F.lit("\ntitle="), x["title"], F.lit("\n"))
    g = m.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "start_ms", "end_ms", "title"))).alias("m"))
    return g.select("book_id", F.concat(F.lit(";FFMETADATA1\ntitle="), "book_id", F.lit("\n"), F.array_join(F.transform("m", mark), "")).alias("text"))


@query(f"""SELECT chapter_id, CASE WHEN st = 'running' AND hls IS NOT NULL THEN 'hls' WHEN st = 'completed' AND book IS NOT NULL THEN 'book' WHEN st = 'completed' THEN CASE WHEN own IS NOT NULL THEN 'chapter' END WHEN own IS NOT NULL THEN 'chapter' WHEN hls IS NOT NULL THEN 'hls' WHEN book IS NOT NULL THEN 'book' END AS transport
    FROM (SELECT chapter_id, CASE chapter_index % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'completed' ELSE 'pending' END AS st, CASE WHEN chapter_index % 2 = 0 THEN 'h' END AS hls, CASE WHEN chapter_index % 5 < 2 THEN 'c' END AS own, CASE WHEN chapter_index % 7 < 3 THEN 'b' END AS book FROM {CHAPTERS} WHERE chapter_index IS NOT NULL)""")
def media_choices(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("chapter_index")
    c = chapters(spark, d, "chapter_index").where("chapter_index IS NOT NULL").withColumns({"status": F.when(i % 3 == 0, "running").when(i % 3 == 1, "completed").otherwise("pending"), "hls_url": F.when(i % 2 == 0, "h"), "chapter_url": F.when(i % 5 < 2, "c"), "book_url": F.when(i % 7 < 3, "b")})
    return P.media(c, F.lit(None).cast("string")).select("chapter_id", "transport")


@query("""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
    w(user_id, n, ms, last, due, hit) AS (SELECT user_id, n, ms, ms, ms + 2200, true FROM e WHERE n = 1
      UNION ALL SELECT user_id, n, ms, CASE WHEN ok THEN ms ELSE mark END, CASE WHEN ok THEN ms + 2200 ELSE pending END, ok FROM
        (SELECT e.user_id, e.n, e.ms, CASE WHEN w.due IS NOT NULL AND e.ms >= w.due THEN w.due ELSE w.last END AS mark, CASE WHEN w.due IS NOT NULL AND e.ms >= w.due THEN NULL ELSE w.due END AS pending,
           e.ms - CASE WHEN w.due IS NOT NULL AND e.ms >= w.due THEN w.due ELSE w.last END >= 5000 AS ok FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
    SELECT user_id, ms, ms + 2200 AS saved_ms FROM w WHERE hit""")
def throttled_saves(spark: SparkSession, d: str) -> DataFrame:
    return P.throttled(table(spark, d, "events"), "user_id", "ts")


@query(f"SELECT book_id, string_agg('file ''' || replace(source, '''', '''\\''''') || '''', chr(10) ORDER BY chapter_index, chapter_id) || chr(10) AS text FROM {CHAPTERS} WHERE source IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL GROUP BY book_id")
def concat_lists(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "source").where("source IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL")
    g = c.groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("chapter_index", "chapter_id", "source"))).alias("s"))
    return g.select("book_id", B.concat_list(F.transform("s", lambda x: x["source"])).alias("text"))


def wrapped_units(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs wrapped to lines of at most 120 characters, words and hyphens whole."""
    p = chapters(spark, d, "text").where("text IS NOT NULL").select("chapter_id", F.posexplode(K.paragraphs(let(F.col("text"), T.normalize_text))).alias("i", "unit"))
    return K.wrapped(p, "unit", 120).select("chapter_id", "i", "n", "line")


QUERIES["wrapped_units"] = wrapped_units
