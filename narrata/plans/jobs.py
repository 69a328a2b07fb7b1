"""Queries over index jobs, run listings and catalogs with runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import books as K
from narrata.operators import jobs as J
from narrata.operators import library as B
from narrata.operators import retrieval as A
from narrata.plans import texts
from narrata.plans.common import BOOKS, CHAPTERS, books, chapters, passages
from narrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# A stored job of every book whose conversion has a status; every other book of the catalog has none.
_JOBS = f"(SELECT id AS book_id, conversion_status AS status, conversion_status AS stage, '' AS message, (length(id) % 5)::BIGINT AS current, (length(id))::BIGINT AS total, ((length(id) % 5) * 100 // length(id))::INTEGER AS percent, CASE WHEN conversion_status = 'error' THEN 'broken' END AS error FROM {BOOKS} WHERE id IS NOT NULL AND conversion_status IS NOT NULL AND id <> '')"
_ALL_JOBS = f"(SELECT b.id AS book_id, coalesce(status, 'idle') AS status, coalesce(stage, 'idle') AS stage, coalesce(message, '') AS message, coalesce(current, 0) AS current, coalesce(total, 0) AS total, coalesce(percent, 0)::INTEGER AS percent, error FROM (SELECT DISTINCT id FROM books WHERE id IS NOT NULL AND id <> '') b LEFT JOIN {_JOBS} j ON j.book_id = b.id)"
_INDEX = "(SELECT book_id, count(DISTINCT id) AS n, min_by(embedding_model, (pos, id)) AS m FROM passages WHERE book_id IS NOT NULL AND pos IS NOT NULL AND chunk_index IS NOT NULL AND embedding_model LIKE 'mini%' GROUP BY book_id)"


def _jobs(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "conversion_status").where("id IS NOT NULL AND id <> ''")
    n = F.length("id")
    stored = b.where("conversion_status IS NOT NULL").select(F.col("id").alias("book_id"), F.col("conversion_status").alias("status"), F.col("conversion_status").alias("stage"), F.lit("").alias("message"), (n % 5).cast("long").alias("current"), n.cast("long").alias("total"), F.floor((n % 5) * 100 / n).cast("int").alias("percent"), F.when(F.col("conversion_status") == "error", "broken").alias("error"))
    return J.with_defaults(b.select(F.col("id").alias("book_id")), stored)


@query(f"SELECT * FROM {_ALL_JOBS}")
def job_defaults(spark: SparkSession, d: str) -> DataFrame:
    """The job of every book, stored or default."""
    return _jobs(spark, d)


@query(f"""SELECT j.book_id, CASE WHEN n IS NOT NULL THEN 'done' ELSE status END AS status, CASE WHEN n IS NOT NULL THEN 'complete' ELSE stage END AS stage,
    CASE WHEN n IS NOT NULL THEN 'Passage index ready (' || n || ' passages)' WHEN status = 'idle' AND message = '' THEN 'No passage index yet.' ELSE message END AS message,
    coalesce(n, current) AS current, coalesce(n, total) AS total, CASE WHEN n IS NOT NULL THEN 100 ELSE percent END AS percent, n AS passage_count, m AS embedding_model, CASE WHEN n IS NULL THEN error END AS error FROM {_ALL_JOBS} j LEFT JOIN {_INDEX} i ON i.book_id = j.book_id""")
def job_status_view(spark: SparkSession, d: str) -> DataFrame:
    """What is said of every book's index job (here only one model's passages with a chunk count as an index)."""
    p = passages(spark, d, "book_id", "pos", "chunk_index", "embedding_model").where("book_id IS NOT NULL AND pos IS NOT NULL AND chunk_index IS NOT NULL AND embedding_model LIKE 'mini%'")
    return J.status_view(_jobs(spark, d), A.index_status(p))


@query("""WITH g AS (SELECT DISTINCT result_id, book_id, model, error, ok, length(text) - 40 AS n FROM gateway_results)
    SELECT result_id, 'done' AS status, 'complete' AS stage, 'Passage index ready (' || greatest(0, coalesce(n, 0)) || ' passages)' AS message, coalesce(nullif(trim(model, ' '), ''), 'unknown') AS embedding_model, NULL::VARCHAR AS error FROM g WHERE ok
    UNION ALL SELECT result_id, 'error', 'error', coalesce(nullif(trim(error, ' '), ''), 'Indexing failed'), NULL, coalesce(nullif(trim(error, ' '), ''), 'Indexing failed') FROM g WHERE NOT ok""")
def job_ends(spark: SparkSession, d: str) -> DataFrame:
    """Jobs as they are stored when they end, well or not (a gateway call stands for a job)."""
    g = table(spark, d, "gateway_results").select("result_id", "book_id", "model", "error", "ok", (F.length("text") - 40).alias("passage_count")).dropDuplicates(["result_id"])
    well = J.completed(g.where("ok").select(F.col("result_id").alias("book_id"), "passage_count", F.col("model").alias("embedding_model"))).drop("current", "total", "percent")
    ill = J.failed(g.where("NOT ok").select(F.col("result_id").alias("book_id"), "error"))
    return well.unionByName(ill, allowMissingColumns=True).withColumnRenamed("book_id", "result_id")


# A listing of run folders: chapters under an output folder of their book, some with a status or an event log.
_FILES = f"""(SELECT CASE WHEN chapter_id % 4 = 0 THEN 'library/runs/' || book_id || '/r1' ELSE 'out' || (chapter_id % 3) || '/' || book_id END || CASE WHEN chapter_id % 7 = 0 THEN '/status.json' WHEN chapter_id % 11 = 0 THEN '/events.jsonl' WHEN chapter_id % 13 = 0 THEN '/notes.txt' ELSE '/chapters/' || chapter_index || '/a.wav' END AS path, extracted_at AS modified
    FROM (SELECT DISTINCT chapter_id, book_id, chapter_index, extracted_at FROM chapters WHERE book_id IS NOT NULL AND book_id <> '' AND chapter_index IS NOT NULL AND extracted_at IS NOT NULL))"""
_DIRS = f"""(SELECT path, name, max(modified) AS updated_at, NOT bool_or(what = 'status.json') AS legacy FROM (SELECT regexp_extract(path, '{J._RUN}', 1) AS path, regexp_extract(path, '{J._RUN}', 2) AS name, regexp_extract(path, '{J._RUN}', 3) AS what, modified FROM {_FILES}) WHERE path <> '' GROUP BY path, name HAVING bool_or(what <> 'events.jsonl'))"""


def _dirs(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "extracted_at").where("book_id IS NOT NULL AND book_id <> '' AND chapter_index IS NOT NULL AND extracted_at IS NOT NULL")
    i = F.col("chapter_id")
    root = F.when(i % 4 == 0, F.concat(F.lit("library/runs/"), "book_id", F.lit("/r1"))).otherwise(F.concat(F.lit("out"), (i % 3).cast("string"), F.lit("/"), "book_id"))
    leaf = F.when(i % 7 == 0, "/status.json").when(i % 11 == 0, "/events.jsonl").when(i % 13 == 0, "/notes.txt").otherwise(F.concat(F.lit("/chapters/"), F.col("chapter_index").cast("string"), F.lit("/a.wav")))
    return J.run_dirs(c.select(F.concat(root, leaf).alias("path"), F.col("extracted_at").alias("modified")))


@query(f"SELECT row_number() OVER (ORDER BY updated_at DESC, path) AS place, path, name, epoch_us(updated_at) AS updated_us, legacy FROM {_DIRS}")
def run_list(spark: SparkSession, d: str) -> DataFrame:
    """All runs, newest first."""
    return B.placed(_dirs(spark, d), [F.desc("updated_at"), F.col("path")]).select("place", "path", "name", F.unix_micros("updated_at").alias("updated_us"), "legacy")


@query(f"SELECT path, name FROM {_DIRS} ORDER BY updated_at DESC, path DESC LIMIT 1")
def default_run(spark: SparkSession, d: str) -> DataFrame:
    return J.default_run(_dirs(spark, d)).select("path", "name")


_FOLDERS = f"""(SELECT book_id, chapter_index AS chapter, lower(replace(coalesce(title, ''), ' ', '-')) AS slug, chapter_id % 9 AS n_txt, chapter_id % 5 AS n_wav, chapter_id % 11 AS n_cache, chapter_id % 3 AS n_empty, round(greatest(coalesce(CASE WHEN isnan(duration_s) THEN 0 ELSE duration_s END, 0), 0), 2) AS elapsed_s, extracted_at AS modified, chapter_id % 31 = 0 AS has_output
    FROM (SELECT DISTINCT chapter_id, book_id, chapter_index, title, duration_s, extracted_at FROM chapters WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND extracted_at IS NOT NULL))"""


@query(f"""SELECT book_id, count(*) AS total_chapters, sum(greatest(n_txt, n_wav, n_cache))::BIGINT AS total_chunks, sum(greatest(n_txt, n_cache))::BIGINT AS rewrite_done, sum(n_wav)::BIGINT AS tts_done, sum(n_empty)::BIGINT AS empty_rewrites, round(sum(elapsed_s), 3) AS rewrite_elapsed_s,
    CASE WHEN bool_or(has_output) THEN 'done' WHEN sum(n_wav) > 0 THEN 'tts' ELSE 'rewriting' END AS phase, epoch_us(max(modified)) AS activity_us, max_by(chapter, (modified, -chapter)) AS current_chapter, max_by(slug, (modified, -chapter)) AS current_slug, max_by(greatest(n_txt, n_cache), (modified, -chapter)) AS chunk_index, max_by(greatest(n_txt, n_wav, n_cache), (modified, -chapter)) AS chunk_total FROM {_FOLDERS} GROUP BY book_id""")
def legacy_status(spark: SparkSession, d: str) -> DataFrame:
    """The status of runs that have only folders."""
    c = chapters(spark, d, "book_id", "chapter_index", "title", "duration_s", "extracted_at").where("book_id IS NOT NULL AND chapter_index IS NOT NULL AND extracted_at IS NOT NULL")
    i, s = F.col("chapter_id"), F.when(F.isnan("duration_s"), 0.0).otherwise(F.col("duration_s"))
    f = c.select("book_id", F.col("chapter_index").alias("chapter"), F.lower(F.replace(F.coalesce("title", F.lit("")), F.lit(" "), F.lit("-"))).alias("slug"), (i % 9).alias("n_txt"), (i % 5).alias("n_wav"), (i % 11).alias("n_cache"), (i % 3).alias("n_empty"), F.round(F.greatest(F.coalesce(s, F.lit(0.0)), F.lit(0.0)), 2).alias("elapsed_s"), F.col("extracted_at").alias("modified"), (i % 31 == 0).alias("has_output"))
    return J.legacy_status(f).withColumn("activity_us", F.unix_micros("activity")).drop("activity")


_CHUNKS = "(SELECT DISTINCT id, book_id, chapter_index, chunk_index, text FROM passages WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL)"


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return passages(spark, d, "book_id", "chapter_index", "chunk_index", "text").where("book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL")


@query(f"SELECT id, book_id, 'empty_rewrite_chunk' AS type, chapter_index, chunk_index FROM {_CHUNKS} WHERE NOT regexp_matches(coalesce(text, ''), '[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]')")
def anomaly_list(spark: SparkSession, d: str) -> DataFrame:
    """Chunks whose rewritten text (here the passage's) is empty."""
    c = _chunks(spark, d)
    keys = c.select("id", "book_id", "chapter_index", "chunk_index")
    return keys.join(J.anomalies(c.select("id", F.col("text").alias("rewritten"), F.col("id").alias("book_id"), "chapter_index", "chunk_index")).select(F.col("book_id").alias("id"), "type"), "id")


@query(f"""WITH c AS (SELECT DISTINCT book_id, chapter_index, chunk_index FROM {_CHUNKS}), f AS (SELECT DISTINCT book_id, chapter_index, chunk_index FROM {_CHUNKS} WHERE length(coalesce(text, '')) > 0 AND chunk_index % 3 <> 0)
    SELECT c.book_id, c.chapter_index, c.chunk_index, f.book_id IS NOT NULL AS reused FROM c LEFT JOIN f USING (book_id, chapter_index, chunk_index)""")
def chunk_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Which chunks have audio that can be used again (a listing made from the passages)."""
    c = _chunks(spark, d)
    name = F.concat(F.lit("chunk-"), F.lpad(F.col("chunk_index").cast("string"), 5, "0"), F.when(F.col("chunk_index") % 3 == 0, ".txt").otherwise(".wav"))
    files = c.select("book_id", "chapter_index", name.alias("name"), F.coalesce(F.length("text"), F.lit(0)).alias("size"))
    return J.chunk_reuse(c.select("book_id", "chapter_index", "chunk_index").distinct(), files)


@query(f"""WITH c AS (SELECT DISTINCT book_id, chapter_index, chunk_index, min(id) AS id FROM {_CHUNKS} GROUP BY ALL), r AS (SELECT book_id, chapter_index, chunk_index FROM c WHERE (length(id) + chunk_index + chapter_index) % 17 <> 0), g AS (SELECT book_id, min((chapter_index, chunk_index)) AS gap FROM c WHERE (length(id) + chunk_index + chapter_index) % 17 = 0 GROUP BY book_id)
    SELECT c.book_id, c.chapter_index, c.chunk_index, (row_number() OVER (PARTITION BY c.book_id ORDER BY c.chapter_index, c.chunk_index))::INTEGER AS position FROM c LEFT JOIN g USING (book_id) WHERE gap IS NULL OR (c.chapter_index, c.chunk_index) < gap""")
def live_order(spark: SparkSession, d: str) -> DataFrame:
    """Chunks in the order a live playlist takes them, up to the first missing one."""
    c = _chunks(spark, d).groupBy("book_id", "chapter_index", "chunk_index").agg(F.min("id").alias("id"))
    return J.live_order(c.select("book_id", "chapter_index", "chunk_index", ((F.length("id") + F.col("chunk_index") + F.col("chapter_index")) % 17 != 0).alias("ready"))).drop("ready")


@query(f"""WITH c AS (SELECT id, text, CASE WHEN chunk_index % 2 = 0 THEN ' ' ELSE 'said ' || chunk_index END AS answer FROM {_CHUNKS})
    SELECT id, CASE WHEN trim(answer, ' ') <> '' THEN answer WHEN coalesce(text, '') <> '' THEN text WHEN id <> '' THEN id ELSE 'kept' END AS text, trim(answer, ' ') = '' AS fallback, true AS use_llm, 'full_rewrite_policy' AS reason FROM c""")
def rewrite_fallbacks(spark: SparkSession, d: str) -> DataFrame:
    """What a chunk becomes when the model answers, or answers nothing."""
    i = F.col("chunk_index")
    answer = F.when(i % 2 == 0, " ").otherwise(F.concat(F.lit("said "), i.cast("string")))
    use, why = J.rewrite_plan("full", F.lit(None), F.lit(None))
    r = J.rewritten(answer, F.coalesce("text", F.lit("")), F.col("id"), F.lit("kept"))
    return _chunks(spark, d).select("id", r.alias("r"), use.alias("use_llm"), why.alias("reason")).select("id", "r.text", "r.fallback", "use_llm", "reason")


@query(f"""WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events), t AS (SELECT user_id, count(*) AS n, max_by(event_type, event_id) AS last FROM e WHERE r <= 40 GROUP BY user_id),
    u AS (SELECT c_custkey AS k, c_name, c_mktsegment, c_custkey % 5 = 0 AS none FROM customer)
    SELECT k AS id, CASE WHEN NOT none THEN c_mktsegment END AS phase, CASE WHEN NOT none THEN coalesce(n, 0) END AS n_events, CASE WHEN NOT none THEN last END AS last_event, CASE WHEN NOT none THEN '/media?path=runs/' || replace(replace(c_name, '#', '%23'), ' ', '%20') || '/book%20a.m4b' END AS final_audio, NOT none AS has_run FROM u LEFT JOIN t ON t.user_id = k""")
def catalog_with_runs(spark: SparkSession, d: str) -> DataFrame:
    """Catalog entries with their run, its last events and its output (customers stand for books, users for runs)."""
    c = table(spark, d, "customer")
    path = F.col("c_custkey").cast("string")
    b = c.select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") % 5 != 0, path).otherwise("").alias("run_relpath"))
    s = c.select(path.alias("path"), F.col("c_mktsegment").alias("phase"), F.concat(F.lit("runs/"), "c_name", F.lit("/book a.m4b")).alias("output"))
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("pos"), F.col("event_type").alias("event"))
    return J.catalog_with_runs(b, s, e).select("id", "phase", "n_events", "last_event", "final_audio", "has_run")


@query(f"""WITH c AS (SELECT * FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL), r AS (SELECT book_id, chapter_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chapter_id) AS nth, count(*) OVER (PARTITION BY book_id) AS n FROM c) SELECT book_id, chapter_id, nth::INTEGER AS nth, greatest(n - 12, 0) AS more FROM r WHERE nth <= 12""")
def first_chapters_and_more(spark: SparkSession, d: str) -> DataFrame:
    """The first 12 chapters of each book and how many follow (a top-k report)."""
    c = chapters(spark, d, "book_id", "chapter_index").where("book_id IS NOT NULL AND chapter_index IS NOT NULL")
    return J.first_and_more(c, "book_id", [F.col("chapter_index"), F.col("chapter_id")]).select("book_id", "chapter_id", "nth", "more")


@query(f"""SELECT chapter_id, CASE WHEN chapter_id % 4 = 3 THEN NULL WHEN chapter_id % 1000 = 0 THEN NULL ELSE (chapter_id % 1000)::INTEGER END AS rate FROM {CHAPTERS}""")
def voice_rates(spark: SparkSession, d: str) -> DataFrame:
    """Sample rates from voice configurations of several shapes."""
    n = (F.col("chapter_id") % 1000).cast("string")
    k = F.col("chapter_id") % 4
    j = F.when(k == 0, F.concat(F.lit('{"sample_rate": '), n, F.lit("}"))).when(k == 1, F.concat(F.lit('{"sample_rate": 0, "sampleRate": "'), n, F.lit('"}'))).when(k == 2, F.concat(F.lit('{"audio": {"sample_rate": '), n, F.lit("}}"))).otherwise("[broken")
    return chapters(spark, d, "book_id").select("chapter_id", J.sample_rate(j).alias("rate"))


@query(f"SELECT chapter_id, CASE WHEN chapter_id % 5 <> 0 THEN (chapter_id % 100000) / 48000.0::DOUBLE END AS seconds FROM {CHAPTERS}")
def wav_lengths(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of sound files from their headers (24,000 samples a second of two bytes)."""
    le = lambda c, n: F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(c, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(n)])
    lit = lambda x: F.unhex(F.lit(x))
    size = F.col("chapter_id") % 100000
    head = F.concat(F.when(F.col("chapter_id") % 5 == 0, lit("52494658")).otherwise(lit("52494646")), le(size + 36, 4), lit("57415645666D742010000000010001" + "00C05D0000"), lit("80BB0000"), lit("02001000"), lit("64617461"), le(size, 4))
    return chapters(spark, d, "book_id").select("chapter_id", J.wav_seconds(head).alias("seconds"))


@query(f"SELECT chapter_id, count(*) AS total_chunks, count(*) FILTER (WHERE use_llm) AS llm_chunks FROM ({texts.ORACLES['rewrite_decisions']}) GROUP BY chapter_id")
def chunk_totals(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of each chapter, and how many of them a selective rewrite would take."""
    r = texts.rewrite_decisions(spark, d)
    return r.groupBy("chapter_id").agg(F.count("*").alias("total_chunks"), F.count_if("use_llm").alias("llm_chunks"))


@query(f"""WITH w AS ({texts.WINDOWS_SQL}), c AS (SELECT w.chapter_id, chunk_index, piece, book_id, chapter_index, title, source FROM w JOIN {CHAPTERS} USING (chapter_id) WHERE book_id IS NOT NULL)
    SELECT 'passage_' || book_id || '_' || (row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chunk_index) - 1) AS id, title AS chapter, source AS href, chapter_index, chunk_index, md5(piece) AS text_md5 FROM c""")
def chapter_passages(spark: SparkSession, d: str) -> DataFrame:
    """Every chapter's passages, numbered through the book, with what is needed to cite them."""
    c = chapters(spark, d, "book_id", "chapter_index", "title", "source", "text")
    return K.passages(c).select("id", "chapter", "href", "chapter_index", "chunk_index", F.md5("text").alias("text_md5"))
