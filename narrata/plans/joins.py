"""Join queries over books, chapters, passages and memories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions.rules import SQUEEZE, STRIP
from narrata.operators import joins as J
from narrata.plans.common import BOOKS, CHAPTERS, books, chapters, memories, passages
from narrata.plans.texts import _SLUG
from narrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH c AS (SELECT * FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL), s AS (SELECT *, chapter_index % 3 <> 0 AS listed FROM c)
    SELECT book_id, chapter_id, (row_number() OVER (PARTITION BY book_id ORDER BY CASE WHEN listed THEN 0 ELSE 1 END, CASE WHEN listed THEN 1000 - chapter_index ELSE chapter_index END, chapter_id))::INTEGER AS position FROM s""")
def spine_order(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index").where("book_id IS NOT NULL AND chapter_index IS NOT NULL")
    spine = c.where("chapter_index % 3 <> 0").select("book_id", "chapter_id", (1000 - F.col("chapter_index")).alias("spine_pos"))
    return J.spine_order(c, spine, "chapter_id", "chapter_index", "spine_pos").select("book_id", "chapter_id", "position")


def _toc(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "source", "title").where("source IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL")
    return c.select("book_id", F.col("chapter_index").alias("pos"), F.concat("source", F.lit("#s"), F.col("chapter_index").cast("string")).alias("href"), F.col("title").alias("label"), F.when(F.col("chapter_index") % 5 == 0, F.concat(F.lit(" Part  "), F.col("chapter_index").cast("string"))).alias("section_title"))


_TOC = f"(SELECT book_id, chapter_index AS pos, source || '#s' || chapter_index AS href, title AS label, CASE WHEN chapter_index % 5 = 0 THEN ' Part  ' || chapter_index END AS section_title FROM {CHAPTERS} WHERE source IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL)"
_ENTRIES = f"(SELECT book_id, href, min_by(title, pos) AS title FROM (SELECT book_id, pos, string_split(href, '#')[1] AS href, {SQUEEZE.sql('coalesce(section_title, label)')} AS title FROM {_TOC}) WHERE href <> '' AND title <> '' GROUP BY ALL)"


@query(f"""WITH e AS {_ENTRIES}, b AS (SELECT book_id, string_split(href, '/')[-1] AS name, min_by(title, href) AS title FROM e GROUP BY ALL)
    SELECT c.chapter_id, coalesce(e.title, b.title) AS toc_title FROM {CHAPTERS} c LEFT JOIN e ON e.book_id = c.book_id AND e.href = c.source LEFT JOIN b ON b.book_id = c.book_id AND b.name = string_split(c.source, '/')[-1]""")
def toc_titles(spark: SparkSession, d: str) -> DataFrame:
    return J.toc_titles(chapters(spark, d, "book_id", "source"), _toc(spark, d)).select("chapter_id", "toc_title")


@query(f"""WITH c AS (SELECT *, lpad(chapter_index::VARCHAR, 3, '0') || '-' || trim(coalesce(nullif(substring({_SLUG}, 1, 80), ''), 'chapter'), '-') AS slug FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL),
    k AS (SELECT book_id, source AS key, min('Known ' || chapter_index) AS title FROM c WHERE chapter_index % 2 = 0 AND source IS NOT NULL GROUP BY ALL),
    t AS (SELECT book_id, chapter_id, unnest([coalesce(source, ''), string_split(coalesce(source, ''), '/')[-1], regexp_replace(string_split(coalesce(source, ''), '/')[-1], '\\.[^.]*$', ''), trim(coalesce(title, ''), ' '), slug, regexp_replace(slug, '^\\d{{3}}-', ''), replace(regexp_replace(slug, '^\\d{{3}}-', ''), '-', '_'), replace(regexp_replace(slug, '^\\d{{3}}-', ''), '-', '_') || '.html']) AS key, unnest(range(0, 8)) AS p FROM c),
    h AS (SELECT t.book_id, t.chapter_id, min_by(k.title, p) AS hit FROM t JOIN k ON k.book_id = t.book_id AND k.key = t.key WHERE t.key <> '' GROUP BY ALL)
    SELECT c.chapter_id, coalesce(hit, CASE WHEN trim(coalesce(title, ''), ' ') <> '' AND NOT regexp_matches(title, '(?i)_epub_c[0-9]+(\\.[0-9]+)?_r[0-9]+$') THEN trim(title, ' ') END, 'Chapter ' || chapter_index) AS display_title FROM c LEFT JOIN h USING (book_id, chapter_id)""")
def display_titles(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "title", "source").where("book_id IS NOT NULL AND chapter_index IS NOT NULL").withColumn("slug", T.chapter_slug(F.col("chapter_index"), F.coalesce("title", F.lit(" "))))
    known = c.where("chapter_index % 2 = 0 AND source IS NOT NULL").groupBy("book_id", F.col("source").alias("key")).agg(F.min(F.concat(F.lit("Known "), F.col("chapter_index").cast("string"))).alias("title"))
    return J.display_titles(c, known).select("chapter_id", "display_title")


@query(f"SELECT chapter_id, chapter_index FROM {CHAPTERS} WHERE chapter_index IN (1, 3) OR chapter_index BETWEEN 5 AND 7")
def chapter_selection(spark: SparkSession, d: str) -> DataFrame:
    return J.selected_chapters(chapters(spark, d, "chapter_index"), "7-5, 1,3").select("chapter_id", "chapter_index")


@query(f"""SELECT c.chapter_id, c.title, m.duration_s, m.m4a FROM {CHAPTERS} c LEFT JOIN (SELECT book_id, chapter_index, max_by(duration_s, chapter_id) AS duration_s, max_by('c' || chapter_id || '.m4a', chapter_id) AS m4a FROM (SELECT * FROM {CHAPTERS} WHERE duration_s IS NOT NULL) GROUP BY ALL) m USING (book_id, chapter_index)""")
def status_with_manifest(spark: SparkSession, d: str) -> DataFrame:
    c = chapters(spark, d, "book_id", "chapter_index", "title", "duration_s")
    m = c.where("duration_s IS NOT NULL").select("book_id", "chapter_index", F.col("chapter_id").alias("pos"), "duration_s", F.concat(F.lit("c"), F.col("chapter_id").cast("string"), F.lit(".m4a")).alias("m4a"))
    return J.with_manifest(c.drop("duration_s"), m).select("chapter_id", "title", "duration_s", "m4a")


@query(f"""WITH e AS (SELECT book_id, chapter_index, 's' || chapter_index AS slug, chapter_index % 4 AS total FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL),
    ok AS (SELECT book_id, chapter_index FROM (SELECT book_id, chapter_index, total, unnest(range(1, total + 1)) AS n FROM e) GROUP BY book_id, chapter_index, total HAVING count(*) FILTER (WHERE (chapter_index * n) % 5 > 0) = total)
    SELECT book_id, chapter_index FROM ok WHERE chapter_index % 3 > 0 OR chapter_index % 2 = 0""")
def resumable_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Chapters whose files are all there (a listing made from the chapters: some chunk files empty, some chapters without audio)."""
    e = chapters(spark, d, "book_id", "chapter_index").where("book_id IS NOT NULL AND chapter_index IS NOT NULL").select("book_id", "chapter_index", F.concat(F.lit("s"), F.col("chapter_index").cast("string")).alias("slug"), (F.col("chapter_index") % 4).alias("total_chunks"))
    chunk = e.where("total_chunks > 0").select("book_id", "slug", "chapter_index", F.explode(F.sequence(F.lit(1), F.col("total_chunks"))).alias("n")).select("book_id", F.concat(F.lit("chapters/"), "slug", F.format_string("/chunk-%03d.wav", "n")).alias("path"), (F.col("chapter_index") * F.col("n") % 5).cast("long").alias("size"))
    audio = e.select("book_id", F.concat("slug", F.lit(".m4a")).alias("path"), (F.col("chapter_index") % 3).cast("long").alias("size"))
    lists = e.where("chapter_index % 2 = 0").select("book_id", F.format_string("chapter-%03d.m3u8", "chapter_index").alias("path"), F.lit(9).cast("long").alias("size"))
    return J.resumable(e, chunk.unionByName(audio).unionByName(lists))


@query("""WITH p AS (SELECT book_id, chapter_index, chunk_index, min(text) AS text FROM passages WHERE text IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL GROUP BY ALL)
    SELECT book_id, chapter_index, chunk_index, chunk_index % 2 = 0 AND chapter_index % 3 > 0 AND trim(text) <> '' AS hit, CASE WHEN chunk_index % 2 = 0 AND chapter_index % 3 > 0 AND trim(text) <> '' THEN 'again: ' || text END AS rewritten_text FROM p""")
def rewrite_cache_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks against a cache in which every second text has changed and every third chapter was made under other settings."""
    p = table(spark, d, "passages").where("text IS NOT NULL AND book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL").groupBy("book_id", "chapter_index", "chunk_index").agg(F.min("text").alias("text")).withColumn("settings", F.lit("full:1200"))
    stale = F.when(F.col("chunk_index") % 2 == 0, F.col("text")).otherwise(F.concat("text", F.lit("!")))
    cache = p.select("book_id", "chapter_index", "chunk_index", F.sha2(stale, 256).alias("raw_sha256"), F.when(F.col("chapter_index") % 3 > 0, "full:1200").otherwise("off:650").alias("settings"), F.when(F.trim("text") != "", F.concat(F.lit("again: "), "text")).otherwise("").alias("rewritten_text"))
    return J.cache_lookup(p, cache).select("book_id", "chapter_index", "chunk_index", "hit", "rewritten_text")




def _label(x: str) -> str:
    return T.CHAPTER_LABEL.sql(f"lower(coalesce({x}, ''))")



@query(f"""WITH m AS (SELECT DISTINCT memory_id, book_id, unnest(citations) AS c FROM memories WHERE book_id IS NOT NULL), w AS (SELECT DISTINCT memory_id, book_id, c.chapter AS chapter, {_label('c.chapter')} AS l FROM m),
    t AS (SELECT book_id, pos, href, {_label('label')} AS t FROM {_TOC}),
    h AS (SELECT w.book_id, l, min_by(href, pos) AS toc_href FROM (SELECT DISTINCT book_id, l FROM w WHERE l <> '') w JOIN t ON t.book_id = w.book_id AND t.t <> '' AND (contains(t.t, l) OR contains(l, t.t)) GROUP BY ALL)
    SELECT memory_id, chapter, toc_href FROM w LEFT JOIN h USING (book_id, l)""")
def citation_targets(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "memories").where("book_id IS NOT NULL").select("memory_id", "book_id", F.explode("citations").alias("c")).select("memory_id", "book_id", F.col("c.chapter").alias("chapter")).distinct()
    return J.citation_targets(c, _toc(spark, d)).select("memory_id", "chapter", "toc_href")


@query(f"""WITH r AS (SELECT DISTINCT run_relpath AS run_dir FROM {BOOKS} WHERE run_relpath IS NOT NULL), p AS (SELECT 'python tool.py --out ' || run_relpath AS cmdline, CASE WHEN favorite THEN 'T' ELSE 'S' END AS state FROM {BOOKS} WHERE run_relpath IS NOT NULL AND conversion_status IN ('running', 'paused', 'stalled'))
    SELECT run_dir, coalesce(bool_or(cmdline IS NOT NULL AND state <> 'T'), false) AS live, coalesce(bool_or(state = 'T'), false) AS paused FROM r LEFT JOIN p ON contains(cmdline, run_dir) GROUP BY run_dir""")
def process_matches(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "run_relpath", "conversion_status", "favorite").where("run_relpath IS NOT NULL")
    p = b.where(F.col("conversion_status").isin("running", "paused", "stalled")).select(F.concat(F.lit("python tool.py --out "), "run_relpath").alias("cmdline"), F.when(F.col("favorite"), "T").otherwise("S").alias("state"))
    return J.process_matches(p, b.select(F.col("run_relpath").alias("run_dir"), F.col("run_relpath").alias("outdir")).distinct(), "tool.py")


@query("""WITH f AS (SELECT DISTINCT book_id, CASE WHEN chunk_index % 2 = 0 THEN 'chunks/' || chunk_index || '.txt' ELSE 'book-' || chunk_index || CASE WHEN chunk_index % 3 = 0 THEN '.m4b' ELSE '.wav' END END AS path FROM passages WHERE book_id IS NOT NULL AND chunk_index IS NOT NULL)
    SELECT book_id, path FROM f WHERE (regexp_matches(path, '^(chapters|chunks)/') OR regexp_matches(path, '\\.(wav|aac|txt|m3u8|json)$')) AND path NOT IN ('chunks/0.txt', 'book-1.wav')""")
def retention_plan(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "passages").where("book_id IS NOT NULL AND chunk_index IS NOT NULL")
    n = F.col("chunk_index").cast("string")
    f = p.select("book_id", F.when(F.col("chunk_index") % 2 == 0, F.concat(F.lit("chunks/"), n, F.lit(".txt"))).otherwise(F.concat(F.lit("book-"), n, F.when(F.col("chunk_index") % 3 == 0, ".m4b").otherwise(".wav"))).alias("path")).distinct()
    return J.retention_plan(f, f.where(F.col("path").isin("chunks/0.txt", "book-1.wav")))
