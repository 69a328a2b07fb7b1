"""Catalog, memory and update queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions.rules import STRIP
from narrata.operators import library as B
from narrata.operators import memory as M
from narrata.plans.common import BOOKS, MEMORIES, books, memories
from narrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"SELECT id, title FROM {BOOKS} WHERE favorite")
def library_favorites(spark: SparkSession, d: str) -> DataFrame:
    return B.filtered(books(spark, d, "title", "favorite"), "favorites").select("id", "title")


@query(f"SELECT id, conversion_status FROM {BOOKS} WHERE conversion_status IN ('starting', 'running', 'stalled')")
def library_active(spark: SparkSession, d: str) -> DataFrame:
    return B.filtered(books(spark, d, "conversion_status"), "active").select("id", "conversion_status")


@query(f"SELECT id, title, author FROM {BOOKS} WHERE contains(lower(coalesce(title, '')), 'the') OR contains(lower(coalesce(author, '')), 'the') OR contains(lower(coalesce(title, '')), 'die')")
def library_search(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "title", "author")
    return B.searched(b, " THE ").union(B.searched(b, "die").where(~F.contains(F.lower(F.coalesce("author", F.lit(""))), F.lit("die")) | F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("die")))).distinct().select("id", "title", "author")


_ORDERS = {"recent": "coalesce(added_at, '') DESC, id", "title": "lower(coalesce(title, '')), id", "author": "lower(coalesce(author, '')), id", "progress": "listen_abs_time_s IS NULL, listen_abs_time_s DESC, id"}


def _listing(by: str) -> None:
    """The first page of the library, with places (a top-k report)."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        b = books(spark, d, "title", "author", "added_at", "listen_abs_time_s").orderBy(*B.order_of(by)).limit(12)
        w = F.row_number().over(Window.orderBy(*B.order_of(by)))
        return b.select(w.alias("place"), "id", "title")

    q.__name__ = f"library_by_{by}"
    QUERIES[q.__name__] = q
    ORACLES[q.__name__] = f"SELECT (row_number() OVER (ORDER BY {_ORDERS[by]}))::INTEGER AS place, id, title FROM {BOOKS} ORDER BY {_ORDERS[by]} LIMIT 12"


def _whole_listing(by: str) -> None:
    """Every book of the library, with its place."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        b = books(spark, d, "title", "author", "added_at", "listen_abs_time_s")
        return B.placed(b, B.order_of(by)).select("place", "id", "title")

    q.__name__ = f"library_all_by_{by}"
    QUERIES[q.__name__] = q
    ORACLES[q.__name__] = f"SELECT row_number() OVER (ORDER BY {_ORDERS[by]}) AS place, id, title FROM {BOOKS}"


for _by in _ORDERS:
    _listing(_by)
    _whole_listing(_by)


@query(f"SELECT id, opened_at FROM {BOOKS} WHERE listen_abs_time_s IS NOT NULL AND opened_at IS NOT NULL ORDER BY opened_at DESC, id DESC LIMIT 1")
def continue_book(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "opened_at", "listen_abs_time_s").where("listen_abs_time_s IS NOT NULL AND opened_at IS NOT NULL")
    return b.agg(F.max_by(F.struct("id", "opened_at"), F.struct("opened_at", "id")).alias("x")).where("x IS NOT NULL").select("x.id", "x.opened_at")


@query(f"SELECT * FROM (SELECT book_id, memory_id, created_at, (row_number() OVER (PARTITION BY book_id ORDER BY coalesce(created_at, '') DESC, memory_id))::INTEGER AS place FROM {MEMORIES}) WHERE place <= 12")
def newest_insights(spark: SparkSession, d: str) -> DataFrame:
    """The twelve newest memories of every book (a top-k report)."""
    w = Window.partitionBy("book_id").orderBy(F.coalesce("created_at", F.lit("")).desc(), "memory_id")
    return memories(spark, d, "book_id", "created_at").withColumn("place", F.row_number().over(w)).where("place <= 12").select("book_id", "memory_id", "created_at", "place")


@query(f"""WITH p AS (SELECT id, CASE WHEN id < '5' THEN 'New ' || id ELSE NULL END AS title, favorite IS NULL OR NOT favorite AS has, CASE WHEN id < '8' THEN '12.5' ELSE 'not a number' END AS t FROM {BOOKS})
    SELECT b.id, CASE WHEN has THEN p.title ELSE b.title END AS title, CASE WHEN has AND t = '12.5' THEN 12.5 ELSE b.listen_abs_time_s END AS listen_abs_time_s FROM {BOOKS} b JOIN p USING (id)""")
def catalog_patches(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "title", "listen_abs_time_s", "favorite")
    has = ~F.coalesce("favorite", F.lit(False))
    p = b.select("id", F.when(F.col("id") < "5", F.concat(F.lit("New "), "id")).alias("title"), has.alias("set_title"), F.when(F.col("id") < "8", "12.5").otherwise("not a number").alias("listen_abs_time_s"), has.alias("set_listen_abs_time_s"))
    return B.patched(b, p, ["title", "listen_abs_time_s"]).select("id", "title", "listen_abs_time_s")


@query(f"SELECT id, title FROM {BOOKS} WHERE id >= '8' UNION ALL SELECT id, upper('x' || substring(id, 1, 4)) FROM {BOOKS} WHERE id < '8'")
def catalog_upserts(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "title")
    return B.upserted(b, b.where("id < '8'").select("id", F.upper(F.concat(F.lit("x"), F.substring("id", 1, 4))).alias("title")), "id")


@query(f"SELECT id FROM {BOOKS} WHERE conversion_status IS NULL OR conversion_status <> 'error'")
def catalog_deletes(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "conversion_status")
    return B.deleted(b, b.where("conversion_status = 'error'"), "id").select("id")


@query(f"""SELECT id, coalesce(nullif(substring(trim(title, ' '), 1, 80), ''), 'af_heart') AS kokoro_voice, CASE WHEN conversion_status IN ('selective', 'full', 'script-only') THEN conversion_status ELSE 'script-only' END AS rewrite_policy, coalesce(language, 'delete_intermediates_after_complete') AS output_retention, 2 AS kokoro_workers, true AS hls_live, 1 AS version FROM {BOOKS}""")
def merged_settings(spark: SparkSession, d: str) -> DataFrame:
    """Settings documents, here made from the books' columns."""
    s = books(spark, d, "title", "conversion_status", "language").select("id", F.col("title").alias("kokoro_voice"), F.col("conversion_status").alias("rewrite_policy"), F.col("language").alias("output_retention"))
    return B.settings(s, "id")


_OPT = lambda c: f"nullif({STRIP.sql(c)}, '')"


@query(f"""SELECT memory_id, {STRIP.sql('text')} AS text, source, {_OPT('title')} AS title, {_OPT('question')} AS question, {_OPT('action')} AS action FROM {MEMORIES} WHERE source IN ('user', 'assistant', 'insight') AND {STRIP.sql("coalesce(text, '')")} <> ''""")
def saved_memories(spark: SparkSession, d: str) -> DataFrame:
    return M.saved(memories(spark, d, "text", "source", "title", "question", "action", "citations")).select("memory_id", "text", "source", "title", "question", "action")


@query(f"""WITH c AS (SELECT DISTINCT memory_id, unnest(citations) AS c FROM memories), t AS (SELECT memory_id, {_OPT('c.passage_id')} AS passage_id, substring({_OPT('c.snippet')}, 1, 1000) AS snippet, {_OPT('c.chapter')} AS chapter, {_OPT('c.source')} AS source, {_OPT('c.href')} AS href, c.chapter_index AS chapter_index, c.chunk_index AS chunk_index FROM c)
    SELECT memory_id, passage_id, snippet, chapter_index FROM t WHERE coalesce(passage_id, snippet, chapter, source, href, chapter_index::VARCHAR, chunk_index::VARCHAR) IS NOT NULL""")
def clean_citations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "memories").select("memory_id", F.explode(M.clean_citations(F.col("citations"))).alias("c")).distinct()
    return c.select("memory_id", "c.passage_id", "c.snippet", "c.chapter_index")


def insight_export(spark: SparkSession, d: str) -> DataFrame:
    """Every book's insights as one markdown text."""
    return M.exported(memories(spark, d, "book_id", "text", "created_at", "title", "question", "action"))


QUERIES["insight_export"] = insight_export


@query(f"""SELECT id, len(map_keys(metadata)) + 1 - CASE WHEN list_contains(map_keys(metadata), 'publisher') THEN 1 ELSE 0 END AS n_keys, 'P-' || id AS publisher FROM (SELECT id, any_value(metadata) AS metadata FROM books WHERE metadata IS NOT NULL GROUP BY id)""")
def merged_metadata(spark: SparkSession, d: str) -> DataFrame:
    b = table(spark, d, "books").where("metadata IS NOT NULL").groupBy("id").agg(F.first("metadata").alias("metadata"))
    m = B.merged_metadata(F.col("metadata"), F.create_map(F.lit("publisher"), F.concat(F.lit("P-"), F.col("id")), F.lit("dropped"), F.lit(None).cast("string")))
    return b.select("id", m.alias("m")).select("id", F.size("m").cast("long").alias("n_keys"), F.element_at("m", "publisher").alias("publisher"))
