"""Timeline and playlist queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.operators import timeline as L
from narrata.plans.common import BOOKS, CHAPTERS, books, chapters

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_OK = "duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s >= 0"
_MARKS = f"""(SELECT chapter_id, book_id, chapter_index, CASE WHEN {_OK} THEN round(s, 6) END AS start_s, CASE WHEN {_OK} THEN round(s + duration_s, 6) END AS end_s FROM
    (SELECT *, coalesce(sum(CASE WHEN {_OK} THEN duration_s END) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL))"""


def _listed(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d, "book_id", "chapter_index", "duration_s").where("book_id IS NOT NULL AND chapter_index IS NOT NULL")


@query(f"SELECT chapter_id, round(start_s, 4) AS start_s, round(end_s, 4) AS end_s FROM {_MARKS}")
def chapter_timeline(spark: SparkSession, d: str) -> DataFrame:
    return L.timeline(_listed(spark, d)).select("chapter_id", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


@query(f"""WITH RECURSIVE c AS (SELECT chapter_id, book_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) AS n, CASE WHEN NOT isnan(duration_s) THEN duration_s END AS d,
      CASE WHEN chapter_index % 4 = 0 THEN chapter_index * 100.0 END AS s, CASE WHEN chapter_index % 8 = 0 THEN chapter_index * 100.0 + 50.0 END AS e FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL),
    w(book_id, n, chapter_id, t, a, b) AS (SELECT book_id, 0::BIGINT, NULL::BIGINT, 0.0::DOUBLE, NULL::DOUBLE, NULL::DOUBLE FROM (SELECT DISTINCT book_id FROM c)
      UNION ALL SELECT c.book_id, c.n, c.chapter_id,
        CASE WHEN s IS NOT NULL AND e IS NOT NULL AND e >= s THEN greatest(t, e) WHEN d > 0 AND s IS NOT NULL THEN greatest(t, s + d) WHEN d > 0 THEN t + d ELSE t END,
        CASE WHEN s IS NOT NULL AND e IS NOT NULL AND e >= s THEN s WHEN d > 0 THEN coalesce(s, t) ELSE s END,
        CASE WHEN s IS NOT NULL AND e IS NOT NULL AND e >= s THEN e WHEN d > 0 THEN coalesce(s, t) + d ELSE e END
      FROM w JOIN c ON c.book_id = w.book_id AND c.n = w.n + 1)
    SELECT chapter_id, round(a, 4) AS start_s, round(b, 4) AS end_s FROM w WHERE chapter_id IS NOT NULL""")
def client_timeline(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("chapter_index")
    c = _listed(spark, d).withColumns({"given_start_s": F.when(i % 4 == 0, i * 100.0), "given_end_s": F.when(i % 8 == 0, i * 100.0 + 50.0)})
    return L.client_timeline(c).select("chapter_id", F.round("start_s", 4).alias("start_s"), F.round("end_s", 4).alias("end_s"))


_MS = "greatest(1, floor(duration_s * 1000))::BIGINT"


@query(f"""SELECT chapter_id, (e - ms)::BIGINT AS start_ms, e::BIGINT AS end_ms FROM (SELECT chapter_id, {_MS} AS ms, sum({_MS}) OVER (PARTITION BY book_id ORDER BY chapter_index) AS e FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND {_OK})""")
def ffmetadata_marks(spark: SparkSession, d: str) -> DataFrame:
    return L.ffmetadata_marks(_listed(spark, d).where(F.expr("duration_s IS NOT NULL AND NOT isnan(duration_s) AND duration_s >= 0"))).select("chapter_id", "start_ms", "end_ms")


@query(f"""WITH m AS {_MARKS}, p AS (SELECT id AS point_id, id AS book_id, listen_abs_time_s / 10 AS t FROM {BOOKS} WHERE listen_abs_time_s IS NOT NULL),
    h AS (SELECT point_id, min_by(chapter_index, chapter_index) AS i, min_by(t - start_s, chapter_index) AS ct FROM p JOIN m USING (book_id) WHERE t >= start_s AND t < end_s GROUP BY point_id),
    l AS (SELECT book_id, max(chapter_index) AS i FROM m GROUP BY book_id), ll AS (SELECT m.* FROM m JOIN l ON l.book_id = m.book_id AND l.i = m.chapter_index)
    SELECT point_id, coalesce(h.i, CASE WHEN ll.start_s IS NOT NULL AND t >= ll.end_s THEN ll.chapter_index END) AS chapter_index, round(coalesce(h.ct, CASE WHEN ll.start_s IS NOT NULL AND t >= ll.end_s THEN greatest(0, ll.end_s - ll.start_s) END), 4) AS chapter_time_s FROM p LEFT JOIN h USING (point_id) LEFT JOIN ll USING (book_id)""")
def listening_chapters(spark: SparkSession, d: str) -> DataFrame:
    """The chapter that each book's saved listening time falls into (a tenth of it, so that all branches occur)."""
    p = books(spark, d, "listen_abs_time_s").select(F.col("id").alias("point_id"), F.col("id").alias("book_id"), (F.col("listen_abs_time_s") / 10).alias("abs_time_s"))
    return L.chapter_at(p, L.timeline(_listed(spark, d))).select("point_id", "chapter_index", F.round("chapter_time_s", 4).alias("chapter_time_s"))


@query(f"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index) - 1 AS n FROM {_MARKS})
    SELECT b.id, round(CASE WHEN a.chapter_id IS NOT NULL THEN a.start_s ELSE c.start_s END + 12.5, 4) AS abs_time_s FROM {BOOKS} b LEFT JOIN m a ON a.book_id = b.id AND a.chapter_index = 3 LEFT JOIN m c ON c.book_id = b.id AND c.n = 3""")
def absolute_times(spark: SparkSession, d: str) -> DataFrame:
    p = books(spark, d, "title").select("id", F.col("id").alias("book_id"), F.lit(3).alias("chapter_index"), F.lit(12.5).alias("chapter_time_s"))
    return L.absolute_times(p, L.timeline(_listed(spark, d))).select("id", F.round("abs_time_s", 4).alias("abs_time_s"))


@query(f"""WITH c AS (SELECT chapter_id, book_id, chapter_index, CASE WHEN duration_s > 0 AND chapter_index % 3 > 0 THEN chapter_index END AS p FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL)
    SELECT chapter_id, min(p) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_playable, max(p) OVER (PARTITION BY book_id ORDER BY chapter_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_playable FROM c""")
def playable_neighbours(spark: SparkSession, d: str) -> DataFrame:
    return L.neighbours(_listed(spark, d), (F.col("duration_s") > 0) & (F.col("chapter_index") % 3 > 0)).select("chapter_id", "next_playable", "prev_playable")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Chunks as a run would list them: up to five a chapter, some missing."""
    c = _listed(spark, d).withColumn("chunk_total", F.col("chapter_index") % 5 + 1)
    c = c.select("book_id", "chapter_index", "chapter_id", "chunk_total", F.explode(F.sequence(F.lit(1), F.col("chunk_total"))).alias("chunk_index"))
    return c.withColumn("duration_s", F.when((F.col("chapter_id") + F.col("chunk_index")) % 7 > 0, F.col("chunk_index") * 1.25 + 0.5))


_CHUNKS = f"(SELECT book_id, chapter_index, t AS chunk_total, n AS chunk_index, CASE WHEN (chapter_id + n) % 7 > 0 THEN n * 1.25 + 0.5 END AS duration_s FROM (SELECT *, chapter_index % 5 + 1 AS t, unnest(range(1, chapter_index % 5 + 2)) AS n FROM {CHAPTERS} WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL))"
_ENTRIES = f"""(WITH k AS {_CHUNKS} SELECT book_id, chapter_index, 0 AS pos, 'chapter-' || lpad(chapter_index::VARCHAR, 3, '0') || '-gap-000.aac' AS name, 1.75::DOUBLE AS duration_s FROM (SELECT DISTINCT book_id, chapter_index FROM k)
    UNION ALL SELECT book_id, chapter_index, chunk_index * 2 - 1, 'chunk-' || lpad(chunk_index::VARCHAR, 3, '0') || '.aac', duration_s FROM k WHERE duration_s IS NOT NULL
    UNION ALL SELECT book_id, chapter_index, chunk_index * 2, 'chapter-' || lpad(chapter_index::VARCHAR, 3, '0') || '-gap-' || lpad(chunk_index::VARCHAR, 3, '0') || '.aac', 0.45 FROM k WHERE duration_s IS NOT NULL AND chunk_index < chunk_total)"""


@query(f"SELECT book_id, chapter_index, pos::INTEGER AS pos, name, duration_s FROM {_ENTRIES}")
def playlist_entries(spark: SparkSession, d: str) -> DataFrame:
    return L.with_gaps(_chunks(spark, d)).select("book_id", "chapter_index", "pos", "name", "duration_s")


@query(f"""SELECT book_id, chapter_index, '#EXTM3U' || chr(10) || '#EXT-X-VERSION:3' || chr(10) || '#EXT-X-TARGETDURATION:' || greatest(1, max(ceil(duration_s)))::BIGINT || chr(10) || '#EXT-X-PLAYLIST-TYPE:EVENT' || chr(10)
    || string_agg('#EXTINF:' || format('{{:.3f}}', duration_s) || ',' || chr(10) || name || chr(10), '' ORDER BY pos) || '#EXT-X-ENDLIST' || chr(10) AS text FROM {_ENTRIES} GROUP BY book_id, chapter_index""")
def playlist_texts(spark: SparkSession, d: str) -> DataFrame:
    return L.playlists(L.with_gaps(_chunks(spark, d)), ["book_id", "chapter_index"], finished=True)


@query(f"SELECT book_id, chapter_index, pos::INTEGER AS pos, greatest(1, max(ceil(duration_s)) OVER (PARTITION BY book_id, chapter_index ORDER BY pos))::BIGINT AS target FROM {_ENTRIES}")
def playlist_targets(spark: SparkSession, d: str) -> DataFrame:
    return L.running_targets(L.with_gaps(_chunks(spark, d)), ["book_id", "chapter_index"]).select("book_id", "chapter_index", "pos", "target")
