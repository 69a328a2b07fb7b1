"""Vector retrieval and answer-drafting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.functions import text as T
from narrata.functions import vectors as V
from narrata.functions.rules import SQUEEZE, STRIP, WS
from narrata.operators import retrieval as A
from narrata.plans.common import MEMORIES, memories, passages
from narrata.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_COS = "CASE WHEN coalesce(isnan(list_cosine_similarity({a}, {b})), true) THEN 0.0 ELSE list_cosine_similarity({a}, {b}) END"


@query(f"""WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0 LIMIT 1), s AS (SELECT vec_id, {_COS.format(a='embedding::DOUBLE[]', b='q')} AS s FROM embeddings, q)
    SELECT vec_id, round(s, 6) AS score FROM s ORDER BY s DESC, vec_id LIMIT 3""")
def topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    """The 3 vectors nearest to vector 0 (a top-k report)."""
    e = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id = 0").limit(1).select(F.col("v").alias("q"))
    s = e.crossJoin(F.broadcast(q)).select("vec_id", V.cosine(F.col("v"), F.col("q")).alias("s"))
    return s.orderBy(F.desc("s"), "vec_id").limit(3).select("vec_id", F.round("s", 6).alias("score"))


@query(f"""WITH e AS (SELECT DISTINCT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query_id, b.vec_id, round({_COS.format(a='b.v', b='a.v')}, 12) AS s FROM e a, e b WHERE a.vec_id % 100 = 0)
    SELECT query_id, vec_id, round(s, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 3""")
def topk_per_query(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100, the 3 nearest of all."""
    e = table(spark, d, "embeddings").dropDuplicates(["vec_id"]).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    q = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit("").alias("g"), F.col("v").alias("q"))
    hits = A.searched(q, e.select(F.col("vec_id").alias("id"), F.lit("").alias("g"), F.col("vec_id").alias("pos"), "v"))
    return hits.select("query_id", F.col("id").alias("vec_id"), F.round("s", 6).alias("score"), "rank")


@query("""WITH p AS (SELECT DISTINCT doc_id AS id, text FROM documents WHERE text IS NOT NULL AND text <> ''), t AS (SELECT id, unnest(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN regexp_extract_all(lower(text), '[a-z0-9]+') ELSE [lower(text)] END) AS tok FROM p),
    h AS (SELECT id, (('0x' || substring(sha256(tok), 1, 8))::BIGINT % 16) AS i, CASE WHEN ('0x' || substring(sha256(tok), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
    g AS (SELECT id, i, sum(s)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT id, sqrt(sum(v * v)) AS n FROM g GROUP BY id), u AS (SELECT g.id, i, CASE WHEN n = 0 THEN 0.0 ELSE v / n END AS v FROM g JOIN n USING (id)),
    s AS (SELECT a0.id AS query_id, b.id AS doc_id, round(coalesce(sum(a.v * c.v), 0.0), 12) AS s FROM (SELECT id FROM p WHERE id % 100 = 0) a0 JOIN p b ON true LEFT JOIN u a ON a.id = a0.id LEFT JOIN u c ON c.id = b.id AND c.i = a.i GROUP BY ALL)
    SELECT query_id, doc_id, round(s, 6) AS score, rank FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, doc_id))::INTEGER AS rank FROM s) WHERE rank <= 3""")
def hash_topk_documents(spark: SparkSession, d: str) -> DataFrame:
    """For every document whose id is divisible by 100, the 3 of all whose hashed embeddings are nearest."""
    e = table(spark, d, "documents").where("text IS NOT NULL AND text <> ''").select("doc_id", "text").dropDuplicates(["doc_id"]).select("doc_id", V.hash_embedding(F.col("text")).alias("v"))
    q = e.where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), F.lit("").alias("g"), F.col("v").alias("q"))
    hits = A.searched(q, e.select(F.col("doc_id").alias("id"), F.lit("").alias("g"), F.col("doc_id").alias("pos"), "v"))
    return hits.select("query_id", F.col("id").alias("doc_id"), F.round("s", 6).alias("score"), "rank")


_USABLE = "embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0"
_P = f"(SELECT DISTINCT id, book_id, pos, chapter, text, embedding FROM passages WHERE {_USABLE} AND book_id IS NOT NULL AND pos IS NOT NULL)"
_Q = f"(SELECT book_id AS query_id, book_id, min_by(embedding, (pos, id)) AS q FROM {_P} WHERE len(embedding) = 32 GROUP BY book_id)"
_RANKED = f"""(SELECT * FROM (SELECT query_id, id, chapter, text, round(s, 6) AS score, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos, id))::INTEGER AS rank FROM
    (SELECT query_id, id, pos, chapter, text, round(CASE WHEN len(embedding) <> len(q) THEN 0.0 ELSE {_COS.format(a='embedding', b='CASE WHEN len(embedding) = len(q) THEN q ELSE embedding END')} END, 12) AS s FROM {_P} JOIN {_Q} USING (book_id))) WHERE rank <= 3)"""


def _ranked(spark: SparkSession, d: str) -> DataFrame:
    """For each book, the passages nearest to its first one."""
    p = passages(spark, d, "book_id", "pos", "chapter", "text", "embedding", "source", "href", "chapter_index", "chunk_index").where("book_id IS NOT NULL AND pos IS NOT NULL")
    q = p.where((F.size("embedding") == 32) & V.usable(F.col("embedding"))).groupBy("book_id").agg(F.min_by("embedding", F.struct("pos", "id")).alias("q"))
    return A.ranked(q.withColumn("query_id", F.col("book_id")), p, 3)


@query(f"SELECT query_id, id, rank, score FROM {_RANKED}")
def topk_per_book(spark: SparkSession, d: str) -> DataFrame:
    return _ranked(spark, d).select("query_id", "id", "rank", "score")


@query("""SELECT p.book_id, true AS indexed, count(DISTINCT id) AS passage_count, min_by(embedding_model, (pos, id)) AS embedding_model FROM passages p WHERE book_id IS NOT NULL AND pos IS NOT NULL GROUP BY book_id""")
def index_status(spark: SparkSession, d: str) -> DataFrame:
    return A.index_status(passages(spark, d, "book_id", "pos", "embedding_model").where("book_id IS NOT NULL AND pos IS NOT NULL"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every question of a listener."""
    m = memories(spark, d, "book_id", "question", "action").where("question IS NOT NULL AND book_id IS NOT NULL")
    return m.select(F.col("memory_id").alias("query_id"), "book_id", "question", "action")


def _answering(spark: SparkSession, d: str) -> DataFrame:
    """For each question, the passages of its book nearest to it.

    The model of the stored vectors is not here, so questions and passages are
    both embedded by hashing, as in ``passage_index``.
    """
    p = passages(spark, d, "book_id", "pos", "chapter", "text", "source", "href", "chapter_index", "chunk_index").where("book_id IS NOT NULL AND pos IS NOT NULL").where(STRIP(F.coalesce("text", F.lit(""))) != "")
    asked = _asked(spark, d).select("book_id", "question", "query_id")
    # A question asked again is searched once.
    first = F.min("query_id").over(Window.partitionBy("book_id", "question"))
    asked = asked.withColumn("first", first)
    hits = A.searched(asked.where("query_id = first").select("query_id", F.col("book_id").alias("g"), V.hash_embedding(STRIP(F.col("question"))).alias("q")), p.select("id", F.col("book_id").alias("g"), "pos", V.hash_embedding(STRIP(F.col("text"))).alias("v")), 3)
    hits = hits.select(F.col("query_id").alias("first"), "id", "rank", F.round("s", 6).alias("score"))
    return asked.select("query_id", "first").join(hits, "first").drop("first").join(p.drop("book_id", "pos"), "id")


def chat_prompts(spark: SparkSession, d: str) -> DataFrame:
    """A prompt for every question."""
    return A.prompts(_asked(spark, d), _answering(spark, d))


def chat_drafts(spark: SparkSession, d: str) -> DataFrame:
    """A draft answer to every question, from its book's passages alone."""
    return A.drafts(_asked(spark, d), _answering(spark, d), fallback=True)


def chat_citations(spark: SparkSession, d: str) -> DataFrame:
    return A.with_citation(_answering(spark, d)).select("query_id", "rank", "citation.passage_id", "citation.snippet", "citation.href")


QUERIES |= {"chat_prompts": chat_prompts, "chat_drafts": chat_drafts, "chat_citations": chat_citations}


def _lit(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_SNIP = f"CASE WHEN length(flat) <= 240 THEN flat ELSE regexp_replace(substring(flat, 1, 239), '[{WS}]+$', '') || '…' END"
_ACTION = f"CASE WHEN lower({STRIP.sql('action')}) IN ({', '.join(map(_lit, T.ACTIONS))}) THEN lower({STRIP.sql('action')}) ELSE 'answer' END"
# Questions and passages embedded by hashing, and the 3 best passages of each question's book.
_HITS = f"""WITH p AS (SELECT DISTINCT id, book_id, pos, chapter, text, href FROM passages WHERE book_id IS NOT NULL AND pos IS NOT NULL AND {STRIP.sql("coalesce(text, '')")} <> ''),
    q AS (SELECT memory_id AS query_id, book_id, {STRIP.sql('question')} AS question, {_ACTION} AS action FROM {MEMORIES} WHERE question IS NOT NULL AND book_id IS NOT NULL),
    x AS (SELECT 'p' || id AS k, lower({STRIP.sql('text')}) AS s FROM p UNION ALL SELECT 'q' || query_id, lower(question) FROM q), t AS (SELECT k, unnest(CASE WHEN len(regexp_extract_all(s, '[a-z0-9]+')) > 0 THEN regexp_extract_all(s, '[a-z0-9]+') ELSE [s] END) AS tok FROM x),
    h AS (SELECT k, (('0x' || substring(sha256(tok), 1, 8))::BIGINT % 16) AS i, CASE WHEN ('0x' || substring(sha256(tok), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
    g AS (SELECT k, i, sum(s)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT k, sqrt(sum(v * v)) AS n FROM g GROUP BY k), u AS (SELECT g.k, i, CASE WHEN n = 0 THEN 0.0 ELSE v / n END AS v FROM g JOIN n USING (k)),
    s AS (SELECT q.query_id, p.id, p.pos, round(coalesce(sum(a.v * c.v), 0.0), 12) AS s FROM q JOIN p ON p.book_id = q.book_id LEFT JOIN u a ON a.k = 'q' || q.query_id LEFT JOIN u c ON c.k = 'p' || p.id AND c.i = a.i GROUP BY ALL),
    r AS (SELECT * FROM (SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY s DESC, pos, id))::INTEGER AS rank FROM s) WHERE rank <= 3),
    f AS (SELECT r.query_id, r.rank, p.id, p.chapter, p.text, p.href, {SQUEEZE.sql("coalesce(p.text, '')")} AS flat FROM r JOIN p USING (id))"""
ORACLES["chat_citations"] = f"{_HITS} SELECT query_id, rank, id AS passage_id, {_SNIP} AS snippet, nullif(href, '') AS href FROM f"
_BODY = "string_agg('[' || id || '] (' || coalesce(chapter, 'None') || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY rank)"
_SAY = "CASE action " + " ".join(f"WHEN '{a}' THEN {_lit(t)}" for a, t in A.INSTRUCTIONS.items()) + " END"
ORACLES["chat_prompts"] = f"""{_HITS}, b AS (SELECT query_id, {_BODY} AS body FROM f GROUP BY query_id)
    SELECT query_id, {_lit(A.OPENING + 'Answer mode: ')} || action || {_lit(chr(10) + 'Mode instructions: ')} || {_SAY} || {_lit(chr(10) * 3 + 'Question: ')} || question || {_lit(chr(10) * 2 + 'Passages:' + chr(10))} || coalesce(body, '(No passages retrieved.)') AS prompt FROM q LEFT JOIN b USING (query_id)"""


def _draft_sql(kind: str) -> str:
    x = _lit("\n".join([A.FALLBACK, *A.DRAFTS[kind]]))
    for mark, value in (("{c}", "coalesce(nullif(chapter, ''), 'this book')"), ("{s80}", "substring(snip, 1, 80)"), ("{s}", "snip"), ("{p}", "id"), ("{q}", "question")):
        x = f"replace({x}, '{mark}', {value})"
    if kind == "socratic":
        x += " || coalesce((SELECT string_agg(chr(10) || '- What would change if you applied [' || o.id || '] differently?', '' ORDER BY o.rank) FROM f o WHERE o.query_id = q.query_id AND o.rank IN (2, 3)), '')"
    if kind == "answer":
        x += " || CASE WHEN k > 1 THEN chr(10) || chr(10) || '(' || (k - 1) || ' additional passage(s) were retrieved for context.)' ELSE '' END"
    return x


ORACLES["chat_drafts"] = f"""{_HITS}, b AS (SELECT query_id, count(*) AS k FROM f GROUP BY query_id), l AS (SELECT query_id, id, chapter, {_SNIP} AS snip FROM f WHERE rank = 1)
    SELECT q.query_id, CASE WHEN k IS NULL THEN {_lit(A.NO_HITS)} {' '.join(f"WHEN action = '{a}' THEN {_draft_sql(a)}" for a in A.DRAFTS)} END AS draft FROM q LEFT JOIN b USING (query_id) LEFT JOIN l USING (query_id)"""


@query("""WITH r AS (SELECT DISTINCT id, book_id, chapter_index, chunk_index, text FROM passages WHERE book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL), n AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY chapter_index, chunk_index, id) - 1 AS pos FROM r)
    SELECT 'passage_' || book_id || '_' || pos AS id, length(trim(text, ' ')) AS n_chars FROM n WHERE text IS NOT NULL AND regexp_matches(text, '[^\\t-\\r\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]')""")
def passage_index(spark: SparkSession, d: str) -> DataFrame:
    """Passages numbered, cleaned and embedded anew."""
    p = passages(spark, d, "book_id", "chapter_index", "chunk_index", "text").where("book_id IS NOT NULL AND chapter_index IS NOT NULL AND chunk_index IS NOT NULL").withColumn("chapter", F.col("id"))
    r = A.passage_index(p)
    return r.where(F.size("embedding") == 16).select("id", F.length(F.trim("text")).cast("long").alias("n_chars"))
