"""Cleaning, classification and chunking queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.functions import chunking as K
from narrata.functions import classify as C
from narrata.functions import html as H
from narrata.functions import text as T
from narrata.functions import vectors as V
from narrata.functions.rules import SQUEEZE, STRIP, WORD, WS
from narrata.plans.common import BOOKS, CHAPTERS, MEMORIES, books, chapters, memories, passages
from narrata.session import table

QUERIES, ORACLES = {}, {}
_WORD_SQL = WORD.replace("'", "''")


def query(sql: str | None = None):  # noqa: ANN201
    def add(f):  # noqa: ANN001, ANN202
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _chapter_text(name: str, of: Callable[[Column], Column], sql: str) -> None:
    def q(spark: SparkSession, d: str) -> DataFrame:
        return chapters(spark, d, "text").where("text IS NOT NULL").select("chapter_id", of(F.col("text")).alias("out"))

    q.__name__ = name
    QUERIES[name], ORACLES[name] = q, f"SELECT chapter_id, {sql} AS out FROM {CHAPTERS} WHERE text IS NOT NULL"


for _name, _chain in {"cleanup_text": T.CLEANUP, "narration_text": T.NARRATION, "sanitized_text": T.SANITIZE, "glossary_text": T.GLOSSARY, "squeezed_text": SQUEEZE}.items():
    _chapter_text(_name, _chain, _chain.sql("text"))
_chapter_text("normalized_text", T.normalize_text, T.normalize_text_sql("text"))
_chapter_text("word_counts", lambda c: T.word_count(c).cast("int"), f"len(regexp_extract_all(text, '{_WORD_SQL}'))::INTEGER")
_chapter_text("rewrite_tokens", T.rewrite_max_tokens, "least(1024, greatest(256, floor(length(text) / 3) + 128))::INTEGER")
_chapter_text("text_sha256", lambda c: F.sha2(c, 256), "sha256(text)")
_chapter_text("ffmetadata_values", T.ffmetadata_value, "replace(replace(replace(replace(replace(regexp_replace(text, '\\r\\n|\\r', chr(10), 'g'), '\\', '\\\\'), chr(10), '\\n'), '=', '\\='), ';', '\\;'), '#', '\\#')")
_SQ = SQUEEZE.sql("text")
_SNIPPET = f"CASE WHEN length({_SQ}) <= 240 THEN {_SQ} ELSE regexp_replace(substring({_SQ}, 1, 239), '[{WS}]+$', '') || '…' END"
_chapter_text("snippets", T.snippet, _SNIPPET)
_chapter_text("tagged_outputs", lambda c: T.tagged_output(F.concat(F.lit("ok <OUT> "), F.substring(c, 1, 200), F.lit(" </out> end"))), STRIP.sql("regexp_extract('ok <OUT> ' || substring(text, 1, 200) || ' </out> end', '(?is)<out>(.*?)</out>', 1)"))
_chapter_text("tagged_whole_outputs", lambda c: T.tagged_output(F.concat(F.lit("ok <OUT> "), c, F.lit(" </out> end"))), STRIP.sql("regexp_extract('ok <OUT> ' || text || ' </out> end', '(?is)<out>(.*?)</out>', 1)"))


@query(f"SELECT md5(text) AS text_key, count(*) AS n_rows, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY ALL")
def text_copies(spark: SparkSession, d: str) -> DataFrame:
    """Documents with the same text; only digests are shuffled."""
    return table(spark, d, "documents").where("text IS NOT NULL").select(F.md5("text").alias("text_key"), "doc_id").groupBy("text_key").agg(F.count("*").alias("n_rows"), F.count_distinct("doc_id").alias("n_docs"), F.min("doc_id").alias("first_doc"))


_SLUG = f"trim(regexp_replace(regexp_replace(lower({STRIP.sql('coalesce(title, chr(32))')}), '[^a-z0-9]+', '-', 'g'), '-{{2,}}', '-', 'g'), '-')"


@query(f"SELECT chapter_id, lpad(chapter_index::VARCHAR, 3, '0') || '-' || trim(coalesce(nullif(substring({_SLUG}, 1, 80), ''), 'chapter'), '-') AS slug FROM {CHAPTERS} WHERE chapter_index IS NOT NULL")
def chapter_slugs(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d, "chapter_index", "title").where("chapter_index IS NOT NULL").select("chapter_id", T.chapter_slug(F.col("chapter_index"), F.coalesce("title", F.lit(" "))).alias("slug"))


@query(f"SELECT chapter_id, title, regexp_matches(coalesce(title, ''), '(?i)_epub_c[0-9]+(\\.[0-9]+)?_r[0-9]+$') AS packaging FROM {CHAPTERS}")
def packaging_titles(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d, "title").select("chapter_id", "title", T.is_packaging_title(F.col("title")).alias("packaging"))


@query(f"""WITH n AS (SELECT id, title || ' (' || author || ').epub' AS a, title || ' - ' || author || '.epub' AS b FROM {BOOKS} WHERE title IS NOT NULL AND author IS NOT NULL)
    SELECT id, {STRIP.sql("regexp_extract(regexp_replace(a, '\\.[^./\\\\]*$', ''), '^([\\s\\S]*?)[ ]*\\(([^)]+)\\)[ ]*$', 1)")} AS title_a,
           {STRIP.sql("regexp_extract(regexp_replace(a, '\\.[^./\\\\]*$', ''), '^([\\s\\S]*?)[ ]*\\(([^)]+)\\)[ ]*$', 2)")} AS author_a,
           CASE WHEN length(regexp_extract(b, '^([\\s\\S]*) - ([\\s\\S]*)\\.epub$', 2)) < 60 THEN {STRIP.sql("regexp_extract(b, '^([\\s\\S]*) - ([\\s\\S]*)\\.epub$', 2)")} ELSE '' END AS author_b FROM n""")
def filename_guesses(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "title", "author").where("title IS NOT NULL AND author IS NOT NULL")
    a, c = T.filename_guess(F.concat("title", F.lit(" ("), "author", F.lit(").epub"))), T.filename_guess(F.concat("title", F.lit(" - "), "author", F.lit(".epub")))
    return b.select("id", a["title"].alias("title_a"), a["author"].alias("author_a"), c["author"].alias("author_b"))


@query("SELECT result_id, min(regexp_replace(text, '^session_id:[^\\n]*\\n?', '')) AS answer FROM gateway_results WHERE text IS NOT NULL GROUP BY result_id")
def gateway_answers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "gateway_results").where("text IS NOT NULL").groupBy("result_id").agg(F.min(T.without_session_header(F.col("text"))).alias("answer"))


_N = f"lower({STRIP.sql('action')})"


@query(f"SELECT memory_id, CASE WHEN {_N} IN ('answer','explain','socratic','challenge','example','practice') THEN {_N} ELSE 'answer' END AS action FROM {MEMORIES}")
def answer_actions(spark: SparkSession, d: str) -> DataFrame:
    return memories(spark, d, "action").select("memory_id", T.answer_action(F.col("action")).alias("action"))


@query(f"""SELECT id, CASE WHEN listen_abs_time_s IS NULL THEN '—'
    WHEN floor(listen_abs_time_s / 3600) > 0 THEN floor(listen_abs_time_s / 3600)::BIGINT::VARCHAR || ':' || lpad(floor((floor(listen_abs_time_s)::BIGINT % 3600) / 60)::BIGINT::VARCHAR, 2, '0') || ':' || lpad((floor(listen_abs_time_s)::BIGINT % 60)::VARCHAR, 2, '0')
    ELSE floor((floor(listen_abs_time_s)::BIGINT % 3600) / 60)::BIGINT::VARCHAR || ':' || lpad((floor(listen_abs_time_s)::BIGINT % 60)::VARCHAR, 2, '0') END AS clock FROM {BOOKS}""")
def clock_labels(spark: SparkSession, d: str) -> DataFrame:
    return books(spark, d, "listen_abs_time_s").select("id", T.clock(F.col("listen_abs_time_s")).alias("clock"))


_TS = """coalesce(try_strptime(regexp_replace(trim({c}), 'Z$', '+0000'), '%Y-%m-%dT%H:%M:%S%z'), try_strptime(regexp_replace(trim({c}), 'Z$', '+0000'), '%Y-%m-%dT%H:%M:%S.%f%z'))"""


@query(f"SELECT id, epoch({_TS.format(c='added_at')})::BIGINT AS added FROM {BOOKS} WHERE regexp_matches(trim(added_at), '^[0-9-]{{10}}T[0-9:]{{8}}(\\.[0-9]+)?(Z|[+-][0-9]{{2}}:?[0-9]{{2}})$')")
def parsed_times(spark: SparkSession, d: str) -> DataFrame:
    b = books(spark, d, "added_at").where(F.trim("added_at").rlike(r"^[0-9-]{10}T[0-9:]{8}(\.[0-9]+)?(Z|[+-][0-9]{2}:?[0-9]{2})$"))
    return b.select("id", F.unix_timestamp(T.parsed_time(F.col("added_at"))).alias("added"))


_stop = ",".join(f"'{w}'" for w in T.TITLE_STOP)
_QW = f"list_filter(string_split({SQUEEZE.sql('regexp_replace(lower(question), ' + chr(39) + '[^A-Za-z0-9_' + chr(92) + 't-' + chr(92) + 'r' + chr(92) + 'x20' + chr(92) + 'xa0]' + chr(39) + ', ' + chr(39) + ' ' + chr(39) + ', ' + chr(39) + 'g' + chr(39) + ')')}, ' '), lambda w: w <> '' AND w NOT IN ({_stop}))"
_PH = " ".join(f"WHEN {' AND '.join(f'contains(lower(question), {chr(39)}{k}{chr(39)})' for k in keys)} THEN '{t}'" for keys, t in T.TITLE_PHRASES)


@query(f"""WITH m AS (SELECT memory_id, question, {_QW} AS w FROM {MEMORIES} WHERE question IS NOT NULL),
    b AS (SELECT *, array_to_string(list_transform(w[1:5], lambda x: upper(substring(x, 1, 1)) || lower(substring(x, 2))), ' ') AS built FROM m)
    SELECT memory_id, CASE {_PH} WHEN length(built) <= 56 THEN built ELSE {STRIP.sql('substring(built, 1, 53)')} || '…' END AS title FROM b WHERE len(w) >= 2""")
def insight_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of insights whose question has at least two main words."""
    m = memories(spark, d, "question", "text", "action").where("question IS NOT NULL")
    main = F.filter(F.split(SQUEEZE(F.regexp_replace(F.lower("question"), r"[^A-Za-z0-9_\t-\r\x20\xa0]", " ")), " "), lambda w: (w != "") & ~w.isin(*T.TITLE_STOP))
    return m.where(F.size(main) >= 2).select("memory_id", T.insight_title(F.col("question"), F.col("text"), F.col("action")).alias("title"))


# --- classification ---------------------------------------------------------------------------------------------
_CLEAN, _NARR = T.CLEANUP.sql("text"), T.NARRATION.sql("text")
_LINES = f"list_filter(list_transform(string_split_regex(c, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\x{{2028}}\\x{{2029}}]'), lambda x: {STRIP.sql('x')}), lambda x: x <> '')"


@query(f"""WITH a AS (SELECT chapter_id, title, source, {_CLEAN} AS c FROM {CHAPTERS} WHERE text IS NOT NULL), l AS (SELECT *, {_LINES} AS lines FROM a),
    h AS (SELECT *, len(list_filter(lines[1:80], lambda x: regexp_matches(x, '\\.{{2,}}[{WS}]*\\p{{Nd}}+$') OR regexp_matches(x, '(?i)^(chapter|part|introduction|preface|appendix)([^\\p{{L}}\\p{{N}}_].*)?\\p{{Nd}}$') OR (regexp_matches(x, '^\\p{{Nd}}+[.)]?[{WS}]+.') AND len(string_split_regex(x, '[{WS}]+')) <= 14))) AS hits FROM l)
    SELECT chapter_id, (lower({STRIP.sql("coalesce(title, '')")}) IN ('contents', 'table of contents', 'toc') OR regexp_matches(lower(coalesce(source, '')), 'toc|contents|nav|ncx') OR starts_with(lower(c), 'table of contents') OR lower(c) = 'contents'
      OR (len(lines) > 0 AND hits >= greatest(3, floor(len(lines) / 2)))) AS is_toc FROM h""")
def contents_pages(spark: SparkSession, d: str) -> DataFrame:
    return chapters(spark, d, "title", "source", "text").where("text IS NOT NULL").select("chapter_id", C.is_contents_page(F.col("title"), F.col("source"), F.col("text")).alias("is_toc"))


_HEAD = f"""(c = '' OR regexp_matches(c, '^\\p{{Nd}}+[.)]?[{WS}]+[A-Z0-9 ,;:''?!–—-]+$') OR (n <= 12 AND upper_ratio >= 0.8) OR (n <= 8 AND length(c) <= 80) OR (n <= 4 AND length(c) <= 120)
    OR regexp_matches(c, '(?i)^(compare|describe|explain|list|summarize|outline|write|discuss|identify|consider)($|[^\\p{{L}}\\p{{N}}_])')
    OR (n_lines = 1 AND n <= 10 AND NOT regexp_matches(c, '(^|[^\\p{{L}}])\\p{{Ll}}') AND NOT regexp_matches(c, '\\p{{L}}\\p{{Lu}}') AND regexp_matches(c, '\\p{{L}}') AND NOT regexp_matches(c, '[.!?]$')))"""


def _head_cte(src: str, clean: str) -> str:
    return f"""a AS (SELECT *, {clean} AS c FROM {src}), l AS (SELECT *, regexp_extract_all(c, '{_WORD_SQL}') AS words, len({_LINES}) AS n_lines FROM a),
    f AS (SELECT *, len(words) AS n, len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z]'))) AS n_alpha, len(list_filter(words, lambda w: regexp_matches(w, '[A-Za-z]') AND upper(w) = w)) AS n_upper FROM l),
    h AS (SELECT *, CASE WHEN n_alpha > 0 THEN n_upper / n_alpha ELSE 0.0 END AS upper_ratio FROM f)"""


_PARA = f"(SELECT chapter_id, i, list_extract(p, i) AS text FROM (SELECT chapter_id, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT chapter_id, list_filter(list_transform(string_split({T.normalize_text_sql('text')}, chr(10) || chr(10)), lambda x: {STRIP.sql('x')}), lambda x: x <> '') AS p FROM {CHAPTERS} WHERE text IS NOT NULL)))"


def _paragraphs(spark: SparkSession, d: str) -> DataFrame:
    p = chapters(spark, d, "text").where("text IS NOT NULL").select("chapter_id", F.posexplode(K.paragraphs(T.normalize_text(F.col("text")))).alias("i", "text"))
    return p.select("chapter_id", (F.col("i") + 1).cast("long").alias("i"), "text")


@query(f"WITH {_head_cte(_PARA, _CLEAN)} SELECT chapter_id, i, {_HEAD} AS heading FROM h")
def heading_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).select("chapter_id", "i", C.is_heading_or_fragment(F.col("text")).alias("heading"))


_MARKS = [("length(c) >= 600", 1, "long_chunk"), ("length(c) >= 900", 1, "very_long_chunk"), ("n >= 120", 1, "dense_chunk"), ("breaks <= 1 AND length(c) >= 350", 2, "few_sentence_breaks"), (f"regexp_matches(c, '[.!?][{WS}]+[a-z]')", 2, "lowercase_after_sentence_end"), ("length(replace(c, '(', '')) <> length(replace(c, ')', ''))", 1, "unbalanced_parentheses"), ("(length(c) - length(replace(c, '\"', ''))) % 2 = 1", 1, "unbalanced_quotes")]
_SCORE = " + ".join(f"CASE WHEN {w} THEN {n} ELSE 0 END" for w, n, _ in _MARKS)
_WHY = "concat_ws(',', " + ", ".join(f"CASE WHEN {w} THEN '{x}' END" for w, _, x in _MARKS) + ")"


@query(f"""WITH {_head_cte(_PARA, _NARR)}, b AS (SELECT *, len(regexp_extract_all(c, '(^|[^\\p{{Nd}}])[.!?]([{WS}]|$)')) AS breaks FROM h)
    SELECT chapter_id, i, CASE WHEN c = '' OR {_HEAD} THEN false ELSE ({_SCORE}) >= 2 END AS use_llm,
      CASE WHEN c = '' THEN 'empty_after_cleanup' WHEN {_HEAD} THEN 'short_or_heading' WHEN {_WHY} = '' THEN 'deterministic_cleanup_only' ELSE {_WHY} END AS reason FROM b""")
def rewrite_decisions(spark: SparkSession, d: str) -> DataFrame:
    r = _paragraphs(spark, d).select("chapter_id", "i", C.rewrite_decision(F.col("text")).alias("r"))
    return r.select("chapter_id", "i", "r.use_llm", "r.reason")


_SA, _SB = T.SANITIZE.sql("text"), T.SANITIZE.sql("substring(text, 1, 400)")


@query(f"""WITH s AS (SELECT chapter_id, {_SA} AS a, {_SB} AS b FROM {CHAPTERS} WHERE text IS NOT NULL), w AS (SELECT *, len(regexp_extract_all(a, '{_WORD_SQL}')) AS wa, len(regexp_extract_all(b, '{_WORD_SQL}')) AS wb FROM s)
    SELECT chapter_id, CASE WHEN b = '' THEN 'empty' WHEN regexp_matches(b, '(?i)</?out>|</?text>') THEN 'tag_leak' WHEN wa >= 40 AND wb < greatest(12, floor(wa * 0.65::DOUBLE)) THEN 'too_short' WHEN length(a) >= 300 AND length(b) < floor(length(a) * 0.45::DOUBLE) THEN 'too_short' ELSE 'ok' END AS verdict FROM w""")
def rewrite_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Each chapter against its own first 400 characters as a rewrite."""
    return chapters(spark, d, "text").where("text IS NOT NULL").select("chapter_id", C.rewrite_verdict(F.col("text"), F.substring("text", 1, 400)).alias("verdict"))


# --- chunking ---------------------------------------------------------------------------------------------------
_UNITS = "list_filter(list_transform(string_split(" + K._CUT.sql(STRIP.sql("text")) + ", chr(1)), lambda x: " + STRIP.sql("x") + "), lambda x: x <> '')"


@query(f"SELECT chapter_id, i, unnest({_UNITS}) AS unit FROM {_PARA}")
def sentence_like_units(spark: SparkSession, d: str) -> DataFrame:
    return _paragraphs(spark, d).select("chapter_id", "i", F.explode(K.sentence_units(F.col("text"))).alias("unit"))


@query(f"""WITH RECURSIVE p AS (SELECT chapter_id, i, {_UNITS} AS u FROM {_PARA}), q AS (SELECT * FROM p WHERE len(u) > 0),
    w(chapter_id, i, u, k, buf, chunk) AS (SELECT chapter_id, i, u, 1, u[1], NULL::VARCHAR FROM q
      UNION ALL SELECT chapter_id, i, u, k + 1,
        CASE WHEN length(buf) + 1 + length(u[k + 1]) <= 360 OR (length(buf) + 1 + length(u[k + 1]) <= 1200 AND length(buf) < 180) THEN buf || ' ' || u[k + 1] ELSE u[k + 1] END,
        CASE WHEN length(buf) + 1 + length(u[k + 1]) <= 360 OR (length(buf) + 1 + length(u[k + 1]) <= 1200 AND length(buf) < 180) THEN NULL ELSE buf END FROM w WHERE k < len(u)),
    o AS (SELECT chapter_id, i, k AS nth, chunk FROM w WHERE chunk IS NOT NULL UNION ALL SELECT chapter_id, i, k + 1, buf FROM w WHERE k = len(u))
    SELECT chapter_id, (row_number() OVER (PARTITION BY chapter_id ORDER BY i, nth))::INTEGER AS chunk_index, chunk FROM o""")
def narration_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Greedy chunks of every chapter, numbered from 1."""
    c = chapters(spark, d, "text").where("text IS NOT NULL").select("chapter_id", F.posexplode(K.chunks(T.normalize_text(F.col("text")))).alias("n", "chunk"))
    return c.select("chapter_id", (F.col("n") + 1).alias("chunk_index"), "chunk")


def overlap_windows(spark: SparkSession, d: str) -> DataFrame:
    """Overlapping windows of every chapter (data-dependent walk: no SQL form)."""
    return K.overlapping(chapters(spark, d, "text").where("text IS NOT NULL"), "text").select("chapter_id", "chunk_index", "piece")


QUERIES["overlap_windows"] = overlap_windows
# The recursive twin: a window ends at the last blank of its last 240 characters; a last piece under 80 joins the one before.
WINDOWS_SQL = f"""WITH RECURSIVE c AS (SELECT chapter_id, {SQUEEZE.sql('text')} AS t FROM {CHAPTERS} WHERE text IS NOT NULL), w(chapter_id, t, k, a, e) AS (
      SELECT chapter_id, t, 0, 0, CASE WHEN length(t) <= 1200 THEN length(t) WHEN contains(substring(t, 961, 240), ' ') THEN 1200 - strpos(reverse(substring(t, 961, 240)), ' ') ELSE 1200 END FROM c WHERE t <> ''
      UNION ALL SELECT chapter_id, t, k + 1, e - 150, CASE WHEN e + 1050 >= length(t) THEN length(t) WHEN contains(substring(t, e + 811, 240), ' ') THEN e + 1050 - strpos(reverse(substring(t, e + 811, 240)), ' ') ELSE e + 1050 END FROM w WHERE e < length(t)),
    p AS (SELECT chapter_id, k, e = length(t) AS last, trim(substring(t, a + 1, e - a), ' ') AS piece FROM w),
    m AS (SELECT *, lead(piece) OVER (PARTITION BY chapter_id ORDER BY k) AS nxt, lead(last) OVER (PARTITION BY chapter_id ORDER BY k) AS nxt_last FROM p)
    SELECT chapter_id, k::INTEGER AS chunk_index, CASE WHEN nxt_last AND length(nxt) < 80 THEN trim(piece || ' ' || nxt, ' ') ELSE piece END AS piece FROM m WHERE k = 0 OR NOT (last AND length(piece) < 80)"""
ORACLES["overlap_windows"] = WINDOWS_SQL


@query(f"""WITH RECURSIVE p AS (SELECT chapter_id, list(text ORDER BY i) AS u FROM {_PARA} GROUP BY chapter_id),
    w(chapter_id, u, k, buf, piece, first) AS (SELECT chapter_id, u, 1, u[1], NULL::VARCHAR, true FROM p
      UNION ALL SELECT chapter_id, u, k + 1, CASE WHEN length(u[k + 1]) < 80 THEN buf || ' ' || u[k + 1] ELSE u[k + 1] END, CASE WHEN length(u[k + 1]) < 80 THEN NULL ELSE buf END, false FROM w WHERE k < len(u)),
    o AS (SELECT chapter_id, k AS nth, piece FROM w WHERE piece IS NOT NULL UNION ALL SELECT chapter_id, k + 1, buf FROM w WHERE k = len(u))
    SELECT chapter_id, (row_number() OVER (PARTITION BY chapter_id ORDER BY nth) - 1)::INTEGER AS n, piece FROM o""")
def merged_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs, tiny ones joined to the one before."""
    c = chapters(spark, d, "text").where("text IS NOT NULL")
    return c.select("chapter_id", F.posexplode(K.merged_tiny(K.paragraphs(T.normalize_text(F.col("text"))))).alias("n", "piece"))


_PAGE = "'<html><head><title>' || coalesce(title, '') || '</title></head><body><nav>x</nav><h1>' || coalesce(title, '') || '</h1><p>' || {t} || '</p></body></html>'"


def html_documents(spark: SparkSession, d: str) -> DataFrame:
    """Text, title and headings of XHTML documents made from chapters (parser in Arrow batches)."""
    esc = F.replace(F.replace(F.coalesce("text", F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    page = F.concat(F.lit("<html><head><title>"), F.coalesce("title", F.lit("")), F.lit("</title></head><body><nav>x</nav><h1>"), F.coalesce("title", F.lit("")), F.lit("</h1><p>"), esc, F.lit("</p></body></html>"))
    x = chapters(spark, d, "title", "text", "chapter_index").select("chapter_id", "chapter_index", H.document_text(page).alias("x"))
    return x.select("chapter_id", "x.text", H.chapter_title(F.col("x.headings"), F.col("x.title"), F.col("x.text"), F.col("chapter_index")).alias("title"))


QUERIES["html_documents"] = html_documents


@query("""WITH p AS (SELECT DISTINCT id, text FROM passages WHERE text IS NOT NULL AND text <> ''), t AS (SELECT id, unnest(CASE WHEN len(regexp_extract_all(lower(text), '[a-z0-9]+')) > 0 THEN regexp_extract_all(lower(text), '[a-z0-9]+') ELSE [lower(text)] END) AS tok FROM p),
    h AS (SELECT id, (('0x' || substring(sha256(tok), 1, 8))::BIGINT % 16) AS i, CASE WHEN ('0x' || substring(sha256(tok), 9, 2))::BIGINT % 2 = 0 THEN 1.0 ELSE -1.0 END AS s FROM t),
    g AS (SELECT id, i, sum(s)::DOUBLE AS v FROM h GROUP BY ALL), n AS (SELECT id, CASE WHEN sqrt(sum(v * v)) = 0 THEN 1.0 ELSE sqrt(sum(v * v)) END AS n FROM g GROUP BY id)
    SELECT g.id, g.i::INTEGER AS i, round(v / n, 6) AS v FROM g JOIN n USING (id) WHERE v <> 0""")
def hashed_embeddings(spark: SparkSession, d: str) -> DataFrame:
    """Non-zero coordinates of every passage's hashed embedding."""
    p = passages(spark, d, "text").where("text IS NOT NULL AND text <> ''").select("id", F.posexplode(V.hash_embedding(F.col("text"))).alias("i", "v"))
    return p.where("v <> 0").select("id", "i", F.round("v", 6).alias("v"))
