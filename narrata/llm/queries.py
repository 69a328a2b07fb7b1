"""Queries of this subpackage: name -> query, and SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from narrata.llm import leakage, lookalike, mixing, mojibake, nearest, pairs, sentences, split
from narrata.session import table


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of oversized chapters and passages."""
    limits = table(spark, d, "split_limits")
    c = split.split_oversized(table(spark, d, "chapters"), limits, item_kind="chapter", id_col="chapter_id")
    p = split.split_oversized(table(spark, d, "passages"), limits, item_kind="passage", id_col="id", model_col="embedding_model")
    return c.unionByName(p)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """The items that had to be cut."""
    return p1_pieces(spark, d).where("chunk_index = 1").select("item_kind", "item_id").distinct()


def p1_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many oversized items have pieces that break a rule: limit, overlap, text, or that do not cover the item."""
    limits = table(spark, d, "split_limits")
    c, p = table(spark, d, "chapters"), table(spark, d, "passages")
    items = c.select(F.lit("chapter").alias("item_kind"), F.col("chapter_id").cast("string").alias("item_id"), F.lit(None).cast("string").alias("m"), "text").unionByName(p.select(F.lit("passage").alias("item_kind"), F.col("id").alias("item_id"), F.col("embedding_model").alias("m"), "text")).dropDuplicates(["item_kind", "item_id"])
    lim = limits.select("item_kind", F.col("embedding_model").alias("m"), "max_chars", "overlap_chars")
    big = items.join(F.broadcast(lim), (items["item_kind"] == lim["item_kind"]) & items["m"].eqNullSafe(lim["m"])).where(F.length("text") > F.col("max_chars")).select(items["item_kind"], "item_id", F.col("text").alias("whole"), "max_chars", "overlap_chars")
    x = p1_pieces(spark, d).join(big, ["item_kind", "item_id"])
    before = F.lag("end_pos").over(Window.partitionBy("item_kind", "item_id").orderBy("chunk_index"))
    last = F.max("end_pos").over(Window.partitionBy("item_kind", "item_id"))
    wrong = (F.length("text") > F.col("max_chars")) | (F.substring("whole", F.col("start_pos") + 1, F.col("end_pos") - F.col("start_pos")) != F.col("text")) | (F.col("start_pos") != F.coalesce(F.col("before") - F.col("overlap_chars"), F.lit(0))) | (F.col("last") != F.length("whole"))
    x = x.withColumns({"before": before, "last": last})
    return x.groupBy("item_kind").agg(F.count_distinct("item_id").alias("items"), F.count_if(wrong).alias("wrong"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Broken pairs of memories and gateway results."""
    m = table(spark, d, "memories").where("question IS NOT NULL").select(F.lit("memory").alias("record_kind"), F.col("memory_id").alias("record_id"), "question", F.col("text").alias("answer"))
    answer = F.regexp_replace("text", r"^\s*session_id:[^\n]*\n?", "")
    g = table(spark, d, "gateway_results").select(F.lit("gateway").alias("record_kind"), F.col("result_id").cast("string").alias("record_id"), F.col("prompt").alias("question"), answer.alias("answer"))
    return pairs.defective(m.unionByName(g))


def p3_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The 5 nearest passages of every usable passage."""
    return nearest.nearest(table(spark, d, "passages"), id_col="id", vector_col="embedding", group_col="embedding_model", k=5, dim=32).drop("similarity")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of passages at least 0.96 similar, one among the 5 nearest of the other."""
    near = nearest.nearest(table(spark, d, "passages"), id_col="id", vector_col="embedding", group_col="embedding_model", k=5, dim=32, min_similarity=0.96)
    return near.select(F.least("id", "neighbour_id").alias("id_a"), F.greatest("id", "neighbour_id").alias("id_b")).distinct()


def _texts(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chapters").select(F.lit("chapter").alias("item_kind"), F.col("chapter_id").cast("string").alias("item_id"), "text")
    return c.unionByName(table(spark, d, "passages").select(F.lit("passage").alias("item_kind"), F.col("id").alias("item_id"), "text"))


def p4_classes(spark: SparkSession, d: str) -> DataFrame:
    """The items that look like others, one row each with its class."""
    return lookalike.classes(_texts(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs that look the same but are stored differently."""
    return lookalike.same_looking(_texts(spark, d))


def p5_sentences(spark: SparkSession, d: str) -> DataFrame:
    """The sentences of every chapter."""
    return sentences.sentences(table(spark, d, "chapters"), id_col="chapter_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return p5_sentences(spark, d).select("chapter_id", "start_pos", "end_pos")


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold test items, with the extent of what leaked."""
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_leaks(spark, d).select("doc_id", "item_id")


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The documents of a mixture by target shares, with their repetitions."""
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares that the mixture reaches."""
    return mixing.shares(p7_mixture(spark, d), table(spark, d, "mix_targets"))


def p7_rules(spark: SparkSession, d: str) -> DataFrame:
    """How many rows of the mixture break a rule: cap, unknown source, a share more than 1 % off where the source has documents."""
    t = table(spark, d, "mix_targets")
    m = p7_mixture(spark, d)
    x = m.join(t, "source", "left").agg(F.count_if(F.col("repeats") > F.col("max_repeats")).alias("over_cap"), F.count_if(F.col("target_share").isNull()).alias("unknown_source"))
    held = F.sum("target_share").over(Window.partitionBy(F.lit(1)))
    s = mixing.shares(m, t).where("n_docs > 0").withColumn("want", F.col("target_share") / held)
    return x.crossJoin(s.agg(F.count_if(F.abs(F.col("actual_share") - F.col("want")) > 0.01).alias("off_share")))


def p8_restored(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with its text as it should have been decoded."""
    return mojibake.restored(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that were decoded with the wrong encoding."""
    return p8_restored(spark, d).where("damaged").select("doc_id").distinct()


QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces, "p1_rules": p1_rules, "p2_found": p2_found, "p3_found": p3_found, "p3_nearest": p3_nearest, "p4_classes": p4_classes, "p4_found": p4_found, "p5_found": p5_found, "p5_sentences": p5_sentences, "p6_found": p6_found, "p6_leaks": p6_leaks, "p7_mixture": p7_mixture, "p7_rules": p7_rules, "p7_shares": p7_shares, "p8_found": p8_found, "p8_restored": p8_restored}
ORACLES = {
    "p1_found": """
        SELECT DISTINCT 'chapter' AS item_kind, chapter_id::VARCHAR AS item_id FROM chapters, split_limits
        WHERE item_kind = 'chapter' AND length(text) > max_chars
        UNION ALL
        SELECT DISTINCT 'passage', id FROM passages p JOIN split_limits s ON s.embedding_model = p.embedding_model
        WHERE item_kind = 'passage' AND length(text) > max_chars""",
    "p1_rules": """
        SELECT item_kind, count(*) AS items, 0::BIGINT AS wrong FROM (
        SELECT DISTINCT 'chapter' AS item_kind, chapter_id::VARCHAR AS item_id FROM chapters, split_limits WHERE item_kind = 'chapter' AND length(text) > max_chars
        UNION ALL SELECT DISTINCT 'passage', id FROM passages p JOIN split_limits s ON s.embedding_model = p.embedding_model WHERE item_kind = 'passage' AND length(text) > max_chars) GROUP BY item_kind""",
    "p7_rules": "SELECT 0::BIGINT AS over_cap, 0::BIGINT AS unknown_source, 0::BIGINT AS off_share",
    "p3_found": """
        WITH v AS (SELECT DISTINCT id, embedding_model AS m, embedding AS e FROM passages WHERE id IS NOT NULL AND embedding_model IS NOT NULL AND len(embedding) = 32
                   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS s FROM v a JOIN v b ON a.m = b.m AND a.id <> b.id WHERE list_cosine_similarity(a.e, b.e) >= 0.96),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS n FROM s)
        SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE n <= 5""",
    # Groups of up to 16,384 vectors are searched whole, so small tables give the exact lists.
    "p3_nearest": """
        WITH v AS (SELECT DISTINCT id, embedding_model AS m, embedding AS e FROM passages WHERE id IS NOT NULL AND embedding_model IS NOT NULL AND len(embedding) = 32
                   AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        s AS (SELECT a.m, a.id AS a, b.id AS b, round(list_cosine_similarity(a.e, b.e), 7) AS s FROM v a JOIN v b ON a.m = b.m AND a.id <> b.id),
        r AS (SELECT *, row_number() OVER (PARTITION BY m, a ORDER BY s DESC, b) AS n FROM s)
        SELECT m AS "group", a AS id, b AS neighbour_id, n::INT AS rank FROM r WHERE n <= 5""",
}
