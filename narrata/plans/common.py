"""Base tables as the queries read them, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.session import table

BOOK_COLUMNS = ["id", "title", "author", "language", "added_at", "opened_at", "favorite", "run_relpath", "conversion_status", "listen_abs_time_s"]
CHAPTER_COLUMNS = ["chapter_id", "book_id", "chapter_index", "title", "source", "text", "duration_s", "lang"]


def chapters(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """Chapters, each once (repeated rows are exact copies); only the named columns are read."""
    cols = cols or tuple(CHAPTER_COLUMNS)
    return table(spark, d, "chapters").select("chapter_id", *[c for c in cols if c != "chapter_id"]).dropDuplicates(["chapter_id"])


def books(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    cols = cols or tuple(BOOK_COLUMNS)
    return table(spark, d, "books").select("id", *[c for c in cols if c != "id"]).dropDuplicates(["id"])


def passages(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "passages").select("id", *[c for c in cols if c != "id"]).dropDuplicates(["id"])


def memories(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    return table(spark, d, "memories").select("memory_id", *[c for c in cols if c != "memory_id"]).dropDuplicates(["memory_id"])


CHAPTERS = f"(SELECT DISTINCT {', '.join(CHAPTER_COLUMNS)} FROM chapters)"
BOOKS = f"(SELECT DISTINCT {', '.join(BOOK_COLUMNS)} FROM books)"
MEMORIES = "(SELECT DISTINCT memory_id, book_id, text, source, created_at, title, question, action FROM memories)"


def one_row(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit(1).alias("one"))
