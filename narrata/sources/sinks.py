"""Writers: replaced indexes, appended events, text documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def replace_by_book(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write so that each book in ``df`` replaces its own rows and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id").format(fmt).save(path)


def append_events(df: DataFrame, path: str) -> None:
    """Append to an event log as new part files, which a file stream picks up."""
    df.write.mode("append").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_texts(df: DataFrame, path: str, key: str, text: str = "text") -> None:
    """One folder a key with its text (playlists, metadata, markdown)."""
    df.select(F.col(key), F.regexp_replace(text, "\n$", "").alias("value")).write.mode("overwrite").partitionBy(key).text(path)
