"""Catalog listing, search and keyed updates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.session import written

# States in which a conversion is active.
ACTIVE = ("starting", "running", "stalled")
# Settings, and what they are where none is stored.
SETTINGS = {"kokoro_voice": "af_heart", "rewrite_policy": "script-only", "output_retention": "delete_intermediates_after_complete", "kokoro_workers": 2, "hls_live": True, "version": 1}
POLICIES = ("full", "selective", "script-only")


def filtered(books: DataFrame, which: str) -> DataFrame:
    if which == "favorites":
        return books.where(F.col("favorite"))
    return books.where(F.col("conversion_status").isin(*ACTIVE)) if which == "active" else books


def searched(books: DataFrame, words: str) -> DataFrame:
    """Books whose title or author holds the words, in any case."""
    w = F.lit(words.strip().lower())
    return books.where(F.contains(F.lower(F.coalesce("title", F.lit(""))), w) | F.contains(F.lower(F.coalesce("author", F.lit(""))), w))


def order_of(by: str) -> list[Column]:
    """Sort columns of a listing; ties by id."""
    return {
        "recent": [F.coalesce("added_at", F.lit("")).desc()],
        "title": [F.lower(F.coalesce("title", F.lit("")))],
        "author": [F.lower(F.coalesce("author", F.lit("")))],
        "progress": [F.col("listen_abs_time_s").isNull(), F.col("listen_abs_time_s").desc()],
    }[by] + [F.col("id")]


def placed(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Every row with its ``place`` (from 1) in that order, which must leave no ties.

    A range sort, then the counts of the partitions before: no row passes
    through a single task.
    """
    s = written(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()), "placed")
    part, at = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND((1 << 33) - 1)
    n = dict(s.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    before, total = [], 0
    for p in sorted(n):
        before.append((p, total))
        total += n[p]
    offsets = s.sparkSession.createDataFrame(before, "__part int, __before long")
    return s.withColumn("__part", part).join(F.broadcast(offsets), "__part").select((F.col("__before") + at + 1).alias("place"), *rows.columns)


def patched(books: DataFrame, patches: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    """Books with the patches' values.

    ``patches`` holds, for each column, ``<column>`` (text) and
    ``set_<column>``; an absent column keeps its value, an explicit null clears
    it, and text that does not fit the column's type keeps the old value.
    """
    p = patches.select(F.col(key), *[F.struct(F.col(f"set_{c}").alias("has"), F.col(c).cast("string").alias("v")).alias(f"__{c}") for c in columns])
    j = books.join(p, key, "left")
    new = {}
    for c in columns:
        kind = books.schema[c].dataType.simpleString()
        fits = F.col(f"__{c}.v").try_cast(kind)
        new[c] = F.when(F.coalesce(F.col(f"__{c}.has"), F.lit(False)) & (F.col(f"__{c}.v").isNull() | fits.isNotNull()), fits).otherwise(F.col(c))
    return j.select(*[new.get(c, F.col(c)).alias(c) for c in books.columns])


def upserted(rows: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``rows`` with those of ``new`` in the place of, or beside, theirs."""
    return rows.join(new.select(key), key, "left_anti").unionByName(new)


def deleted(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def settings(stored: DataFrame, *keep: str) -> DataFrame:
    """Settings with defaults for what is missing or not allowed; worker count and live playlists are fixed."""
    voice = F.substring(F.nullif(F.trim("kokoro_voice"), F.lit("")), 1, 80)
    policy = F.when(F.col("rewrite_policy").isin(*POLICIES), F.col("rewrite_policy"))
    return stored.select(*keep, F.coalesce(voice, F.lit(SETTINGS["kokoro_voice"])).alias("kokoro_voice"), F.coalesce(policy, F.lit(SETTINGS["rewrite_policy"])).alias("rewrite_policy"), F.coalesce("output_retention", F.lit(SETTINGS["output_retention"])).alias("output_retention"), F.lit(2).alias("kokoro_workers"), F.lit(True).alias("hls_live"), F.lit(1).alias("version"))


def appended(items: Column, item: Column) -> Column:
    return F.array_append(F.coalesce(items, F.array()), item)


def removed(items: Column, id_: Column) -> Column:
    return F.filter(items, lambda x: x["id"] != id_)


def replaced_text(items: Column, id_: Column, text: Column, most: int = 16_000) -> Column:
    """The list with the text of one item, cut to ``most`` characters."""
    return F.transform(items, lambda x: F.when(x["id"] == id_, x.withField("text", F.substring(text, 1, most))).otherwise(x))


def merged_metadata(old: Column, new: Column) -> Column:
    """Both maps; the new one wins, and null values do not."""
    keep = F.map_filter(F.coalesce(new, F.create_map().cast("map<string,string>")), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, v: ~F.map_contains_key(keep, k))
    return F.map_concat(rest, keep)


def identifiers(entries: Column) -> Column:
    """Map of identifier kind to value: the scheme, else isbn by the look of it; of a repeated kind the first wins."""
    kind = lambda e: F.coalesce(F.nullif(F.lower(F.trim(e["scheme"])), F.lit("")), F.when(e["value"].startswith("978") | F.length(e["value"]).isin(10, 13), F.lit("isbn")), F.lit("id"))
    pairs = F.transform(entries, lambda e: F.struct(kind(e).alias("key"), e["value"].alias("value")))
    first = F.aggregate(pairs, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["key"] == p["key"]), acc).otherwise(F.array_append(acc, p)))
    return F.map_from_entries(first)


def cover_type(data: Column) -> Column:
    """Image type by first bytes."""
    h = F.hex(F.substring(data, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), "png").when(h.startswith("47494638"), "gif").when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp").otherwise("jpg")
