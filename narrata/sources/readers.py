"""Tolerant JSON and folder scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException

from narrata import schemas


def _lines(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def jsonl(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Objects of a JSON-lines file or folder, with ``pos`` in file order.

    A missing path is empty; blank and malformed lines, scalars and arrays are
    left out; fields that do not fit are null. ``pos`` orders by file name and
    then line (one file is one ordered stretch).
    """
    text = _lines(spark, path)
    if text is None:
        return spark.createDataFrame([], schema.add("pos", "long") if "pos" not in schema.names else schema)
    # The id grows along each file's blocks and, within a plan without shuffle, across files by partition.
    rows = text.select(F.monotonically_increasing_id().alias("pos"), F.trim("value").alias("v")).where(F.col("v").startswith("{") & F.try_parse_json("v").isNotNull())
    return rows.select("pos", F.from_json("v", schema, {"mode": "PERMISSIVE"}).alias("r")).select("r.*", "pos")


def jsonl_strict(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """As :func:`jsonl` without places; rows whose fields do not fit drop out too, and the scan prunes columns."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def json_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One row a document; an unreadable or missing one is a row of nulls."""
    text = _lines(spark, path)
    if text is None:
        return spark.createDataFrame([tuple(None for _ in schema.names)], schema)
    docs = spark.read.option("wholetext", True).text(path)
    return docs.select(F.from_json("value", schema).alias("r")).select("r.*")


def catalog(spark: SparkSession, path: str) -> DataFrame:
    """Books of a catalog document."""
    return json_document(spark, path, schemas.CATALOG).select(F.explode("books").alias("b")).select("b.*")


def files(spark: SparkSession, path: str, pattern: str = "*", base: str | None = None) -> DataFrame:
    """``path, size, modified`` of files below a folder; contents are not read."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(path)
    p: Column = F.col("path")
    return r.select((F.regexp_replace(p, F.lit("^.*?" + base), F.lit("")) if base else p).alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def newer(inputs: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Inputs whose output is missing, empty or older."""
    o = outputs.where("size > 0").select(key, F.col("modified").alias("__m"))
    return inputs.join(o, key, "left").where("__m IS NULL OR __m < modified").drop("__m")
