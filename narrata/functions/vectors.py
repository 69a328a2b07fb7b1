"""Vector arithmetic on ``array<double>`` columns, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0.0 for empty vectors, differing lengths or a zero norm."""
    na, nb = (norm(a) if norm_a is None else norm_a), (norm(b) if norm_b is None else norm_b)
    return F.when((F.size(a) != F.size(b)) | (F.size(a) <= 0) | (na == 0) | (nb == 0), F.lit(0.0)).otherwise(dot(a, b) / (na * nb))


def usable(a: Column) -> Column:
    """Not null, not empty, no null or not-a-number element."""
    return (F.size(a) > 0) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x))


def hash_embedding(text: Column, dim: int = 16) -> Column:
    """Feature hashing: each token adds a sign at a place of its SHA-256, then unit length.

    A text without ASCII letters or digits counts as one token as a whole.
    """
    low = F.lower(text)
    found = F.regexp_extract_all(low, F.lit("[a-z0-9]+"), F.lit(0))
    tokens = F.when(F.size(found) > 0, found).otherwise(F.array(low))
    # Digests are the fold's collection, so each is taken once a token and not once a coordinate.
    sums = F.transform(tokens, lambda t: F.sha2(t, 256))
    at = F.transform(sums, lambda h: F.struct((F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int").alias("i"), F.when(F.conv(F.substring(h, 9, 2), 16, 10).cast("int") % 2 == 0, F.lit(1.0)).otherwise(F.lit(-1.0)).alias("s")))
    v = F.aggregate(at, F.array_repeat(F.lit(0.0), dim), lambda acc, x: F.transform(acc, lambda y, j: F.when(j == x["i"], y + x["s"]).otherwise(y)))
    # The finish step of a fold sees the vector once, so its norm is not taken for every coordinate.
    zero = F.struct(F.lit(0.0).alias("n"), v.alias("v"))
    return F.aggregate(F.array(zero), F.array().cast("array<double>"), lambda acc, x: x["v"], lambda u: F.transform(F.zip_with(u, F.array_repeat(norm(u), dim), lambda y, n: F.struct(y.alias("y"), n.alias("n"))), lambda p: p["y"] / F.when(p["n"] == 0, F.lit(1.0)).otherwise(p["n"])))
