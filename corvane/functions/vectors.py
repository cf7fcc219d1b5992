"""Hash embeddings and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 384


def bucket(token: Column) -> Column:
    """The first four bytes of the token's SHA-256, as a number modulo the dimensions."""
    return F.conv(F.substring(F.sha2(token, 256), 1, 8), 16, 10).cast("bigint") % DIMENSIONS


def tally(values: Column) -> Column:
    """Distinct values of an array without nulls, with their numbers, as structs (x, n); null for a null array."""

    def of(s: Column) -> Column:
        ends = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == F.size(s)) | (F.get(s, i) != F.get(s, i - 1)))
        runs = lambda e: F.transform(e, lambda i, k: F.struct(F.get(s, i - 1).alias("x"), (i - F.coalesce(F.get(e, k - 1), F.lit(0))).cast("bigint").alias("n")))
        return F.get(F.transform(F.array(ends), runs), 0)

    return F.when(F.size(values) > 0, F.get(F.transform(F.array(F.sort_array(values)), of), 0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Zero where either vector is."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(0.0)
