"""Functions on vectors (arrays of numbers)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Lengths of the windows that the hash embedding counts.
GRAMS = (3, 4, 5)


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision; of vectors of unequal length, over the shorter one."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.when(norm > 1e-12, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))


def fit(v: Column, dim: int) -> Column:
    """Cut or padded with zeros to ``dim`` numbers."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0).cast("float"), dim)), 1, dim)


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))


def hash_grams(c: Column, dim: int) -> Column:
    """``array<struct<at,sign>>``: place and sign of each character window in a hash embedding."""
    s = F.regexp_replace(text.fold(text.tr_lower(c)), r"[^\p{L}\p{N}]", " ")
    hashed = F.transform(text.let(s, _windows), lambda g: F.sha2(g, 256))
    at = lambda h: (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % dim).cast("int")
    sign = lambda h: F.when(F.conv(F.substring(h, 9, 1), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    return F.transform(hashed, lambda h: F.struct(at(h).alias("at"), sign(h).alias("sign")))


def _windows(s: Column) -> Column:
    """All windows of a text that aren't blank."""

    def of(n: int) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) >= n, every).otherwise(F.array().cast("array<string>"))

    return F.filter(F.concat(*map(of, GRAMS)), lambda g: F.trim(g) != "")
