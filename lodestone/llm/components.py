"""Connected components of a graph whose edges are a table: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lookup, staged

#: A node with over one in this many of all edges is looked up by broadcast.
SLOTS = 512


def _hooked(edges: DataFrame, small: bool) -> DataFrame:
    """One star step on edges ``(u, v)`` with u > v: every node's neighbours meet its smallest one."""
    both = edges if small else edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
    total = edges.count() * (1 if small else 2)
    told = lookup(both, "u", least, "n", total, SLOTS)
    if small:
        out = told.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
    else:
        out = told.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return out.where("u <> v").distinct()


def stars(edges: DataFrame) -> DataFrame:
    """``(u, root)`` for each node that isn't the smallest of its component.

    ``edges`` has bigint columns ``u`` and ``v`` (either order, repeats and loops allowed).  Each
    round is written to the shared folder in place of the one before; the number of rounds is logarithmic in the longest path.
    """
    now = staged(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "stars")
    mark = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
    before = mark(now)
    while before[0]:
        large = staged(_hooked(now, small=False), "stars", now)
        now = staged(_hooked(large, small=True), "stars", large)
        after = mark(now)
        if after == before:
            break
        before = after
    return now.select("u", F.col("v").alias("root"))
