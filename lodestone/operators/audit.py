"""Hash-chained audit log."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Fixed value: what the first record of a chain follows.
GENESIS = "GENESIS"
FIELDS = ("id", "at", "actor", "action", "subject", "detail")


def payload() -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("")) for f in FIELDS])


def append(events: DataFrame, chain: str = "actor", order: str = "seq") -> DataFrame:
    """``events`` with ``prev_hash`` and ``hash``; each chain is folded in order by one task, row by
    row.  A chain is sequential by its nature; many chains (one an actor) run side by side."""
    rows = events.withColumn("__payload", payload())
    out = rows.schema.add("prev_hash", "string").add("hash", "string")

    def fold(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, before = None, GENESIS
        for part in parts:
            prev, own = [], []
            for key, value in zip(part[chain], part["__payload"], strict=True):
                if key != last:
                    last, before = key, GENESIS
                prev.append(before)
                before = hashlib.sha256(f"{before}|{value}".encode()).hexdigest()
                own.append(before)
            yield part.assign(prev_hash=prev, hash=own)

    dealt = rows.repartition(F.col(chain)).sortWithinPartitions(chain, order)
    return dealt.mapInPandas(fold, out).drop("__payload")


def verify(log: DataFrame, chain: str = "actor", order: str = "seq") -> DataFrame:
    """``(chain, records, first_broken)``: place of the first record whose link or own hash is wrong,
    or null.  Links are compared side by side; nothing is folded."""
    w = Window.partitionBy(chain).orderBy(order)
    good = (F.col("prev_hash") == F.lag("hash", 1, GENESIS).over(w)) & (F.col("hash") == F.sha2(F.concat(F.col("prev_hash"), F.lit("|"), payload()), 256))
    told = log.withColumn("place", F.row_number().over(w)).withColumn("good", good)
    return told.groupBy(chain).agg(F.count("*").alias("records"), F.min(F.when(~F.col("good"), F.col("place"))).alias("first_broken"))


def recent(log: DataFrame, n: int = 200, order: str = "seq") -> DataFrame:
    """The last ``n`` records as JSON, newest first."""
    return log.orderBy(F.desc(order)).limit(n).select(order, F.to_json(F.struct(*[c for c in log.columns if c != order])).alias("record"))
