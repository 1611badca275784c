"""Quartile bucket digests (operator 3).

Hashed byte triplets are counted in buckets; each bucket is written as the quartile its count falls
in, beside a code for the length.  Two digests are compared by a bounded difference score.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _arrow_schema, partitions, slices

BUCKETS = 256
#: Which bytes of a sliding window make up a triplet.
TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3))
_WINDOW = 4
#: A bucket's difference by the distance of its two quartiles; opposite ends count double.
_STEP = np.array([0, 1, 2, 6], np.int64)
#: Two independent texts differ by this much on average; more counts as no likeness at all.
BOUND = BUCKETS * 1.625
#: A length code is this many steps to a doubling.
_PER_DOUBLING = 4
_LENGTH_WEIGHT = 2


def buckets(data: np.ndarray) -> np.ndarray:
    """Bucket numbers of all triplets that start at each byte, one row a kind of triplet."""
    wide = data.astype(np.uint32)
    n = max(0, len(data) - _WINDOW + 1)
    out = np.empty((len(TRIPLETS), n), np.uint8)
    for k, (a, b, c) in enumerate(TRIPLETS):
        h = wide[a : a + n] * np.uint32(0x9E3779B1)
        h += wide[b : b + n] * np.uint32(0x85EBCA77)
        h ^= h >> np.uint32(15)
        h += wide[c : c + n] * np.uint32(0xC2B2AE3D)
        h += np.uint32((k * 0x27D4EB2F) & 0xFFFFFFFF)
        h ^= h >> np.uint32(13)
        h *= np.uint32(0x2C1B3C6D)
        out[k] = h >> np.uint32(24)
    return out


def codes(counts: np.ndarray) -> np.ndarray:
    """Quartile (0 to 3) of each bucket's count among all buckets."""
    ranked = np.sort(counts)
    cuts = ranked[[BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1]]
    return np.searchsorted(cuts, counts, side="left").astype(np.uint8)


def length_code(n: int) -> int:
    return min(255, round(_PER_DOUBLING * math.log2(n + 1)))


def digest(data: bytes) -> bytes:
    """The length code, then four quartiles to a byte.  Texts under four bytes have no triplets."""
    found = buckets(np.frombuffer(data, np.uint8))
    counts = np.bincount(found.ravel(), minlength=BUCKETS)
    q = codes(counts).reshape(-1, 4)
    packed = q[:, 0] | q[:, 1] << 2 | q[:, 2] << 4 | q[:, 3] << 6
    return bytes([length_code(len(data))]) + packed.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """1 for equal digests, down to 0 at ``BOUND`` or more."""
    if a == b:
        return 1.0
    p, q = np.frombuffer(a, np.uint8)[1:], np.frombuffer(b, np.uint8)[1:]
    total = _LENGTH_WEIGHT * abs(a[0] - b[0])
    for shift in (0, 2, 4, 6):
        total += int(_STEP[np.abs(((p >> shift) & 3).astype(np.int8) - ((q >> shift) & 3).astype(np.int8))].sum())
    return 1.0 - min(total, BOUND) / BOUND


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fingerprint)``: the digest of each text in hex; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            marks = [digest((t or "").encode()).hex() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.string())], schema=arrow)

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, fingerprint string").schema
    arrow = _arrow_schema(out)
    return docs.select(id_col, text_col).mapInArrow(run, out)


#: Stands for a null id: it comes last in descending order.
_LOWEST = -(1 << 63)


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of ``bounds`` (in descending order) are above ``key``: a binary search."""
    depth = max(1, len(bounds).bit_length())
    padded = bounds + [_LOWEST] * ((1 << depth) - len(bounds))
    table = F.lit(padded).cast("array<bigint>")
    steps = F.array(*[F.lit(1 << s) for s in reversed(range(depth))])
    return F.aggregate(
        steps, F.lit(0), lambda low, s: F.when((low + s <= len(padded)) & (F.element_at(table, F.least(low + s, F.lit(len(padded)))) > key), low + s).otherwise(low)
    )


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digest of each text, of its edited text, and how alike they and the next text's are.

    The next document is the one with the next smaller id; after the smallest comes the largest.
    The edited text has its last ``n_chars // 3`` code points replaced by the first as many of the
    next text (all, if it has fewer).  Null texts count as empty; a null id comes last; rows with
    equal ids follow in the order of their texts; an only row is its own next one; an empty table
    gives an empty result; other columns are not read.

    Texts move once, dealt by quantiles of the id into as many partitions as the session shuffles
    to, so partitions are even whatever the ids; each partition also gets the first row of the next
    one.  The driver sees one id a partition.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.coalesce(F.col("id").cast("long"), F.lit(_LOWEST)))
    ids = rows.select("key")
    cuts = ids.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 100 * n)).head()[0] if n > 1 else []
    bounds = sorted(set(cuts or []), reverse=True)
    heads = sorted(map(tuple, ids.groupBy(_place(F.col("key"), bounds).alias("place")).agg(F.max("key")).collect()))
    first, before = [None] * (len(bounds) + 1), [0] * (len(bounds) + 1)
    for i, (place, key) in enumerate(heads):
        first[place], before[place] = key, heads[i - 1][0]
    placed = rows.withColumn("place", _place(F.col("key"), bounds))
    heads_of = F.get(F.lit(first).cast("array<bigint>") if heads else F.array().cast("array<bigint>"), F.col("place"))
    own = F.struct("place", F.lit(False).alias("ahead"))
    early = F.struct(F.get(F.lit(before).cast("array<int>"), F.col("place")).alias("place"), F.lit(True).alias("ahead"))
    both = F.when(heads_of == F.col("key"), F.array(own, early)).otherwise(F.array(own))
    dealt = placed.withColumn("to", F.explode(both)).select("id", "text", "key", F.col("to.place").alias("place"), F.col("to.ahead").alias("ahead"))
    dealt = dealt.repartitionById(len(bounds) + 1, F.col("place")).sortWithinPartitions(
        "place", "ahead", F.desc("key"), "text"
    )
    out = spark.createDataFrame(
        [], f"`{id_col}` {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    ).schema
    arrow = _arrow_schema(out)

    def finish(held: tuple, then: tuple) -> tuple:
        (key, text, mark), (_, following, after) = held, then
        cut = len(text) // 3
        edited = (text[: len(text) - cut] + following[:cut]).encode()
        other = digest(edited)
        return key, len(text), hashlib.sha256(edited).hexdigest(), mark.hex(), other.hex(), likeness(mark, other), likeness(mark, after)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, place, closed = None, None, True
        for batch in slices(batches, "text"):
            done = []
            for key, text, at, ahead in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3, 4)), strict=True):
                if at != place:
                    held, place, closed = None, at, False
                if closed:
                    continue  # copies of the row that closed this place
                row = (key, text, digest(text.encode()))
                if held is not None:
                    done.append(finish(held, row))
                held, closed = row, ahead
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True) if done else [[]] * len(arrow), arrow, strict=True)], schema=arrow)

    return dealt.select("id", "text", "key", "place", "ahead").mapInArrow(run, out)


def brute(rows: list[tuple]) -> list[tuple]:
    """The same on the driver; for tests."""
    order = sorted(((_LOWEST if i is None else i, t or "", i) for i, t in rows), key=lambda r: (-r[0], r[1]))
    out = []
    for k, (_, text, key) in enumerate(order):
        following = order[(k + 1) % len(order)][1]
        cut = len(text) // 3
        edited = text[: len(text) - cut] + following[:cut]
        marks = [digest(x.encode()) for x in (text, edited, following)]
        out.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest(), marks[0].hex(), marks[1].hex(), likeness(marks[0], marks[1]), likeness(marks[0], marks[2])))
    return out
