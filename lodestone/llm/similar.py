"""Groups of documents whose shingles of five words have a Jaccard similarity of 0.8 or more.

The index is operator 6's: SimHash fingerprints of the shingles, bits in an order that makes
correlated ones neighbours, blocks and thresholds by its dynamic programme, probes.  One fingerprint
of 64 bits can't do it: at the similarity 9.7 bits differ on average and over 20 may, while of all
pairs of different texts some 3 % are within 24.  So a document has several fingerprints of
independent bits, as many as it takes that a pair at the similarity agrees in a block up to its
threshold in one of them.  Rows that meet are verified on 256 bits where they meet, and what is left
by the exact similarity of the whole sets of shingles.  Documents of one set are one class.  A class
is first linked to one other of the slot only; classes that these links leave in different groups
then meet in all pairs, so a group of near copies costs a star and no pair that could join two
groups is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import acos, ceil, comb, log, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stars
from .shared import lookup, map_texts, partitions, released, staged
from .simhash import TILE, Block, allocate, plan

#: Words in a shingle, and the Jaccard similarity of a pair.
SHINGLE, SIMILAR = 5, 0.8
#: Probability that a pair at the similarity meets in no block of any fingerprint; more similar pairs
#: have less.
MISSED = 1e-6
#: Bits of a fingerprint's index that may differ without loss, of which the cheapest is taken, and
#: what comparing a pair costs, if shuffling a row costs 1.
RADII, PAIR_COST = range(3, 9), 0.001
#: Fingerprints of 64 bits on which pairs are verified where they meet.
SKETCH = 4
#: Sets of so many shingles also meet by their parts of one shingle less: so few votes a bit differ more often.
FEW = 5
#: Marks of texts in candidate pairs that are broadcast at most (of 16 bytes each), so that only their
#: sets of shingles move; if there are more, all sets are shuffled.
BROADCAST_ROWS = 500_000
SEED = 42
_SAMPLE = 16

_WORD = re.compile(r"[^\W_]+")
_GOLDEN = 0x9E3779B97F4A7C15


def shingles(text: str) -> np.ndarray:
    """Hashes of the distinct runs of five words, sorted; of all words, if there are fewer."""
    words = [w.encode() for w in _WORD.findall(text.lower())]
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= SHINGLE:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE])).tolist()
    last = (ends[SHINGLE - 1 :] - 1).tolist()
    return np.unique(np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, last, strict=True)), np.uint64, len(starts)))


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def prints(own: np.ndarray, words: int) -> np.ndarray:
    """SimHash of a set: bit-wise majorities of ``words`` times 64 independent bits of each shingle."""
    salts = np.random.default_rng(SEED).integers(0, 1 << 64, words, np.uint64)
    ones = np.zeros(words * 64, np.int64)
    for k in range(0, len(own), 255):
        h = _mixed(own[k : k + 255, None] ^ salts)
        ones += np.unpackbits(h.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(own), bitorder="little").view(np.uint64)


def slots(own: np.ndarray) -> np.ndarray:
    """Slots of a row's block values; a collision costs a comparison, never a link."""
    return _mixed(own)


def differing(similar: float) -> float:
    """Probability that a bit of two sets of the similarity differs: their angle over pi."""
    return acos(min(2 * similar / (1 + similar), 1.0)) / pi


def _met(blocks: list[Block], p: float) -> float:
    """Of a pair, of which a bit differs with probability ``p``: the negative logarithm of the
    probability that it meets in none of the blocks."""
    return -sum(log(1 - sum(comb(len(b.bits), d) * p**d * (1 - p) ** (len(b.bits) - d) for d in range(min(b.threshold, len(b.bits) - 1) + 1))) for b in blocks)


def index_size(n: int, similar: float = SIMILAR) -> tuple[int, int]:
    """Number of fingerprints, and the radius within which each one's blocks lose no pair, of least
    estimated cost."""
    best = []
    for radius in RADII:
        blocks = allocate(n, [0.5] * 64, list(range(64)), radius, PAIR_COST)
        words = ceil(-log(MISSED) / _met(blocks, differing(similar)))
        values = [sum(comb(len(b.bits), d) for d in range(b.threshold + 1)) for b in blocks]
        best.append((words * sum(v + n / 2 * v / 2 ** len(b.bits) * PAIR_COST for v, b in zip(values, blocks, strict=True)), words, radius))
    return min(best)[1:]


def sketch_radius(similar: float = SIMILAR) -> int:
    """Bits of the sketch in which a pair may differ: six deviations over the mean, a bit of small
    sets counted as differing a quarter more often."""
    p, n = min(1.25 * differing(similar), 0.5), 64 * SKETCH
    return ceil(n * p + 6 * sqrt(n * p * (1 - p)))


def _sets(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(id, mark, n, shingles, prints, parts)``; texts of one set have one mark."""

    def parts(s: np.ndarray) -> bytes:
        if not 0 < len(s) <= FEW:
            return b""
        return np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in (s, *(np.delete(s, i) for i in range(len(s)))) if len(x)], np.uint64).tobytes()

    def step(batch: pa.RecordBatch) -> dict:
        sets = [shingles(t or "") for t in batch.column(1).to_pylist()]
        marks = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64)
        return {
            "id": batch.column(0), "mark": pa.array(marks.view(np.int64)), "n": pa.array([len(s) for s in sets], pa.int32()),
            "shingles": pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int32), pa.array(np.concatenate(sets).view(np.int64))).cast(pa.list_(pa.field("element", pa.int64()))),
            "prints": pa.ListArray.from_arrays(np.arange(0, len(sets) * words + 1, words, np.int32), pa.array(np.concatenate([prints(s, words) for s in sets]).view(np.int64))).cast(pa.list_(pa.field("element", pa.int64()))), "parts": pa.array([parts(s) for s in sets], pa.binary()),
        }

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(F.col(id_col).alias("id"), text_col), text_col, f"id {kind}, mark long, n int, shingles array<bigint>, prints array<bigint>, parts binary", step)


def _blocks(classes: DataFrame, words: int, radius: int) -> list[list[Block]]:
    """Blocks of each fingerprint, by operator 6's plan for its own correlations and shares of bits."""
    return [plan(classes.select(F.col("prints")[w].alias("fp")), radius, PAIR_COST)[1] for w in range(words)]


_FIELDS = "slot long, mark long, n int, root long, " + ", ".join(f"s{i} long" for i in range(SKETCH))


def _index(classes: DataFrame, blocks: list[list[Block]]) -> DataFrame:
    """A row ``(slot, mark, n, root, s0, ...)`` for each block value of a class, and for each probe
    of it; s0 and so on: its sketch."""
    flat = [(w, b, np.array([0, *b.masks()], np.uint64)) for w, own in enumerate(blocks) for b in own]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                piece = batch.slice(k, 1024)
                fps = piece.column(3).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(piece.num_rows, -1)
                values = [(b.values(fps[:, w])[:, None] ^ masks) + np.uint64((i + 1) * _GOLDEN & (1 << 64) - 1) for i, (w, b, masks) in enumerate(flat)]
                values = np.concatenate(values, axis=1) if values else np.empty((len(fps), 0), np.uint64)
                held = [np.concatenate([slots(v), np.frombuffer(p, np.uint64)]) for v, p in zip(values, piece.column(4).to_pylist(), strict=True)]
                many = [len(h) for h in held]
                same = [np.repeat(piece.column(i).to_numpy(zero_copy_only=False), many) for i in range(3)]
                sketch = [np.repeat(fps[:, i].view(np.int64), many) for i in range(SKETCH)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(held).view(np.int64), *same, *sketch)], names=["slot", "mark", "n", "root", *[f"s{i}" for i in range(SKETCH)]])

    return classes.select("mark", "n", "root", "prints", "parts").mapInArrow(released(run), _FIELDS)


def _near(slot: np.ndarray, mark: np.ndarray, n: np.ndarray, root: np.ndarray, sketch: np.ndarray, similar: float, radius: int, every: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of marks in one slot whose sizes and sketches fit: the first partner of each row in the
    order of sizes (so that each row that fits another is in a pair), or ``every`` pair of different
    roots."""
    order = np.lexsort((mark, n, slot))
    slot, mark, n, root, sketch = slot[order], mark[order], n[order], root[order], sketch[:, order]
    starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
    sizes = np.diff(np.r_[starts, len(slot)])
    for start, size in zip(starts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
        own, tree, at, marks = n[start : start + size], root[start : start + size], sketch[:, start : start + size], mark[start : start + size]
        until = np.searchsorted(own, own / (similar - 1e-9), side="right")
        free, unpaired = np.ones(size, bool), np.ones(size, bool)  # of an earlier partner, of any
        for k in range(0, size, 64):
            to = int(until[min(k + 64, size) - 1])
            js = np.arange(k + 1, to)
            if not len(js):
                continue
            i = np.arange(k, min(k + 64, size))
            apart = np.zeros((len(i), len(js)), np.uint16)
            for word in at:
                apart += np.bitwise_count(word[i, None] ^ word[None, js])
            near = (apart <= radius) & (i[:, None] < js) & (js < until[i, None]) & (marks[i, None] != marks[None, js])
            if every:
                a, b = np.nonzero(near & (tree[i, None] != tree[None, js]))
            else:
                b = np.flatnonzero(near.any(axis=0) & free[js])
                a = near[:, b].argmax(axis=0)
                free[js[b]] = unpaired[js[b]] = unpaired[i[a]] = False
                alone = np.flatnonzero(near.any(axis=1) & unpaired[i])
                a, b = np.r_[a, alone], np.r_[b, near[alone].argmax(axis=1)]
                unpaired[i[alone]] = False
            if len(a):
                yield marks[i[a]], marks[js[b]]


def candidates(classes: DataFrame, blocks: list[list[Block]], similar: float, every: bool) -> DataFrame:
    """``(u, v)``: pairs of classes ``(mark, n, root, prints, parts)`` that meet in a slot and may be
    similar enough; see ``_near``.  Slots with many rows, found on a sample (which sets cost, never
    results), are split into pairs of tiles as in operator 6."""
    spark, radius = classes.sparkSession, sketch_radius(similar)
    rows = _index(classes, blocks)
    many = max(TILE, classes.count() * sum(1 + len(b.masks()) for own in blocks for b in own) // 65_536)
    hot = _index(classes.where(F.pmod(F.xxhash64("mark"), F.lit(_SAMPLE)) == 0), blocks).groupBy("slot").count().where(F.col("count") >= many // _SAMPLE)
    hot = staged(hot.select("slot", F.ceil(F.col("count") * _SAMPLE / TILE).cast("int").alias("tiles")), "hot-slots")
    tile = F.pmod(F.xxhash64("mark"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rest = [c for c in rows.columns if c != "slot"]
    rows = rows.join(F.broadcast(hot), "slot", "left").withColumn("tile", tile).withColumn("other", other)
    rows = rows.select(F.when(F.col("tiles").isNull(), F.col("slot")).otherwise(F.xxhash64("slot", F.least("tile", "other"), F.greatest("tile", "other"))).alias("slot"), *rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        slot, mark, n, root, *sketch = (np.concatenate([h[k] for h in held]) for k in range(4 + SKETCH))
        del held
        found: list[np.ndarray] = []
        size = 0
        for u, v in _near(slot, mark, n, root, np.stack(sketch).view(np.uint64), similar, radius, every):
            found.append(np.stack([np.maximum(u, v), np.minimum(u, v)], axis=1))
            size += len(u)
            if size >= 1 << 18:
                both = np.unique(np.concatenate(found), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])
                found, size = [], 0
        if found:
            both = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["u", "v"])

    return rows.repartition(partitions(spark), "slot").mapInArrow(released(run), "u long, v long")


def _alike(pairs: DataFrame, rows: DataFrame, similar: float) -> DataFrame:
    """``(u, v)``: the pairs ``(u, v)`` whose sets of shingles are similar enough."""
    pairs = staged(pairs.distinct(), "similar-pairs")
    total = 2 * pairs.count()
    ends = staged(pairs.select(F.explode(F.array("u", "v")).alias("mark")).groupBy("mark").agg(F.count("*").alias("times")), "similar-ends")
    few = ends.count() <= BROADCAST_ROWS
    sets = rows.select("mark", "shingles").join(F.broadcast(ends) if few else ends, "mark").groupBy("mark").agg(F.first("shingles").alias("shingles"), F.first("times").alias("times"))
    sets = staged(sets, "similar-sets")
    for end in ("u", "v"):
        pairs = lookup(pairs, end, sets.select(F.col("mark").alias(end), F.col("shingles").alias(f"of_{end}"), F.col("times").alias(f"times_{end}")), f"times_{end}", total)
    common = F.size(F.array_intersect("of_u", "of_v"))
    return pairs.where(common >= (F.size("of_u") + F.size("of_v") - common) * F.lit(similar)).select("u", "v")


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR) -> DataFrame:
    """``(id, component_id)``: the smallest id that pairs of at least ``similar`` lead to.

    Words are runs of letters and digits in lower case; texts without a word are alike.  A null id
    takes part but is no component's id unless all its ids are null; repeated rows each give a row.
    """
    words, radius = index_size(docs.count(), similar)
    words = max(words, SKETCH)
    rows = staged(_sets(docs, id_col, text_col, words), "similar-rows")
    n_rows = rows.count()
    # Texts without a word are one class already.
    distinct = staged(rows.where("n > 0").groupBy("mark").agg(*[F.first(c).alias(c) for c in ("n", "prints", "parts")]).withColumn("root", F.col("mark")), "similar-distinct")
    blocks = _blocks(distinct, words, radius)
    met = staged(candidates(distinct, blocks, similar, every=False), "similar-met")
    first = staged(_alike(met, rows, similar), "similar-links")

    # Classes that met one and are not linked yet meet in all pairs.
    trees = stars(first)
    ends = met.select(F.explode(F.array("u", "v")).alias("mark")).distinct()
    left = distinct.drop("root").join(ends, "mark", "left_semi").join(trees.withColumnRenamed("u", "mark"), "mark", "left")
    left = staged(left.withColumn("root", F.coalesce("root", "mark")), "similar-left")
    second = staged(_alike(candidates(left, blocks, similar, every=True), rows, similar), "similar-links")

    trees = stars(staged(first.unionByName(second), "similar-links"))
    classes = staged(rows.groupBy("mark").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")), "similar-classes")
    linked = classes.join(trees, classes.mark == trees.u, "left").select("mark", "first_id", "copies", F.coalesce("root", "mark").alias("root"))
    linked = staged(linked, "similar-linked")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    told = lookup(linked.select("mark", "copies", "root"), "root", least, "members", n_rows)
    out = lookup(rows.select("id", "mark"), "mark", staged(told.select("mark", "copies", "component_id"), "similar-components"), "copies", n_rows)
    return out.select(F.col("id").alias(id_col), "component_id")


def brute(rows: list[tuple], similar: float = SIMILAR) -> list[tuple]:
    """The same by comparing all pairs of word tuples; for tests."""
    sets = []
    for _, t in rows:
        w = _WORD.findall((t or "").lower())
        sets.append({tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set())
    group = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) / len(a | b) >= similar:
                low, high = sorted((group[i], group[j]))
                group = [low if g == high else g for g in group]
    ids: dict[int, list] = {}
    for g, (key, _) in zip(group, rows, strict=True):
        ids.setdefault(g, []).append(key)
    return [(key, min((x for x in ids[g] if x is not None), default=None)) for g, (key, _) in zip(group, rows, strict=True)]
