"""SimHash near-duplicates by a generalised pigeonhole (operator 6).

The 64 bits are put in order so that correlated bits are neighbours, and cut into blocks, each with a
threshold of its own.  If the thresholds plus one add up to the radius plus one, two fingerprints
within the radius agree in some block up to its threshold.  Widths and thresholds come from a
dynamic programme on the estimated number of probes and candidates.  Probes that meet a fingerprint
in a block are verified on all 64 bits; links become components.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import stars
from .shared import map_texts, lookup, partitions, staged

SEED = 42
#: Estimated cost of shuffling a probe and of comparing a candidate pair, in the same unit.
PROBE_COST, PAIR_COST = 1.0, 0.02
#: Rows of one slot that are compared in one place; slots with more are split into pairs of tiles.
TILE = 2048
_SAMPLE = 16


def fingerprint(text: str, size: int = 4) -> int:
    """Bit-wise majority of the XXH64 of all word shingles, repeats included."""
    words = text.encode().lower().split()  # of bytes: ASCII letters and ASCII white space only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if n <= size:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - size])).tolist()
    last = (ends[size - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + (1 << 16)], last[k : k + (1 << 16)], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n - size + 1, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``(id, fp)``: the fingerprint as a signed long; null texts count as empty."""

    def step(batch: pa.RecordBatch) -> dict:
        marks = np.array([fingerprint(t or "", size) for t in batch.column(1).to_pylist()], np.uint64)
        return {id_col: batch.column(0), "fp": pa.array(marks.view(np.int64))}

    kind = docs.schema[id_col].dataType.simpleString()
    return map_texts(docs.select(id_col, text_col), text_col, f"`{id_col}` {kind}, fp long", step)


@dataclass(frozen=True)
class Block:
    bits: tuple[int, ...]
    threshold: int

    def values(self, fps: np.ndarray) -> np.ndarray:
        out = np.zeros(len(fps), np.uint64)
        for j, b in enumerate(self.bits):
            out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(j)
        return out

    def masks(self) -> list[int]:
        """All changes of one bit up to the threshold."""
        return [sum(1 << j for j in c) for d in range(1, self.threshold + 1) for c in combinations(range(len(self.bits)), d)]


def bit_order(products: np.ndarray) -> list[int]:
    """Order of bits in which each is followed by the one most correlated with it."""
    size = np.sqrt(np.maximum(np.outer(np.diag(products), np.diag(products)), 1))
    strength = np.abs(products / size)
    np.fill_diagonal(strength, -1)
    left = set(range(64))
    order = [int(np.unravel_index(strength.argmax(), strength.shape)[0])]
    left.remove(order[0])
    while left:
        order.append(max(left, key=lambda b: (strength[order[-1], b], -b)))
        left.remove(order[-1])
    return order


def allocate(n: int, agree: list[float], order: list[int], radius: int, pair_cost: float = PAIR_COST) -> list[Block]:
    """Blocks of least estimated cost whose thresholds plus one add up to ``radius`` plus one.

    ``agree``: for each bit, the share of pairs of fingerprints that agree in it.  A threshold of -1
    (a block that is not probed) is allowed.  State of the programme: bits used, thresholds so far.
    """
    goal = radius + 1
    best: dict[tuple[int, int], tuple[float, tuple[Block, ...]]] = {(0, 0): (0.0, ())}
    for at in range(64):
        for have in range(goal + 1):
            if (at, have) not in best:
                continue
            cost, blocks = best[at, have]
            spread = [1.0]  # of the distance of a pair within the block
            for end in range(at + 1, 65):
                p = agree[order[end - 1]]
                spread = [(spread[d] if d < len(spread) else 0) * p + (spread[d - 1] * (1 - p) if d else 0) for d in range(min(len(spread) + 1, radius + 1))]
                for t in range(-1, goal - have):
                    if t >= end - at:
                        break
                    probes = sum(comb(end - at, d) for d in range(t + 1))
                    new = cost + (n * (1 + probes) * PROBE_COST + n * n / 2 * sum(spread[: t + 1]) * pair_cost if t >= 0 else 0)
                    key = (end, have + t + 1)
                    if key not in best or new < best[key][0]:
                        best[key] = (new, (*blocks, Block(tuple(order[at:end]), t)))
    return [b for b in best[64, goal][1] if b.threshold >= 0]


def plan(classes: DataFrame, radius: int, pair_cost: float = PAIR_COST) -> tuple[int, list[Block]]:
    """Number of fingerprints, and blocks for them.  The driver sees 64 by 64 sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, ones, n = np.zeros((64, 64)), np.zeros(64), 0
        for batch in batches:
            fps = np.ascontiguousarray(batch.column(0).to_numpy(zero_copy_only=False)).view(np.uint64)
            bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += bits.T @ bits
            ones += bits.sum(axis=0)
            n += len(fps)
        where = np.arange(65 * 64)
        yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), pa.array(np.concatenate([total.ravel(), np.r_[n, np.zeros(63)]]))], names=["at", "x"])

    got = classes.select("fp").mapInArrow(run, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).where("at <= 4096").collect()
    flat = np.zeros(4097)
    for r in got:
        flat[r["at"]] = r["x"]
    n, joint = int(flat[4096]), flat[:4096].reshape(64, 64)
    if not n:
        return 0, []
    share = np.diag(joint) / n
    order = bit_order(joint / n - np.outer(share, share))
    return n, allocate(n, (share**2 + (1 - share) ** 2).tolist(), order, radius, pair_cost)


def _slots(fps: DataFrame, blocks: list[Block]) -> DataFrame:
    """A row ``(slot, fp, probe)`` for each block value of a fingerprint and for each probe of it.
    Slots are hashes of the block and the value: a collision costs a comparison, never a link."""
    masks = [np.array(b.masks(), np.uint64) for b in blocks]

    def mixed(block: int, values: np.ndarray) -> np.ndarray:
        h = values + np.uint64((block + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
        return (h ^ (h >> np.uint64(31))).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 4096):
                own = np.ascontiguousarray(batch.column(0).slice(k, 4096).to_numpy(zero_copy_only=False))
                for i, block in enumerate(blocks):
                    values = block.values(own.view(np.uint64))
                    near = (values[:, None] ^ masks[i][None, :]).ravel()
                    slot = mixed(i, np.concatenate([values, near]))
                    probe = np.arange(len(slot)) >= len(values)
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.concatenate([own, np.repeat(own, len(masks[i]))])), pa.array(probe)], names=["slot", "fp", "probe"])

    return fps.select("fp").mapInArrow(run, "slot long, fp long, probe boolean")


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges a-b: each node that is not the smallest of its component, and that smallest one."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    moved = root != np.arange(len(nodes))
    return nodes[moved], nodes[root[moved]]


def _links_of(slot: np.ndarray, fp: np.ndarray, probe: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rows of each slot, as stars: every two rows of a slot of which at least one is
    not a probe are compared, but only a forest of the links leaves."""
    order = np.lexsort((probe, slot))
    slot, fp, probe = slot[order], fp[order], probe[order]
    new = np.r_[True, slot[1:] != slot[:-1]]
    starts = np.flatnonzero(new)
    sizes = np.diff(np.r_[starts, len(slot)])
    keep = np.repeat((sizes > 1) & ~probe[starts], sizes)
    slot, fp, probe = slot[keep], fp[keep], probe[keep]
    found: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def add(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal held
        if len(a):
            found.append((a, b))
            held += len(a)
            if held > 1 << 20:
                merged = _roots(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                found[:] = [merged]
                held = len(merged[0])

    if len(slot):
        starts = np.flatnonzero(np.r_[True, slot[1:] != slot[:-1]])
        sizes = np.diff(np.r_[starts, len(slot)])
        large = sizes > 48
        small = np.repeat(~large, sizes)
        s, f, p = slot[small], fp[small], probe[small]
        for d in range(1, 48):
            i = np.flatnonzero((s[:-d] == s[d:]) & ~p[:-d]) if len(s) > d else ()
            if not len(i):
                break
            near = np.bitwise_count(f[i].view(np.uint64) ^ f[i + d].view(np.uint64)) <= radius
            add(f[i][near], f[i + d][near])
        for start, n in zip(starts[large].tolist(), sizes[large].tolist(), strict=True):
            whole, own = fp[start : start + n], fp[start : start + n][~probe[start : start + n]]
            for k in range(0, len(own), 256):
                i, j = np.nonzero(np.bitwise_count(own[k : k + 256, None].view(np.uint64) ^ whole[None, :].view(np.uint64)) <= radius)
                add(own[k + i], whole[j])
    if not found:
        none = np.empty(0, np.int64)
        return none, none
    a, b = (np.concatenate([x[k] for x in found]) for k in (0, 1))
    return _roots(a[a != b], b[a != b])


def links(classes: DataFrame, radius: int = 4) -> DataFrame:
    """``(u, v)``: links whose components are those of all pairs of fingerprints within ``radius``.

    ``classes`` has each fingerprint once (``fp``).  Slots with many rows are found on a sample of
    the fingerprints (which sets cost, never results) and split into pairs of tiles, so no slot's
    rows meet in one task; fewer than 65,536 slots can be split, whatever the input.
    """
    n, blocks = plan(classes, radius)
    rows = _slots(classes, blocks)
    if not n:
        return rows.selectExpr("fp u", "fp v")
    emitted = n * sum(1 + len(b.masks()) for b in blocks)
    many = max(TILE, emitted // 65_536)
    sample = _slots(classes.where(F.pmod(F.xxhash64("fp"), F.lit(_SAMPLE)) == 0), blocks)
    hot = sample.groupBy("slot").count().where(F.col("count") >= many // _SAMPLE)
    hot = staged(hot.select("slot", F.ceil(F.col("count") * _SAMPLE / TILE).cast("int").alias("tiles")), "hot-slots")
    tile = F.pmod(F.xxhash64("fp"), F.col("tiles")).cast("int")
    other = F.explode(F.when(F.col("tiles").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("tiles") - 1)))
    rows = rows.join(F.broadcast(hot), "slot", "left").withColumn("tile", tile).withColumn("other", other)
    rows = rows.select(F.when(F.col("tiles").isNull(), F.col("slot")).otherwise(F.xxhash64("slot", F.least("tile", "other"), F.greatest("tile", "other"))).alias("slot"), "fp", "probe")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if held:
            u, v = _links_of(*(np.concatenate([h[k] for h in held]) for k in range(3)), radius)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return rows.repartition(partitions(classes.sparkSession), "slot").mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = 4, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, similar: float | None = None) -> DataFrame:
    """``(id, fingerprint, component_id)``: 16 hex digits, and the smallest id that links lead to.

    Null and empty texts have the fingerprint zero and link like others; a null id takes part but
    is no component's id unless all its ids are null; repeated rows each give a row; other columns
    are not read; an empty table gives an empty result.  Exact copies fall together before the
    search, so a group of copies costs one fingerprint.

    With ``similar`` (and shingles of five words) pairs of at least that Jaccard similarity link, and
    there is no ``fingerprint``.  At 0.8, 9.7 of 64 bits differ on average and over 20 may, so there
    the blocks are of several fingerprints and links are verified by their shingles (``similar.py``).
    """
    if similar is not None:
        from . import similar as alike  # which uses this module's index

        if shingle != alike.SHINGLE:
            raise ValueError(f"similarity is of shingles of {alike.SHINGLE} words")
        return alike.groups(docs, id_col, text_col, similar)
    marks = staged(fingerprints(docs.select(F.col(id_col).alias("id"), text_col), "id", text_col, shingle), "simhash")
    classes = staged(marks.groupBy("fp").agg(F.min("id").alias("first_id"), F.count("*").alias("copies")), "simhash-classes")
    total = marks.count()
    trees = stars(staged(links(classes, radius), "simhash-links"))
    linked = classes.join(trees, classes.fp == trees.u, "left").select("fp", "first_id", "copies", F.coalesce("root", "fp").alias("root"))
    linked = staged(linked, "simhash-members")
    least = linked.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("members"))
    told = lookup(linked.select("fp", "copies", "root"), "root", least, "members", total)
    out = lookup(marks, "fp", staged(told.select("fp", "copies", "component_id"), "simhash-components"), "copies", total)
    return out.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def brute(rows: list[tuple], radius: int = 4) -> list[tuple]:
    """The same by comparing all pairs; for tests."""
    marks = [fingerprint(t or "") for _, t in rows]
    group = list(range(len(rows)))

    def top(i: int) -> int:
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (marks[i] ^ marks[j]).bit_count() <= radius:
                a, b = top(i), top(j)
                group[max(a, b)] = min(a, b)
    ids: dict[int, list] = {}
    for i, (key, _) in enumerate(rows):
        ids.setdefault(top(i), []).append(key)
    return [(key, f"{marks[i]:016x}", min((x for x in ids[top(i)] if x is not None), default=None)) for i, (key, _) in enumerate(rows)]
