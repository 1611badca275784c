"""Hidden Markov language model (operator 2).

A token is emitted in two steps: a hidden state emits a word class, and the class emits the token by
its smoothed share of the class.  Frequent words are classes of their own; the others are classed by
a hash of their last bytes.  So the numbers that Baum-Welch re-estimates don't grow with the
vocabulary, while every word of the corpus has its count.  Expected counts are summed over
partitions; a scaled forward recursion gives the exact likelihood of a text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, partitions, slices, staged

#: Hidden states, and classes of rare words.
STATES = 8
TAILS = 2048
#: Words with at least this share of the training tokens are classes of their own; so are some with
#: half of it or more, which makes at most 2 / ``FREQUENT`` such classes.
FREQUENT = 1 / 250_000
#: and no word with fewer training tokens is one, since its states could not be told.
LEAST = 50
#: Baum-Welch first goes once through the training rows in this many parts, dealt by a hash of the
#: row, with a new model after each part; then this many times through all of them.
PARTS, ROUNDS = 12, 3
#: What the counts of the parts before weigh beside those of a part.
KEPT = 0.5
#: Added to each count of a token; to expected counts of classes (by the class's share) and states.
ADD = 0.1
_CLASS_PRIOR, _MOVE_PRIOR = 500.0, 1.0
#: Sequences that are worked on together, step by step.
LANES = 2048

_WHITE = np.zeros(256, bool)
_WHITE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    known = _powers.get(base)
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = np.cumprod(known)
        _powers[base] = known
    return known[:n]


def _mixed(h: np.ndarray) -> np.ndarray:
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    return h ^ (h >> np.uint64(31))


def tokens(texts: list[str], between: np.ndarray = _WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words of some texts: 64-bit hash of each, hash of its last four bytes, and how many each
    text has.  ASCII letters count as lower case; the bytes of ``between`` (ASCII white space) separate.  A word is known by
    its hash: among a billion words, two share one with a chance of 3 percent."""
    data = [t.encode() for t in texts]
    joined = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    low = _LOWER[joined]
    inside = ~between[joined]
    edges = np.diff(np.concatenate(([0], inside.view(np.int8))))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    n = len(joined)
    # A polynomial in a base with an inverse: differences of running sums, moved to a common power.
    run = np.cumsum((low.astype(np.uint64) + np.uint64(1)) * _power(_INVERSE, n))
    run = np.concatenate((np.zeros(1, np.uint64), run))
    hashes = _mixed((run[end] - run[start]) * _power(_BASE, n + 1)[end] + (end - start).astype(np.uint64))
    near = np.maximum(start, end - 4)
    tails = _mixed((run[end] - run[near]) * _power(_BASE, n + 1)[end] + np.uint64(7))
    stops = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 1)
    counts = np.diff(np.concatenate(([0], np.searchsorted(start, stops))))
    return hashes, tails, counts


@dataclass
class Classes:
    """Hashes of the frequent words, in order."""

    hashes: np.ndarray

    @property
    def size(self) -> int:
        return len(self.hashes) + TAILS + 1  # the last is the end of a text

    @property
    def kind(self) -> str:
        return "<u2" if self.size <= 1 << 16 else "<i4"

    def of(self, hashes: np.ndarray, tails: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Class of each word, and whether it is a frequent one."""
        tail = len(self.hashes) + (tails % np.uint64(TAILS)).astype(np.int64)
        if not len(self.hashes):
            return tail, np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = self.hashes[at] == hashes
        return np.where(same, at, tail), same


class Summary:
    """Frequent words of a stream: counts that are at most ``seen * FREQUENT / 4`` too low."""

    def __init__(self, keep: int):
        self.keep, self.seen, self.held = keep, 0, []
        self.words, self.counts = np.empty(0, np.uint64), np.empty(0, np.int64)

    def add(self, hashes: np.ndarray) -> None:
        self.seen += len(hashes)
        self.held.append(np.unique(hashes, return_counts=True))
        if len(self.held) == 8:
            self.merge()

    def merge(self) -> None:
        self.words, self.counts = _merged([(self.words, self.counts), *self.held])
        self.held = []
        if len(self.words) > self.keep:
            least = np.partition(self.counts, len(self.counts) - self.keep - 1)[len(self.counts) - self.keep - 1]
            more = self.counts > least
            self.words, self.counts = self.words[more], self.counts[more] - least


def frequent(train: DataFrame, text_col: str) -> Classes:
    """The words that are classes of their own.

    Each task sends those of its summary with a quarter of the share in it; if a word has the share
    over all, the sum of what is sent is at least half of it.  So none is missed, at most
    2 / ``FREQUENT`` words reach the driver, and no other word has more than the share (or, in a
    small corpus, ``LEAST`` tokens or a few more).
    """

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Summary(round(4 / FREQUENT))
        for batch in slices(batches, text_col):
            found.add(tokens([t or "" for t in batch.column(0).to_pylist()])[0])
        found.merge()
        keep = found.counts >= max(1, found.seen * FREQUENT / 4)
        yield pa.RecordBatch.from_arrays([pa.array(found.words[keep].view(np.int64)), pa.array(found.counts[keep])], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([found.seen])], names=["word", "n"])

    sent = staged(train.select(text_col).mapInArrow(local, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-frequent")
    total = sent.where("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).head()[0]
    rows = sent.where(F.col("word").isNotNull() & (F.col("n") >= max(LEAST, total * FREQUENT / 2))).select("word").toPandas()
    return Classes(np.sort(rows["word"].to_numpy(np.int64).view(np.uint64)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    words, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return words, np.bincount(at, weights=np.concatenate([p[1] for p in parts]), minlength=len(words)).astype(np.int64)


@dataclass
class Model:
    start: np.ndarray  # states
    move: np.ndarray  # states x states
    emit: np.ndarray  # classes x states
    share: np.ndarray  # of each class among all tokens

    @classmethod
    def fresh(cls, share: np.ndarray, seed: int = 1) -> Model:
        rng = np.random.default_rng(seed)
        emit = share[:, None] * rng.uniform(0.5, 1.5, (len(share), STATES))
        move = np.full((STATES, STATES), 0.1 / (STATES - 1))
        np.fill_diagonal(move, 0.9)
        return cls(np.full(STATES, 1 / STATES), move, emit / emit.sum(axis=0), share)

    def updated(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray) -> Model:
        """From expected counts, with a prior in proportion to the classes' shares."""
        emit = emit + _CLASS_PRIOR * self.share[:, None]
        move = move + _MOVE_PRIOR
        start = start + _MOVE_PRIOR
        return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0), self.share)


def lanes(sequences: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sequences side by side, long ones first: their indexes, their classes (step x lane), and how
    many lanes are still going at each step."""
    order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
    for k in range(0, len(order), LANES):
        mine = np.array(order[k : k + LANES])
        sizes = np.array([len(sequences[i]) for i in mine])
        cuts = np.concatenate(([0], np.cumsum(sizes)))
        flat = np.concatenate([sequences[i] for i in mine])
        going = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
        # Tokens in order of their step, in each step by lane.
        where = np.arange(len(flat)) - np.repeat(cuts[:-1], sizes)
        yield mine, flat[np.argsort(where, kind="stable")], going


def forward(model: Model, sequences: list[np.ndarray]) -> np.ndarray:
    """Log10-likelihood of each sequence of classes, by the scaled forward recursion."""
    out = np.zeros(len(sequences))
    for mine, flat, going in lanes(sequences):
        total = np.zeros(len(mine))
        at, alpha = 0, None
        for n in going.tolist():
            b = model.emit[flat[at : at + n]]
            at += n
            alpha = model.start * b if alpha is None else (alpha[:n] @ model.move) * b
            scale = alpha.sum(axis=1)
            alpha /= scale[:, None]
            total[:n] += np.log10(scale)
        out[mine] = total
    return out


def expected(model: Model, sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts of starts, moves and emissions, and the log10-likelihood."""
    start, move, emit, likelihood = np.zeros(STATES), np.zeros((STATES, STATES)), np.zeros((len(model.emit), STATES)), 0.0
    for _, flat, going in lanes(sequences):
        ends = np.cumsum(going)
        begins = ends - going
        b = model.emit[flat]
        alpha, scale = np.empty_like(b), np.empty(len(flat))
        for t, (i, j) in enumerate(zip(begins.tolist(), ends.tolist(), strict=True)):
            a = (model.start if t == 0 else alpha[begins[t - 1] : begins[t - 1] + j - i] @ model.move) * b[i:j]
            scale[i:j] = a.sum(axis=1)
            alpha[i:j] = a / scale[i:j, None]
        likelihood += float(np.log10(scale).sum())
        beta = np.ones((int(going[0]), STATES))
        for t in range(len(going) - 1, -1, -1):
            i, j = int(begins[t]), int(ends[t])
            if t + 1 < len(going):
                k, m = int(begins[t + 1]), int(ends[t + 1])
                ahead = b[k:m] * beta[: m - k] / scale[k:m, None]
                move += alpha[i : i + m - k].T @ ahead * model.move
                beta[: m - k] = ahead @ model.move.T
            alpha[i:j] *= beta[: j - i]
        start += alpha[: ends[0]].sum(axis=0)
        for k in range(STATES):
            emit[:, k] += np.bincount(flat, weights=alpha[:, k], minlength=len(emit))
    return start, move, emit, likelihood


def encoded(docs: DataFrame, classes: Classes, id_col: str, text_col: str) -> DataFrame:
    """``(row, id, learn, classes, rare, pack, n_rare)`` for each row of ``docs``: its classes with
    the end, its distinct rare words (int64), and for each of them its class and count (int64)."""
    shipped = docs.sparkSession.sparkContext.broadcast(classes)

    def step(batch: pa.RecordBatch) -> dict:
        known: Classes = shipped.value
        h, tails, counts = tokens([t or "" for t in batch.column(2).to_pylist()])
        code, same = known.of(h, tails)
        cuts = np.concatenate(([0], np.cumsum(counts)))
        ends = np.array([known.size - 1])
        out: dict[str, list] = {"classes": [], "rare": [], "pack": [], "n_rare": []}
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            s = ~same[a:b]
            words, first, n = np.unique(h[a:b][s], return_index=True, return_counts=True)
            out["classes"].append(np.concatenate((code[a:b], ends)).astype(known.kind).tobytes())
            out["rare"].append(words.tobytes())
            out["pack"].append((code[a:b][s][first] - len(known.hashes) << 32 | n).tobytes())
            out["n_rare"].append(len(words))
        return out | {"row": batch.column(0), "id": batch.column(1), "learn": batch.column(3)}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows.withColumn("learn", learns("id")), "text", f"row long, id {kind}, learn boolean, classes binary, rare binary, pack binary, n_rare int", step)


def learns(id_col: str = "doc_id"):
    """Whether a row is for training: CRC-32 of the id as text, modulo 10, isn't 0 (null ids are)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 10 != 0, F.lit(True))


def rare_words(rows: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """What rare words add to each row's score, and how many training words each rare class has.

    Every distinct rare word of a row goes once to the partition of its hash, where it is counted;
    no word there has over ``FREQUENT`` of the training tokens (and, as rows are held out by a hash,
    about as much of the others).  A partition sends one packed array of its sums by row to each
    group of rows, where they are added up; the driver adds up ``TAILS`` numbers a partition.
    """

    n = partitions(rows.sparkSession)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "rare"):
            ids, learn, sizes = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 4))
            words = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64)
            pack = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(np.repeat(ids, sizes)), pa.array(pack << 1 | np.repeat(learn, sizes))], names=["word", "row", "pack"])

    pairs = rows.select("row", "learn", "rare", "pack", "n_rare").mapInArrow(spread, "word long, row long, pack long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
        if not held:
            return
        word, row, pack = (np.concatenate([h[k] for h in held]) for k in range(3))
        del held
        size = pack >> 1 & 0xFFFFFFFF
        distinct, first, at = np.unique(word, return_index=True, return_inverse=True)
        c = np.bincount(at, weights=size * (pack & 1), minlength=len(distinct))
        own, where = np.unique(row, return_inverse=True)
        score = np.bincount(where, weights=size * np.log10(c[at] + ADD))
        known = np.bincount(where, weights=size * (c[at] > 0)).astype(np.int64)
        kinds = np.bincount((pack[first] >> 33)[c > 0], minlength=TAILS)
        group = (_mixed(own.astype(np.uint64)) % np.uint64(n)).astype(np.int64)
        order = np.argsort(group, kind="stable")
        groups, starts = np.unique(group[order], return_index=True)
        parts = [b"".join(x[o].tobytes() for x in (own, score, known)) for o in np.split(order, starts[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([-1, *groups.tolist()], pa.int32()), pa.array([kinds.astype(np.int64).tobytes(), *parts], pa.binary())], names=["group", "sums"])

    dealt = staged(pairs.repartition(n, "word").mapInArrow(count, "group int, sums binary"), "lm-rare")
    kinds = np.zeros(TAILS, np.int64)
    for r in dealt.where("group < 0").toLocalIterator():
        kinds += np.frombuffer(r["sums"], np.int64)

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a group, as three arrays end to end: row, score, known.
        parts = [np.frombuffer(x, np.int64).reshape(3, -1) for b in batches for x in b.column(1).to_pylist()]
        if parts:
            row, score, known = np.concatenate(parts, axis=1)
            own, where = np.unique(row, return_inverse=True)
            sums = [np.bincount(where, weights=score.copy().view(np.float64)), np.bincount(where, weights=known).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(own), *map(pa.array, sums)], names=["row", "rare_score", "rare_known"])

    return dealt.where("group >= 0").repartition(n, "group").mapInArrow(gather, "row long, rare_score double, rare_known long"), kinds


_SUMS = [f"x{k}" for k in range(STATES)]


def _summed(rows: DataFrame, sums, kind: str = "float") -> np.ndarray:
    """Add up one matrix a task (rows x ``STATES``), made by ``sums`` from an iterator of pieces.
    Its numbers travel as ``kind`` (single precision will do for expected counts) and are added in
    double precision."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sums(b.column(0).to_pylist() for b in slices(batches, "classes", 2 << 20))
        at = np.flatnonzero(found.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), *[pa.array(found[at, k].astype(np.float32 if kind == "float" else np.float64)) for k in range(STATES)]], names=["at", *_SUMS])

    schema = ", ".join(["at int", *[f"{x} {kind}" for x in _SUMS]])
    got = rows.select("classes").mapInArrow(run, schema).groupBy("at").agg(*[F.sum(x).alias(x) for x in _SUMS]).toPandas()
    out = np.zeros((int(got["at"].max()) + 1 if len(got) else 0, STATES))
    out[got["at"]] = got[_SUMS]
    return out


def train(rows: DataFrame, classes: Classes, mass: np.ndarray) -> Model:
    """Baum-Welch on all of ``rows`` (encoded training rows), whole texts.  ``mass``: smoothed tokens
    by class.

    Every round is a job that sums expected counts over partitions.  The first ``PARTS`` rounds each
    read another part of the rows, so together all of them once, and use the counts of the parts
    before at a falling weight; the last ``ROUNDS`` read all rows.
    """
    spark = rows.sparkSession
    size, kind = classes.size, classes.kind
    model = Model.fresh(mass / mass.sum())
    held = np.zeros((size + STATES + 1, STATES))
    part = F.pmod(F.xxhash64("row"), F.lit(PARTS))
    for k in range(PARTS + ROUNDS):
        shipped = spark.sparkContext.broadcast(model)

        def sums(pieces, shipped=shipped) -> np.ndarray:
            out = np.zeros((size + STATES + 1, STATES))
            for piece in pieces:
                start, move, emit, _ = expected(shipped.value, [np.frombuffer(c, kind) for c in piece])
                out += np.concatenate((emit, move, start[None]))
            return out

        found = _summed(rows.where(part == k) if k < PARTS else rows, sums)
        held = held * KEPT if k < PARTS else held * 0
        held[: len(found)] += found
        if len(found):
            model = model.updated(held[size + STATES], held[size : size + STATES], held[:size])
    return model


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row.

    Rows whose ``learns`` is false are held out: nothing is learned from them.  A text's tokens are
    its words and one end; null texts count as empty (the end alone).  ``base_score`` is the
    smoothed unigram's log10 probability of the text, ``score`` the hidden Markov model's, in which
    a word unknown in training is one slot of its class.  Null ids learn; repeated rows are counted
    as often; without training rows all words are unknown; other columns are not read.
    """
    docs = docs.select(id_col, text_col)
    classes = frequent(docs.where(learns(id_col)), text_col)
    size, kind, own = classes.size, classes.kind, len(classes.hashes)
    rows = staged(encoded(docs, classes, id_col, text_col), "lm-rows")
    learning = rows.where("learn")

    def sums(pieces) -> np.ndarray:
        out = np.zeros((size, STATES))
        for piece in pieces:  # in the first column alone
            out[:, 0] += np.bincount(np.frombuffer(b"".join(piece), kind), minlength=size)
        return out

    counted = _summed(learning, sums, "double")[:, 0]
    counts = np.zeros(size, np.int64)
    counts[: len(counted)] = counted.round().astype(np.int64)
    by_row, kinds = rare_words(rows)
    n, v = int(counts.sum()), own + int(kinds.sum()) + int(counts[-1] > 0)
    mass = counts.astype(float)
    mass[own:-1] += ADD * (kinds + 1)
    mass[-1] += ADD
    model = train(learning, classes, mass)
    within = np.zeros(size)  # what a class's total takes from a rare word's score
    within[own:-1] = np.log10(mass[own:-1])
    base = np.zeros(size)
    base[:own], base[-1] = np.log10(counts[:own] + ADD), np.log10(counts[-1] + ADD)
    all_mass = float(np.log10(n + ADD * (v + 1)))
    shipped = docs.sparkSession.sparkContext.broadcast((model, within, base, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, within, base, counts = shipped.value
        known = counts > 0
        known[own:-1] = False
        for batch in slices(batches, "classes", 8 << 20):
            codes = [np.frombuffer(c, kind) for c in batch.column(3).to_pylist()]
            whole = forward(model, codes)
            columns = [[len(c) for c in codes], [int(known[c].sum()) for c in codes], [float(base[c].sum()) for c in codes], [w - float(within[c].sum()) for c, w in zip(codes, whole.tolist(), strict=True)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *map(pa.array, columns)], names=["row", "id", "learn", "n", "known", "base", "chain"])

    id_kind = docs.schema[id_col].dataType.simpleString()
    found = rows.select("row", "id", "learn", "classes").mapInArrow(run, f"row long, id {id_kind}, learn boolean, n long, known long, base double, chain double")
    rare, seen = F.coalesce("rare_score", F.lit(0.0)), F.coalesce("rare_known", F.lit(0))
    return found.join(by_row, "row", "left").select(
        F.col("id").alias(id_col), (~F.col("learn")).alias("held_out"), F.col("n").alias("n_tokens"), (F.col("known") + seen).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + rare - F.col("n") * all_mass).alias("base_score"), (F.col("chain") + rare).alias("score"),
    )
