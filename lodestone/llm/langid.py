"""Language spans and document language (operator 7).

Script ranges narrow the languages that a word can be of; each word is scored for each of them by
its letter trigrams; Viterbi with a penalty for switching labels the words.  The language of a
document is the one with most letters.
"""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_texts, released, slices

#: First and last code points of the letters of each script.
SCRIPTS = [
    ("latin", 0x0041, 0x024F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x0370, 0x03FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x0400, 0x052F), ("armenian", 0x0530, 0x058F), ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF), ("arabic", 0x0750, 0x077F), ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF), ("tamil", 0x0B80, 0x0BFF), ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF), ("hangul", 0xAC00, 0xD7AF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x4DBF), ("han", 0x4E00, 0x9FFF), ("han", 0x20000, 0x2FFFF),
]
NAMES = ["other", *dict.fromkeys(s for s, _, _ in SCRIPTS)]

#: Buckets that letter trigrams are hashed to: the model has this many numbers a language.
FEATURES = 1 << 15
#: A language is a candidate for a script if at least this share of its letters are of it.
SCRIPT_SHARE = 0.01
#: Log-probability that a change of language costs.
PENALTY = 12.0
#: A word's score for a language is not below its best one by more.
WORD_BOUND = 8.0
_SMOOTH = 0.5
#: Text that is worked on at a time, in bytes; what is held beside it is some fifty times as much.
PIECE = 1 << 20
UNKNOWN = "und"

_tables: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def letter_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter or mark within a word, its script, and whether it
    is a mark."""
    global _tables
    if _tables is None:
        kinds = np.fromiter((ord(unicodedata.category(chr(c))[0]) for c in range(0x110000)), np.uint8, 0x110000)
        marks = kinds == ord("M")
        letters = marks | (kinds == ord("L"))
        scripts = np.zeros(0x110000, np.uint8)
        for name, first, last in SCRIPTS:
            scripts[first : last + 1] = NAMES.index(name)
        _tables = letters, scripts, marks
    return _tables


def script_of(char: str) -> str:
    """Script of one character by its range."""
    ordered = sorted((a, b, s) for s, a, b in SCRIPTS)
    i = bisect_right(ordered, (ord(char), 0x110000, "")) - 1
    return ordered[i][2] if i >= 0 and ord(char) <= ordered[i][1] else "other"


@dataclass
class Words:
    """The words (runs of letters and marks with a letter in them) of some texts, laid end to end."""

    start: np.ndarray
    end: np.ndarray
    text: np.ndarray  # which text each word is of
    script: np.ndarray
    features: np.ndarray = field(repr=False)  # a bucket for each code point of the joined texts
    offset: np.ndarray = field(repr=False)  # where each text begins in the joined texts


def words_of(texts: list[str]) -> Words:
    letters, scripts, marks = letter_tables()
    lowered = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    joined = "\n".join(lowered) + "\n"
    cps = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters[cps]
    edges = np.diff(np.concatenate(([0], is_letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    if (is_mark := marks[cps]).any():
        run = np.concatenate(([0], np.cumsum(is_mark)))
        worded = run[end] - run[start] < end - start
        start, end = start[worded], end[worded]
    offset = np.concatenate(([0], np.cumsum(np.fromiter(map(len, lowered), np.int64, len(lowered)) + 1)))
    text = np.searchsorted(offset, start, side="right") - 1
    # Trigrams of letters; the characters around a word count as one boundary sign.
    x = np.where(is_letter, cps, np.uint32(1)) * np.uint32(0x9E3779B1)
    before, after = np.concatenate((x[:1] * 0 + np.uint32(0x9E3779B1), x[:-1])), np.concatenate((x[1:], x[:1] * 0 + np.uint32(0x9E3779B1)))
    h = (before * np.uint32(0x85EBCA77)) ^ (x * np.uint32(0xC2B2AE3D) + (x >> np.uint32(15))) ^ ((after >> np.uint32(7)) + after * np.uint32(0x27D4EB2F))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return Words(start, end, text, scripts[cps[start]] if len(start) else np.empty(0, np.uint8), (h >> np.uint32(32 - 15)).astype(np.int32), offset)


@dataclass
class Model:
    langs: list[str]
    score: np.ndarray  # FEATURES x languages: log-probability of a trigram
    allowed: np.ndarray  # scripts x languages
    prior: str

    def words(self, found: Words) -> np.ndarray:
        """Score of each word for each language, 0 for the best one; not in the candidates: the bound."""
        if not len(found.start):
            return np.zeros((0, len(self.langs)), np.float32)
        out = np.empty((len(found.start), len(self.langs)), np.float64)
        for k in range(len(self.langs)):
            total = np.concatenate(([0.0], np.cumsum(self.score[:, k][found.features])))
            out[:, k] = total[found.end] - total[found.start]
        can = self.allowed[found.script]
        can = np.where(can.any(axis=1, keepdims=True), can, True)
        out = np.where(can, out, -np.inf)
        return np.maximum(out - out.max(axis=1, keepdims=True), -WORD_BOUND)


def viterbi(score: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """Best sequence of columns: sum of scores less ``penalty`` for each change; ties: the smaller."""
    return paths(score, np.array([0, len(score)]), penalty)[0]


def paths(score: np.ndarray, cuts: np.ndarray, penalty: float = PENALTY) -> list[np.ndarray]:
    """``viterbi`` of each stretch of rows between two cuts."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * (len(cuts) - 1)
    mixed = []
    for k, (a, b) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        own = score[a:b]
        best = int(own.sum(axis=0).argmax()) if b > a else 0
        # A constant sequence is best if no stretch gains half a penalty or more by another language.
        gain = np.cumsum(own - own[:, best : best + 1], axis=0)
        low = np.minimum(np.minimum.accumulate(gain, axis=0), 0)
        if b == a or ((gain - low).max() < penalty / 2):
            out[k] = np.full(b - a, best, np.int64)
        else:
            mixed.append(k)
    if not mixed:
        return out
    # The others side by side, long ones first: a step takes a row of each that is still going.
    mixed.sort(key=lambda k: cuts[k] - cuts[k + 1])
    sizes = np.array([cuts[k + 1] - cuts[k] for k in mixed])
    begin = np.array([cuts[k] for k in mixed])
    going = np.searchsorted(-sizes, -np.arange(sizes[0]), side="left")
    first = np.concatenate(([0], np.cumsum(going)))
    now = np.zeros((len(mixed), score.shape[1]))
    stay, top = np.empty((first[-1], score.shape[1]), bool), np.empty(first[-1], np.int16)
    for t, n in enumerate(going.tolist()):
        own, i = now[:n], first[t]
        at = own.argmax(axis=1)
        lead = own[np.arange(n), at][:, None] - penalty
        np.greater_equal(own, lead, out=stay[i : i + n])
        top[i : i + n] = at
        now[:n] = np.maximum(own, lead) + score[begin[:n] + t]
    k = now.argmax(axis=1)
    told = np.empty(first[-1], np.int16)
    for t in range(len(going) - 1, -1, -1):
        n, i = going[t], first[t]
        told[i : i + n] = own = k[:n]
        k[:n] = np.where(stay[np.arange(i, i + n), own], own, top[i : i + n])
    for lane, (j, n) in enumerate(zip(mixed, sizes.tolist(), strict=True)):
        out[j] = told[first[:n] + lane].astype(np.int64)
    return out


def label(texts: list[str], model: Model) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
    """For each text: language, share of its letters in that language, and spans ``(start, end,
    language)`` in code points, from the first letter of a stretch of words to its last."""
    found = words_of(texts)
    scores = model.words(found)
    cuts = np.searchsorted(found.text, np.arange(len(texts) + 1))
    out = []
    told = paths(scores, cuts)
    for t in range(len(texts)):
        a, b = int(cuts[t]), int(cuts[t + 1])
        if a == b:
            out.append((UNKNOWN, 0.0, []))
            continue
        path = told[t]
        size = np.bincount(path, weights=(found.end - found.start)[a:b], minlength=len(model.langs))
        k = int(size.argmax())
        turns = np.flatnonzero(np.concatenate(([True], path[1:] != path[:-1])))
        ends = np.concatenate((turns[1:], [b - a])) - 1
        base = int(found.offset[t])
        spans = [(int(found.start[a + i]) - base, int(found.end[a + j]) - base, model.langs[path[i]]) for i, j in zip(turns.tolist(), ends.tolist(), strict=True)]
        out.append((model.langs[k], float(size[k] / size.sum()), spans))
    return out


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Count trigrams and scripts of every row of ``docs`` that has a language.

    Each task sums its rows before the shuffle; the driver gets at most ``FEATURES`` plus scripts
    numbers a language.  The languages' names must be few.  None if there is no row with a letter.
    """
    size = FEATURES + len(NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, text_col, PIECE):
            langs, texts = batch.column(1).to_pylist(), [t or "" for t in batch.column(0).to_pylist()]
            found = words_of(texts)
            lengths = found.end - found.start
            code = {x: i for i, x in enumerate(dict.fromkeys(langs))}
            of_text = np.array([code[x] for x in langs], np.int64)
            of_letter = np.repeat(of_text[found.text], lengths)
            where = np.repeat(found.start - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum()) if len(lengths) else np.empty(0, np.int64)
            for x, i in code.items():
                mine = counts.setdefault(x, np.zeros(size, np.int64))
                mine[:FEATURES] += np.bincount(found.features[where[of_letter == i]], minlength=FEATURES)
                own = of_text[found.text] == i
                mine[FEATURES:] += np.bincount(found.script[own], weights=lengths[own], minlength=len(NAMES)).astype(np.int64)
        for x, c in counts.items():
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], names=["lang", "feature", "n"])

    counted = docs.where(F.col(lang_col).isNotNull()).select(text_col, lang_col).mapInArrow(released(run), "lang string, feature int, n long")
    rows = counted.groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    if not len(rows):
        return None
    langs = sorted(rows["lang"].unique())
    counts = np.zeros((size, len(langs)))
    counts[rows["feature"], [langs.index(x) for x in rows["lang"]]] = rows["n"]
    letters, scripts = counts[:FEATURES], counts[FEATURES:]
    score = np.log((letters + _SMOOTH) / (letters.sum(axis=0) + _SMOOTH * FEATURES))
    allowed = scripts >= SCRIPT_SHARE * np.maximum(scripts.sum(axis=0), 1)
    return Model(langs, score, allowed, langs[int(letters.sum(axis=0).argmax())])


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """``(id, lang_pred, score[, spans])`` for each row, from the text alone.

    Null texts and texts without a letter: ``und``, 0.  Words in a script that no learned language
    uses are open to all languages.  Rows are handled one by one; other columns are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, lang_pred string, score double" + (", spans array<struct<start:int,end:int,lang:string>>" if spans else "")

    def step(batch: pa.RecordBatch) -> dict:
        texts = [t or "" for t in batch.column(1).to_pylist()]
        found = label(texts, shipped.value) if shipped.value else [(UNKNOWN, 0.0, [])] * len(texts)
        out = {id_col: batch.column(0), "lang_pred": [x[0] for x in found], "score": [x[1] for x in found]}
        return out | ({"spans": [[{"start": a, "end": b, "lang": c} for a, b, c in x[2]] for x in found]} if spans else {})

    return map_texts(docs.select(id_col, text_col), text_col, schema, step, PIECE)


def held_out(id_col: str = "doc_id", parts: int = 3, part: int = 1):
    """Whether a row is held out: CRC-32 of the id as text, modulo ``parts``; null ids are not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))


def brute_viterbi(score: np.ndarray, penalty: float) -> float:
    """The best total by the plain recursion; for tests."""
    now = score[0].copy()
    for row in score[1:]:
        now = np.maximum(now, now.max() - penalty) + row
    return float(now.max())


def total(score: np.ndarray, path: np.ndarray, penalty: float) -> float:
    return float(score[np.arange(len(path)), path].sum() - penalty * (path[1:] != path[:-1]).sum()) if len(path) else -math.inf
