"""Personal data by base patterns and bootstrapped contexts (operator 5).

Entities that the base patterns find are seeds.  The words before them are lexical patterns (three
words, backed off to two and to one).  A graph of patterns and instances is scored in rounds (a
pattern by the share of its words' occurrences in all texts that stand before a trusted instance, an
instance by its patterns), and patterns of high confidence discover identifiers that the base
patterns do not accept.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .hmm import tokens
from .shared import SMALL_BYTES, lookup, map_texts, released, slices, staged

KINDS = ("email", "ip", "card", "phone")
#: Rounds of scoring; distinct trusted instances and confidence that a pattern needs.
ROUNDS, SUPPORT, CONFIDENCE = 3, 3, 0.8
#: Words of a pattern, the longest first, and what is added to its occurrences.
DEPTHS = (3, 2, 1)
PRIOR = 0.5
#: Text whose words are hashed at a time, in bytes; what is held beside it is some hundred times as much.
HASHED = 1 << 17
#: Patterns whose words are counted in one pass over the texts; more are counted in further passes.
BLOCK = 1_000_000
#: Trusted patterns (of some 50 bytes) that are broadcast at most, to mask texts in one pass.
SHIPPED = 100_000
#: The words of a pattern lie within so many code points before the entity.
NEAR = 200

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Shapes of what a trusted pattern may discover.
_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,2}[0-9])++")
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++(?:@|\x20?[\[(](?:at|AT)[\])]\x20?)[A-Za-z0-9.-]++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each sign has the longest run of local characters before it, back to the last address."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((start, domain.end()))
        free = domain.end() if domain else at + 1
        at = text.find("@", free)
    return out


def _low(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, sorted; kind: place in ``KINDS``.  Linear in the text."""
    out = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text) is None:
        return out
    for m in _IP.finditer(text):
        if all(map(_low, m[0].split("."))):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGIT.findall(m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans shaped like an identifier that stand alone and touch no base span."""
    out = []
    if "@" in text or "(at)" in text or "[at]" in text or "(AT)" in text or "[AT]" in text:
        out += [(m.start(), 0, m.end()) for m in _ADDRESS.finditer(text)]
    if _DIGIT.search(text):
        for m in _NUMBER.finditer(text):
            n = len(_DIGIT.findall(m[0]))
            if m[0].count(".") == 3 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", m[0]):
                out.append((m.start(), 1, m.end()))
            else:  # those of 12 to 15 digits may be either: their patterns decide
                if 7 <= n <= 15:
                    out.append((m.start(), 3, m.end()))
                if 12 <= n <= 19:
                    out.append((m.start(), 2, m.end()))
    # Base spans joined where they overlap, so that a binary search tells what touches one.
    starts, ends = [], []
    for a, _, b in base:
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def clear(a: int, b: int) -> bool:
        k = bisect_right(ends, a)
        return k == len(starts) or starts[k] >= b

    alone = lambda a, b: not (a and text[a - 1].isalnum()) and not (b < len(text) and text[b].isalnum())
    return [s for s in out if alone(s[0], s[2]) and clear(s[0], s[2])]


def instance(kind: int, found: str) -> str:
    """One form for all spellings of an identifier."""
    return f"{kind}:" + (found.lower() if kind == 0 else found if kind == 1 else "".join(_DIGIT.findall(found)))


#: What stands between the words of patterns: ASCII that isn't a letter.
_BETWEEN = np.array([c < 0x80 and not chr(c).isalpha() for c in range(256)])
_BEFORE = re.compile(r"[A-Za-z\x80-\U0010ffff]+")


def contexts(text: str, start: int, kind: int, end: int) -> list[str]:
    """Lexical patterns: the last one, two and three words before an entity, whatever signs and
    digits stand between, ASCII letters in lower case.  A word that isn't whole within ``NEAR``
    code points ends them."""
    a = max(0, start - NEAR)
    found = _BEFORE.findall(text[a:start])
    if found and a and _BEFORE.match(text[a - 1]) and _BEFORE.match(text[a]):
        found = found[1:]
    if found and _BEFORE.match(text[start - 1 : start]):
        found = []  # the entity is part of a word
    words = [w.translate(_LOWER) for w in found[-max(DEPTHS) :]]
    return [f"{kind}<{' '.join(words[-n:])}" for n in DEPTHS if len(words) >= n]


_LOWER = {c: c + 32 for c in range(65, 91)}


def _runs(hashes: np.ndarray, inside: np.ndarray, depth: int) -> np.ndarray:
    """A hash of each run of ``depth`` words; ``inside``: how many words of its text are before each."""
    out = hashes
    for k in range(1, depth):
        out = out * np.uint64(0x9E3779B97F4A7C15)
        out[k:] += hashes[:-k]
    return out[inside >= depth - 1]


def _counted(batches: Iterator[pa.RecordBatch], text_col: str, wanted: np.ndarray) -> Iterator[pa.RecordBatch]:
    """``(key, n)``: how often the runs of words with the hashes ``wanted`` (in order) occur."""
    counts = np.zeros(len(wanted), np.int64)
    for batch in slices(batches, text_col, HASHED):
        h, _, n = tokens([t or "" for t in batch.column(0).to_pylist()], _BETWEEN)
        inside = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n)
        for depth in DEPTHS if len(wanted) else ():
            keys = _runs(h, inside, depth)
            at = np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)
            np.add.at(counts, at[wanted[at] == keys], 1)
    some = counts > 0
    yield pa.RecordBatch.from_arrays([pa.array(wanted[some].view(np.int64)), pa.array(counts[some])], names=["key", "n"])


def occurrences(docs: DataFrame, phrases: DataFrame, text_col: str = "text") -> DataFrame:
    """``(words, n)``: how often each of ``phrases`` (``words``: one to three, joined by spaces)
    occurs in the texts, wherever in them.

    Every text is read once for each ``BLOCK`` phrases, whose 64-bit hashes are broadcast; tasks
    send a number for each phrase met.
    """
    spark = docs.sparkSession
    n_blocks = -(-phrases.count() // BLOCK)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            keys = np.zeros(len(words), np.uint64)
            h, _, counts = tokens(words, _BETWEEN)
            first = np.cumsum(counts) - counts
            inside = np.arange(len(h)) - np.repeat(first, counts)
            for depth in DEPTHS:
                own = counts == depth
                every = np.zeros(len(h), np.uint64)
                every[inside >= depth - 1] = _runs(h, inside, depth)
                keys[own] = every[(first + counts - 1)[own]]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys.view(np.int64)), pa.array(counts.astype(np.int32))], names=["words", "key", "depth"])

    keyed = staged(phrases.select("words").mapInArrow(released(hashed), "words string, key long, depth int"), "pii-phrases")
    told = None
    for block in range(n_blocks):
        mine = keyed.where(F.pmod("key", F.lit(n_blocks)) == block).select("key").toPandas()["key"].to_numpy(np.int64)
        shipped = spark.sparkContext.broadcast(np.unique(mine.view(np.uint64)))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            yield from _counted(batches, text_col, shipped.value)

        part = docs.select(text_col).mapInArrow(released(run), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        told = part if told is None else told.unionByName(part)
    if told is None:
        return phrases.select("words", F.lit(0).cast("long").alias("n")).limit(0)
    return keyed.join(told, "key").select("words", "n")


_SPAN = "struct<start:int,kind:int,end:int>"


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(row, id, spans, seen)``: base spans, and each span or candidate with its instance and
    patterns."""

    def step(batch: pa.RecordBatch) -> dict:
        spans, seen = [], []
        for text in batch.column(2).to_pylist():
            text = text or ""
            base = base_spans(text)
            spans.append([{"start": a, "kind": k, "end": b} for a, k, b in base])
            seen.append([{"start": a, "kind": k, "end": b, "seed": seed, "instance": instance(k, text[a:b]), "patterns": contexts(text, a, k, b)} for group, seed in ((base, True), (candidates(text, base), False)) for a, k, b in group])
        return {"row": batch.column(0), "id": batch.column(1), "spans": spans, "seen": seen}

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(rows, "text", f"row long, id {kind}, spans array<{_SPAN}>, seen array<struct<start:int,kind:int,end:int,seed:boolean,instance:string,patterns:array<string>>>", step, SMALL_BYTES)


def trusted_patterns(edges: DataFrame, totals: DataFrame) -> DataFrame:
    """``(pattern)`` of high confidence.  ``edges``: distinct ``(pattern, instance, seed, times)``;
    ``totals``: ``(pattern, n)``, how often a pattern's words occur in all texts.

    A pattern's confidence is the share of its occurrences that stand before trusted instances (0
    with fewer than ``SUPPORT`` distinct ones); those before instances that are not decided yet
    weigh half, ``PRIOR`` is added to all.  An instance's score is that of its best
    pattern (they overlap, so they don't add up), and 1 for seeds.  Copies of one text add no distinct instances.  Patterns
    and instances with very many edges are looked up by broadcast, the others by a shuffle join.
    """
    now = staged(edges.select("pattern", "instance", "seed", "times", F.col("seed").cast("double").alias("score")), "pii-graph")
    total = now.count()

    def scored(graph: DataFrame) -> DataFrame:
        good = F.col("score") >= CONFIDENCE
        summed = graph.groupBy("pattern").agg(F.count_if(good).alias("support"), F.sum(F.when(good, F.col("score") * F.col("times")).otherwise(0.0)).alias("held"), F.sum(F.when(good, 0).otherwise(F.col("times"))).alias("open"), F.count("*").alias("n"))
        said = summed.join(totals.withColumnRenamed("n", "occurs"), "pattern", "left")
        occurs = F.greatest(F.coalesce("occurs", F.lit(0)), F.col("held") + F.col("open"))
        confidence = F.when(F.col("support") >= SUPPORT, F.col("held") / (occurs - 0.5 * F.col("open") + PRIOR)).otherwise(0.0)
        return said.select("pattern", confidence.alias("confidence"), "n")

    for _ in range(ROUNDS - 1):
        told = lookup(now.drop("score"), "pattern", scored(now), "n", total).drop("n")
        told = staged(told, "pii-told", now)
        instances = told.groupBy("instance").agg(F.max("confidence").alias("found"), F.count("*").alias("n"))
        after = lookup(told.drop("confidence"), "instance", instances, "n", total)
        now = staged(after.select("pattern", "instance", "seed", "times", F.when(F.col("seed"), 1.0).otherwise(F.col("found")).alias("score")), "pii-graph", told)
    return scored(now).where(F.col("confidence") >= CONFIDENCE).select("pattern")


def _learned(docs: DataFrame, rows: DataFrame, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``(row, start, kind, end, seed, instance, pattern)`` and trusted patterns."""
    seen = rows.where(F.size("seen") > 0).select("row", F.explode("seen").alias("s")).select("row", "s.*")
    linked = seen.select("row", "start", "kind", "end", "seed", "instance", F.explode("patterns").alias("pattern"))
    edges = staged(linked.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("times")), "pii-edges")
    # Patterns with fewer instances can't get the support in any round; the others are counted.
    induced = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("pattern"), "pii-induced")
    words = F.substring_index("pattern", "<", -1)
    counted = occurrences(docs, induced.select(words.alias("words")).distinct(), text_col)
    totals = induced.withColumn("words", words).join(counted, "words").select("pattern", "n")
    return linked, staged(trusted_patterns(edges, staged(totals, "pii-totals")), "pii-trusted")


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, base, spans)`` for each row: arrays of ``(start, kind, end)`` in order of start, then
    kind; offsets in code points, end exclusive.

    ``spans`` has all base spans and those that trusted patterns discover; discovered ones touch no
    base span.  Null texts count as empty; null ids and repeated rows each give a row; other columns
    are not read; an empty table gives an empty result.  Texts are read twice (the second time to count
    the patterns' words) and don't move.
    """
    rows = staged(entities(docs, id_col, text_col), "pii-rows")
    linked, trusted = _learned(docs, rows, text_col)
    spots = linked.where("not seed")
    totals = spots.groupBy("pattern").agg(F.count("*").alias("n")).join(trusted, "pattern", "left_semi").withColumn("ok", F.lit(True))
    met = lookup(spots, "pattern", staged(totals, "pii-spots"), "n", spots.count()).where("ok")
    added = met.select("row", F.struct("start", "kind", "end").alias("span")).distinct().groupBy("row").agg(F.collect_set("span").alias("added"))
    none = F.array().cast(f"array<{_SPAN}>")
    joined = rows.select("row", "id", "spans").join(added.withColumnRenamed("row", "row_"), F.col("row") == F.col("row_"), "left")
    return joined.select(F.col("id").alias(id_col), F.col("spans").alias("base"), F.array_sort(F.concat("spans", F.coalesce("added", none))).alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, n_email, n_ip, n_card, n_phone, base_sha256, spans)``: numbers of all spans by kind,
    digest of the list of base spans, list of all spans."""
    found = find(docs, id_col, text_col)
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _count(kind: int) -> Column:
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


def _mask(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind]}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def masked(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs``, with each span of the text replaced by its kind in brackets
    (overlapping spans by that of the first).  Null texts stay null.

    Three passes over the texts: two learn the trusted patterns, one masks by them where the rows
    lie.  If there are over ``SHIPPED`` patterns, so that they can't be broadcast, rows are written
    with a number and joined with their spans instead.
    """
    names = docs.columns
    linked, trusted = _learned(docs, staged(entities(docs.select(F.lit(0).alias("id"), text_col), "id", text_col), "pii-rows"), text_col)
    at = names.index(text_col)
    if trusted.count() <= SHIPPED:
        shipped = docs.sparkSession.sparkContext.broadcast({r[0] for r in trusted.collect()})

        def spans_of(text: str, _) -> list[tuple[int, int, int]]:
            base = base_spans(text)
            found = [s for s in candidates(text, base) if any(p in shipped.value for p in contexts(text, *s))] if shipped.value else []
            return sorted(base + found)

        rows = docs
    else:
        numbered = staged(docs.select(F.monotonically_increasing_id().alias("__row"), F.struct(*names).alias("__all")), "pii-docs")
        found = find(numbered.select("__row", F.col("__all")[text_col].alias("text")), "__row", "text")
        rows = numbered.join(found.select(F.col("__row").alias("__found"), "spans"), F.col("__row") == F.col("__found"), "left").select("__all.*", F.col("spans").alias("__spans"))

        def spans_of(text: str, held) -> list[tuple[int, int, int]]:
            return [(s["start"], s["kind"], s["end"]) for s in held or []]

    def run(batches):
        for batch in slices(batches, text_col, SMALL_BYTES):
            held = batch.column(len(names)).to_pylist() if batch.num_columns > len(names) else [None] * batch.num_rows
            texts = [t if t is None else _mask(t, spans_of(t, h)) for t, h in zip(batch.column(at).to_pylist(), held, strict=True)]
            columns = [pa.array(texts, batch.column(at).type) if i == at else batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(released(run), docs.schema)
