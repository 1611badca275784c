"""Text functions on columns.  Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---- Fixed values ---------------------------------------------------------------------------
CHARS_PER_TOKEN = 3.6
ABBREVIATIONS = (
    "vb", "vs", "bkz", "örn", "orn", "dr", "prof", "doç", "doc", "md", "no", "nr", "sy", "tbl",
    "şek", "sek", "fig", "eq", "etc", "e.g", "i.e", "mr", "mrs", "vol", "pp", "ref",
)
TR_STOPWORDS = (
    "ve", "ile", "bir", "bu", "için", "olarak", "daha", "gibi", "olan", "veya", "her", "ancak", "ise", "de", "da",
    "ki", "en", "çok", "sonra", "kadar", "tarafından", "üzere", "göre", "mi", "ne", "nasıl", "nedir", "var", "yok",
    "olduğu", "kullanılan", "kullanilan", "sonucu", "sonuclari", "yöntem", "yontem", "algoritma", "algoritmalari",
    "model", "modelleri", "veri", "icindeki", "içindeki", "icerik", "içerik", "karsılastırıldı", "karsilastirildi",
    "değer", "deger", "değerler", "degerler",
)
EN_STOPWORDS = (
    "the", "and", "for", "with", "that", "this", "from", "are", "was", "have", "has", "not",
    "which", "will", "shall", "been", "were", "their", "these", "such",
)
TR_LETTERS = "çğıöşü"
TR_LETTER_WEIGHT, LANG_WORDS = 0.12, 600
#: Question types in order of precedence, each with the strings that tell it.
QUESTION_TYPES = (
    ("temporal", ("ne zaman", "hangi tarih", "tarihinde")),
    ("causal", ("neden", "sebebi", "nedeni", "neden?")),
    ("procedure", ("nasıl", "nasil", "yapılır", "yapilir")),
    ("person", ("kim", "kisi", "kişi")),
    ("location", ("nerede", "yeri", "konum")),
    ("numeric", ("kaç", "kac", "ne kadar", "miktar")),
    ("selection", ("hangi", "hangisi")),
    ("list", ("neler", "liste", "örnek", "ornek")),
    ("definition", ("nedir", "tanım", "tanim", "aciklama")),
)
DATE = r"\b\d{1,2}[./\-]\d{1,2}[./\-]\d{2,4}\b"
TIME = r"\b\d{1,2}:\d{2}(?::\d{2})?\b"
PERCENT = r"\b\d+[.,]?\d*\s*%|%\s*\d+[.,]?\d*\b"
NUMBER_UNIT = r"\b\d+[.,]?\d*\s*(?:saat|dakika|gün|hafta|ay|yıl|yil|km|m|kg|g|mb|gb|tl|usd|eur|adet|miktar|oran|derece)?\b"
EMAIL = r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b"
URL = r"\bhttps?://[^\s,)\]]+\b"
CODE = r"\b[A-ZÇĞİÖŞÜ]{2,}[\s\-]?\d+[\.\d]*\b"
# ---------------------------------------------------------------------------------------------

BETWEEN = r"[^\p{L}\p{N}]+"


def let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once a row however often ``body`` (or a function in
    it that runs for each element) uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _fold_map() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A and their base letters, from Unicode's own tables."""
    pairs = {"ı": "i"}
    for code in range(0xC0, 0x250):
        parts = unicodedata.normalize("NFD", chr(code))
        base = "".join(c for c in parts if not unicodedata.combining(c))
        if len(parts) > 1 and len(base) == 1:
            pairs[chr(code)] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _fold_map()


def tr_lower(c: Column) -> Column:
    return F.lower(F.translate(c, "Iİ", "ıi"))


def casefold(c: Column) -> Column:
    return F.lower(F.translate(c, "İ", "i"))


def tr_upper(c: Column) -> Column:
    return F.upper(F.translate(c, "iı", "İI"))


def fold(c: Column) -> Column:
    """Base letters for accented ones, within Latin-1 and Latin Extended-A."""
    return F.translate(c, FOLD_FROM, FOLD_TO)


@F.pandas_udf(T.StringType())
def fold_exact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """As ``fold``, for all of Unicode."""
    strip = lambda s: s and "".join(c for c in unicodedata.normalize("NFD", s) if not unicodedata.category(c).startswith("M")).replace("ı", "i")
    for part in parts:
        yield part.map(strip, na_action="ignore")


def clean(c: Column) -> Column:
    """Extracted text: hyphenated and soft line breaks joined, white space reduced."""
    steps = [
        (r"(\p{L})[-­]\n(\p{Ll})", "$1$2"),
        (r"(\p{Ll},?)\n(\p{Ll})", "$1 $2"),
        (r"[ \t\x0B\f\r]+", " "),
        (r"\n{3,}", "\n\n"),
        (r" +(\n|\z)", "$1"),
        (r"\A\s+|\s+\z", ""),
    ]
    for a, b in (("\u0000", " "), ("\r\n", "\n"), ("ﬁ", "fi"), ("ﬂ", "fl")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return reduce(lambda s, r: F.regexp_replace(s, *r), steps, c)


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.length(c) / CHARS_PER_TOKEN).cast("long")


def words(c: Column) -> Column:
    return F.filter(F.split(c, BETWEEN), lambda w: w != "")


def detect_lang(c: Column) -> Column:
    low = tr_lower(c)
    letters = F.length(low) - F.length(F.translate(low, TR_LETTERS, ""))

    def counted(first: Column) -> Column:
        hits = lambda known: F.size(F.filter(first, lambda w: w.isin(*known)))
        return F.struct(F.size(first).alias("n"), hits(TR_STOPWORDS).alias("tr"), hits(EN_STOPWORDS).alias("en"), letters.alias("letters"))

    def vote(v: Column) -> Column:
        tr, en = v["tr"] + v["letters"] * TR_LETTER_WEIGHT, v["en"]
        return F.when((v["n"] < 3) | ((tr < 1) & (en < 1)), "und").when(tr >= en, "tr").otherwise("en")

    return let(let(F.slice(words(low), 1, LANG_WORDS), counted), vote)


def truncate_chars(c: Column, n: int) -> Column:
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 1), F.lit("…"))).otherwise(c)


def tokens(c: Column) -> Column:
    """Search tokens: two bytes at least, 40 characters at most; repeats kept."""
    return F.filter(F.split(fold(tr_lower(c)), BETWEEN), lambda t: (F.octet_length(t) >= 2) & (F.length(t) <= 40))


#: Characters whose case, base letter and kind are the same in every version of Unicode at hand:
#: Latin letters up to here, and general punctuation.
_LATIN, _PUNCTUATION = 0x250, range(0x2000, 0x2070)
_RARE = rf"[^\x{{0}}-\x{{{_LATIN - 1:X}}}\x{{{_PUNCTUATION[0]:X}}}-\x{{{_PUNCTUATION[-1]:X}}}]"


def _token_map() -> np.ndarray:
    """What ``tokens`` makes of each of these characters before it splits: a letter, digit or space."""
    base, out = dict(zip(FOLD_FROM, FOLD_TO, strict=True)), np.full(1 << 16, ord(" "), np.uint16)
    for code in range(_LATIN):
        c = {"I": "ı", "İ": "i"}.get(chr(code), chr(code)).lower()
        c = base.get(c, c)
        if unicodedata.category(c)[0] in "LN":
            out[code] = ord(c)
    return out


_TOKEN_MAP = _token_map()


def token_sources(c: Column) -> list[Column]:
    """``plain``: texts whose tokens ``counted_terms`` finds by itself; ``others``: tokens of the rest."""
    rare = (F.octet_length(c) != F.length(c)) & c.rlike(_RARE)
    return [F.when(~rare, c).alias("plain"), F.when(rare, tokens(c)).alias("others")]


def pieces(batch: pa.RecordBatch, rows: int = 1000, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """A batch with ``plain`` in parts of bounded rows and bytes; longer texts go alone."""
    start = held = 0
    for i, n in enumerate(pc.binary_length(batch["plain"]).to_pylist()):
        if i > start and (i - start >= rows or held + (n or 0) > limit):
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n or 0
    if batch.num_rows > start:
        yield batch.slice(start)


def counted_terms(piece: pa.RecordBatch, words: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows with ``token_sources``: numbers of tokens (-1: no text), and how often (``tf``) a row
    has which of ``words``: rows, words' numbers, ``tf``."""
    n, found, sizes = np.full(piece.num_rows, -1, np.int64), [], np.zeros(piece.num_rows, np.int64)
    for i, (plain, others) in enumerate(zip(piece["plain"], piece["others"], strict=True)):
        if (s := plain.as_py()) is not None:
            codes = _TOKEN_MAP[np.frombuffer(s.encode("utf-16-le"), np.uint16)]
            every = codes.tobytes().decode("utf-16-le").split()
            n[i] = _sized(codes)
        elif (every := others.as_py()) is not None:
            n[i] = len(every)
        else:
            continue
        mine = [words[t] for t in every if t in words]
        found += mine
        sizes[i] = len(mine)
    key, tf = np.unique(np.repeat(np.arange(piece.num_rows), sizes) * len(words) + np.array(found, np.int64), return_counts=True)
    doc, term = np.divmod(key, max(1, len(words)))
    return n, doc, term, tf


def _sized(codes: np.ndarray) -> int:
    """How many words have the size of a token: 40 characters at most, two bytes at least."""
    edges = np.flatnonzero(np.diff(codes != ord(" "), prepend=False, append=False))
    starts, size = edges[::2], edges[1::2] - edges[::2]
    return int(((size <= 40) & ((size > 1) | (codes[starts] > 127))).sum())


def without_repeats(a: Column) -> Column:
    """An array without elements equal to the one before."""
    return F.filter(a, lambda x, i: (i == 0) | (x != F.get(a, i - 1)))


def query_terms(c: Column) -> Column:
    """Tokens, before each long one its stem: it without its last two letters."""
    stems = F.transform(tokens(c), lambda t: F.when(F.length(t) >= 7, F.array(F.substring(t, F.lit(1), F.length(t) - 2), t)).otherwise(F.array(t)))
    return without_repeats(F.flatten(stems))


def highlight_terms(c: Column) -> Column:
    return F.filter(tokens(c), lambda t: F.length(t) >= 3)


def char_ngrams(c: Column, n: int) -> Column:
    """Distinct windows of ``n`` characters of the folded text; a shorter text is one window."""

    def windows(s: Column) -> Column:
        every = F.transform(F.sequence(F.lit(1), F.length(s) - n + 1), lambda i: F.substring(s, i, F.lit(n)))
        return F.when(F.length(s) == 0, F.array().cast("array<string>")).when(F.length(s) < n, F.array(s)).otherwise(F.array_distinct(every))

    return let(F.trim(F.regexp_replace(fold(tr_lower(c)), BETWEEN, " ")), windows)


def _both(a: Column, b: Column, n: int, body) -> Column:
    return let(F.struct(char_ngrams(a, n).alias("x"), char_ngrams(b, n).alias("y")), lambda g: body(g["x"], g["y"]))


def containment(a: Column, b: Column, n: int = 4) -> Column:
    """Share of ``a``'s windows that ``b`` has, 0 if it has none."""
    return _both(a, b, n, lambda x, y: F.when(F.size(x) == 0, 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(x)))


def ngram_similarity(a: Column, b: Column, n: int = 4) -> Column:
    share = lambda x, y: F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
    return _both(a, b, n, lambda x, y: F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(share(x, y)))


def question_type(c: Column) -> Column:
    q = tr_lower(c)
    out = F.lit(None).cast("string")
    for kind, marks in reversed(QUESTION_TYPES):
        out = F.when(reduce(lambda x, y: x | y, [q.contains(m) for m in marks]), kind).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def entities(c: Column) -> Column:
    """``array<struct<kind,text,value,unit>>``: all matches of each kind, kinds in fixed order."""
    every = lambda p: F.regexp_extract_all(c, F.lit("(?U)" + p), F.lit(0))
    number = lambda t: F.replace(F.regexp_extract(t, r"\d+[.,]?\d*", 0), F.lit(","), F.lit(".")).try_cast("double")
    none = F.lit(None)

    def made(kind: str, pattern: str, value=lambda t: none, unit=lambda t: none) -> Column:
        return F.transform(every(pattern), lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text"), value(t).cast("double").alias("value"), unit(t).cast("string").alias("unit")))

    unit = lambda t: F.nullif(F.regexp_extract(t, r"\s(\S+)\s*$", 1), F.lit(""))
    return F.concat(made("date", DATE), made("time", TIME), made("percentage", PERCENT, number), made("number", NUMBER_UNIT, number, unit), made("email", EMAIL), made("url", URL), made("code", CODE))


def analyze(c: Column) -> Column:
    """Question type, entities and search terms of a question."""
    return F.struct(question_type(c).alias("question_type"), entities(c).alias("entities"), query_terms(c).alias("terms"))


def normalize_query(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(F.trim(F.regexp_replace(tr_lower(c), r"\s+", " ")), r"[?.!]+$", ""))


def key_of(*parts: Column) -> Column:
    """SHA-256 of the parts, each followed by a unit separator."""
    return F.sha2(F.concat(*[x for p in parts for x in (p.cast("string"), F.lit("\u001f"))]), 256)


def cache_scope(model: Column, clearance: Column, docs: Column) -> Column:
    return F.concat_ws("|", model, clearance.cast("string"), F.array_join(F.array_sort(docs.cast("array<string>")), ","))


def best_snippet(text: Column, query: Column, max_chars: int) -> Column:
    """Window of ``max_chars`` that holds most distinct query terms (the first of equals), with
    ellipses where text is cut off."""
    step = max(1, max_chars // 4)

    def start(v: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.length(v["low"]) - max_chars, F.lit(0)), F.lit(step))
        score = lambda i: F.size(F.filter(v["terms"], lambda t: F.substring(v["low"], i + 1, F.lit(max_chars)).contains(t)))
        return -F.array_max(F.transform(starts, lambda i: F.struct(score(i).alias("n"), (-i).alias("s"))))["s"]

    def cut(at: Column) -> Column:
        body = F.trim(F.substring(text, at + 1, F.lit(max_chars)))
        return F.concat(F.when(at > 0, "…").otherwise(""), body, F.when(at + max_chars < F.length(text), "…").otherwise(""))

    held = F.struct(F.array_distinct(highlight_terms(query)).alias("terms"), fold(tr_lower(text)).alias("low"))
    short = F.length(text) <= max_chars
    return let(held, lambda v: F.when(short | (F.size(v["terms"]) == 0), truncate_chars(text, max_chars)).otherwise(let(start(v), cut)))


def _next_sign(text: str, i: int) -> str:
    """First character from ``i`` on that isn't white space, or nothing."""
    while i < len(text) and text[i].isspace():
        i += 1
    return text[i : i + 1]


def sentences_of(text: str) -> list[str]:
    """Sentences of one text: a stop ends one if white space and then a capital, digit, dash or
    bullet (or nothing) follow, it isn't within a number, and no abbreviation comes before it; an
    empty line ends one too.  Pieces under three characters join the sentence before."""
    out: list[str] = []
    start = i = 0

    def close(end: int) -> None:
        piece = text[start:end].strip()
        if piece and len(piece) < 3 and out:
            out[-1] += " " + piece
        elif piece:
            out.append(piece)

    while i < len(text):
        ends = text.startswith("\n\n", i)
        if text[i] in ".!?…" and (i + 1 == len(text) or text[i + 1].isspace()):
            follows = _next_sign(text, i + 1)
            word = text[start:i].rstrip(".")
            k = len(word)
            while k and (word[k - 1].isalnum() or word[k - 1] == "."):
                k -= 1
            known = word[k:].replace("I", "ı").replace("İ", "i").lower() in ABBREVIATIONS
            ends = (not follows or follows.isupper() or follows.isdecimal() or follows in "-•") and not known
        i += 1
        if ends:
            close(i)
            while i < len(text) and text[i].isspace():
                i += 1
            start = i
    close(len(text))
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def sentences(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(sentences_of, na_action="ignore")


def json_object_of(text: str) -> str | None:
    """First balanced JSON object in free text; braces within strings don't count."""
    start = text.find("{")
    while start >= 0:
        depth, quoted, skip = 0, False, False
        for i in range(start, len(text)):
            ch = text[i]
            if skip:
                skip = False
            elif quoted:
                skip, quoted = ch == "\\", ch != '"'
            elif ch == '"':
                quoted = True
            elif ch in "{}":
                depth += 1 if ch == "{" else -1
                if not depth:
                    return text[start : i + 1]
        return None
    return None


@F.pandas_udf(T.StringType())
def json_object(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(json_object_of, na_action="ignore")


def micros(column: str) -> Column:
    """Microseconds since 1970 of a time without zone (one with a zone: as the session shows it)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(`{column}` as timestamp_ntz))")
