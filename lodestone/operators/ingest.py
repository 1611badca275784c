"""From files and pages to chunks."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from ..functions import text
from ..functions.text import sentences_of

# ---- Fixed values ---------------------------------------------------------------------------
MAX_BYTES, MAX_PAGES, NAME_CHARS, OCR_BELOW = 50 * 1024 * 1024, 500, 180, 120
MIMES = ("application/pdf", "image/jpeg", "image/png")
NUMBERED = r"^\s*(\d+(?:\.\d+){0,4})\.?\s+(\S.{0,110})$"
KEYWORD = r"(?i)^\s*(madde|b[öo]l[üu]m|k[ıi]s[ıi]m|ek|annex|section|chapter|appendix|part)\s+([0-9IVXA-Z]+)"
HEADING_CHARS, UPPER_SHARE, SENTENCE_WORDS = 130, 0.85, 12
DARK_SHARE = 0.002
LOW_CONTRAST, SMALL_SIDE, MOST_SCALE, LARGE_SIDE, LOW_CONFIDENCE = 55.0, 1400, 3.0, 4000, 0.7
IMAGE_SIDE, IMAGE_BYTES = 20_000, 512 * 1024 * 1024
# ---------------------------------------------------------------------------------------------

#: Characters and chunks that a worker hands back at a time.
BATCH_CHARS, BATCH_ROWS = 1 << 20, 10_000


@dataclass(frozen=True)
class ChunkLimits:
    """Tokens of a chunk, of the overlap, and the fewest worth a chunk of their own."""

    budget: int = 380
    overlap: int = 64
    least: int = 40
    last: int = 8


def sniff(content: Column) -> Column:
    """MIME type by magic bytes; null if none fits or there are under eight bytes."""
    head = F.hex(F.substring(content, 1, 1024))
    pdf = F.regexp_extract(head, "^(?:..)*?255044462D", 0) != ""
    out = F.when(pdf, MIMES[0]).when(head.startswith("FFD8FF"), MIMES[1]).when(head.startswith("89504E470D0A1A0A"), MIMES[2])
    return F.when(F.octet_length(content) >= 8, out)


def accepted(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``files`` (``content``) with ``mime`` and why one is ``rejected`` (null: it isn't)."""
    rows = files.withColumn("mime", sniff(F.col("content")))
    reason = F.when(F.octet_length("content") > max_bytes, "too large").when(F.col("mime").isNull(), "unknown type")
    return rows.withColumn("rejected", reason)


def safe_name(c: Column) -> Column:
    """Last segment of a path without control and reserved characters."""
    last = F.element_at(F.split(c, r"[/\\]"), -1)
    clean = F.regexp_replace(F.regexp_replace(last, r'[\x00-\x1F\x7F<>:"|?*]', "_"), r"^[.\s]+|[.\s]+$", "")
    return F.when(F.coalesce(clean, F.lit("")) == "", "belge").otherwise(F.substring(clean, 1, NAME_CHARS))


def deduplicate(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", existing: DataFrame | None = None) -> DataFrame:
    """One row, that of the smallest id (null ids last), for each ``content_hash``; none that
    ``existing`` has.  Null texts count as empty.  Each task sends on one row a hash at most."""
    rows = docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    if existing is not None:
        rows = rows.join(existing.select("content_hash"), "content_hash", "left_anti")
    order = Window.partitionBy("content_hash").orderBy(F.col(id_col).asc_nulls_last())
    return rows.withColumn("__place", F.row_number().over(order)).where("__place = 1").drop("__place")


def document_stats(pages: DataFrame) -> DataFrame:
    """Per document: pages with text, mean confidence, language by its first 20,000 characters,
    number of pages that need recognition.  ``pages``: ``doc_id, page_no, text, confidence``."""
    rows = pages.withColumns({"clean": text.clean(F.col("text")), "needs_ocr": F.length("text") < OCR_BELOW})
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.length("clean") > 0, F.struct("page_no", F.substring("clean", 1, 20_000).alias("t"))))), lambda x: x["t"]), "\n")
    out = rows.groupBy("doc_id").agg(F.count_if(F.length("clean") > 0).alias("pages"), F.avg(F.when(F.length("clean") > 0, F.col("confidence"))).alias("confidence"), F.count_if("needs_ocr").alias("ocr_pages"), whole.alias("__text"))
    return out.withColumn("lang", text.detect_lang(F.substring("__text", 1, 20_000))).drop("__text")


# ---- Recognised text ------------------------------------------------------------------------


def ocr_lines(words: DataFrame, least: float = 0.0) -> DataFrame:
    """Lines from rows of an OCR table: ``(doc_id, page, line_key, text, confidence, dropped)``.

    ``words``: ``doc_id, seq, level, page, block, par, line, conf, text``; words are of level 5, with
    a confidence from 0 to 100, and join in order of ``seq``.
    """
    rows = words.where((F.col("level") == 5) & (F.trim("text") != "") & (F.col("conf") >= 0))
    good = F.col("conf") / 100 >= least
    parts = F.array_sort(F.collect_list(F.when(good, F.struct("seq", F.trim("text").alias("t")))))
    out = rows.groupBy("doc_id", "page", "block", "par", "line").agg(F.array_join(F.transform(parts, lambda x: x["t"]), " ").alias("text"), F.avg(F.when(good, F.col("conf") / 100)).alias("confidence"), F.count_if(~good).alias("dropped"), F.min("seq").alias("first"))
    return out


def otsu(image: np.ndarray) -> int:
    """Threshold of most variance between the two parts of a gray histogram."""
    counts = np.bincount(image.ravel(), minlength=256).astype(float)
    total, levels = counts.sum(), np.arange(256)
    below, mass = np.cumsum(counts), np.cumsum(counts * levels)
    above = total - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nan_to_num(between).argmax())


def binarize(image: np.ndarray) -> np.ndarray:
    return np.where(image > otsu(image), 255, 0).astype(np.uint8)


def is_blank(image: np.ndarray) -> bool:
    return float((image < 128).mean()) < DARK_SHARE if image.size else True


def within_limits(height: int, width: int, channels: int = 1) -> bool:
    """Whether an image of these measures may be decoded."""
    return 0 < height <= IMAGE_SIDE and 0 < width <= IMAGE_SIDE and height * width * channels <= IMAGE_BYTES


def prepared(image: np.ndarray) -> np.ndarray:
    """An image as recognisers like it: gray; small ones enlarged, at most threefold; faint ones black
    and white; none over the largest side."""
    gray = image.astype(float) @ [0.299, 0.587, 0.114] if image.ndim == 3 else image.astype(float)
    side = min(gray.shape)
    if 0 < side < SMALL_SIDE:
        gray = _resized(gray, min(SMALL_SIDE / side, MOST_SCALE))
    if gray.size and gray.std() < LOW_CONTRAST:
        gray = binarize(gray.round().astype(np.uint8)).astype(float)
    if gray.size and max(gray.shape) > LARGE_SIDE:
        gray = _resized(gray, LARGE_SIDE / max(gray.shape))
    return gray.round().clip(0, 255).astype(np.uint8)


def _resized(gray: np.ndarray, scale: float) -> np.ndarray:
    """By straight lines between the nearest points, first down, then across."""
    for axis in (0, 1):
        n = gray.shape[axis]
        at = np.clip((np.arange(round(n * scale)) + 0.5) / scale - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        high, share = np.minimum(low + 1, n - 1), at - low
        share = share[:, None] if axis == 0 else share
        gray = gray.take(low, axis) * (1 - share) + gray.take(high, axis) * share
    return gray


# ---- Structure ------------------------------------------------------------------------------


def heading_level(line: Column) -> Column:
    """1 to 5 for headings, null for other lines."""
    t = F.trim(line)
    letters = F.regexp_replace(t, r"[^\p{IsAlphabetic}]", "")
    upper = F.length(F.regexp_replace(letters, r"[^\p{Lu}]", ""))
    number = F.regexp_extract(t, NUMBERED, 1)
    dots = F.length(number) - F.length(F.replace(number, F.lit("."), F.lit("")))
    n_words = F.size(F.filter(F.split(t, r"\s+"), lambda w: w != ""))
    numbered = (number != "") & (~t.endswith(".") | (n_words <= SENTENCE_WORDS))
    shout = (F.length(letters) >= 4) & (upper / F.length(letters) > UPPER_SHARE) & ~t.endswith(".")
    return F.when((F.length(t) == 0) | (F.length(t) > HEADING_CHARS), None).when(numbered, F.least(dots + 1, F.lit(5))).when(t.rlike(KEYWORD) | shout, 1)


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(F.split(text_col, "\n")).alias("line_no", "line")).withColumn("level", heading_level(F.col("line")))


def blocks(rows: DataFrame) -> DataFrame:
    """``(doc_id, block, level, text)``: headings, and paragraphs between headings and empty lines."""
    order = Window.partitionBy("doc_id").orderBy("line_no")
    empty = F.trim("line") == ""
    heads = F.col("level").isNotNull()
    turn = (empty | heads | F.lag(empty | heads, 1, True).over(order)).cast("int")
    island = F.sum(turn).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = rows.withColumn("block", island).where(~empty)
    out = marked.groupBy("doc_id", "block").agg(F.min("level").alias("level"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.trim("line").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return out


def _size(s: str) -> int:
    return -(-len(s) * 10 // 36)


_NUMBERED, _KEYWORD = re.compile(NUMBERED, re.ASCII), re.compile(KEYWORD, re.ASCII)


def level_of(line: str) -> int | None:
    """``heading_level`` of one line."""
    t = line.strip(" ")
    if not t or len(t) > HEADING_CHARS:
        return None
    if (m := _NUMBERED.match(t)) and (not t.endswith(".") or len(t.split()) <= SENTENCE_WORDS):
        return min(m[1].count(".") + 1, 5)
    if _KEYWORD.match(t):
        return 1
    letters = [c for c in t if c.isalpha()]
    shout = len(letters) >= 4 and sum(c.isupper() for c in letters) / len(letters) > UPPER_SHARE
    return 1 if shout and not t.endswith(".") else None


@dataclass
class Part:
    """A heading (with a level) or paragraph of a page."""

    text: str
    level: int | None = None
    page: int = 1
    confidence: float = 1.0


def parts_of(body: str, page: int = 1, confidence: float = 1.0) -> Iterator[Part]:
    """Headings and paragraphs of a page's text, in order."""
    held: list[str] = []
    for line in [*body.split("\n"), ""]:
        line = line.strip(" ")
        level = level_of(line) if line else None
        if line and level is None:
            held.append(line)
            continue
        if held:
            yield Part(" ".join(held), None, page, confidence)
            held = []
        if line:
            yield Part(line, level, page, confidence)


class Builder:
    """Folds parts into chunks: a chunk is closed by what would take it over the budget, and by a
    heading once it is half full; it needs ``least`` tokens, unless it is the last.  Headings are
    part of the text, and on the path of what follows.  A chunk that a paragraph opens starts with
    the end of the one before."""

    def __init__(self, limits: ChunkLimits):
        self.limits, self.out, self.stack, self.tail = limits, [], [], ""
        self._open()

    def _open(self) -> None:
        self.held, self.size, self.pages, self.sure = [], 0, [], []

    def _close(self, last: bool = False) -> bool:
        body = "\n".join(self.held)
        if not self.held or (_size(body) < self.limits.last if last else self.size < self.limits.least):
            return False
        path = " > ".join(t for _, t in self.stack) or None
        sure = sum(self.sure) / len(self.sure) if self.sure else 1.0
        self.out.append((path, body, self.pages[0], self.pages[-1], sure))
        self.tail = overlap(" ".join(self.held), self.limits.overlap) if self.limits.overlap else ""
        self._open()
        return True

    def _put(self, part: Part, piece: str) -> None:
        if not self.held and part.level is None and self.tail:
            self.held, self.size, self.tail = [self.tail], _size(self.tail), ""
        self.held.append(piece)
        self.size += _size(piece)
        self.pages.append(part.page)
        if part.level is None:
            self.sure.append(part.confidence)

    def add(self, part: Part) -> None:
        if part.level is not None:
            if self.size >= self.limits.budget // 2:
                self._close()
            self.stack = [x for x in self.stack if x[0] < part.level] + [(part.level, part.text)]
            self._put(part, part.text)
            return
        for piece in [part.text] if _size(part.text) <= self.limits.budget else sentences_of(part.text):
            if self.size + _size(piece) > self.limits.budget:
                self._close()
            self._put(part, piece)

    def finish(self) -> list[tuple[str | None, str, int, int, float]]:
        self._close(last=True)
        return self.out


def chunks_of(parts: Iterable[Part], limits: ChunkLimits = ChunkLimits()) -> list[tuple[str | None, str, int, int, float]]:
    """``(heading path, text, first page, last page, confidence)`` of the chunks of one document."""
    builder = Builder(limits)
    for part in parts:
        builder.add(part)
    return builder.finish()


def overlap(body: str, budget: int) -> str:
    """Last sentences of a text up to a budget, one at least."""
    out: list[str] = []
    for s in reversed(sentences_of(body)):
        if out and _size(" ".join([s, *out])) > budget:
            break
        out.insert(0, s)
    return " ".join(out)


def chunk_pages(pages: DataFrame, limits: ChunkLimits = ChunkLimits()) -> DataFrame:
    """``(doc_id, ordinal, chunk_id, heading_path, text, page_from, page_to, tokens, confidence,
    lang)``: chunks of each document, ordinals dense from 0, ids by hash of document and ordinal.

    ``pages``: ``doc_id, text`` and, if there are, ``page_no`` (1), ``confidence`` (1.0), ``lang``
    (that of the document; chunks of unknown language are judged by their own text).  Pages of a
    document are brought together in order if they have numbers.  The fold over one document's parts
    runs row by row in Python; null texts are empty pages.
    """
    has = set(pages.columns)
    page = F.struct((F.col("page_no").cast("int") if "page_no" in has else F.lit(1)).alias("page_no"), F.coalesce("text", F.lit("")).alias("text"), (F.col("confidence").cast("double") if "confidence" in has else F.lit(1.0)).alias("confidence"))
    lang = F.col("lang") if "lang" in has else F.lit(None).cast("string")
    if "page_no" in has:
        rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"), F.first(lang, ignorenulls=True).alias("lang"))
    else:
        rows = pages.select("doc_id", F.array(page).alias("pages"), lang.alias("lang"))
    kind = pages.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "ordinal", "heading_path", "text", "page_from", "page_to", "confidence", "lang"]

    schema = T.StructType.fromDDL(f"doc_id {kind}, ordinal int, heading_path string, text string, page_from int, page_to int, confidence double, lang string")
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        out, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):  # one document at a time: a batch may hold thousands of long ones
                key, held, own = (batch[c][i].as_py() for c in ("doc_id", "pages", "lang"))
                parts = (p for x in held for p in parts_of(x["text"], x["page_no"], x["confidence"]))
                for k, (path, body, a, b, sure) in enumerate(chunks_of(parts, limits)):
                    out.append((key, k, path, body, a, b, sure, own))
                    size += len(body)
                    if size > BATCH_CHARS or len(out) >= BATCH_ROWS:
                        yield made()
                        out, size = [], 0
        if out:
            yield made()

    found = rows.mapInArrow(run, schema)
    told = F.when(F.coalesce("lang", F.lit("und")) == "und", text.detect_lang(F.col("text"))).otherwise(F.col("lang"))
    return found.select("doc_id", "ordinal", chunk_id(F.col("doc_id"), F.col("ordinal")).alias("chunk_id"), "heading_path", "text", "page_from", "page_to", text.estimate_tokens(F.col("text")).alias("tokens"), "confidence", told.alias("lang"))


def chunk_id(doc: Column, ordinal: Column) -> Column:
    return text.key_of(doc, ordinal)


def chunk_documents(docs: DataFrame, limits: ChunkLimits = ChunkLimits(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``chunk_pages`` of documents of one page each."""
    own = ["lang"] if "lang" in docs.columns else []
    return chunk_pages(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *own), limits)


# ---- Files and pages ------------------------------------------------------------------------


def page_limit(pages: DataFrame, most: int = MAX_PAGES) -> DataFrame:
    """``(doc_id, n_pages, rejected)``: a document needs a page and has ``most`` at most."""
    n = pages.groupBy("doc_id").agg(F.count("page_no").alias("n_pages"))
    return n.withColumn("rejected", F.when(F.col("n_pages") == 0, "no pages").when(F.col("n_pages") > most, "too many pages"))


def page_texts(pages: DataFrame, recognise: Callable[[list[bytes]], list[tuple[str, float]]] | None = None, below: int = OCR_BELOW) -> DataFrame:
    """``pages`` (``doc_id, page_no, text, image``) with ``text, method, confidence``: the text layer,
    or what ``recognise`` (images in, texts and confidences out; none: nothing is recognised) finds
    where the layer has under ``below`` characters; both, if both have text."""
    kinds = F.struct(F.lit("").alias("text"), F.lit(0.0).alias("confidence"))

    @F.pandas_udf("text string, confidence double")
    def read(parts: pd.Series) -> pd.DataFrame:
        some = [x is not None for x in parts]
        found = iter(recognise([bytes(x) for x in parts if x is not None]))
        return pd.DataFrame([next(found) if s else ("", 0.0) for s in some], columns=["text", "confidence"])

    layer = F.trim(F.coalesce("text", F.lit("")))
    short = F.length(layer) < below
    rows = pages.withColumn("__ocr", F.when(short, read("image")).otherwise(kinds) if recognise else kinds)
    seen = F.trim(F.coalesce("__ocr.text", F.lit("")))
    method = F.when(seen == "", "pdf_text").when(layer == "", "ocr").otherwise("hybrid")
    whole = F.when(seen == "", layer).when(layer == "", seen).otherwise(F.concat_ws("\n", layer, seen))
    sure = F.when(seen == "", 1.0).otherwise(F.col("__ocr.confidence"))
    out = rows.withColumns({"__m": method, "__t": text.clean(whole), "__c": sure})
    return out.drop("text", "__ocr", "image").withColumnsRenamed({"__m": "method", "__t": "text", "__c": "confidence"})


def ingest_report(pages: DataFrame) -> DataFrame:
    """``document_stats`` with ``warnings``: no text, language not told, low confidence."""
    out = document_stats(pages)
    told = F.array(F.when(F.col("pages") == 0, "no text"), F.when(F.col("lang") == "und", "unknown language"), F.when(F.coalesce("confidence", F.lit(0.0)) < LOW_CONFIDENCE, "low confidence"))
    return out.withColumn("warnings", F.filter(told, lambda w: w.isNotNull()))


def tsv_words(files: DataFrame, tsv_col: str = "tsv") -> DataFrame:
    """Rows of OCR engines' twelve-column tables, as ``ocr_lines`` takes them; the header goes."""
    rows = files.select("doc_id", F.posexplode(F.split(tsv_col, "\n")).alias("seq", "row")).withColumn("f", F.split("row", "\t"))
    rows = rows.where(F.size("f") >= 12).withColumns({n: F.get("f", F.lit(k)).try_cast("int") for n, k in (("level", 0), ("page", 1), ("block", 2), ("par", 3), ("line", 4))})
    return rows.where("level is not null").select("doc_id", "seq", "level", "page", "block", "par", "line", F.get("f", F.lit(10)).try_cast("double").alias("conf"), F.get("f", F.lit(11)).alias("text"))
