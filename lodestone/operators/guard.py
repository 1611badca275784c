"""Guards: prompt injection, personal data, groundedness of answers."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import checks, text

# ---- Fixed values: rule, category, weight, pattern (on case-folded text) --------------------
RULES = (
    ("override_tr", "instruction_override", 0.85, r"(önceki|yukarıdaki|tüm|bütün|bundan önceki)\s+(talimat|kural|yönerge|komut)\w*\s*\w*\s*(yoksay|unut|görmezden|iptal|dikkate alma|geçersiz)"),
    ("override_en", "instruction_override", 0.85, r"(ignore|disregard|forget|override|bypass)\s+(all\s+|any\s+|the\s+)?(previous|prior|above|earlier|system)\s*(instruction|rule|prompt|direction)"),
    ("role_tr", "role_manipulation", 0.6, r"(sen\s+artık|bundan\s+sonra\s+sen|rolün\s+değişti|kısıtlaman\s+yok|sınırsız\s+mod)"),
    ("role_en", "role_manipulation", 0.6, r"(you\s+are\s+now|act\s+as\s+(a|an)\s|pretend\s+to\s+be|developer\s+mode|jailbreak|do\s+anything\s+now)"),
    ("exfil_tr", "prompt_exfiltration", 0.75, r"(sistem\s+(mesaj|talimat|prompt|istem)\w*|gizli\s+talimat\w*|kurallarını\s+(yaz|göster|söyle)|yukarıdaki\s+metni\s+(tekrarla|yazdır))"),
    ("exfil_en", "prompt_exfiltration", 0.75, r"(system\s+prompt|initial\s+instructions|reveal\s+your\s+(prompt|rules|instructions)|repeat\s+(the\s+)?(text|words)\s+above|print\s+your\s+instructions)"),
    ("delimiter", "delimiter_injection", 0.7, r"(<\|im_(start|end)\|>|<\|endoftext\|>|\[/?inst\]|</?belgeler>|</?documents>|^\s*###\s*(system|sistem))"),
    ("hijack_tr", "output_hijack", 0.45, r"(sadece|yalnızca)\s+[\wçğıöşü]+\s+(yaz|yanıtla|cevapla)|kaynak\s+(gösterme|belirtme|ekleme)|uydur"),
    ("hijack_en", "output_hijack", 0.45, r"(output\s+only|respond\s+with\s+only|answer\s+without\s+(citation|source)|make\s+up|fabricate)"),
    ("encoded", "encoded_payload", 0.5, r"[A-Za-z0-9+/]{80,}={0,2}"),
)
FULL_SCORE, BLOCK_SCORE, MAX_QUERY = 1.6, 0.5, 1000
MIN_SENTENCE, GRAM, SUPPORTED, UNMARKED = 12, 4, 0.30, 0.85
MIN_SUPPORT, MIN_TOP, SNIPPET = 0.3, 0.15, 240
MARKER = r"\[(\d{1,3})\]"
# ---------------------------------------------------------------------------------------------
REFUSALS = {"en": "The documents you may read hold no reliable answer to this question.", "tr": "Okuyabildiğiniz belgelerde bu soruya güvenilir bir yanıt yok."}


def triggered(query: Column) -> Column:
    """``array<struct<rule,category,weight>>`` of the rules that a query meets."""
    q = text.casefold(query)
    rows = [F.when(q.rlike("(?U)" + p), F.struct(F.lit(n).alias("rule"), F.lit(c).alias("category"), F.lit(w).alias("weight"))) for n, c, w, p in RULES]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


def injection_score(query: Column) -> Column:
    return F.least(F.aggregate(triggered(query), F.lit(0.0), lambda s, r: s + r["weight"]) / FULL_SCORE, F.lit(1.0))


def check_queries(queries: DataFrame, query_col: str = "query", denylist: tuple[str, ...] = (), block_pii: bool = False, max_chars: int = MAX_QUERY) -> DataFrame:
    """``queries`` with a ``verdict``: score, rules, whether allowed, why not, language, and the
    query to go on with (personal data masked if that blocks)."""
    q = F.trim(F.coalesce(F.col(query_col), F.lit("")))
    denied = reduce(lambda a, b: a | b, [text.casefold(q).contains(d.lower()) for d in denylist], F.lit(False))
    pii = redact(q) if block_pii else None
    rows = queries.withColumns({"__q": q, "__score": injection_score(q), "__rules": triggered(q)}).withColumn("__pii", pii if block_pii else F.lit(None))
    has_pii = F.size("__pii.kinds") > 0 if block_pii else F.lit(False)
    reasons = F.array(
        F.when(F.length("__q") == 0, "empty"), F.when(F.length("__q") > max_chars, "too long"), F.when(denied, "denied term"),
        F.when(has_pii, "personal data"), F.when(F.col("__score") >= BLOCK_SCORE, "injection"),
    )
    reasons = F.filter(reasons, lambda r: r.isNotNull())
    verdict = F.struct(
        (F.size(reasons) == 0).alias("allowed"), F.col("__score").alias("score"), F.col("__rules").alias("rules"), reasons.alias("reasons"),
        text.detect_lang(F.col("__q")).alias("lang"), (F.col("__pii.text") if block_pii else F.col("__q")).alias("query"),
    )
    return rows.withColumn("verdict", verdict).drop("__q", "__score", "__rules", "__pii")


# ---- Personal data --------------------------------------------------------------------------

_PATTERNS = [(k, re.compile(p), m) for k, p, m in checks.KINDS]


def _valid(kind: str, found: str) -> bool:
    digits = re.sub(r"\D", "", found)
    if kind == "tckn":
        d = [int(x) for x in found]
        return d[9] == (sum(d[0:9:2]) * 7 - sum(d[1:8:2])) % 10 and d[10] == sum(d[:10]) % 10
    if kind == "card":
        twice = [sum(divmod(2 * int(x), 10)) if i % 2 else int(x) for i, x in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(twice) % 10 == 0
    if kind == "iban":
        s = "".join(found.split())
        return 15 <= len(s) <= 34 and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    return True


def pii_of(value: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, mask)`` in order; where kinds overlap, the first in precedence stays."""
    found: list[tuple[int, int, str, str]] = []  # in order, and none overlaps another
    for kind, pattern, mask in _PATTERNS:
        fresh = []
        for m in pattern.finditer(value):
            k = bisect_left(found, (m.end(),))
            if not (k and found[k - 1][1] > m.start()) and _valid(kind, m[0]):
                fresh.append((m.start(), m.end(), kind, mask))
        if fresh:
            found = sorted([*found, *fresh])
    return found


@F.pandas_udf(T.ArrayType(T.StructType().add("kind", "string").add("start", "integer").add("end", "integer")))
def detect_pii(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for part in parts:
        yield part.map(lambda s: [{"kind": k, "start": a, "end": b} for a, b, k, _ in pii_of(s)], na_action="ignore")


@F.pandas_udf(T.StructType().add("text", "string").add("kinds", T.ArrayType(T.StringType())))
def redact(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Text with masks, and the kinds that were masked, in order of first place."""
    for part in parts:
        texts, kinds = [], []
        for s in part:
            out, at = [], 0
            found = pii_of(s) if s is not None else []
            for a, b, _, mask in found:
                out += [s[at:a], mask]
                at = b
            texts.append(None if s is None else "".join(out) + s[at:])
            kinds.append(list(dict.fromkeys(k for _, _, k, _ in found)))
        yield pd.DataFrame({"text": texts, "kinds": kinds})


def pii_counts(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with the number of valid matches of each kind (kinds may overlap), without Python."""
    return df.withColumns({f"n_{k}": F.size(checks.matches(F.col(text_col), k)) for k, _, _ in checks.KINDS})


# ---- Groundedness ---------------------------------------------------------------------------


def grounded_sentences(sentences: DataFrame, context: DataFrame) -> DataFrame:
    """``sentences`` (``query_id, position, sentence``) that count, with ``markers``, best score over
    the ``context`` (``query_id, rank, text``) and whether they are supported.

    A sentence is held against the chunks that it cites, or, at 0.85, against all.
    """
    n = context.groupBy("query_id").agg(F.count("*").alias("n_chunks"))
    s = sentences.withColumn("clean", F.trim(F.regexp_replace("sentence", MARKER, ""))).where(F.length("clean") >= MIN_SENTENCE)
    cited = F.transform(F.regexp_extract_all("sentence", F.lit(MARKER), F.lit(1)), lambda m: m.cast("int"))
    s = s.join(n, "query_id", "left").withColumn("markers", F.array_sort(F.array_distinct(F.filter(cited, lambda m: (m >= 1) & (m <= F.coalesce("n_chunks", F.lit(0)))))))
    # Windows of characters are made once a sentence and once a chunk, not once a pair.
    s = s.withColumn("__own", text.char_ngrams(F.col("clean"), GRAM))
    c = context.select(F.col("query_id").alias("__q"), F.col("rank").alias("__rank"), text.char_ngrams(F.col("text"), GRAM).alias("__grams"))
    both = s.join(c, (F.col("query_id") == F.col("__q")) & ((F.size("markers") == 0) | F.array_contains("markers", F.col("__rank"))), "left")
    share = F.when(F.size("__own") > 0, F.size(F.array_intersect("__own", "__grams")) / F.size("__own"))
    score = F.coalesce(share, F.lit(0.0)) * F.when(F.size("markers") == 0, UNMARKED).otherwise(1.0)
    out = both.groupBy("query_id", "position", "sentence", "markers").agg(F.max(score).alias("score"))
    return out.withColumn("supported", F.col("score") >= SUPPORTED)


def groundedness(sentences: DataFrame, context: DataFrame, min_support: float = MIN_SUPPORT, min_top: float = MIN_TOP) -> DataFrame:
    """One row a query: counted and supported sentences, ratio, unsupported ones, used markers, the
    best retrieval score, and whether the answer passes.  ``context`` has ``score``."""
    told = grounded_sentences(sentences, context)
    bad = F.transform(F.array_sort(F.collect_list(F.when(~F.col("supported"), F.struct("position", "sentence")))), lambda x: x["sentence"])
    agg = told.groupBy("query_id").agg(F.count("*").alias("counted"), F.count_if("supported").alias("supported"), bad.alias("unsupported"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("markers")))).alias("markers"))
    tops = context.groupBy("query_id").agg(F.max("score").alias("top_score"))
    asked = sentences.select("query_id").distinct()
    out = asked.join(agg, "query_id", "left").join(tops, "query_id", "left")
    ratio = F.when(F.coalesce("counted", F.lit(0)) > 0, F.col("supported") / F.col("counted")).otherwise(0.0)
    out = out.withColumn("support_ratio", ratio)
    top = F.coalesce("top_score", F.lit(0.0))
    reason = F.when(F.coalesce("counted", F.lit(0)) == 0, "nothing to check").when(F.col("support_ratio") < min_support, "unsupported").when(top < min_top, "weak sources")
    return out.withColumn("reason", reason).withColumn("grounded", reason.isNull())


def citations(markers: DataFrame, context: DataFrame, require: bool = True) -> DataFrame:
    """``(query_id, marker, id, snippet, classification)`` of the cited chunks (if citations aren't
    required and there are none, of the first)."""
    c = context.withColumnRenamed("rank", "marker")
    used = markers.select("query_id", F.explode("markers").alias("marker"))
    if not require:
        used = used.unionByName(markers.where(F.size("markers") == 0).select("query_id", F.lit(1).alias("marker")))
    return used.distinct().join(c, ["query_id", "marker"]).select("query_id", "marker", "id", text.truncate_chars(F.col("text"), SNIPPET).alias("snippet"), "classification")


def stamp(cited: DataFrame) -> DataFrame:
    """Highest classification among each answer's citations."""
    return cited.groupBy("query_id").agg(F.max("classification").alias("classification"))
