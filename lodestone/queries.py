"""Queries over the test tables, one an operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import checks, text, vectors
from .operators import access, answer, audit, expansion, guard, ingest, retrieval
from .plans.ask import ask
from .sources.tables import table
from .streaming import limits

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Clearance under test; a document's level is its id modulo 5.
CLEARANCE = 2


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(values) -> str:
    return "(" + ", ".join(map(quoted, values)) + ")"


# ---- SQL of the text functions --------------------------------------------------------------
TR_LOWER = "lower(translate({}, 'Iİ', 'ıi'))"
FOLD = f"translate({{}}, {quoted(text.FOLD_FROM)}, {quoted(text.FOLD_TO)})"
SPLIT = r"regexp_split_to_array({}, '[^\p{{L}}\p{{N}}]+')"


def sql_tokens(c: str) -> str:
    return f"list_filter({SPLIT.format(FOLD.format(TR_LOWER.format(c)))}, lambda t: strlen(t) >= 2 AND length(t) <= 40)"


def sql_words(c: str) -> str:
    return f"list_filter({SPLIT.format(c)}, lambda t: t <> '')"


def sql_terms(c: str) -> str:
    stems = f"flatten(list_transform({sql_tokens(c)}, lambda t: CASE WHEN length(t) >= 7 THEN [left(t, length(t)::INT - 2), t] ELSE [t] END))"
    return f"list_filter({stems}, lambda x, i: i = 1 OR x <> ({stems})[i - 1])"


def sql_grams(c: str, n: int) -> str:
    s = f"trim(regexp_replace({FOLD.format(TR_LOWER.format(c))}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    return f"CASE WHEN length({s}) = 0 THEN []::VARCHAR[] WHEN length({s}) < {n} THEN [{s}] ELSE list_distinct(list_transform(range(1, length({s})::INT - {n - 2}), lambda i: substr({s}, i::INT, {n}))) END"


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").withColumn("classification", (F.col("doc_id") % 5).cast("int"))


DOCS = "(SELECT *, (doc_id % 5)::INT AS classification FROM documents)"


# ---- Text functions -------------------------------------------------------------------------


@query(f"SELECT doc_id, md5({TR_LOWER.format('text')}) AS lowered, md5(lower(translate(text, 'İ', 'i'))) AS folded_case, md5(upper(replace(translate(text, 'iı', 'İI'), 'ß', 'SS'))) AS raised, md5({FOLD.format('text')}) AS folded FROM documents")
def case_maps(spark, d):
    c = F.col("text")
    return documents(spark, d).select("doc_id", F.md5(text.tr_lower(c)).alias("lowered"), F.md5(text.casefold(c)).alias("folded_case"), F.md5(text.tr_upper(c)).alias("raised"), F.md5(text.fold(c)).alias("folded"))


def sql_clean(c: str) -> str:
    s = f"replace(replace(replace({c}, E'\\r\\n', E'\\n'), 'ﬁ', 'fi'), 'ﬂ', 'fl')"
    for a, b in ((r"(\p{L})[-­]\n(\p{Ll})", r"\1\2"), (r"(\p{Ll},?)\n(\p{Ll})", r"\1 \2"), (r"[ \t\x0B\f\r]+", " ")):
        s = f"regexp_replace({s}, '{a}', '{b}', 'g')"
    s = f"regexp_replace({s}, '\\n{{3,}}', E'\\n\\n', 'g')"
    s = f"regexp_replace({s}, ' +(\\n|\\z)', '\\1', 'g')"
    return f"regexp_replace({s}, '\\A\\s+|\\s+\\z', '', 'g')"


@query(f"SELECT doc_id, length({sql_clean('text')})::BIGINT AS n, md5({sql_clean('text')}) AS cleaned FROM documents")
def clean_text(spark, d):
    c = text.clean(F.col("text"))
    return documents(spark, d).select("doc_id", F.length(c).cast("long").alias("n"), F.md5(c).alias("cleaned"))


@query("SELECT doc_id, ceil(length(text) / 3.6::DOUBLE)::BIGINT AS n_tokens FROM documents")
def token_estimates(spark, d):
    return documents(spark, d).select("doc_id", text.estimate_tokens(F.col("text")).alias("n_tokens"))


_LOW = TR_LOWER.format("text")


@query(f"""
    WITH w AS (SELECT doc_id, {sql_words(_LOW)}[1:{text.LANG_WORDS}] AS w, length(regexp_replace({_LOW}, '[^{text.TR_LETTERS}]', '', 'g')) AS letters FROM documents),
    s AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x IN {strings(text.TR_STOPWORDS)})) + letters * {text.TR_LETTER_WEIGHT}::DOUBLE AS tr, len(list_filter(w, lambda x: x IN {strings(text.EN_STOPWORDS)})) AS en FROM w)
    SELECT doc_id, CASE WHEN n < 3 OR (tr < 1 AND en < 1) THEN 'und' WHEN tr >= en THEN 'tr' ELSE 'en' END AS lang_vote FROM s""")
def language_vote(spark, d):
    return documents(spark, d).select("doc_id", text.detect_lang(F.col("text")).alias("lang_vote"))


@query(f"SELECT doc_id, len({sql_tokens('text')})::INT AS n, md5(array_to_string({sql_tokens('text')}, ' ')) AS tokens FROM documents")
def search_tokens(spark, d):
    t = text.tokens(F.col("text"))
    return documents(spark, d).select("doc_id", F.size(t).alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


@query(f"SELECT item_id, array_to_string({sql_terms('text')}, ' ') AS terms, array_to_string(list_filter({sql_tokens('text')}, lambda t: length(t) >= 3), ' ') AS marked FROM benchmark")
def query_terms(spark, d):
    c = F.col("text")
    return table(spark, d, "benchmark").select("item_id", F.array_join(text.query_terms(c), " ").alias("terms"), F.array_join(text.highlight_terms(c), " ").alias("marked"))


@query(f"""
    WITH p AS (SELECT a.conv_id, a.turn, a.text AS x, b.text AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1),
    g AS (SELECT conv_id, turn, {sql_grams('x', 4)} AS gx, {sql_grams('y', 4)} AS gy FROM p)
    SELECT conv_id, turn, CASE WHEN len(gx) = 0 THEN 0.0 ELSE len(list_intersect(gx, gy)) / len(gx)::DOUBLE END AS contained,
           CASE WHEN len(gx) = 0 OR len(gy) = 0 THEN 0.0 ELSE len(list_intersect(gx, gy)) / len(list_distinct(list_concat(gx, gy)))::DOUBLE END AS likeness FROM g""")
def ngram_overlap(spark, d):
    c = table(spark, d, "conversations")
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("y"))
    return c.join(b, ["conv_id", "turn"]).select("conv_id", "turn", text.containment(F.col("text"), F.col("y")).alias("contained"), text.ngram_similarity(F.col("text"), F.col("y")).alias("likeness"))


@query("SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 99) || '…' ELSE text END AS head FROM documents")
def truncated(spark, d):
    return documents(spark, d).select("doc_id", text.truncate_chars(F.col("text"), 100).alias("head"))


_NORM = f"rtrim(regexp_replace(trim(regexp_replace({TR_LOWER.format('text')}, '\\s+', ' ', 'g')), '[?.!]+$', ''))"


@query(f"SELECT item_id, {_NORM} AS normal, sha256({_NORM} || chr(31) || 'model|2|1,2' || chr(31)) AS cache_key FROM benchmark")
def cache_keys(spark, d):
    b = table(spark, d, "benchmark")
    return b.select("item_id", text.normalize_query(F.col("text")).alias("normal"), answer.cache_key(F.col("text"), F.lit("model"), F.lit(2), F.array(F.lit(2), F.lit(1))).alias("cache_key"))


def _sql_type() -> str:
    low = TR_LOWER.format("text")
    whens = " ".join(f"WHEN {' OR '.join(f'contains({low}, {quoted(m)})' for m in marks)} THEN '{kind}'" for kind, marks in text.QUESTION_TYPES)
    return f"CASE {whens} ELSE 'unknown' END"


@query(f"SELECT conv_id, turn, {_sql_type()} AS question_type FROM conversations")
def question_types(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", text.question_type(F.col("text")).alias("question_type"))


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{text.EMAIL}'))::INT AS n_email, len(regexp_extract_all(text, '{text.TIME}'))::INT AS n_time, len(regexp_extract_all(text, '{text.URL}'))::INT AS n_url FROM documents")
def entity_counts(spark, d):
    e = text.entities(F.col("text"))
    n = lambda kind: F.size(F.filter("e", lambda x: x["kind"] == kind)).alias(f"n_{kind}")
    return documents(spark, d).select("doc_id", e.alias("e")).select("doc_id", n("email"), n("time"), n("url"))


@query()
def snippets(spark, d):
    b = table(spark, d, "benchmark").select(F.col("text").alias("q"), F.col("item_id"))
    return documents(spark, d).join(b, F.col("doc_id") == F.col("item_id")).select("doc_id", text.best_snippet(F.col("text"), F.col("q"), 200).alias("snippet"))


@query()
def sentence_counts(spark, d):
    return documents(spark, d).select("doc_id", F.size(text.sentences("text")).alias("n_sentences"))


# ---- Checks ---------------------------------------------------------------------------------


@query(r"""
    WITH m AS (SELECT doc_id, regexp_extract_all(text, '\b(?:\d{1,3}\.){3}\d{1,3}\b') AS ips, regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b') AS emails,
               list_transform(regexp_extract_all(text, '\b(?:\d{4}[ -]?){3}\d{4}\b'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS cards FROM documents)
    SELECT doc_id, len(emails)::INT AS n_email, len(list_filter(ips, lambda x: list_max(string_split(x, '.')::INT[]) <= 255))::INT AS n_ip,
           len(list_filter(cards, lambda c: list_sum(list_transform(range(1, 17), lambda i: CASE WHEN i % 2 = 1 THEN (2 * substr(c, i::INT, 1)::INT) // 10 + (2 * substr(c, i::INT, 1)::INT) % 10 ELSE substr(c, i::INT, 1)::INT END)) % 10 = 0))::INT AS n_card FROM m""")
def identifier_counts(spark, d):
    return guard.pii_counts(documents(spark, d).select("doc_id", "text")).select("doc_id", "n_email", "n_ip", "n_card")


@query()
def pii_spans(spark, d):
    return documents(spark, d).select("doc_id", guard.detect_pii("text").alias("spans"))


@query()
def pii_redaction(spark, d):
    return documents(spark, d).select("doc_id", guard.redact("text").alias("r")).select("doc_id", "r.text", "r.kinds")


def _sql_rule(pattern: str) -> str:
    return pattern.replace(r"[\wçğıöşü]", r"[\pL\pN_]").replace(r"\w", r"[\pL\pN_]")


@query(f"""
    SELECT conv_id, turn, round(least(1.0, ({' + '.join(f"CASE WHEN regexp_matches(lower(translate(text, 'İ', 'i')), {quoted(_sql_rule(p))}) THEN {w}::DOUBLE ELSE 0 END" for _, _, w, p in guard.RULES)}) / {guard.FULL_SCORE}::DOUBLE), 9) AS score FROM conversations""")
def injection_scores(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.round(guard.injection_score(F.col("text")), 9).alias("score"))


# ---- Access ---------------------------------------------------------------------------------


@query(f"SELECT doc_id, CASE classification WHEN 0 THEN 'unclassified' WHEN 1 THEN 'restricted' ELSE 'confidential' END AS level FROM {DOCS} WHERE classification <= {CLEARANCE}")
def readable_documents(spark, d):
    rows = documents(spark, d).where(access.may_read(F.lit(CLEARANCE), F.col("classification")))
    return rows.select("doc_id", access.level_label(F.col("classification")).alias("level"))


@query(f"SELECT doc_id, classification <= {CLEARANCE} AS writable FROM {DOCS}")
def no_write_up(spark, d):
    return documents(spark, d).select("doc_id", access.may_write(F.lit(CLEARANCE), F.col("classification")).alias("writable"))


@query(f"SELECT i.item_id AS request_id, i.item_id * 40 AS doc_id, CASE WHEN c.doc_id IS NULL THEN 404 WHEN c.classification <= {CLEARANCE} THEN 200 ELSE 403 END::INT AS status FROM benchmark i LEFT JOIN {DOCS} c ON c.doc_id = i.item_id * 40")
def open_requests(spark, d):
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("request_id"), (F.col("item_id") * 40).alias("doc_id"), F.lit(CLEARANCE).alias("clearance"))
    return access.open_document(asked, documents(spark, d)).drop("clearance")


@query(f"SELECT doc_id FROM {DOCS} WHERE classification <= {CLEARANCE} ORDER BY doc_id DESC LIMIT 30")
def document_catalog(spark, d):
    rows = documents(spark, d).withColumns({"status": F.lit("ready"), "created_at": F.timestamp_seconds("doc_id")})
    return access.catalog(rows, CLEARANCE).select("doc_id")


@query("""
    WITH u AS (SELECT user_id, event_type AS last_type, value AS last_value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
    SELECT user_id, last_type, last_value FROM u WHERE r = 1""")
def user_upsert(spark, d):
    e = table(spark, d, "events").select("user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"), "event_id")
    return access.upsert(e.where("event_id % 2 = 0"), e, "user_id", "event_id").select("user_id", "last_type", "last_value")


@query("SELECT (SELECT count(*) FROM documents WHERE doc_id % 7 <> 0) AS documents, (SELECT count(*) FROM conversations WHERE conv_id % 7 <> 0) AS chunks, (SELECT count(*) FROM conversations WHERE conv_id % 7 <> 0) AS vectors")
def cascade_delete(spark, d):
    docs = documents(spark, d)
    chunks = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"))
    gone = docs.select("doc_id").union(chunks.select("doc_id")).where("doc_id % 7 = 0").distinct()
    a, b, c = access.delete_documents(gone, docs, chunks, chunks.select("chunk_id"))
    one = lambda t, name: t.agg(F.count("*").alias(name))
    return one(a, "documents").crossJoin(one(b, "chunks")).crossJoin(one(c, "vectors"))


@query("SELECT c.conv_id AS doc_id, c.turn::INT AS ordinal, d.lang, (d.doc_id % 5)::INT AS classification FROM conversations c JOIN documents d ON d.doc_id = c.conv_id")
def index_scan(spark, d):
    c = table(spark, d, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"))
    docs = documents(spark, d).withColumn("status", F.lit("ready"))
    return access.index_scan(c, c.select("chunk_id"), docs).select("doc_id", "ordinal", "lang", "classification")


# ---- Ingest ---------------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY text")
def exact_dedup(spark, d):
    return ingest.deduplicate(documents(spark, d)).select("content_hash", "doc_id")


@query("SELECT page_id, (octet_length(encode(html)) > 4096) AS too_large FROM pages")
def size_guard(spark, d):
    files = table(spark, d, "pages").select("page_id", F.col("html").cast("binary").alias("content"))
    rows = ingest.accepted(files, 4096)
    return rows.select("page_id", F.coalesce(F.col("rejected") == "too large", F.lit(False)).alias("too_large"))


@query(r"""SELECT page_id, CASE WHEN s = '' THEN 'belge' ELSE substr(s, 1, 180) END AS name FROM
    (SELECT page_id, regexp_replace(regexp_replace(string_split(url, '/')[-1], '[\x00-\x1F\x7F<>:"|?*]', '_', 'g'), '^[.\s]+|[.\s]+$', '', 'g') AS s FROM pages)""")
def safe_names(spark, d):
    return table(spark, d, "pages").select("page_id", ingest.safe_name(F.col("url")).alias("name"))


_SQL_LEVEL = r"""CASE WHEN length(t) = 0 OR length(t) > 130 THEN NULL
    WHEN num <> '' AND (NOT ends_with(t, '.') OR len(list_filter(regexp_split_to_array(t, '\s+'), lambda w: w <> '')) <= 12) THEN least(length(num) - length(replace(num, '.', '')) + 1, 5)
    WHEN regexp_matches(t, '(?i)^\s*(madde|b[öo]l[üu]m|k[ıi]s[ıi]m|ek|annex|section|chapter|appendix|part)\s+([0-9IVXA-Z]+)') THEN 1
    WHEN length(letters) >= 4 AND length(regexp_replace(letters, '[^\p{Lu}]', '', 'g')) / length(letters)::DOUBLE > 0.85 AND NOT ends_with(t, '.') THEN 1 END"""
_SQL_LINES = r"""lines AS (SELECT doc_id, i - 1 AS line_no, trim(a[i]) AS t, regexp_extract(trim(a[i]), '^\s*(\d+(?:\.\d+){0,4})\.?\s+(\S.{0,110})$', 1) AS num, regexp_replace(trim(a[i]), '[^\p{L}]', '', 'g') AS letters
    FROM (SELECT doc_id, a, unnest(range(1, len(a) + 1))::INT AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))"""


@query(f"WITH {_SQL_LINES}, l AS (SELECT doc_id, {_SQL_LEVEL} AS level FROM lines) SELECT doc_id, count(*) AS n_lines, count(level) AS n_headings, coalesce(sum(level), 0)::BIGINT AS levels FROM l GROUP BY doc_id")
def headings(spark, d):
    return ingest.lines(documents(spark, d)).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count("level").alias("n_headings"), F.coalesce(F.sum("level"), F.lit(0)).cast("long").alias("levels"))


@query(f"""WITH {_SQL_LINES}, l AS (SELECT doc_id, line_no, t, {_SQL_LEVEL} AS level FROM lines),
    b AS (SELECT *, t = '' OR level IS NOT NULL AS brk FROM l), c AS (SELECT *, brk OR lag(brk, 1, true) OVER (PARTITION BY doc_id ORDER BY line_no) AS turn FROM b),
    i AS (SELECT *, sum(turn::INT) OVER (PARTITION BY doc_id ORDER BY line_no ROWS UNBOUNDED PRECEDING) AS block FROM c WHERE true)
    SELECT doc_id, block::BIGINT AS block, min(level)::INT AS level, md5(string_agg(t, ' ' ORDER BY line_no)) AS text FROM i WHERE t <> '' GROUP BY doc_id, block""")
def paragraph_blocks(spark, d):
    rows = ingest.blocks(ingest.lines(documents(spark, d)))
    return rows.select("doc_id", "block", "level", F.md5("text").alias("text"))


@query()
def document_chunks(spark, d):
    return ingest.chunk_documents(documents(spark, d))


@query("SELECT c.conv_id AS doc_id, count(*) FILTER (length(regexp_replace(c.text, '\\s', '', 'g')) > 0) AS pages, avg((c.turn % 10) / 10.0::DOUBLE) FILTER (length(c.text) > 0) AS confidence, count(*) FILTER (length(c.text) < 120) AS ocr_pages FROM conversations c GROUP BY 1")
def document_statistics(spark, d):
    pages = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text", ((F.col("turn") % 10) / 10.0).alias("confidence"))
    return ingest.document_stats(pages).select("doc_id", "pages", "confidence", "ocr_pages")


@query("""SELECT user_id AS doc_id, event_type AS block, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) FILTER (value >= 35) AS text, count(*) FILTER (value < 35) AS dropped
    FROM events WHERE value BETWEEN 0 AND 100 GROUP BY 1, 2""")
def ocr_line_groups(spark, d):
    e = table(spark, d, "events").where("value between 0 and 100")
    words = e.select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("seq"), F.lit(5).alias("level"), F.lit(1).alias("page"), F.col("event_type").alias("block"), F.lit(1).alias("par"), F.lit(1).alias("line"), F.col("value").alias("conf"), F.col("event_id").cast("string").alias("text"))
    return ingest.ocr_lines(words, 0.35).select("doc_id", "block", F.nullif("text", F.lit("")).alias("text"), "dropped")


# ---- Retrieval ------------------------------------------------------------------------------


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("vec"), F.col("embedding"))
    return v, max(v.count(), 1)


def _queries(spark: SparkSession, d: str) -> DataFrame:
    v, n = _vectors(spark, d)
    b = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), (F.col("item_id") % n).alias("vec"))
    return b.join(v.withColumnRenamed("embedding", "vector"), "vec").drop("vec").withColumn("clearance", F.lit(CLEARANCE))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    """Every document, with the vector whose number is its own modulo how many there are."""
    v, n = _vectors(spark, d)
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "classification", (F.col("doc_id") % n).alias("vec"))
    return rows.join(v, "vec").drop("vec")


def _texts(spark: SparkSession, d: str) -> DataFrame:
    """``_chunks`` without vectors.  If every number has its vector, no text moves to meet one."""
    v, n = _vectors(spark, d)
    rows = documents(spark, d).select(F.col("doc_id").alias("id"), "text", "classification", (F.col("doc_id") % n).alias("vec"))
    seen = v.agg(F.count("vec").alias("n"), F.count_distinct("vec").alias("distinct"), F.min("vec").alias("first"), F.max("vec").alias("last")).head()
    whole = tuple(seen) == (n, n, 0, n - 1)
    return (rows.where("vec >= 0") if whole else rows.join(v.select("vec"), "vec")).drop("vec")


_SQL_CHUNKS = "nv AS (SELECT count(*) AS n FROM embeddings), chunks AS (SELECT doc_id AS id, text, classification, embedding FROM " + DOCS + " d CROSS JOIN nv JOIN embeddings ON vec_id = doc_id % n), asked AS (SELECT item_id AS query_id, text AS query, embedding AS vector FROM benchmark CROSS JOIN nv JOIN embeddings ON vec_id = item_id % n)"
_SQL_BM25 = f"""tok AS (SELECT id, classification, {sql_tokens('text')} AS t FROM chunks), lens AS (SELECT id, len(t) AS n FROM tok), stats AS (SELECT count(*) AS n_chunks, greatest(avg(n), 1) AS avg_n FROM lens),
    post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(t) AS term FROM tok) GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM post GROUP BY term),
    qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({sql_terms('query')}) AS term FROM asked) GROUP BY ALL),
    sp0 AS (SELECT query_id, p.id, sum(times * ln((n_chunks - df + 0.5) / (df + 0.5) + 1) * (tf * {1 + retrieval.K1}) / (tf + {retrieval.K1} * ({1 - retrieval.B} + {retrieval.B} * n / avg_n))) AS score
        FROM qt JOIN post p USING (term) JOIN dfs USING (term) JOIN lens USING (id) JOIN tok USING (id) CROSS JOIN stats WHERE classification <= {CLEARANCE} GROUP BY ALL),
    sp AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM sp0 QUALIFY rank <= 100)"""
_SQL_DENSE = f"""de0 AS (SELECT query_id, id, list_dot_product(embedding::DOUBLE[], vector::DOUBLE[]) AS score FROM chunks CROSS JOIN asked WHERE classification <= {CLEARANCE}),
    de AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM de0 QUALIFY rank <= 100)"""
_SQL_FUSE = f"""fu0 AS (SELECT query_id, id, sum(1 / ({retrieval.RRF_K} + rank)) AS score FROM (SELECT query_id, id, rank FROM de UNION ALL SELECT query_id, id, rank FROM sp) GROUP BY ALL),
    fu AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS rank FROM fu0 QUALIFY rank <= 50)"""


@query(f"WITH {_SQL_CHUNKS}, {_SQL_BM25} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM sp WHERE rank <= 10")
def bm25_search(spark, d):
    hits = retrieval.sparse(_texts(spark, d), _queries(spark, d), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_SQL_CHUNKS}, {_SQL_DENSE} SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM de WHERE rank <= 10")
def dense_search(spark, d):
    hits = retrieval.dense(_chunks(spark, d).drop("text"), _queries(spark, d), 10)
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {_SQL_CHUNKS}, {_SQL_BM25}, {_SQL_DENSE}, {_SQL_FUSE} SELECT query_id, id, round(score, 9) AS score FROM fu WHERE rank <= 20")
def rank_fusion(spark, d):
    c, q = _chunks(spark, d), _queries(spark, d)
    a = retrieval.dense(c.drop("text"), q, 100)
    b = retrieval.sparse(_texts(spark, d), q, 100)
    return retrieval.fuse(a, b, k=20).select("query_id", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {_SQL_CHUNKS}, {_SQL_BM25}, {_SQL_DENSE}, {_SQL_FUSE}, best AS (SELECT query_id, greatest(max(score), 1e-6) AS top FROM sp GROUP BY query_id),
    sc AS (SELECT fu.query_id, fu.id, {retrieval.DENSE_WEIGHT} * coalesce(de.score, 0) + {retrieval.SPARSE_WEIGHT} * coalesce(sp.score / top, 0) AS score
        FROM fu LEFT JOIN de ON de.query_id = fu.query_id AND de.id = fu.id LEFT JOIN sp ON sp.query_id = fu.query_id AND sp.id = fu.id LEFT JOIN best ON best.query_id = fu.query_id)
    SELECT query_id, id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id)::INT AS rank FROM sc WHERE score >= 0 QUALIFY rank <= 10""")
def hybrid_search(spark, d):
    hits = retrieval.hybrid(_chunks(spark, d), _queries(spark, d), diversify=False, expand=False, texts=_texts(spark, d))
    return hits.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query()
def diverse_search(spark, d):
    c, q = _chunks(spark, d), _queries(spark, d)
    found = retrieval.dense(c.drop("text"), q, 50).join(c.select("id", "embedding"), "id")
    return retrieval.mmr(found, q, 10)


@query(f"""WITH {_SQL_CHUNKS}, {_SQL_DENSE}, m AS (SELECT query_id // 4 AS parent, id, max(score) AS score FROM de WHERE rank <= 10 GROUP BY ALL)
    SELECT parent, id, round(score, 6) AS score, row_number() OVER (PARTITION BY parent ORDER BY round(score, 9) DESC, id)::INT AS rank FROM m QUALIFY rank <= 20""")
def merged_search(spark, d):
    q = _queries(spark, d)
    hits = retrieval.dense(_chunks(spark, d).drop("text"), q, 10)
    out = retrieval.merged(hits, q.select("query_id", F.floor(F.col("query_id") / 4).alias("parent")))
    return out.select("parent", "id", F.round("score", 6).alias("score"), "rank")


@query("""SELECT conv_id AS doc_id, turn::INT AS ordinal,
    md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING), '')) AS before,
    md5(coalesce(string_agg(text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), '')) AS after FROM conversations""")
def neighbour_texts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ordinal"), "text")
    return retrieval.neighbours(c).select("doc_id", "ordinal", F.md5("before").alias("before"), F.md5("after").alias("after"))


@query(f"""WITH {_SQL_CHUNKS}, {_SQL_DENSE}, p AS (SELECT query_id, id - id % 10 AS parent, min(rank) AS f FROM de WHERE rank <= 10 GROUP BY ALL)
    SELECT query_id, parent AS id, row_number() OVER (PARTITION BY query_id ORDER BY f, parent)::INT AS rank FROM p WHERE parent IN (SELECT id FROM chunks)""")
def parent_chunks(spark, d):
    c = _chunks(spark, d)
    hits = retrieval.dense(c.drop("text"), _queries(spark, d), 10)
    return retrieval.parents(hits, c.withColumn("parent_id", F.col("id") - F.col("id") % 10))


@query()
def expanded_queries(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.concat_ws(" ", "text", F.lit("model veri")).alias("query"))
    return expansion.expanded_terms(q)


def _sql_hash(dim: int) -> str:
    s = f"regexp_replace({FOLD.format(TR_LOWER.format('text'))}, '[^\\p{{L}}\\p{{N}}]', ' ', 'g')"
    grams = " UNION ALL ".join(f"SELECT item_id, substr(s, i::INT, {n}) AS g FROM (SELECT item_id, s, unnest(range(1, length(s)::INT - {n - 2})) AS i FROM t)" for n in vectors.GRAMS)
    return f"""WITH t AS (SELECT item_id, {s} AS s FROM benchmark), g AS ({grams}),
        h AS (SELECT item_id, ('0x' || substr(sha256(g), 1, 8))::BIGINT % {dim} AS k, CASE WHEN ('0x' || substr(sha256(g), 9, 1))::INT % 2 = 0 THEN 1.0 ELSE -1.0 END AS sign FROM g WHERE trim(g) <> ''),
        v AS (SELECT item_id, k, sum(sign)::DOUBLE AS x FROM h GROUP BY ALL)
        SELECT item_id AS id, k::INT AS at, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM v"""


@query(_sql_hash(64))
def hash_embeddings(spark, d):
    rows = retrieval.hash_embeddings(table(spark, d, "benchmark"), 64, "item_id")
    held = rows.select("id", F.posexplode("embedding").alias("at", "x"))
    grams = table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.explode(vectors.hash_grams(F.col("text"), 64)).alias("g")).select("id", F.col("g.at").alias("at")).distinct()
    return held.join(grams, ["id", "at"]).select("id", "at", F.round("x", 6).alias("x"))


# ---- Answers, cache, audit ------------------------------------------------------------------


@query(f"""WITH b AS (SELECT conv_id AS query_id, turn::INT + 1 AS rank, '[' || (turn + 1) || '] kaynak: ' || role || ' | s. ' || (turn + 1) || CASE WHEN turn % 2 = 0 THEN '' ELSE '-' || (turn + 2) END || ' | bölüm: -' || chr(10) ||
        replace(replace(text, '<|', '(|'), '|>', '|)') || chr(10) || chr(10) AS block FROM conversations),
    c AS (SELECT *, sum(ceil(length(block) / 3.6::DOUBLE)) OVER (PARTITION BY query_id ORDER BY rank) AS used FROM b)
    SELECT query_id, count(*)::INT AS included, md5('<belgeler>' || chr(10) || string_agg(block, '' ORDER BY rank) || '</belgeler>') AS context FROM c WHERE used <= 300 OR rank = 1 GROUP BY query_id""")
def packed_contexts(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.col("role").alias("filename"), (F.col("turn") + 1).cast("int").alias("page_from"), F.lit(None).cast("string").alias("heading_path"), "text")
    c = c.withColumn("page_to", F.col("page_from") + F.when(F.col("rank") % 2 == 1, 0).otherwise(1))
    return answer.contexts(c, 300).select("query_id", "included", F.md5("context").alias("context"))


def _spoken(spark: SparkSession, d: str) -> DataFrame:
    """Turns as sentences of hits: a plain split at stops, which SQL can do as well."""
    c = table(spark, d, "conversations").where("role = 'assistant'")
    return c.select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), F.posexplode(F.split("text", r"\. ")).alias("position", "sentence"))


_SQL_SPOKEN = "spoken AS (SELECT conv_id AS query_id, turn::INT + 1 AS rank, i::INT - 1 AS position, a[i] AS sentence FROM (SELECT conv_id, turn, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT *, string_split(text, '. ') AS a FROM conversations WHERE role = 'assistant')))"


@query(f"""WITH {_SQL_SPOKEN}, q AS (SELECT conv_id AS query_id, list_distinct(list_filter({sql_tokens('text')}, lambda t: length(t) >= 3)) AS terms FROM conversations WHERE turn = (SELECT min(turn) FROM conversations c WHERE c.role = 'user') AND role = 'user'),
    s AS (SELECT query_id, rank, position, sentence, len(list_intersect(terms, {sql_tokens('sentence')})) AS shared, greatest(len(terms), 1) AS n FROM spoken JOIN q USING (query_id) WHERE length(sentence) >= 25)
    SELECT query_id, rank, position, round(shared / n + 0.35 / rank, 9) AS score FROM s WHERE shared > 0""")
def sentence_scores(spark, d):
    c = table(spark, d, "conversations").where("role = 'user'")
    first = c.agg(F.min("turn").alias("t"))
    q = c.join(first, F.col("turn") == F.col("t")).select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    return answer.scored_sentences(q, _spoken(spark, d)).select("query_id", "rank", "position", F.round("score", 9).alias("score"))


@query()
def extractive_answers(spark, d):
    q = table(spark, d, "conversations").where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.min_by("text", "turn").alias("query")).withColumn("lang", text.detect_lang(F.col("query")))
    return answer.extractive(q, _spoken(spark, d))


_SQL_CONTEXT = "context AS (SELECT conv_id AS query_id, turn::INT + 1 AS rank, text FROM conversations WHERE role = 'user')"


@query(f"""WITH {_SQL_SPOKEN}, {_SQL_CONTEXT},
    s AS (SELECT query_id, rank * 1000 + position AS position, {sql_grams("trim(sentence)", 4)} AS a FROM spoken WHERE length(trim(sentence)) >= 12),
    g AS (SELECT query_id, position, unnest(a) AS g FROM s), c AS (SELECT query_id, rank, unnest({sql_grams("text", 4)}) AS g FROM context),
    m AS (SELECT query_id, position, c.rank, count(*) AS n FROM g JOIN c USING (query_id, g) GROUP BY ALL), best AS (SELECT query_id, position, max(n) AS n FROM m GROUP BY ALL),
    t AS (SELECT s.query_id, s.position, CASE WHEN len(a) = 0 THEN 0 ELSE coalesce(n, 0) / len(a)::DOUBLE END * 0.85::DOUBLE AS score FROM s LEFT JOIN best b ON b.query_id = s.query_id AND b.position = s.position)
    SELECT query_id, count(*) AS counted, count(*) FILTER (score >= 0.3::DOUBLE) AS supported, count(*) FILTER (score >= 0.3::DOUBLE) / count(*) >= 0.3::DOUBLE AS grounded FROM t GROUP BY query_id""")
def groundedness(spark, d):
    s = _spoken(spark, d).select("query_id", (F.col("rank") * 1000 + F.col("position")).alias("position"), "sentence")
    c = table(spark, d, "conversations").where("role = 'user'").select(F.col("conv_id").alias("query_id"), (F.col("turn") + 1).cast("int").alias("rank"), "text", F.lit(1.0).alias("score"))
    return guard.groundedness(s, c).where("counted > 0").select("query_id", "counted", "supported", "grounded")


@query("""WITH a AS (SELECT vec_id, embedding, label FROM embeddings), c AS (SELECT vec_id, embedding, label FROM embeddings WHERE label % 2 = 0),
    m AS (SELECT a.vec_id, c.vec_id AS k, list_dot_product(a.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS s FROM a JOIN c ON a.label % 3 = c.label % 3 AND c.label <= a.label WHERE a.label % 2 = 1)
    SELECT a.vec_id AS query_id, CASE WHEN a.label % 2 = 0 THEN 'exact' WHEN b.k IS NOT NULL THEN 'semantic' ELSE 'miss' END AS hit
    FROM a LEFT JOIN (SELECT vec_id, min(k) AS k FROM m WHERE s >= 0.3::DOUBLE GROUP BY 1) b ON a.vec_id = b.vec_id""")
def cache_probe(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("vec_id").cast("string").alias("key"), (F.col("label") % 3).cast("string").alias("scope"), F.col("label").alias("clearance"), F.col("embedding").alias("vector"))
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    cache = e.where("clearance % 2 = 0").drop("query_id").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return answer.probe(e, cache, now, near=0.3).select("query_id", "hit")


def _log(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("id"), text.micros("ts").alias("at"), F.col("user_id").alias("actor"), F.col("event_type").alias("action"), F.lit(None).cast("string").alias("subject"), F.col("props").alias("detail"), F.col("event_id").alias("seq"))
    return audit.append(rows)


_SQL_PAYLOAD = "concat_ws('|', event_id, epoch_us(ts), user_id, event_type, '', coalesce(props, ''))"


@query(f"""WITH RECURSIVE r AS (SELECT user_id, event_id, {_SQL_PAYLOAD} AS p, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
    c AS (SELECT user_id, event_id, k, sha256('GENESIS|' || p) AS hash FROM r WHERE k = 1 UNION ALL SELECT r.user_id, r.event_id, r.k, sha256(c.hash || '|' || r.p) FROM c JOIN r ON r.user_id = c.user_id AND r.k = c.k + 1)
    SELECT user_id AS actor, event_id AS seq, hash FROM c""")
def audit_chain(spark, d):
    return _log(spark, d).select("actor", "seq", "hash")


@query("""SELECT user_id AS actor, count(*) AS records, CASE WHEN count(*) > 5 THEN 5 END::INT AS first_broken FROM events GROUP BY 1""")
def audit_verify(spark, d):
    from pyspark.sql.window import Window

    log = _log(spark, d)
    place = F.row_number().over(Window.partitionBy("actor").orderBy("seq"))
    n = F.count("*").over(Window.partitionBy("actor"))
    forged = log.withColumns({"__p": place, "__n": n}).withColumn("action", F.when((F.col("__p") == 5) & (F.col("__n") > 5), "forged").otherwise(F.col("action"))).drop("__p", "__n")
    return audit.verify(forged)


@query("SELECT event_id AS seq, user_id AS actor FROM events ORDER BY event_id DESC LIMIT 200")
def audit_recent(spark, d):
    rows = audit.recent(table(spark, d, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("actor"), "event_type"))
    return rows.select("seq", F.get_json_object("record", "$.actor").cast("long").alias("actor"))


@query("SELECT count(*) AS chunks, coalesce(sum(value), 0) AS hits, max(event_id) AS version FROM events")
def health_counts(spark, d):
    return table(spark, d, "events").agg(F.count("*").alias("chunks"), F.coalesce(F.sum("value"), F.lit(0.0)).alias("hits"), F.max("event_id").alias("version"))


# ---- Limits and metrics ---------------------------------------------------------------------


@query()
def rate_limited(spark, d):
    return limits.rate_limit(table(spark, d, "events"), "user_id", 2, 6 * 3600)


@query("SELECT time_bucket(INTERVAL 1 hour, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def request_counters(spark, d):
    return limits.counters(table(spark, d, "events"), size="1 hour")


@query(f"SELECT event_type, le::DOUBLE AS le, count(*) FILTER (value / 10 <= le) AS n FROM events, (SELECT unnest([{', '.join(map(str, limits.BUCKETS))}]::DOUBLE[]) AS le) GROUP BY ALL")
def latency_histogram(spark, d):
    e = table(spark, d, "events").withColumn("v10", F.col("value") / 10)
    return limits.histogram(e, "v10", "event_type")


@query()
def ask_batch(spark, d):
    return ask(_queries(spark, d), _chunks(spark, d), retrieval.Limits(), texts=_texts(spark, d))
