"""Context packing, extractive answers and the answer cache."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text
from .guard import REFUSALS

# ---- Fixed values ---------------------------------------------------------------------------
NEUTRAL = (("<belgeler>", "(belgeler)"), ("</belgeler>", "(/belgeler)"), ("<documents>", "(documents)"), ("</documents>", "(/documents)"), ("<|", "(|"), ("|>", "|)"))
MIN_SENTENCE, MIN_TERM, RANK_BONUS = 25, 3, 0.35
CACHE_TTL, CACHE_NEAR, CACHE_SIZE = 3600, 0.96, 512
# ---------------------------------------------------------------------------------------------

#: Queries and cache entries of one scope that meet in one task at most, on average; products held at a time.
PROBE_ROWS, PROBE_PAIRS = 8192, 2_000_000


def neutralized(c: Column) -> Column:
    """Text in which nothing looks like a mark of the prompt."""
    for a, b in NEUTRAL:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def page_label(first: Column, last: Column) -> Column:
    return F.when(first == last, F.format_string("s. %d", first)).otherwise(F.format_string("s. %d-%d", first, last))


def context_blocks(hits: DataFrame, budget: int) -> DataFrame:
    """``hits`` (``query_id, rank, filename, page_from, page_to, heading_path, text``) that fit a
    token budget, with their ``block``.  The first always fits; costs are positive, so a running sum
    cuts a prefix."""
    block = F.format_string("[%d] kaynak: %s | %s | bölüm: %s\n%s\n\n", F.col("rank"), F.col("filename"), page_label(F.col("page_from"), F.col("page_to")), F.coalesce("heading_path", F.lit("-")), neutralized(F.col("text")))
    rows = hits.withColumn("block", block).withColumn("cost", text.estimate_tokens(F.col("block")))
    upto = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("used", F.sum("cost").over(upto)).where((F.col("used") <= budget) | (F.col("rank") == 1))


def contexts(hits: DataFrame, budget: int) -> DataFrame:
    """``(query_id, context, included)``: one prompt context a query."""
    blocks = context_blocks(hits, budget).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "block"))).alias("b"))
    body = F.array_join(F.transform("b", lambda x: x["block"]), "")
    return blocks.select("query_id", F.concat(F.lit("<belgeler>\n"), body, F.lit("</belgeler>")).alias("context"), F.size("b").alias("included"))


def scored_sentences(queries: DataFrame, sentences: DataFrame) -> DataFrame:
    """``(query_id, rank, position, sentence, score)``: sentences of hits that share terms with the
    query.  ``sentences``: ``query_id, rank, position, sentence``."""
    asked = queries.select("query_id", F.array_distinct(F.filter(text.tokens(F.col("query")), lambda t: F.length(t) >= MIN_TERM)).alias("terms"))
    both = sentences.where(F.length("sentence") >= MIN_SENTENCE).join(asked, "query_id")
    shared = F.size(F.array_intersect("terms", text.tokens(F.col("sentence"))))
    score = shared / F.greatest(F.size("terms"), F.lit(1)) + RANK_BONUS / F.col("rank")
    return both.withColumn("shared", shared).where("shared > 0").select("query_id", "rank", "position", "sentence", score.alias("score"))


def best_sentences(scored: DataFrame, n: int) -> DataFrame:
    """The ``n`` best of each query; a sentence equal to the one before it in score order goes."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "rank", "position")
    kept = scored.withColumn("same", F.lag("sentence").over(order).eqNullSafe(F.col("sentence"))).where("not same").drop("same")
    return kept.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def extractive(queries: DataFrame, sentences: DataFrame, n: int = 3) -> DataFrame:
    """``(query_id, answer, markers)``: best sentences as bullets in order of their sources, or a
    refusal in the query's ``lang``."""
    best = best_sentences(scored_sentences(queries, sentences), n)
    rows = best.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "place", "sentence"))).alias("s"))
    lines = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- "), F.trim(x["sentence"]), F.lit(" ["), x["rank"].cast("string"), F.lit("]"))), "\n")
    lang = F.coalesce("lang", F.lit("und")) if "lang" in queries.columns else F.lit("und")
    prefix = F.when(lang == "en", "Relevant excerpts from the documents:").otherwise("Belgelerden ilgili bölümler:")
    refusal = F.when(lang == "en", REFUSALS["en"]).otherwise(REFUSALS["tr"])
    out = queries.join(rows, "query_id", "left")
    answer = F.when(F.col("s").isNull(), refusal).otherwise(F.concat(prefix, F.lit("\n\n"), lines))
    return out.select("query_id", answer.alias("answer"), F.coalesce(F.array_distinct(F.transform("s", lambda x: x["rank"])), F.array().cast("array<int>")).alias("markers"))


# ---- Cache ----------------------------------------------------------------------------------


def cache_key(query: Column, model: Column, clearance: Column, docs: Column) -> Column:
    return text.key_of(text.normalize_query(query), text.cache_scope(model, clearance, docs))


def live(cache: DataFrame, now: Column, ttl: int = CACHE_TTL) -> DataFrame:
    return cache.where(F.col("created_at") >= now - F.make_interval(secs=F.lit(ttl)))


def probe(queries: DataFrame, cache: DataFrame, now: Column, ttl: int = CACHE_TTL, near: float = CACHE_NEAR) -> DataFrame:
    """``(query_id, hit, cached_key)``: exact, semantic or miss.  ``queries``: ``query_id, key, scope,
    clearance, vector``; ``cache``: ``key, scope, clearance, vector, created_at``.  A semantic hit is
    the nearest live entry of the same scope that asks no higher clearance.

    All pairs of a scope are compared, in tiles of bounded size: matrix products in Python find the
    pairs that can matter, which are worked out in the order of ``vectors.dot``.
    """
    c = live(cache, now, ttl).select(F.col("key").alias("cached_key"), F.col("scope").alias("c_scope"), F.col("clearance").alias("c_clearance"), F.col("vector").alias("c_vector"))
    exact = queries.join(c, F.col("key") == F.col("cached_key"), "left_semi").select("query_id", F.lit("exact").alias("hit"), F.col("key").alias("cached_key"))
    rest = queries.join(exact, "query_id", "left_anti").where("vector is not null")
    met = _nearest(rest, c.where("c_vector is not null"), near)
    order = Window.partitionBy("query_id").orderBy(F.desc("like"), "cached_key")
    semantic = met.withColumn("r", F.row_number().over(order)).where("r = 1").select("query_id", F.lit("semantic").alias("hit"), "cached_key")
    found = exact.unionByName(semantic)
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("hit", F.lit("miss")).alias("hit"), "cached_key")


def _nearest(queries: DataFrame, cache: DataFrame, near: float) -> DataFrame:
    """``(query_id, cached_key, like)``: of each tile the nearest entry of each query, if it is near
    enough.  Scopes with more rows than a tile holds are dealt to a grid of tiles, small ones share
    tiles; a task holds one tile at a time, whatever the sizes."""
    queries = queries.where("scope is not null and clearance is not null").select("query_id", "scope", "clearance", "vector")
    cache = cache.where("c_scope is not null and c_clearance is not null").select("cached_key", "c_scope", "c_clearance", "c_vector")
    sides = queries.select("scope", F.lit(1).alias("nq"), F.lit(0).alias("nc")).unionByName(cache.select(F.col("c_scope").alias("scope"), F.lit(0).alias("nq"), F.lit(1).alias("nc")))
    sizes = sides.groupBy("scope").agg(F.sum("nq").alias("nq"), F.sum("nc").alias("nc"))
    total = sizes.agg(F.greatest(F.sum("nq"), F.sum("nc")).alias("n")).head().n or 0
    shared = max(1, -(-total // PROBE_ROWS))
    tiles = lambda n: F.ceil(F.greatest(F.col(n), F.lit(1)) / PROBE_ROWS).cast("int").alias(n)
    large = sizes.where((F.col("nq") > PROBE_ROWS) | (F.col("nc") > PROBE_ROWS)).select(F.col("scope").alias("__large"), tiles("nq"), tiles("nc"))

    def dealt(rows: DataFrame, scope: str, key: str, own: str, other: str) -> DataFrame:
        """A row goes to one part of its own side, and there meets each part of the other."""
        both = rows.join(F.broadcast(large), F.col(scope) == F.col("__large"), "left")
        group = F.when(F.col("__large").isNull(), F.pmod(F.xxhash64(scope), F.lit(shared)).cast("string")).otherwise(F.concat(F.lit("/"), F.col("__large").cast("string")))
        part = F.pmod(F.xxhash64(key), F.coalesce(own, F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        return both.select(*rows.columns, group.alias("__group"), part.alias(f"__{own}"), every.alias(f"__{other}"))

    by = ["__group", "__nq", "__nc"]
    q, c = dealt(queries, "scope", "query_id", "nq", "nc"), dealt(cache, "c_scope", "cached_key", "nc", "nq")
    kinds = f"query_id {queries.schema['query_id'].dataType.simpleString()}, cached_key {cache.schema['cached_key'].dataType.simpleString()}, like double"
    return q.groupBy(*by).cogroup(c.groupBy(*by)).applyInArrow(_tile(near), kinds)


def _tile(near: float):
    def run(queries: pa.Table, cache: pa.Table) -> pa.Table:
        rows, keys, likes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        entries = _by_scope(cache["c_scope"])
        for scope, mine in _by_scope(queries["scope"]).items():
            if scope in entries:
                theirs = entries[scope]
                i, k, like = _nearest_pairs(queries.take(pa.array(mine)), cache.take(pa.array(theirs)), near)
                rows, keys, likes = [*rows, mine[i]], [*keys, theirs[k]], [*likes, like]
        i, k = pa.array(np.concatenate(rows)), pa.array(np.concatenate(keys))
        return pa.table({"query_id": queries["query_id"].take(i), "cached_key": cache["cached_key"].take(k), "like": pa.array(np.concatenate(likes))})

    return run


def _by_scope(scopes: pa.ChunkedArray) -> dict:
    """Row numbers of each scope."""
    codes, names = pd.factorize(scopes.to_pandas())
    order = np.argsort(codes, kind="stable")
    return dict(zip(names, np.split(order, np.cumsum(np.bincount(codes))[:-1]), strict=True)) if len(codes) else {}


class _Vectors:
    """Vectors as rows of one width: their lengths, which elements are null, and which vectors are
    ``plain`` (numbers whose products can't overflow)."""

    def __init__(self, column: pa.ChunkedArray):
        held = column.combine_chunks()
        held = pa.concat_arrays(held.chunks) if isinstance(held, pa.ChunkedArray) else held
        self.size = held.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        flat = held.flatten()
        values, gaps = flat.cast(pa.float64()).to_numpy(zero_copy_only=False), flat.is_null().to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(self.size)), self.size)
        at = np.arange(len(row)) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.values = np.zeros((len(self.size), int(self.size.max(initial=0))))
        self.values[row, at] = values
        self.plain = np.ones(len(self.size), bool)
        self.plain[row[~(np.abs(values) < 1e150)]] = False
        self.null = np.zeros(self.values.shape, bool)
        self.null[row, at] = gaps

    def dots(self, i: np.ndarray, other: _Vectors, k: np.ndarray) -> np.ndarray:
        """``vectors.dot`` of rows ``i`` and rows ``k`` of the other, term by term; where it is null, minus infinity."""
        out, null, last = np.zeros(len(i)), np.zeros(len(i), bool), np.minimum(self.size[i], other.size[k])
        with np.errstate(all="ignore"):
            for d in range(int(last.max(initial=0))):
                both = d < last
                out = np.where(both, out + self.values[i, d] * other.values[k, d], out)
                null |= both & (self.null[i, d] | other.null[k, d])
        return np.where(null, -np.inf, out)


def _nearest_pairs(queries: pa.Table, cache: pa.Table, near: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row numbers of queries and their nearest entries, of one scope, and how near they are."""
    q, c = _Vectors(queries["vector"]), _Vectors(cache["c_vector"])
    level, may = cache["c_clearance"].to_numpy(), queries["clearance"].to_numpy()
    names = cache["cached_key"].to_pylist()
    place = np.empty(len(names), np.int64)  # among the keys, by which ties are broken
    place[sorted(range(len(names)), key=lambda k: (names[k] is not None, names[k] or ""))] = np.arange(len(names))
    best, like = np.full(len(may), -1), np.full(len(may), -np.inf)

    def offer(i: np.ndarray, k: np.ndarray) -> None:
        """Pairs that may be the best of their queries."""
        held = np.flatnonzero(best[i] >= 0)
        s = np.concatenate([q.dots(i, c, k), like[i[held]]])
        i, k = np.concatenate([i, i[held]]), np.concatenate([k, best[i[held]]])
        ok = (s >= near) | np.isnan(s)  # to Spark, NaN is the greatest number
        i, k, s = i[ok], k[ok], s[ok]
        order = np.lexsort((place[k], -np.nan_to_num(s, nan=0.0), ~np.isnan(s), i))
        first = order[np.concatenate([[True], i[order][1:] != i[order][:-1]])] if len(order) else order
        best[i[first]], like[i[first]] = k[first], s[first]

    # Plain vectors: products of matrices; of equal entries of one level the first by key is enough.
    own, theirs = np.flatnonzero(q.plain), np.flatnonzero(c.plain)
    theirs = theirs[np.lexsort((place[theirs], level[theirs]))]
    width = min(q.values.shape[1], c.values.shape[1])
    a, b = np.ascontiguousarray(q.values[own, :width]), np.ascontiguousarray(c.values[theirs, :width])
    if width and len(theirs):
        # Equal in the columns compared and of one level.
        whole = np.ascontiguousarray(np.column_stack([b, level[theirs].astype(np.float64)]))
        _, first = np.unique(whole.view(f"V{whole.shape[1] * 8}").ravel(), return_index=True)
        theirs, b = theirs[np.sort(first)], b[np.sort(first)]
    upto = np.searchsorted(level[theirs], may[own], side="right")
    # By how much two ways to sum the products may differ, at most.
    norms = np.sqrt((b * b).sum(axis=1)).max(initial=0.0)
    slack = 4 * (width + 2) * np.finfo(np.float64).eps * norms * np.sqrt((a * a).sum(axis=1))
    step = max(1, PROBE_PAIRS // max(1, len(theirs)))
    for lo in range(0, len(own), step):
        some = slice(lo, lo + step)
        most = int(upto[some].max(initial=0))
        if not most:
            continue
        s = a[some] @ b[:most].T
        if int(upto[some].min()) < most:
            s[np.arange(most)[None] >= upto[some][:, None]] = -np.inf
        top = s.max(axis=1)
        rows = np.flatnonzero(top >= near - slack[some])
        floor = np.maximum(top[rows], near) - 2 * slack[some][rows]
        i, k = np.nonzero(s[rows] >= floor[:, None])
        offer(own[some][rows[i]], theirs[k])
    # The others: one by one, against all.
    for i in np.flatnonzero(~q.plain):
        k = np.flatnonzero(level <= may[i])
        offer(np.full(len(k), i), k)
    for k in np.flatnonzero(~c.plain):
        i = np.flatnonzero(q.plain & (level[k] <= may))
        offer(i, np.full(len(i), k))
    found = np.flatnonzero(best >= 0)
    return found, best[found], like[found]


def put(cache: DataFrame, answers: DataFrame, now: Column) -> DataFrame:
    """``cache`` with the ``answers`` (its columns but ``created_at`` and ``hits``, and ``kind``) that
    are worth keeping: refused and blocked ones are not.  An entry of the same key is replaced; its
    hits stay."""
    fresh = answers.where(F.col("kind").isin("grounded", "extractive")).drop("kind").withColumns({"created_at": now, "hits": F.lit(0).cast("long")})
    both = cache.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    last = F.max_by(F.struct(*[c for c in both.columns if c not in ("key", "hits", "__new")]), "__new").alias("e")
    return both.groupBy("key").agg(last, F.max("hits").alias("hits")).select("key", "e.*", "hits").select(*cache.columns)


def invalidate(cache: DataFrame) -> DataFrame:
    """The cache after documents came or went: empty."""
    return cache.limit(0)


def counted(cache: DataFrame, probes: DataFrame) -> DataFrame:
    """``cache`` with the hits of ``probe`` added to its entries."""
    met = probes.where(F.col("cached_key").isNotNull()).groupBy(F.col("cached_key").alias("key")).agg(F.count("*").alias("__more"))
    return cache.join(met, "key", "left").withColumn("hits", F.col("hits") + F.coalesce("__more", F.lit(0))).select(*cache.columns)


def hit_counts(probes: DataFrame) -> DataFrame:
    """``(exact, semantic, miss)``: how many probes ended how."""
    return probes.agg(*[F.count_if(F.col("hit") == k).alias(k) for k in ("exact", "semantic", "miss")])


def evict(cache: DataFrame, size: int = CACHE_SIZE) -> DataFrame:
    """The ``size`` entries inserted last (first in, first out)."""
    return cache.orderBy(F.desc("created_at"), "key").limit(size)
