"""The ask plan for a batch of queries: guard, cache probe, retrieval, context budget, answer, output
guard; with a model, further steps for queries whose answer isn't grounded; cache put and audit."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import answer, audit, guard, hooks, retrieval
from ..sources.tables import settled
from . import prompts

_COLUMNS = ("query_id", "kind", "answer", "markers", "support_ratio", "classification", "lang", "cached", "warnings", "trace")
_DETAILS = {"filename": "document", "page_from": None, "page_to": None, "heading_path": None}


def _no_markers() -> Column:
    return F.array().cast("array<int>")


def _refusal(lang: Column) -> Column:
    return F.when(lang == "en", guard.REFUSALS["en"]).otherwise(guard.REFUSALS["tr"])


def _trace(*steps: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(k).alias("kind"), v.cast("string").alias("detail")) for k, v in steps])


def _row(kind: Column, said: Column, markers: Column, ratio: Column, level: Column, lang: Column, cached: Column, warnings: Column, trace: Column) -> list[Column]:
    return [F.col("query_id"), kind.alias("kind"), said.alias("answer"), markers.cast("array<int>").alias("markers"), ratio.cast("double").alias("support_ratio"), level.cast("int").alias("classification"), lang.alias("lang"), cached.alias("cached"), warnings.cast("array<string>").alias("warnings"), trace.alias("trace")]


def _answered(asked: DataFrame, chunks: DataFrame, limits: retrieval.Limits, output_guard: bool, budget: int, generate, step: int, texts: DataFrame | None = None) -> DataFrame:
    """One step: retrieval, context, answer and output guard for each query of ``asked``."""
    hits = retrieval.few_hits(retrieval.hybrid(chunks, asked, limits, texts=texts), asked, limits.final)
    texts = chunks if texts is None else texts
    for name, default in _DETAILS.items():
        if name not in texts.columns:
            texts = texts.withColumn(name, F.lit(default).cast("string") if default or name == "heading_path" else F.lit(1))
    found = settled(hits.join(texts.select("id", "text", "classification", *_DETAILS), "id"))
    context = settled(answer.context_blocks(found, budget).select("query_id", "rank", "id", "text", "classification", "score", "block"))
    sentences = context.select("query_id", "rank", F.posexplode(text.sentences("text")).alias("position", "sentence"))
    answers = answer.extractive(asked, sentences).withColumn("kind", F.lit("extractive"))
    if generate is not None:
        packed = answer.contexts(found, budget)
        asked_for = asked.join(packed, "query_id").select("query_id", prompts.answer_prompt(F.col("lang"), F.col("context"), F.col("query")).alias("prompt"))
        said = hooks.generated(asked_for, generate).select("query_id", F.col("answer").alias("said"))
        cited = F.array_distinct(F.transform(F.regexp_extract_all("said", F.lit(guard.MARKER), F.lit(1)), lambda m: m.try_cast("int")))
        only = F.coalesce(F.trim(F.regexp_replace("said", guard.MARKER, "")) == "", F.lit(True))  # nothing, or citations alone
        both = answers.join(said, "query_id", "left")
        answers = both.select("query_id", F.when(only, F.col("answer")).otherwise(F.col("said")).alias("answer"), F.when(only, F.col("markers")).otherwise(cited).alias("markers"), F.when(only, F.col("kind")).otherwise("grounded").alias("kind"))
    counts = context.groupBy("query_id").agg(F.count("*").alias("sources"))
    answers = settled(answers.join(counts, "query_id", "left").join(asked.select("query_id", "lang"), "query_id"))
    trace = _trace(("retrieve", F.coalesce("sources", F.lit(0))), ("generate", F.col("kind")))
    none = F.array().cast("array<string>")
    if not output_guard:
        return answers.select(*_row(F.col("kind"), F.col("answer"), F.col("markers"), F.lit(None), F.lit(None), F.col("lang"), F.lit(False), none, trace))
    said = answers.where((F.size("markers") > 0) | (F.col("kind") == "grounded")).select("query_id", F.posexplode(text.sentences("answer")).alias("position", "sentence"))
    checks = guard.groundedness(said, context).select("query_id", "grounded", "support_ratio", "reason")
    stamped = guard.stamp(guard.citations(answers.select("query_id", "markers"), context))
    joined = settled(answers.join(checks, "query_id", "left").join(stamped, "query_id", "left").withColumn("masked", guard.redact("answer")))
    ok = F.coalesce("grounded", F.lit(False))
    other = text.detect_lang(F.col("masked.text"))
    warnings = F.array(F.when(~ok, F.coalesce("reason", F.lit("no sources"))), F.when(ok & (F.size("masked.kinds") > 0), "personal data masked"), F.when(ok & (F.col("lang") != "und") & (other != "und") & (other != F.col("lang")), "answer in another language"))
    trace = F.concat(trace, _trace(("check", F.when(ok, "passed").otherwise(F.coalesce("reason", F.lit("no sources"))))))
    return joined.select(*_row(
        F.when(ok, F.col("kind")).otherwise("refused"), F.when(ok, F.col("masked.text")).otherwise(_refusal(F.col("lang"))), F.when(ok, F.col("markers")).otherwise(_no_markers()),
        F.when(ok, F.col("support_ratio")).otherwise(0.0), F.when(ok, F.col("classification")).otherwise(0), F.col("lang"), F.lit(False), F.filter(warnings, lambda w: w.isNotNull()), trace,
    ))


def keyed(queries: DataFrame, model: str) -> DataFrame:
    """``queries`` with the ``key`` and ``scope`` of their cache entries."""
    docs = F.coalesce("doc_filter", F.array().cast("array<long>")) if "doc_filter" in queries.columns else F.array().cast("array<long>")
    scope = text.cache_scope(F.lit(model), F.col("clearance"), docs)
    return queries.withColumns({"scope": scope, "key": answer.cache_key(F.col("query"), F.lit(model), F.col("clearance"), docs)})


def ask(queries: DataFrame, chunks: DataFrame, limits: retrieval.Limits = retrieval.Limits(), output_guard: bool = True, budget: int = 4000, cache: DataFrame | None = None, now: Column | None = None, model: str = "extractive", generate: Callable[[list[str]], list[str | None]] | None = None, rewrite: Callable[[list[str]], list[str | None]] | None = None, max_steps: int = 1, texts: DataFrame | None = None) -> DataFrame:
    """``(query_id, kind, answer, markers, support_ratio, classification, lang, cached, warnings,
    trace)`` for each query.

    ``queries``: ``query_id, query, vector, clearance``; ``chunks``: ``id, text, embedding,
    classification`` and, for the context, ``filename, page_from, page_to, heading_path`` if there
    are.  Blocked queries are answered ``blocked``; those without support ``refused``, in the query's
    language.  ``cache`` (``key, scope, clearance, vector, answer, markers, classification,
    created_at``) answers what it has.  ``generate`` writes answers from prompts; without it, and
    where it says nothing, sentences are extracted.  With ``rewrite``, refused queries are asked in
    other words, ``max_steps`` times in all.  ``texts``: the chunks without their vectors, if these are
    kept apart (as for ``hybrid``).
    """
    # A batch of queries is small beside the chunks: what is known of it is settled between the parts
    # of the plan, each of which would otherwise plan and work it out again.
    checked = settled(guard.check_queries(queries))
    open_ = checked.where("verdict.allowed").withColumn("lang", F.col("verdict.lang"))
    none = F.array().cast("array<string>")
    told = checked.where("not verdict.allowed").select(*_row(F.lit("blocked"), F.array_join("verdict.reasons", ", "), _no_markers(), F.lit(0.0), F.lit(0), F.col("verdict.lang"), F.lit(False), F.col("verdict.reasons"), _trace(("guard", F.lit("blocked")))))
    if cache is not None:
        probes = answer.probe(keyed(open_, model), cache, now if now is not None else F.current_timestamp()).where("hit <> 'miss'")
        probes = settled(probes)
        met = probes.join(cache.select(F.col("key").alias("cached_key"), "answer", "markers", "classification"), "cached_key").join(open_.select("query_id", "lang"), "query_id")
        told = told.unionByName(met.select(*_row(F.lit("grounded"), F.col("answer"), F.col("markers"), F.lit(1.0), F.col("classification"), F.col("lang"), F.lit(True), none, _trace(("cache", F.col("hit"))))))
        open_ = open_.join(probes.select("query_id"), "query_id", "left_anti")
        open_ = settled(open_)
    found = _answered(open_, chunks, limits, output_guard, budget, generate, 1, texts)
    for step in range(2, max_steps + 1):
        if rewrite is None:
            break
        found = settled(found)
        again = found.where("kind = 'refused'").select("query_id", F.col("trace").alias("before"))
        words = hooks.generated(open_.join(again.select("query_id"), "query_id", "left_semi").select("query_id", F.col("query").alias("prompt")), rewrite).where("answer is not null")
        asked = open_.join(words.select("query_id", F.col("answer").alias("__query")), "query_id").withColumn("query", F.col("__query")).drop("__query")
        more = _answered(settled(asked), chunks, limits, output_guard, budget, generate, step, texts).join(again, "query_id").withColumn("trace", F.concat("before", _trace(("rewrite", F.lit(step))), F.col("trace"))).select(*_COLUMNS)
        found = found.join(more.select("query_id"), "query_id", "left_anti").select(*_COLUMNS).unionByName(more)
    return told.unionByName(found)


def cached(answers: DataFrame, queries: DataFrame, cache: DataFrame, now: Column, model: str = "extractive") -> DataFrame:
    """``cache`` with the answers that weren't in it and are worth keeping."""
    fresh = answers.where("not cached").join(keyed(queries, model).select("query_id", "key", "scope", "clearance", "vector"), "query_id")
    return answer.put(cache, fresh.select("key", "scope", "clearance", "vector", "answer", "markers", "classification", "kind"), now)


def audited(answers: DataFrame, queries: DataFrame, at: Column) -> DataFrame:
    """The audit records of a batch of answers (``queries`` with ``actor``), chained by actor."""
    rows = answers.join(queries.select("query_id", "actor"), "query_id")
    detail = F.to_json(F.struct("kind", "cached", "support_ratio", "classification"))
    return audit.append(rows.select(F.col("query_id").alias("id"), at.alias("at"), "actor", F.lit("ask").alias("action"), F.lit(None).cast("string").alias("subject"), detail.alias("detail"), F.col("query_id").alias("seq")))
