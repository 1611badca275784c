"""Chunks, hooks, plans, caches, indexes, settings and streams against small expected results."""

import datetime as dt
import hashlib
import json
import logging

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone import config, queries
from lodestone.functions import text
from lodestone.operators import answer, guard, hooks, ingest, retrieval
from lodestone.plans import prompts
from lodestone.streaming import limits


def test_chunk_builder_row_by_row(spark):
    def para(tag, n):
        return " ".join(f"{tag}{i:03d} word." for i in range(n))  # 36 signs (10 tokens) for three sentences

    pages = [
        (1, 1, "1 Intro\n" + para("a", 120), 0.9),
        (1, 2, "1.1 Part\n" + para("b", 60) + "\n\n" + para("c", 60), 0.5),
        (2, 1, "short text that stays alone though it is small", 1.0),
        (3, 1, None, 1.0),
    ]
    rows = spark.createDataFrame(pages, "doc_id long, page_no int, text string, confidence double").withColumn("lang", F.lit("und"))
    got = {(r.doc_id, r.ordinal): r for r in ingest.chunk_pages(rows).collect()}
    assert set(got) == {(1, 0), (1, 1), (2, 0)}
    a, b = got[1, 0], got[1, 1]
    # The heading of page 2 closes the first chunk, whose tokens are over half of the budget.
    assert a.text == "1 Intro\n" + para("a", 120) and (a.heading_path, a.page_from, a.page_to, a.confidence) == ("1 Intro", 1, 1, 0.9)
    assert b.text == "1.1 Part\n" + para("b", 60) + "\n" + para("c", 60) and (b.heading_path, b.page_from, b.page_to, b.confidence) == ("1 Intro > 1.1 Part", 2, 2, 0.5)
    assert all(r.tokens == -(-len(r.text) * 10 // 36) and r.chunk_id == hashlib.sha256(f"{r.doc_id}\x1f{r.ordinal}\x1f".encode()).hexdigest() for r in got.values())
    assert got[2, 0].text.startswith("short text") and got[2, 0].lang in ("und", "en", "tr")


def test_long_paragraphs_are_cut_at_sentences_with_overlap():
    body = " ".join(f"Sentence number {i:04d} stands here." for i in range(120))
    got = ingest.chunks_of(ingest.parts_of(body))
    assert len(got) > 2 and all(ingest._size(t) <= 380 + 64 + 10 for _, t, *_ in got)
    first, second = got[0][1].split("\n"), got[1][1].split("\n")
    assert second[0] == " ".join(first[-6:]) or second[0].endswith(first[-1])


def test_levels_same_as_column(spark):
    lines = ["1 Intro", "1.2.3 Deep part", "2. A sentence that has number and ends with a stop and is far too long to be one here.", "MADDE 7", "chapter IV", "ALL CAPS TITLE", "ALL CAPS END.", "abc", "", "ÖZET VE SONUÇ", "x" * 200, "3) no", "1.1.1.1.1 five", "  4 spaced  ", "AB1", "Ünlü Ad"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = {r.i: r.level for r in rows.select("i", ingest.heading_level(F.col("line")).alias("level")).collect()}
    assert [got[i] for i in range(len(lines))] == [ingest.level_of(x) for x in lines]


def test_deduplicate_keeps_nulls_and_one_of_repeats(spark):
    docs = spark.createDataFrame([(2, "a"), (1, "a"), (1, "a"), (5, None), (4, None), (None, "b")], "doc_id long, text string")
    assert sorted((r.doc_id is None, r.doc_id, r.text) for r in ingest.deduplicate(docs).collect() if r.doc_id is not None) == [(False, 1, "a"), (False, 4, None)]
    assert ingest.deduplicate(docs).count() == 3


def test_pages_and_images(spark):
    pages = spark.createDataFrame([(1, 1, "x" * 200, b"1"), (1, 2, "", b"22"), (1, 3, "part", b"333"), (1, 4, None, None)], "doc_id long, page_no int, text string, image binary")
    read = lambda images: [(f"seen {len(b)}", 0.8) for b in images]
    got = {r.page_no: (r.method, r.text, r.confidence) for r in ingest.page_texts(pages, read).collect()}
    assert got == {1: ("pdf_text", "x" * 200, 1.0), 2: ("ocr", "seen 2", 0.8), 3: ("hybrid", "part seen 3", 0.8), 4: ("pdf_text", "", 1.0)}
    assert {r.text for r in ingest.page_texts(pages).collect()} == {"x" * 200, "part", ""}
    assert [r.rejected for r in ingest.page_limit(pages, 3).collect()] == ["too many pages"]
    told = ingest.ingest_report(pages.select("doc_id", "page_no", F.lit("").alias("text"), F.lit(0.5).alias("confidence"))).head()
    assert told.warnings == ["no text", "unknown language", "low confidence"]
    faint = np.full((50, 60), 120, np.uint8)
    faint[10:20] = 140
    out = ingest.prepared(faint)
    assert out.shape == (150, 180) and set(np.unique(out)) <= {0, 255}
    assert ingest.prepared(np.full((5000, 2000, 3), 255, np.uint8)).shape == (4000, 1600)
    assert ingest.within_limits(20_000, 20_000) and not ingest.within_limits(20_001, 5) and not ingest.within_limits(20_000, 20_000, 4)
    tsv = "level\tpage_num\tb\tp\tl\tw\tx\ty\tw\th\tconf\ttext\n5\t1\t1\t1\t1\t1\t0\t0\t0\t0\t96\tBakim\n5\t1\t1\t1\t1\t2\t0\t0\t0\t0\t10\tzz\n5\t1\t1\t1\t2\t1\t0\t0\t0\t0\t91\tYillik\n4\t1\t1\t1\t2\t0\t0\t0\t0\t0\t-1\t"
    lines = ingest.ocr_lines(ingest.tsv_words(spark.createDataFrame([(1, tsv)], "doc_id long, tsv string")), 0.35).orderBy("line").collect()
    assert [(r.text, r.dropped) for r in lines] == [("Bakim", 1), ("Yillik", 0)]


def test_pii_overlaps_and_many():
    assert [(k, "4785380592391139 x"[a:b]) for a, b, k, _ in guard.pii_of("4785380592391139 x")] == [("card", "4785380592391139")]
    many = " ".join(f"u{i}@b.co" for i in range(20_000))
    assert len(guard.pii_of(many)) == 20_000


def test_hooks(spark):
    rows = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    got = {r.id: r.embedding for r in hooks.embeddings(rows, lambda ts: [[float(len(t))] for t in ts], "q: ").collect()}
    assert got == {1: [5.0], 2: [3.0]} and hooks.embeddings(rows, dim=32).count() == 2
    files = spark.createDataFrame([("a", b"x|y"), ("b", b"bad")], "path string, content binary")

    def extract(data):
        if data == b"bad":
            raise ValueError("no")
        return data.decode().split("|")

    got = sorted((r.path, r.page_no, r.item and bytes(r.item), r.error) for r in hooks.extracted(files, extract).collect())
    assert got == [("a", 1, b"x", None), ("a", 2, b"y", None), ("b", None, None, "ValueError: no")]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise OSError("later")
        return "done"

    assert hooks.retried(flaky, wait=0)() == "done" and len(tries) == 3
    with pytest.raises(OSError):
        hooks.retried(lambda: (_ for _ in ()).throw(OSError()), attempts=2, wait=0)()


def test_index_tables_and_filters(spark, tmp_path):
    chunks = spark.createDataFrame([(1, "pump service plan", 10, "en"), (2, "pump pump budget", 20, "de"), (3, "other words", 10, "en")], "id long, text string, doc_id long, lang string")
    q = spark.createDataFrame([(1, "pump", [20], None), (2, "pump", [], "en"), (3, "pump", None, None)], "query_id long, query string, doc_filter array<long>, lang_filter string")
    retrieval.write_index(chunks.where("id < 3"), f"{tmp_path}/i")
    retrieval.write_index(chunks.where("id = 3"), f"{tmp_path}/i", mode="append")
    index, stats = retrieval.read_index(spark, f"{tmp_path}/i")
    assert stats.head().n_chunks == 3
    want = {(r.query_id, r.id, round(r.score, 9)) for r in retrieval.bm25(retrieval.postings(chunks), retrieval.corpus_stats(chunks), q, 5, chunks.drop("text")).collect()}
    got = {(r.query_id, r.id, round(r.score, 9)) for r in retrieval.bm25(index, stats, q, 5, chunks.drop("text")).collect()}
    assert got == want and {(a, b) for a, b, _ in got} == {(1, 2), (2, 1), (3, 1), (3, 2)}
    index, stats = retrieval.read_index(spark, f"{tmp_path}/i", chunks.where("id = 2"))
    assert {r.id for r in index.collect()} == {1, 3} and stats.head().n_chunks == 2
    vectors = chunks.withColumn("embedding", F.array(F.lit(1.0), F.col("id").cast("double")))
    dense = retrieval.dense(vectors, q.withColumn("vector", F.array(F.lit(0.0), F.lit(1.0))), 2)
    assert {(r.query_id, r.id) for r in dense.collect()} == {(1, 2), (2, 3), (2, 1), (3, 3), (3, 2)}


def test_merging_and_reranking(spark):
    plans = spark.createDataFrame([(7, ["a b", "a b", " "], ["c"]), (8, None, ["d"])], "query_id long, queries array<string>, expanded array<string>")
    assert [tuple(r) for r in retrieval.sub_queries(plans).orderBy("query_id").collect()] == [(7, "7:0", "a b"), (7, "7:1", "c"), (8, "8:0", "d")]
    chunks = spark.createDataFrame([(1, "long text here", [1.0, 0.0], 5), (2, "short", [0.9, 0.1], 5), (3, "mid text", [0.0, 1.0], 6)], "id long, text string, embedding array<double>, doc_id long")
    q = spark.createDataFrame([(1, "text", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    hits = retrieval.hybrid(chunks, q, retrieval.Limits(final=3), rerank=lambda qs, ts: [-float(len(t)) for t in ts])
    assert [r.id for r in hits.orderBy("rank").collect()] == [2, 3, 1] and hits.where("rank = 1").head().score == pytest.approx(1 / (1 + np.exp(5)))
    assert tuple(retrieval.distinct_documents(hits, chunks).head()) == (1, 3, 2) and retrieval.final_cut(hits, 2).count() == 3


def test_hybrid_diversity_same_as_plain(spark):
    rng = np.random.default_rng(5)
    unit = lambda v: (v / np.linalg.norm(v)).tolist()
    base = [unit(rng.normal(size=8)) for _ in range(6)]
    rows = [(i, f"pump word{i % 4} x{i}", unit(np.array(base[i % 6]) + rng.normal(size=8) * 0.05)) for i in range(40)]
    chunks = spark.createDataFrame(rows, "id long, text string, embedding array<double>")
    q = spark.createDataFrame([(1, "pump word1", base[0]), (2, "pump word2", base[3])], "query_id long, query string, vector array<double>")
    lim = retrieval.Limits(dense=20, sparse=20, candidates=12, final=4)
    got = {(r.query_id, r.rank): (r.id, round(r.score, 9)) for r in retrieval.hybrid(chunks, q, lim).collect()}
    open_ = {(r.query_id, r.id): r for r in retrieval.hybrid(chunks, q, retrieval.Limits(dense=20, sparse=20, candidates=12, final=12), diversify=False).collect()}
    a, b = retrieval.dense(chunks.drop("text"), q, 20), retrieval.bm25(retrieval.postings(chunks), retrieval.corpus_stats(chunks), q, 20)
    fused = retrieval.fuse(a, b, k=12).collect()
    for k, (_, _, v) in enumerate(q.collect(), 1):
        order = [r.id for r in sorted(fused, key=lambda r: r.rank) if r.query_id == k]
        m = {i: np.array(rows[i][2]) for i in order}
        picked = []
        while len(picked) < 4:
            gain = {i: 0.5 * float(m[i] @ np.array(v)) - 0.5 * max([0.0, *(float(m[i] @ m[j]) for j in picked)]) for i in order if i not in picked}
            picked.append(max(gain, key=lambda i: gain[i]))
        want = sorted(((round(open_[k, i].score, 9), i) for i in picked), key=lambda x: (-x[0], x[1]))
        assert [got[k, r] for r in range(1, 5)] == [(i, s) for s, i in want]


def test_cache_operations(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp")
    cache = spark.createDataFrame([("k", "s", 1, "old", 3)], "key string, scope string, clearance int, answer string, hits long").withColumn("created_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    fresh = spark.createDataFrame([("k", "s", 1, "new", "grounded"), ("r", "s", 1, "no", "refused")], "key string, scope string, clearance int, answer string, kind string")
    got = answer.put(cache, fresh, now).collect()
    assert [(r.key, r.answer, r.hits) for r in got] == [("k", "new", 3)]
    probes = spark.createDataFrame([(1, "exact", "k"), (2, "miss", None), (3, "semantic", "k")], "query_id long, hit string, cached_key string")
    assert answer.counted(cache, probes).head().hits == 5 and tuple(answer.hit_counts(probes).head()) == (1, 1, 1)
    assert [r.key for r in answer.evict(cache.unionByName(cache.withColumns({"key": F.lit("z"), "created_at": now})), 1).collect()] == ["z"]


def test_prompts_and_analysis(spark):
    r = spark.createDataFrame([("en", "C", "Q"), ("tr", "C", "S")], "lang string, context string, q string")
    got = [x[0] for x in r.select(prompts.answer_prompt(F.col("lang"), F.col("context"), F.col("q"))).collect()]
    assert got[0].endswith("C\n\nQuestion: Q") and got[1].endswith("C\n\nSoru: S")
    for f in (prompts.plan_prompt, prompts.rewrite_prompt, prompts.expand_prompt):
        assert all(x[0].endswith(y) for x, y in zip(r.select(f(F.col("lang"), F.col("q"))).collect(), "QS", strict=True))
    a = spark.createDataFrame([("Bakım ne zaman yapılır, 12.05.2024 mi?",)], "q string").select(text.analyze(F.col("q")).alias("a")).head().a
    assert a.question_type == "temporal" and "date" in [e.kind for e in a.entities] and "bakim" in a.terms


def test_settings(tmp_path, caplog):
    (tmp_path / "s.toml").write_text("max_pages = 7\n[retrieval]\nfinal = 4\n")
    s = config.load(str(tmp_path / "s.toml"), env={"LODESTONE_CACHE_NEAR": "0.5", "LODESTONE_INGEST__BUDGET": "200", "OTHER": "1"})
    assert (s.max_pages, s.retrieval.final, s.cache_near, s.ingest.budget, s.retrieval.dense) == (7, 4, 0.5, 200, 100)
    assert config.PRESETS["small"].retrieval.final == 2
    for bad in ({"LODESTONE_NOPE": "1"}, {"LODESTONE_MMR_LAMBDA": "2"}, {"LODESTONE_INGEST__OVERLAP": "999"}):
        with pytest.raises(config.LodestoneError):
            config.load(env=bad)
    assert [(config.LodestoneError(k, "m").status, config.LodestoneError(k, "m").code) for k in ("Forbidden", "Storage", "odd")] == [(403, "forbidden"), (500, "storage_failed"), (500, "internal_error")]
    assert config.LodestoneError("Forbidden", "m").public_message == "m" and "m" != config.LodestoneError("Storage", "m").public_message
    with caplog.at_level(logging.INFO), config.timed(logging.getLogger("x"), "done"):
        pass
    assert json.loads(config.JsonLines().format(caplog.records[-1]))["message"] == "done"


def run(frame, name, path, mode="append"):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{path}/{name}").start()
    q.awaitTermination(120)
    return q


def test_state_streams(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    schema = "id long, shard int, key string, value string, ts timestamp"
    rows = [(1, 0, "a", "1", 0), (2, 0, "a", None, 5), (3, 0, "b", "2", 6), (4, 0, "c", "3", 7), (5, 0, "a", None, 8), (6, 0, "c", None, 50), (7, 0, "c", None, 70)]
    spark.createDataFrame([(*r[:4], start + dt.timedelta(seconds=r[4])) for r in rows], schema).coalesce(1).write.parquet(f"{tmp_path}/in")
    run(limits.cache_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), ttl=60, size=2), "held", tmp_path)
    assert [r.hit for r in spark.table("held").orderBy("id").collect()] == [False, True, False, False, False, True, False]
    e = [(i, f"t{i}", "a" if i % 2 else "b", "act", None, "{}", i) for i in range(8)]
    schema = "id long, at string, actor string, action string, subject string, detail string, seq long"
    from lodestone.operators import audit

    log = spark.createDataFrame(e, schema)
    log.coalesce(1).write.parquet(f"{tmp_path}/log")
    run(limits.audit_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/log")), "chain", tmp_path)
    assert {(r.seq, r.hash) for r in spark.table("chain").collect()} == {(r.seq, r.hash) for r in audit.append(log).collect()}


def test_index_stream(spark, tmp_path):
    schema = "id long, text string"
    rows = [(1, "pump plan"), (2, "pump budget"), (3, "other")]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        limits.index_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/index", f"{tmp_path}/check").awaitTermination(120)
        index, stats = retrieval.read_index(spark, f"{tmp_path}/index")
        assert stats.head().n_chunks == i + 1
    want = {tuple(r) for r in retrieval.postings(spark.createDataFrame(rows, schema)).select("term", "id", "tf").collect()}
    assert {tuple(r) for r in index.select("term", "id", "tf").collect()} == want


def test_searches_ask_all_items_of_all_documents(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").count()
    assert queries._chunks(spark, sf_dir).count() == d and queries._queries(spark, sf_dir).count() == b


def test_observed(spark, tmp_path):
    df, seen = limits.watched(spark.range(10), "n", rows=F.count(F.lit(1)))
    df.write.parquet(f"{tmp_path}/o")
    assert seen.get == {"rows": 10}
