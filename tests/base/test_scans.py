"""The sparse scan gives what the index gives, and moves neither texts nor postings."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone import queries
from lodestone.functions import text
from lodestone.operators import retrieval
from lodestone.plans.ask import ask

WORDS = ["bakım", "BAKIM", "plan", "İstanbul", "ıslak", "straße", "ø", "x", "café", "ΣΟΦΟΣ", "中文", "áb", "naïve", "y" * 41, "z" * 40, "½", "ﬁne", "don't", "ǅabc", "9", "42", "— dash", "​zero", "Ⱥbc", "ŁÓDŹ", "𝔘nicode", "Ωmega", "\n\n", " "]


def _texts(n):
    dice = random.Random(5)
    return [None, "", " ", *(dice.choice([" ", "\t", "-"]).join(dice.choices(WORDS, k=dice.randrange(1, 30))) for _ in range(n))]


def test_counted_terms_are_those_of_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(_texts(120))), "id long, text string")
    want = {r.id: r.t for r in rows.select("id", text.tokens(F.col("text")).alias("t")).collect()}
    words = {t: i for i, t in enumerate(sorted({t for ts in want.values() for t in ts or []})[::2])}
    made = rows.select("id", *text.token_sources(F.col("text"))).collect()
    assert any(r.plain is not None for r in made) and any(r.others is not None for r in made)
    batch = pa.RecordBatch.from_pydict({"id": [r.id for r in made], "plain": [r.plain for r in made], "others": [r.others for r in made]}, pa.schema([("id", pa.int64()), ("plain", pa.string()), ("others", pa.list_(pa.string()))]))
    seen = 0
    for piece in text.pieces(batch, 7, 200):
        n, doc, term, tf = text.counted_terms(piece, words)
        got = {(int(d), int(t)): int(c) for d, t, c in zip(doc, term, tf, strict=True)}
        for i, key in enumerate(piece["id"].to_pylist()):
            mine = want[key]
            assert n[i] == (-1 if mine is None else len(mine))
            assert {t: c for (d, t), c in got.items() if d == i} == {words[w]: mine.count(w) for w in set(mine or []) if w in words}
            seen += 1
    assert seen == len(want)


@pytest.mark.parametrize("at_once, asked", [(1_000_000, 4096), (40, 4096), (40, 3)])
def test_scan_scores_as_the_index(spark, monkeypatch, at_once, asked):
    monkeypatch.setattr(retrieval, "SCAN_SCORES", at_once)
    monkeypatch.setattr(retrieval, "SCAN_QUERIES", asked)
    chunks = spark.createDataFrame([(k, t, k % 4, "en" if k % 3 else "tr") for k, t in enumerate(_texts(150))], "id long, text string, classification int, lang string").repartition(3)
    q = spark.createDataFrame([(k, t or "bakım", k % 4, None if k % 2 else "en") for k, t in enumerate(_texts(8)[1:])], "query_id long, query string, clearance int, lang_filter string")
    want = retrieval.bm25(retrieval.postings(chunks), retrieval.corpus_stats(chunks), q, 6, chunks.drop("text"))
    found = retrieval.sparse(chunks, q, 6)
    as_rows = lambda df: sorted((r.query_id, r.rank, r.id, round(r.score, 9)) for r in df.collect())
    assert as_rows(found) == as_rows(want) and want.count() > 20


@pytest.mark.parametrize("name", ["bm25_search", "rank_fusion", "hybrid_search"])
def test_no_text_moves(spark, sf_dir, name):
    plan = queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
    assert not [line for line in plan.split("\n") if "Exchange" in line and "text#" in line]


def test_few_hits_are_broadcast(spark, monkeypatch):
    hits = spark.createDataFrame([(1, 2)], "query_id long, id long")
    chunks = spark.range(10).repartition(2)
    plan = lambda: retrieval.few_hits(hits, hits, 5).join(chunks, "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(retrieval, "BROADCAST_HITS", 4)
    assert "strategy=broadcast" not in plan()


def test_ask_reads_texts_apart(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 4)], "id long, embedding array<float>, classification int")
    texts = spark.createDataFrame([(1, "The pump service interval is one year. Ask the north team.", 1), (2, "Secret pump service interval is two years.", 4)], "id long, text string, classification int")
    q = spark.createDataFrame([(1, "What is the pump service interval?", [1.0, 0.0], 2)], "query_id long, query string, vector array<float>, clearance int")
    (row,) = ask(q, chunks, texts=texts).collect()
    assert row.kind == "extractive" and "one year" in row.answer and row.classification == 1


@pytest.mark.parametrize("ids", [[0, 1, 2, 3], [0, 2, 5], [0, 1, 1]])
def test_texts_are_those_of_chunks(spark, tmp_path, ids):
    spark.createDataFrame([(k, f"t{k}") for k in (*range(-3, 12), None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, [1.0]) for k in ids], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same = lambda df: sorted(map(tuple, df.select("id", "text", "classification").collect()))
    assert same(queries._texts(spark, str(tmp_path))) == same(queries._chunks(spark, str(tmp_path)))
