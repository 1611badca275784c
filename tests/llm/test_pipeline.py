import public_tokenizers
import pytest

import corpus_pipeline
from lodestone.llm import decontam, langid, pii, sentencepiece, similar
from tests.llm.test_decontam import brute as leaks


def plain(rows, items, model):
    """The stages one after another on the driver, over (id, text)."""
    rows = [(i, t) for (i, t), (k, share, _) in zip(rows, langid.label([t or "" for _, t in rows], model), strict=True) if k != "und" and share >= 0.5]
    ids = [(i is None, i or 0, n) for n, (i, _) in enumerate(rows)]
    groups = similar.brute([(k, t) for k, (_, t) in zip(ids, rows, strict=True)])
    rows = [r for r, (k, c) in zip(rows, groups, strict=True) if k == c]
    bad = {k for k, _ in leaks([(n, t) for n, (_, t) in enumerate(rows)], items)}
    rows = [r for n, r in enumerate(rows) if n not in bad]
    return [(i, pii._mask(t, pii.base_spans(t))) for i, t in rows]


def test_stages(spark, sf_dir, tmp_path):
    words = "the cat sat on the mat and then it ran away from home to see the world again with all of its friends and more".split()
    item = "a benchmark passage about forty two rivers that flow north into one lake near an old stone bridge over there"
    rows = [(1, " ".join(words)), (2, " ".join(words)), (2, " ".join(words)), (0, " ".join([*words, "extra"]).upper()), (3, "123 456"), (10, "a long text of many words " + " ".join(f"word{k % 5000} and" for k in range(20_000))), (4, None), (5, ""), (6, f"some words {item} and more words"), (7, "write to a.b@c.org or call +1 (743) 555-3824 now my dear friend of old times"), (None, "an unknown document that has no id of its own at all, alas"), (8, "der hund und die katze sind nicht im haus und auch nicht im garten"), (8, "der hund und die katze sind nicht im haus und auch nicht im garten")]
    full = [(i, t, "de" if t and t.startswith("der") else "en", "s", len(t or ""), "x", 1, "k") for i, t in rows]
    docs = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, __row string, `key` int, tag string").repartition(3)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(9, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    model = langid.train(docs.where(~langid.held_out()))
    want = plain(rows, [(9, item)], model)
    assert {i for i, _ in want} == {0, 7, 8, 10, None} and len(want) == 5
    out = corpus_pipeline.run(spark, str(tmp_path))
    coder = sentencepiece.Coder(sentencepiece.Pieces(public_tokenizers.path("piece_bpe_32k.model")))
    assert sorted(((r.doc_id, coder.decode(r.pieces)) for r in out.collect()), key=str) == sorted(want, key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, str(tmp_path))
        assert kept.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_shuffled_tags(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", -1)
    docs = spark.createDataFrame([(1, "a b"), (2, "a b"), (2, "a b"), (None, "zz " * 40)], "doc_id long, text string")
    assert sorted(map(tuple, corpus_pipeline.near_dedup(spark, docs, "").collect()), key=str) == [(1, "a b"), (None, "zz " * 40)]
