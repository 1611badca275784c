import random

import corpus_pipeline
from lodestone.llm import similar, simhash


def edited(rng, words, n):
    out = list(words)
    for at in rng.sample(range(0, len(out), 5), n):
        out[at] = f"new{rng.randrange(10**6)}"
    return " ".join(out)


def test_same_as_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(1, ""), (2, None), (3, "  .. "), (4, "Four words, no more"), (5, "four WORDS no more"), (6, "aa bb " * 60), (7, "aa bb " * 90)]
    for base in range(12):
        words = [word() for _ in range(200)]
        rows += [(100 * base + k + 10, edited(rng, words, k)) for k in range(7)]
        rows += [(100 * base + 50, " ".join(words[:170])), (100 * base + 51, " ".join(words[100:] + words[:100]))]
    shared = [word() for _ in range(60)]
    rows += [(5000 + k, " ".join(shared + [word() for _ in range(60)])) for k in range(20)]
    rows += [(None, rows[12][1]), (10, rows[12][1]), (10, rows[12][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = sorted(similar.brute(rows), key=str)
    assert sorted(map(tuple, similar.groups(docs).collect()), key=str) == want
    assert len({c for _, c in want}) < len(want) - 30
    assert similar.groups(docs.limit(0)).count() == 0
    # Two slots' smallest classes that fit nothing: all pairs still meet.
    monkeypatch.setattr(similar, "slots", lambda own: similar.np.arange(3, dtype=similar.np.uint64))
    assert sorted(map(tuple, similar.groups(docs).collect()), key=str) == want


def test_pipeline_drops_near_copies(spark):
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(words)), (2, edited(rng, words, 3)), (3, edited(rng, words, 12))]
    assert len({c for _, _, c in simhash.brute(rows)}) == 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 3]
