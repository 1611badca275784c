import random

import numpy as np

import corpus_pipeline
from lodestone.llm import similar, simhash
from tests.llm.test_similar import edited


def test_near_dedup_finds_links_by_simhash(spark, monkeypatch):
    """The stage's links come from operator 6's blocks: without any, near copies stay."""
    rng = random.Random(8)
    words = [f"w{rng.randrange(5000)}" for _ in range(200)]
    rows = [(1, " ".join(words)), (2, edited(rng, words, 3)), (3, edited(rng, words, 12)), (4, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    planned = []

    def no_blocks(classes, radius, pair_cost=0.0):
        planned.append(radius)
        return classes.count(), []

    monkeypatch.setattr(similar, "plan", no_blocks)
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == [1, 2, 3]
    assert planned and planned == [similar.index_size(4)[1]] * similar.index_size(4)[0]


def sets(rng, size, similar_at):
    """Two sets of ``size`` shingles and the least number of others that keeps the similarity."""
    other = int(size * (1 - similar_at) / (1 + similar_at))
    pool = rng.integers(0, 1 << 64, size + other, np.uint64)
    return np.sort(pool[:size]), np.sort(pool[other:])


def test_pairs_at_the_similarity_meet():
    rng = np.random.default_rng(5)
    for n in (1000, 226_000):
        words, radius = similar.index_size(n)
        blocks = simhash.allocate(n, [0.5] * 64, list(range(64)), radius, similar.PAIR_COST)
        assert sum(b.threshold + 1 for b in blocks) == radius + 1
        for size in (9, 20, 150, 700):
            for _ in range(100):
                a, b = (similar.prints(s, max(words, similar.SKETCH)) for s in sets(rng, size, 0.8))
                apart = a ^ b
                assert any((x.values(apart[w : w + 1])[0]).bit_count() <= x.threshold for w in range(words) for x in blocks)
                assert sum(int(w).bit_count() for w in apart[: similar.SKETCH]) <= similar.sketch_radius()


def test_rows_that_fit_are_in_a_pair():
    """Also one whose only partner has an earlier one; and all pairs of different roots."""
    rng = np.random.default_rng(7)
    size = 300
    sketch = rng.integers(0, 1 << 64, (similar.SKETCH, size), np.uint64)
    for k in range(2, size, 3):  # k - 2 and k - 1 are apart, both are near k
        for w in range(similar.SKETCH):
            sketch[w, k - 1] = sketch[w, k - 2] ^ np.uint64(0xFFFFFFF)
            sketch[w, k] = sketch[w, k - 2] ^ np.uint64(0x3FFF)
    n = rng.integers(50, 90, size)
    mark, slot = np.arange(size) * 7, np.arange(size) // 150
    want = set()
    for i in range(size):
        for j in range(i):
            far = int(np.bitwise_count(sketch[:, i] ^ sketch[:, j]).sum())
            if slot[i] == slot[j] and far <= similar.sketch_radius() and min(n[i], n[j]) >= 0.8 * max(n[i], n[j]):
                want.add((mark[j], mark[i]))
    run = lambda every: {(min(a, b), max(a, b)) for u, v in similar._near(slot, mark, n, mark, sketch, 0.8, similar.sketch_radius(), every) for a, b in zip(u, v, strict=True)}
    assert run(True) == want and len(want) > 50
    first = run(False)
    assert first <= want and {x for p in first for x in p} == {x for p in want for x in p}
