import random

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import components, simhash


def plain(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) << b for b in range(64)) if hashes else 0


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from("aB ñÉ\n\t\x1f b"), max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_blocks_reach_radius():
    blocks = simhash.allocate(10**6, [0.5] * 64, list(range(64)), 4)
    assert sum(b.threshold + 1 for b in blocks) == 5
    rng = random.Random(1)
    for _ in range(2000):
        change = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(sum(change >> b & 1 for b in x.bits) <= x.threshold for x in blocks)


def near(words, k, rng):
    words = list(words)
    for _ in range(k):
        words[rng.randrange(len(words))] = f"w{rng.randrange(999)}"
    return " ".join(words)


@pytest.mark.parametrize("tile", [2048, 8])
def test_same_as_brute_force(spark, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    rng = random.Random(tile)
    rows = [(None, None), (7, ""), (8, " \n"), (9, "one"), (10, "ONE"), (11, "one two three")]
    for g in range(25):
        words = [f"v{rng.randrange(400)}" for _ in range(150)]
        rows += [(100 + g * 10 + i, near(words, i, rng)) for i in range(5)]
    words = [f"v{rng.randrange(400)}" for _ in range(300)]
    rows += [(1000 + i, near(words, rng.randrange(3), rng)) for i in range(150)] + [(900, rows[-1][1])] * 3
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 fp", "2 copies", "3 root", "4 u").repartition(3)
    got = sorted(map(tuple, simhash.near_duplicates(docs).collect()), key=str)
    assert got == sorted(simhash.brute(rows), key=str)


def test_empty(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_links_lose_none():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.int64)
    fp = np.unique(np.concatenate([base, base ^ 1, base ^ 6, base ^ (1 << 40)]))
    u, v = simhash._links_of(np.zeros(len(fp), np.int64), fp, np.zeros(len(fp), bool), 4)
    assert len(fp) - len(u) == 40 and (v < u).all()


def test_long_path(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (300, 200), (5, 5)]
    got = {r.u: r.root for r in components.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 100, 300: 100}
