"""The cache probe works in tiles of bounded size and finds what comparing all pairs finds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import answer

QUERY = "query_id long, key string, scope string, clearance int, vector array<float>"
ENTRY = "key string, scope string, clearance int, vector array<float>, created_at timestamp"


def _dot(a, b):
    total = 0.0
    for x, y in zip(a, b, strict=False):
        if x is None or y is None:
            return None
        total += x * y
    return total


def _vector(dice):
    v = [dice.choice([-1.0, -0.5, 0.0, 0.25, 0.5, 1.0]) for _ in range(dice.choice([4, 4, 4, 2, 0]))]
    for odd in (None, math.nan, math.inf):
        if v and dice.random() < 0.05:
            v[dice.randrange(len(v))] = odd
    return v


@pytest.mark.parametrize("rows", [5, 1000])
def test_tiles_find_what_all_pairs_find(spark, monkeypatch, rows):
    monkeypatch.setattr(answer, "PROBE_ROWS", rows)
    monkeypatch.setattr(answer, "PROBE_PAIRS", 2 * rows)
    dice = random.Random(3)
    some = lambda n: [(dice.choice(["a", "a", "a", "b", "c", None]), dice.choice([0, 1, 2, None]), None if dice.random() < 0.05 else _vector(dice)) for _ in range(n)]
    asked = [(k, f"q{k}" if k % 9 else f"c{k}", *x) for k, x in enumerate(some(90))]
    held = [(f"c{k}", *x) for k, x in enumerate(some(60))]
    keys, want = {e[0] for e in held}, {}
    for i, key, scope, level, v in asked:
        want[i] = ("exact", key) if key in keys else ("miss", None)
        if key in keys or v is None or scope is None or level is None:
            continue
        met = [(_dot(v, e[3]), e[0]) for e in held if e[1] == scope and e[2] is not None and e[2] <= level and e[3] is not None]
        met = [(math.isnan(s), 0.0 if math.isnan(s) else s, k) for s, k in met if s is not None and (s >= 0.5 or math.isnan(s))]
        if met:
            want[i] = ("semantic", min(met, key=lambda m: (not m[0], -m[1], m[2]))[2])
    now = F.lit("2024-01-01 00:30:00").cast("timestamp")
    cache = spark.createDataFrame([(*e, None) for e in held], ENTRY).withColumn("created_at", now)
    got = {r.query_id: (r.hit, r.cached_key) for r in answer.probe(spark.createDataFrame(asked, QUERY), cache, now, near=0.5).collect()}
    assert got == want and sum(h == "semantic" for h, _ in want.values()) > 20
