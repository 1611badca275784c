import hashlib
import math
import random

import pytest

from lodestone.llm import digest

LOW = 0xFFFFFFFF


def plain_digest(data):
    """The digest by plain loops: triplets, buckets, quartiles, packing."""
    counts = [0] * 256
    for i in range(len(data) - 3):
        for k, (a, b, c) in enumerate([(0, 1, 2), (0, 1, 3), (0, 2, 3)]):
            h = (data[i + a] * 0x9E3779B1 + data[i + b] * 0x85EBCA77) & LOW
            h ^= h >> 15
            h = (h + data[i + c] * 0xC2B2AE3D + k * 0x27D4EB2F) & LOW
            h ^= h >> 13
            counts[((h * 0x2C1B3C6D) & LOW) >> 24] += 1
    ranked = sorted(counts)
    cuts = [ranked[63], ranked[127], ranked[191]]
    q = [sum(c > x for x in cuts) for c in counts]
    packed = [q[4 * i] + 4 * q[4 * i + 1] + 16 * q[4 * i + 2] + 64 * q[4 * i + 3] for i in range(64)]
    return [min(255, round(4 * math.log2(len(data) + 1))), *packed]


def plain_likeness(a, b):
    total = 2 * abs(a[0] - b[0])
    for x, y in zip(a[1:], b[1:], strict=True):
        total += sum([0, 1, 2, 6][abs((x >> s & 3) - (y >> s & 3))] for s in (0, 2, 4, 6))
    return 1 - min(total, 416) / 416


def test_same_as_plain_loops(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choice("abcdeñ 日\n") for _ in range(rng.choice([0, 1, 3, 4, 50, 700])))) for i in range(40)]
    order = sorted(rows, reverse=True)
    want = {}
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        own, other, following = (plain_digest(x.encode()) for x in (t, edited, after))
        want[i] = (len(t), hashlib.sha256(edited.encode()).hexdigest(), bytes(own).hex(), bytes(other).hex(), plain_likeness(own, other), plain_likeness(own, following))
    got = digest.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want


def test_equal_texts_and_bounds():
    assert digest.digest(b"") == digest.digest(b"") and len(digest.digest(b"abc")) == 65
    a, b = digest.digest(b"the quick brown fox " * 50), digest.digest(bytes(range(256)) * 9)
    assert digest.likeness(a, a) == 1 and 0 <= digest.likeness(a, b) < 0.5


@pytest.mark.parametrize("n", [1, 2, 7, 60])
def test_same_as_brute_force(spark, n):
    rows = [(i * 3, f"text number {i} " * (i % 5 + 1)) for i in range(n)] + ([(None, None), (6, "text number 2 " * 3), (6, ""), (9, "ñ" * 40000)] if n > 5 else [])
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 place", "2 key", "3 n_chars").repartition(3)
    got = sorted(map(tuple, digest.edited_fingerprints(docs).collect()), key=str)
    assert got == sorted(digest.brute(rows), key=str)


def test_empty(spark):
    assert digest.edited_fingerprints(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_edits_stay_nearer(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("n_chars >= 200")
    rows = digest.edited_fingerprints(docs).collect()
    assert sum(r.near_edited > r.near_next for r in rows) >= 0.97 * len(rows)
