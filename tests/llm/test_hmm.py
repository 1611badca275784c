import math
import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import hmm


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBñ \n\x1f"), max_size=20), min_size=1, max_size=6))
def test_tokens(texts):
    h, _, counts = hmm.tokens(texts)
    flat = [w for t in texts for w in words(t)]
    assert counts.tolist() == [len(words(t)) for t in texts]
    assert len(set(zip(flat, h.tolist(), strict=True))) == len(set(flat)) == len(set(h.tolist()))


def model(classes=3):
    rng = np.random.default_rng(0)
    unit = lambda *n: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(n))
    return hmm.Model(unit(hmm.STATES), unit(hmm.STATES, hmm.STATES), unit(hmm.STATES, classes).T, np.ones(classes) / classes)


def test_forward_is_exact_and_sums_to_one():
    m = model()
    every = [np.array(c) for c in product(range(3), repeat=4)]
    found = hmm.forward(m, [*every, np.array([1]), np.array([0, 2])])
    assert (10 ** found[: len(every)]).sum() == pytest.approx(1)
    paths = sum(m.start[a] * m.emit[0, a] * m.move[a, b] * m.emit[2, b] for a in range(hmm.STATES) for b in range(hmm.STATES))
    assert 10 ** found[-1] == pytest.approx(paths)


def test_expected_counts():
    m, c = model(), np.array([0, 2, 1])
    start, move, emit, likelihood = hmm.expected(m, [c, c[:1], c])
    joint = {s: m.start[s[0]] * m.emit[c[0], s[0]] * math.prod(m.move[a, b] * m.emit[k, b] for a, b, k in zip(s, s[1:], c[1:], strict=False)) for s in product(range(hmm.STATES), repeat=3)}
    z = sum(joint.values())
    assert sum(start) == pytest.approx(3) and move.sum() == pytest.approx(4) and emit.sum() == pytest.approx(7)
    assert move[1, 2] == pytest.approx(2 * sum(p * sum((a, b) == (1, 2) for a, b in zip(s, s[1:], strict=False)) for s, p in joint.items()) / z)
    assert emit[2, 3] == pytest.approx(2 * sum(p for s, p in joint.items() if s[1] == 3) / z)
    assert likelihood == pytest.approx(sum(hmm.forward(m, [c, c[:1], c])))


def check(rows, got):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter()
    for i, t in rows:
        if not held(i):
            c.update(words(t))
            c[None] += 1
    n, v = sum(c.values()), len(c)
    want = Counter()
    for i, t in rows:
        mine = [*words(t), None]
        want[i, held(i), len(mine), sum(c[w] > 0 for w in mine), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in mine), 6)] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_scores(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(hmm, "FREQUENT", 1 / 1000)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(None, None), (None, "A a  a"), (rows[0][0], rows[0][1]), (10**9, ""), (10**9 + 1, "zz " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 row", "2 score", "3 classes").repartition(3)
    got = hmm.score(docs).collect()
    check(rows, got)
    held = [r for r in got if r.held_out and r.n_tokens > 20]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert hmm.score(docs).count() == 0


def test_all_rounds_run_over_partitions(spark, monkeypatch):
    from lodestone.llm import hmm

    real = hmm.expected

    def in_task(*args):
        from pyspark import TaskContext

        assert TaskContext.get() is not None
        return real(*args)

    monkeypatch.setattr(hmm, "expected", in_task)
    docs = spark.createDataFrame([(k, f"one two three four w{k % 7}") for k in range(40)], "doc_id long, text string")
    assert hmm.score(docs).count() == 40


def plain_scores(rows, classes, model):
    """Scores of (id, text) rows by the plain recursion, from the words' counts and a model."""
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    kind, own = {}, len(classes.hashes)
    for w in {w for _, t in rows for w in words(t)}:
        h, tails, _ = hmm.tokens([w])
        kind[w] = int(classes.of(h, tails)[0][0])
    seen = Counter(w for i, t in rows if not held(i) for w in words(t))
    mass = Counter()
    for w, n in seen.items():
        mass[kind[w]] += n + 0.1
    for c in range(own, classes.size - 1):
        mass[c] += 0.1
    out = []
    for i, t in rows:
        codes = [*(kind[w] for w in words(t)), classes.size - 1]
        alpha = [model.start[s] * model.emit[codes[0], s] for s in range(hmm.STATES)]
        total = 0.0
        for c in codes[1:]:
            z = sum(alpha)
            total += math.log10(z)
            alpha = [sum(alpha[a] / z * model.move[a, s] for a in range(hmm.STATES)) * model.emit[c, s] for s in range(hmm.STATES)]
        total += math.log10(sum(alpha))
        total += sum(math.log10((seen[w] + 0.1) / mass[kind[w]]) for w in words(t) if kind[w] >= own)
        out.append((i, round(total, 6)))
    return out


def test_score_of_whole_table_is_the_plain_recursion(spark, monkeypatch):
    monkeypatch.setattr(hmm, "LEAST", 5)
    held = {}
    real = hmm.train

    def spy(rows, classes, mass):
        held["classes"], held["model"] = classes, real(rows, classes, mass)
        return held["model"]

    monkeypatch.setattr(hmm, "train", spy)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"w{min(rng.geometric(0.2), 40)}" for _ in range(rng.integers(0, 40)))) for i in range(60)] + [(None, "w1 odd"), (1, "w1 w1"), (1, "w1 w1"), (70, None)]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert len(held["classes"].hashes) > 3
    assert sorted(((r.doc_id, round(r.score, 6)) for r in got), key=str) == sorted(plain_scores(rows, **held), key=str)


def test_all_rows_held_out(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows = [(i, f"some words {i}") for i in ids]
    got = hmm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)


def test_training_reads_whole_texts(spark, monkeypatch):
    """Every start counted is that of a text, and every move within a text is counted."""
    docs = spark.createDataFrame([(k, "a b " * (500 + k)) for k in range(6)] + [(9, None)], "doc_id long, text string")
    seen = []
    real = hmm._summed

    def spy(rows, sums, kind="float"):
        found = real(rows, sums, kind)
        if kind == "float":
            seen.append((found, rows.count()))
        return found

    monkeypatch.setattr(hmm, "_summed", spy)
    hmm.score(docs).collect()
    whole, n = seen[-1]
    tokens = sum(2 * (500 + k) + 1 for k in range(6) if zlib.crc32(str(k).encode()) % 10) + 1
    assert len(seen) == hmm.PARTS + hmm.ROUNDS and sum(m for _, m in seen[: hmm.PARTS]) == n
    assert whole[-1].sum() == pytest.approx(n, rel=1e-5) and whole[-1 - hmm.STATES : -1].sum() == pytest.approx(tokens - n, rel=1e-5)
