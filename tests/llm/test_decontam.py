import random
import re
from collections import Counter

from lodestone.llm import decontam


def grams(words, k=5):
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words)]


def split(text):
    return [w for w in re.split(r"[\W_]+", (text or "").lower()) if w]


def brute(docs, items):
    """All windows of all documents."""
    best = {}
    for i, t in docs:
        for j, u in items:
            a, b = split(t), split(u)
            if not a or not b:
                continue
            k = min(5, len(b))
            if len(a) < k:
                continue
            own, whole = Counter(grams(b, k)), grams(a, k)
            m = sum(own.values())
            for s in range(max(1, len(whole) - m + 1)):
                w = Counter(whole[s : s + m])
                common = sum((w & own).values())
                x = common / (m + sum(w.values()) - common)
                if x >= 0.8:
                    best[i, j] = max(best.get((i, j), 0), x)
    return best


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(rng.randrange(20, 70)))) for k in range(12)]
    items += [(20, "Two words"), (21, None), (22, "  "), (None, items[0][1]), (3, items[3][1]), (23, "aa bb " * 20), (24, "solo")]
    docs = [(None, None), (1, ""), (2, "two, WORDS here"), (3, "aa bb " * 60), (4, "solo")]
    for d in range(10, 60):
        body = [word() for _ in range(rng.randrange(0, 200))]
        own = split(items[rng.randrange(12)][1])
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(own))
            own[at : at + rng.randrange(2)] = [word()] if rng.random() < 0.7 else []
        at = rng.randrange(len(body) + 1)
        docs.append((d, " ".join(body[:at] + own[: rng.choice([len(own), len(own), len(own) // 2])] + body[at:]).title()))
    docs += [(10, items[1][1]), (11, docs[-1][1]), (11, docs[-1][1])]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 item_id", "2 mark", "3 m").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 doc_id")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(a, b).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert got == want and len(want) > 20
    decontam.BROADCAST_ROWS, before = 0, decontam.BROADCAST_ROWS
    try:
        assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(a, b).collect()} == want
    finally:
        decontam.BROADCAST_ROWS = before
    for x, y in ((a.limit(0), b), (a, b.limit(0))):
        assert decontam.contaminated(x, y).count() == 0


def test_reordered_items(spark):
    rng = random.Random(9)
    words = [f"v{k}" for k in range(60)]
    around = lambda n: [f"z{rng.randrange(10**6)}" for _ in range(n)]
    items = [(1, " ".join(words)), (2, " ".join(f"u{k}" for k in range(100)))]
    long = items[1][1].split()
    docs = [(1, " ".join(around(80) + words[30:] + words[:30] + around(80))), (2, " ".join(words[30:] + words[:30])), (3, " ".join(around(9) + words[30:] + words[:30]))]
    docs += [(4, " ".join(long[30:60] + long[:30] + long[60:] + around(200))), (5, " ".join(words[45:] + words[30:45] + words[15:30] + words[:15]))]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(a, b).collect()}
    want = {k: round(v, 9) for k, v in brute(docs, items).items()}
    assert got == want and {(1, 1), (2, 1), (3, 1), (4, 2)} <= set(want)


def test_random_permuted_items_and_long_texts(spark):
    """Items cut into parts that stand in any order, with words changed, in very long and in highly
    repetitive texts: the same as brute force."""
    rng = random.Random(11)
    items = [(k, " ".join(f"t{rng.randrange(400)}" for _ in range(rng.choice([6, 12, 30, 60])))) for k in range(14)]
    items += [(50, "ab cd " * 15), (51, "one two three four five six seven eight nine ten " * 3), (52, items[0][1]), (53, items[1][1].upper())]
    docs = []
    for d in range(60):
        w = items[rng.randrange(14)][1].split()
        cuts = sorted(rng.sample(range(1, len(w)), rng.choice([0, 1, 1, 2])))
        parts = [w[a:b] for a, b in zip([0, *cuts], [*cuts, len(w)], strict=True)]
        rng.shuffle(parts)
        body = [x for p in parts for x in p]
        if rng.random() < 0.3:
            body[rng.randrange(len(body))] = "changed"
        around = lambda: [f"t{rng.randrange(400)}" for _ in range(rng.randrange(40))]
        docs.append((d, " ".join(around() + body + around())))
    docs += [(100, "ab cd " * 3000), (101, "seven eight nine ten one two three four five six " * 400), (102, "x " * 20_000 + items[3][1] + " y" * 20_000)]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontam.contaminated(a, b).collect()}
    small = [x for x in docs if x[0] != 102]
    want = {k: round(v, 9) for k, v in brute(small, items).items()} | {(102, 3): 1.0}
    assert got == want and len(want) > 30


def test_windows_are_looked_up_among_all_items(spark):
    """A document that holds one of two nearly equal items is near both."""
    words = [f"p{k}" for k in range(60)]
    items = [(1, " ".join(words)), (2, " ".join([*words[:59], "other"])), (3, " ".join(words[:30]))]
    docs = spark.createDataFrame([(1, "before " + items[0][1] + " after")], "doc_id long, text string")
    got = {r.item_id: r.similarity for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {1: 1.0, 2: 55 / 57, 3: 1.0}
