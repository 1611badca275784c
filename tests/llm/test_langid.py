import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import langid


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.floats(-8, 0), min_size=3, max_size=3), min_size=1, max_size=40), st.floats(0.5, 15))
def test_viterbi_is_best(rows, penalty):
    score = np.array(rows)
    path = langid.viterbi(score, penalty)
    assert langid.total(score, path, penalty) == pytest.approx(langid.brute_viterbi(score, penalty))


def plain_path(rows, penalty):
    """Best path word by word, with plain lists; ties to the smaller language."""
    m, now, back = len(rows[0]), [0.0] * len(rows[0]), []
    for row in rows:
        top = max(range(m), key=lambda k: (now[k], -k))
        come = [k if now[k] >= now[top] - penalty else top for k in range(m)]
        now = [max(now[k], now[top] - penalty) + row[k] for k in range(m)]
        back.append(come)
    k, out = max(range(m), key=lambda k: (now[k], -k)), []
    for come in reversed(back):
        out.append(k)
        k = come[k]
    return out[::-1]


def test_many_paths_side_by_side():
    rng = np.random.default_rng(2)
    sizes = [0, 1, 40, 3, 200, 40, 0, 17]
    cuts = np.concatenate(([0], np.cumsum(sizes)))
    score = -rng.random((cuts[-1], 3)) * 8
    for penalty in (0.5, 3, 12):
        got = langid.paths(score, cuts, penalty)
        for k, n in enumerate(sizes):
            own = score[cuts[k] : cuts[k + 1]]
            if n:
                assert langid.total(own, got[k], penalty) == pytest.approx(langid.total(own, np.array(plain_path(own.tolist(), penalty)), penalty))
            else:
                assert not len(got[k])


def plain_label(text, train):
    """Language and its share of letters by plain loops: trigrams of words, scripts, best path."""
    import unicodedata

    def words(t):
        out, now = [], ""
        for c in "".join(c.lower() if len(c.lower()) == 1 else c for c in t) + " ":
            if unicodedata.category(c)[0] in "LM":
                now += c
                continue
            if any(unicodedata.category(x)[0] == "L" for x in now):
                out.append(now)
            now = ""
        return out

    low = 0xFFFFFFFF

    def buckets(word):
        x = [(ord(c) if c != " " else 1) * 0x9E3779B1 & low for c in f" {word} "]
        for a, b, c in zip(x, x[1:], x[2:], strict=False):
            h = (a * 0x85EBCA77 & low) ^ ((b * 0xC2B2AE3D & low) + (b >> 15) & low) ^ ((c >> 7) + (c * 0x27D4EB2F & low) & low)
            h ^= h >> 15
            yield (h * 0x2C1B3C6D & low) >> 17

    langs = sorted({g for _, g in train})
    counts = {g: {} for g in langs}
    scripts = {g: {} for g in langs}
    for t, g in train:
        for w in words(t):
            scripts[g][langid.script_of(w[0])] = scripts[g].get(langid.script_of(w[0]), 0) + len(w)
            for b in buckets(w):
                counts[g][b] = counts[g].get(b, 0) + 1
    found = words(text)
    rows = []
    for w in found:
        can = [g for g in langs if scripts[g].get(langid.script_of(w[0]), 0) >= 0.01 * sum(scripts[g].values())] or langs
        s = {g: sum(np.log((counts[g].get(b, 0) + 0.5) / (sum(counts[g].values()) + 0.5 * 32768)) for b in buckets(w)) for g in can}
        rows.append([max(s.get(g, -np.inf) - max(s.values()), -8.0) for g in langs])
    if not rows:
        return "und", 0.0
    size = [0] * len(langs)
    for w, k in zip(found, plain_path(rows, 12.0), strict=True):
        size[k] += len(w)
    return langs[size.index(max(size))], max(size) / sum(size)


def test_predictions_same_as_plain_loops(spark):
    train = [(t, g) for _, t, g in ROWS]
    docs = spark.createDataFrame([(i, t, g) for i, (t, g) in enumerate(train)], "doc_id long, text string, lang string")
    texts = ["the cat und der hund", "мама и der hund sind", "cat", "", "12 !", "die katze sind nicht im haus und the mat ran away and then it ran away", "a\u0301 \u0301 İstanbul", "мыла мыла the"]
    got = langid.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), langid.train(docs)).collect()
    for r in got:
        assert (r.lang_pred, pytest.approx(r.score)) == plain_label(texts[r.doc_id], train), texts[r.doc_id]


def test_scripts():
    assert [langid.script_of(c) for c in "aЖ漢ひ1"] == ["latin", "cyrillic", "han", "kana", "other"]
    found = langid.words_of(["Abc déf", "", "Жук 漢"])
    assert found.text.tolist() == [0, 0, 2, 2] and [langid.NAMES[s] for s in found.script] == ["latin", "latin", "cyrillic", "han"]


ROWS = [(i, t, g) for i, (t, g) in enumerate([("the cat sat on the mat and then it ran away", "en"), ("der hund und die katze sind nicht im haus", "de"), ("мама мыла раму и пошла домой", "ru")] * 4)]


def test_table(spark):
    more = [(100, None, "en"), (101, "", None), (102, "123 !?", "de"), (None, "the cat and the mat", None), (103, "the cat sat on the mat and then it ran away der hund und die katze sind nicht im haus", None), (104, "漢字", None), (105, "мама домой", None), (106, "\u0301 \u0300\u0302", None)]
    docs = spark.createDataFrame(ROWS + more, "doc_id long, text string, lang string").selectExpr("*", "1 score", "2 n", "3 feature")
    model = langid.train(docs)
    got = {r.doc_id: r for r in langid.predict(docs, model, spans=True).collect()}
    assert [got[i].lang_pred for i in (100, 101, 102, 106)] == ["und"] * 4
    assert (got[None].lang_pred, got[105].lang_pred) == ("en", "ru") and got[104].lang_pred in model.langs
    assert [(s.lang, ROWS[0][1] if s.start == 0 else ROWS[1][1]) for s in got[103].spans] == [("en", ROWS[0][1]), ("de", ROWS[1][1])]
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.train(docs.limit(0)) is None and langid.predict(docs, None).where("lang_pred = 'und'").count() == len(ROWS + more)


def test_held_out_accuracy(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("held", langid.held_out())
    got = langid.predict(docs.where("held"), langid.train(docs.where("not held"))).join(docs, "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) >= 0.97 * len(got)
