import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import sentencepiece as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
CODER = sp.Coder(sp.Pieces(PATH))
TEXT = st.text(st.one_of(st.characters(blacklist_categories=["Cs"]), st.sampled_from(" \n▁ethndsñ")), max_size=25)


def best(text):
    """Best score by trying every piece at every place."""
    score = {t: s for t, _, s in CODER.pieces.usable()}
    top = [0.0]
    for end in range(1, len(text) + 1):
        options = [top[a] + score[text[a:end]] for a in range(max(0, end - 20), end) if text[a:end] in score]
        if text[end - 1] not in score:
            options.append(top[end - 1] + CODER.unknown)
        top.append(max(options))
    return top[-1]


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_viterbi_is_best_and_chunks_are_exact(text):
    signs = CODER.escaped(text)
    ids, score = CODER.viterbi(signs)
    assert score == pytest.approx(best(signs)) and CODER.encode(text).tolist() == ids
    assert CODER.score(CODER.encode(text)) == pytest.approx(score)
    assert CODER.decode(CODER.encode(text)) == text


def unigram_library():
    """The library's own unigram segmentation over the same pieces."""
    with open(PATH, "rb") as f:
        data = f.read()
    # A message that follows overrides the model type (field 3 of field 2) with 1, unigram.
    return sentencepiece.SentencePieceProcessor(model_proto=data + bytes([2 << 3 | 2, 2, 3 << 3, 1]))


@pytest.mark.parametrize("text", ["hello world", "The and attion to thanedble the, anea.", "Ñaciónrriez de la", "schöne Grüße", "a", "token = 24be64439e3e"])
def test_same_as_library(text):
    assert CODER.encode(text).tolist() == unigram_library().nbest_encode_as_ids(text, 2)[0]  # its lattice


def test_tables(spark):
    rows = [(1, "hello  world "), (2, None), (None, ""), (1, "hello  world "), (3, "a▁b\n\t日本 🙂 x"), (4, "word " * 20_000), (5, "x" * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 n_pieces", "2 pieces", "3 score").repartition(3)
    coded = sp.encode(docs, PATH)
    assert sorted(map(tuple, sp.decode(coded, PATH).collect()), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert all(r.n_pieces == len(r.pieces) for r in coded.collect())
    got = sp.round_trip(docs, PATH).collect()
    assert len(got) == len(rows) and all(r.exact for r in got)
    texts = dict(rows)
    assert all(r.score == pytest.approx(best(CODER.escaped(texts[r.doc_id] or ""))) for r in got)
    assert sp.encode(docs.limit(0), PATH).count() == 0 == sp.round_trip(docs.limit(0), PATH).count()
