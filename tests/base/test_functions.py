import pytest
from pyspark.sql import functions as F

from lodestone.functions import checks, text, vectors
from lodestone.operators import guard, ingest


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).head().y


def test_turkish_case(spark):
    assert one(spark, "IĞDIR İZMİR", text.tr_lower) == "ığdır izmir"
    assert one(spark, "ığdır izmir", text.tr_upper) == "IĞDIR İZMİR"
    assert one(spark, "çğıöşü ÇĞİÖŞÜ é", text.fold) == one(spark, "çğıöşü ÇĞİÖŞÜ é", text.fold_exact) == "cgiosu CGIOSU e"


def test_clean_and_tokens(spark):
    assert one(spark, "doku-\nman  uzun,\nsatır \n\n\n\nSon ", text.clean) == "dokuman uzun, satır\n\nSon"
    assert one(spark, "MADDE 7 Bakımı É x", text.tokens) == ["madde", "bakimi"]
    assert one(spark, "bakım bakımları", text.query_terms) == ["bakim", "bakimla", "bakimlari"]
    assert one(spark, "", text.estimate_tokens) == 0 and one(spark, "a" * 37, text.estimate_tokens) == 11


@pytest.mark.parametrize(("value", "lang"), [("Bu belge veri ve model için olarak hazırlanmıştır", "tr"), ("the system shall have been tested with these", "en"), ("xx yy", "und"), ("qq ww zz", "und")])
def test_language(spark, value, lang):
    assert one(spark, value, text.detect_lang) == lang


def test_sentences():
    assert text.sentences_of("Bu bir. Ikinci 3.14 sayı! Son mu?") == ["Bu bir.", "Ikinci 3.14 sayı!", "Son mu?"]
    assert text.sentences_of("Bkz. Madde 4. Tamam.\n\nyeni satır") == ["Bkz. Madde 4.", "Tamam.", "yeni satır"]
    assert text.sentences_of("Uzun cümle. A. Devam") == ["Uzun cümle. A.", "Devam"] and text.sentences_of("") == []


def test_overlap_measures(spark):
    f = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(text.containment(F.col("a"), F.col("b")).alias("y")).head().y
    assert f("the pump is serviced yearly", "It is known that the pump is serviced yearly by us") > 0.6
    assert f("wholly unrelated words", "the pump is serviced yearly") < 0.3 and f("", "x") == 0


def test_questions_and_entities(spark):
    assert one(spark, "Proje ne zaman bitti?", text.question_type) == "temporal" and one(spark, "Kaç adet?", text.question_type) == "numeric"
    found = {(e.kind, e.text) for e in one(spark, "12.03.2024 tarihinde %15 artış, a@b.co, MADDE 7", text.entities)}
    assert {("date", "12.03.2024"), ("percentage", "%15"), ("email", "a@b.co"), ("code", "MADDE 7")} <= found


@pytest.mark.parametrize(("value", "f", "ok"), [("10000000146", checks.tckn_ok, True), ("10000000145", checks.tckn_ok, False), ("4111 1111 1111 1111", checks.luhn_ok, True), ("4111 1111 1111 1112", checks.luhn_ok, False), ("GB82 WEST 1234 5698 7654 32", checks.iban_ok, True), ("GB82 WEST 1234 5698 7654 33", checks.iban_ok, False), ("10.0.0.255", checks.ip_ok, True), ("10.0.0.256", checks.ip_ok, False)])
def test_checks(spark, value, f, ok):
    assert one(spark, value, f) is ok


def test_pii():
    found = guard.pii_of("TC 10000000146, kart 4111 1111 1111 1111, parça 12345678901, a@b.co, 10.0.0.1")
    assert [k for _, _, k, _ in found] == ["tckn", "card", "email", "ip"]


def test_json_object():
    assert text.json_object_of('x ```{"a": {"b": "}"}} y') == '{"a": {"b": "}"}}' and text.json_object_of("{a") is None


def test_vectors(spark):
    assert one(spark, [3.0, 4.0], vectors.normalize, "array<float>") == [0.6, 0.8] and one(spark, [0.0], vectors.normalize, "array<float>") == [0.0]
    assert one(spark, [1.0], lambda c: vectors.fit(c, 3), "array<float>") == [1.0, 0.0, 0.0]


def test_sniff_and_names(spark):
    for head, mime in ((b"xx%PDF-1.7 rest", "application/pdf"), (b"\xff\xd8\xff" + b"0" * 9, "image/jpeg"), (b"\x89PNG\r\n\x1a\n..", "image/png"), (b"MZ" + b"0" * 9, None), (b"%PDF-", None)):
        assert one(spark, bytearray(head), ingest.sniff, "binary") == mime
    assert one(spark, "../../etc/pass<wd>", ingest.safe_name) == "pass_wd_" and one(spark, " .. ", ingest.safe_name) == "belge"


@pytest.mark.parametrize(("line", "level"), [("2.1 Bakım planı", 2), ("MADDE 7 Kapsam", 1), ("GENEL HÜKÜMLER", 1), ("Bu bir cümledir ve başlık değildir.", None), ("", None)])
def test_headings(spark, line, level):
    assert one(spark, line, ingest.heading_level) == level


def test_chunks():
    parts = [ingest.Part("1 Giriş", 1), ingest.Part("Kısa paragraf burada durur ve yeter."), ingest.Part("1.1 Alt", 2), ingest.Part("Uzun bir cümle yazılır. " * 120)]
    out = ingest.chunks_of(parts)
    assert out[-1][0] == "1 Giriş > 1.1 Alt" and len(out) > 2 and all(ingest._size(t) <= 380 + 70 for _, t, *_ in out)


def test_images():
    import numpy as np

    gray = np.tile(np.arange(256, dtype=np.uint8), (8, 1))
    assert set(np.unique(ingest.binarize(gray))) == {0, 255} and ingest.is_blank(np.full((9, 9), 255, np.uint8)) and not ingest.is_blank(gray)
