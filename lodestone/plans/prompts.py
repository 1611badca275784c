"""Prompts, in Turkish and English."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: the wording --------------------------------------------------------------
SYSTEM = {
    "tr": "Yalnızca verilen belgelere dayanarak cevap ver. Her cümlenin sonuna kaynağını [n] biçiminde ekle. Cevap belgelerde yoksa bunu söyle.",
    "en": "Answer from the given documents only. End each sentence with its source as [n]. If the answer is not in them, say so.",
}
USER = {"tr": "%s\n\nSoru: %s", "en": "%s\n\nQuestion: %s"}
PLAN = {
    "tr": "Soruyu en çok üç alt soruya ayır ve JSON olarak ver: {\"sub_queries\": []}\n\nSoru: %s",
    "en": "Split the question into three sub-questions at most, as JSON: {\"sub_queries\": []}\n\nQuestion: %s",
}
REWRITE = {"tr": "Bu soruyu başka sözlerle sor: %s", "en": "Ask this question in other words: %s"}
EXPAND = {"tr": "Bu sorunun eş anlamlı biçimlerini JSON dizisi olarak ver: %s", "en": "Give other wordings of this question as a JSON array: %s"}
# ---------------------------------------------------------------------------------------------


def _told(lang: Column, texts: dict[str, str]) -> Column:
    return F.when(lang == "en", F.lit(texts["en"])).otherwise(F.lit(texts["tr"]))


def _filled(lang: Column, texts: dict[str, str], *values: Column) -> Column:
    return F.when(lang == "en", F.format_string(texts["en"], *values)).otherwise(F.format_string(texts["tr"], *values))


def answer_prompt(lang: Column, context: Column, question: Column) -> Column:
    return F.concat(_told(lang, SYSTEM), F.lit("\n\n"), _filled(lang, USER, context, question))


def plan_prompt(lang: Column, question: Column) -> Column:
    return _filled(lang, PLAN, question)


def rewrite_prompt(lang: Column, question: Column) -> Column:
    return _filled(lang, REWRITE, question)


def expand_prompt(lang: Column, question: Column) -> Column:
    return _filled(lang, EXPAND, question)
