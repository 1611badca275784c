"""The thin queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, decontam, digest, hmm, langid, licenses, pii, sentencepiece, simhash, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.round_trip(_table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op2_hidden_markov_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(_table(spark, sf_dir, "documents"))


def op3_quartile_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op4_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(_table(spark, sf_dir, "pages"))


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def op6_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op8_license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_hidden_markov_scores": op2_hidden_markov_scores,
    "op3_quartile_digest": op3_quartile_digest,
    "op4_warc_archive": op4_warc_archive,
    "op5_personal_data": op5_personal_data,
    "op6_simhash_near_duplicates": op6_simhash_near_duplicates,
    "op7_language_id": op7_language_id,
    "op8_license_digests": op8_license_digests,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}

ORACLE_SQL: dict[str, str] = {
    "op4_warc_archive": f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
        f AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html)
        SELECT page_id, strlen(p.html)::BIGINT AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('{warc.BASE32}',
                   ((('0x' || substr(h, (i // 8 * 10 + 1)::INT, 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INT + 1, 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to, true AS verified
        FROM p JOIN f USING (html)
    """,
    "op8_license_digests": licenses.sql(),
    "op10_decontamination": f"""
        WITH dw AS (SELECT DISTINCT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
        iw AS (SELECT DISTINCT item_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM benchmark),
        ds AS (SELECT doc_id, w, unnest(range(1, len(w) - {decontam.SHINGLE - 2})) AS pos FROM dw),
        dg AS (SELECT doc_id, len(w) - {decontam.SHINGLE - 1} AS n, pos, array_to_string(w[pos:pos + {decontam.SHINGLE - 1}], ' ') AS g FROM ds),
        isx AS (SELECT item_id, w, unnest(range(1, len(w) - {decontam.SHINGLE - 2})) AS pos FROM iw),
        ig AS (SELECT item_id, len(w) - {decontam.SHINGLE - 1} AS m, array_to_string(w[pos:pos + {decontam.SHINGLE - 1}], ' ') AS g, count(*) AS k FROM isx GROUP BY ALL),
        hits AS (SELECT doc_id, item_id, n, m, pos, g, k FROM dg JOIN ig USING (g)),
        starts AS (SELECT DISTINCT doc_id, item_id, n, m, unnest(range(greatest(1, pos - m + 1), least(pos, greatest(n - m + 1, 1)) + 1)) AS s FROM hits),
        counts AS (SELECT doc_id, item_id, n, m, s, g, least(count(*), any_value(k)) AS c
                   FROM starts JOIN hits USING (doc_id, item_id, n, m) WHERE pos BETWEEN s AND s + m - 1 GROUP BY ALL),
        likeness AS (SELECT doc_id, item_id, sum(c) / (m + least(m, n) - sum(c)) AS similarity FROM counts GROUP BY doc_id, item_id, n, m, s)
        SELECT doc_id, item_id, max(similarity)::DOUBLE AS similarity FROM likeness WHERE similarity >= {decontam.SIMILAR} GROUP BY ALL
    """,
}
