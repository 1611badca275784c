"""The corpus pipeline: five stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontam, langid, pii, sentencepiece, simhash
from lodestone.llm.shared import released, slices, staged

#: A document stays if its language holds at least this share of its letters.
LANGUAGE_SHARE = 0.5
#: Rows to drop (of some 30 bytes) that are broadcast at most; more are found by a shuffle join.
BROADCAST_ROWS = 500_000


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or without a language that holds half of their letters, go.

    The model learns from the rows of ``docs`` with a language that aren't held out; if there are
    none, only documents without a letter go.  Rows are filtered where they lie.
    """
    model = langid.train(docs.where(~langid.held_out()))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    shipped = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        for batch in slices(batches, "text", langid.PIECE):
            found = langid.label([t or "" for t in batch.column(at).to_pylist()], shipped.value)
            yield batch.filter(pa.array([k != langid.UNKNOWN and share >= LANGUAGE_SHARE for k, share, _ in found]))

    return docs.mapInArrow(released(run), docs.schema)


def _keyed(docs: DataFrame) -> DataFrame:
    """``(key, text, row)``: a key that only rows of equal id and text share (null ids come last), and
    the whole row, so that no column's name clashes with ours."""
    key = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("mark"))
    return docs.select(key.alias("key"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


def _tagged(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """``(key, row, tag)``: the rows of ``docs`` with the tag of their key, or null."""
    keyed = _keyed(docs).select("key", "row", F.to_json("key").alias("own"))
    right = tags.select(F.to_json("key").alias("other"), "tag")
    right = F.broadcast(right) if tags.count() <= BROADCAST_ROWS else right
    return keyed.join(right, F.col("own") == F.col("other"), "left").select("key", "row", "tag")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates (five-word shingles of similarity 0.8 or more) the document
    with the smallest id stays (of repeated rows, one; null ids count as largest)."""
    groups = staged(simhash.near_duplicates(_keyed(docs).select("key", "text"), id_col="key", shingle=5, similar=0.8), "dedup-groups")
    kept = F.col("key") == F.col("component_id")
    tags = groups.groupBy("key").agg(F.bool_or(kept).alias("kept"), F.count("*").alias("n")).where("not kept or n > 1")
    tagged = _tagged(docs, staged(tags.select("key", F.when(F.col("kept"), "repeated").otherwise("copy").alias("tag")), "dedup-tags"))
    once = tagged.where(F.col("tag") == "repeated").dropDuplicates(["key"])
    return tagged.where(F.col("tag").isNull()).unionByName(once).select("row.*")


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = decontam.contaminated(_keyed(docs).select("key", "text"), benchmark, id_col="key")
    tags = staged(found.select("key", F.lit("leak").alias("tag")).distinct(), "leak-tags")
    return _tagged(docs, tags).where(F.col("tag").isNull()).select("row.*")


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars`` follows the text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_pieces, pieces)`` of each document."""
    return sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("mask_personal_data", mask_personal_data),
    ("encode_pieces", encode_pieces),
]

#: Viterbi and bit-majority fingerprints are beyond SQL; tests compare with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
