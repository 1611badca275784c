"""Parquet tables and files."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNKS = T.StructType().add("chunk_id", "string").add("doc_id", "long").add("ordinal", "integer").add("heading_path", "string").add("text", "string").add("parent_id", "string").add("page_from", "integer").add("page_to", "integer")
EMBEDDINGS = T.StructType().add("chunk_id", "string").add("model", "string").add("embedding", T.ArrayType(T.FloatType()))
CACHE = T.StructType().add("key", "string").add("scope", "string").add("clearance", "integer").add("vector", T.ArrayType(T.FloatType())).add("answer", "string").add("created_at", "timestamp").add("hits", "long")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def settled(df: DataFrame) -> DataFrame:
    """``df`` worked out once and kept in the shared folder: plans that go on from it are short, and
    don't need the executors that computed it.  For small results only (of a batch of queries).

    The folder is ``spark.checkpoint.dir``; only a local session without it gets its own.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir", None)
        if own is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(own or tempfile.mkdtemp(prefix="lodestone-"))
    return df.checkpoint()


def files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """``(path, name, length, content)`` of the files of a folder."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return rows.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length", "content")


def stored_vector(blob: bytes) -> list[float]:
    """A vector kept as little-endian 4-byte floats."""
    import numpy as np

    return np.frombuffer(blob, "<f4").tolist()


def vectors_from_blobs(df: DataFrame, blob_col: str = "vec") -> DataFrame:
    import pandas as pd

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def decode(part: pd.Series) -> pd.Series:
        return part.map(stored_vector, na_action="ignore")

    return df.withColumn("embedding", decode(blob_col)).drop(blob_col)
