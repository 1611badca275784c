"""Documents, users and who may read what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# ---- Fixed values ---------------------------------------------------------------------------
LEVELS = ("unclassified", "restricted", "confidential", "secret", "top_secret")
STATUSES = ("pending", "processing", "ready", "failed")
# ---------------------------------------------------------------------------------------------


def level_label(level: Column) -> Column:
    """Name of a level; unknown numbers are the lowest."""
    return F.coalesce(F.get(F.array(*map(F.lit, LEVELS)), F.when(level.between(0, len(LEVELS) - 1), level).otherwise(0).cast("int")), F.lit(LEVELS[0]))


def status(c: Column) -> Column:
    return F.when(c.isin(*STATUSES), c).otherwise(STATUSES[0])


def may_read(clearance: Column, level: Column) -> Column:
    return clearance >= level


def may_write(clearance: Column, level: Column) -> Column:
    """A level above the writer's clearance is refused."""
    return level <= clearance


def has_role(roles: Column, role: str) -> Column:
    return F.array_contains(roles, "admin") | F.array_contains(roles, role)


def open_document(requests: DataFrame, documents: DataFrame) -> DataFrame:
    """``requests`` (``request_id, doc_id, clearance``) with 200, 403 or 404."""
    d = documents.select(F.col("doc_id").alias("__doc"), "classification")
    out = requests.join(d, F.col("doc_id") == F.col("__doc"), "left")
    code = F.when(F.col("__doc").isNull(), 404).when(may_read(F.col("clearance"), F.col("classification")), 200).otherwise(403)
    return out.select(*requests.columns, code.alias("status"))


def catalog(documents: DataFrame, clearance: int, n: int = 30) -> DataFrame:
    """The first ``n`` ready documents that a clearance may read, newest first."""
    rows = documents.where((F.col("status") == "ready") & (F.col("classification") <= clearance))
    return rows.orderBy(F.desc("created_at"), "doc_id").limit(n)


def upsert(table: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Last writer wins: ``changes`` come after ``table``, among themselves by ``order``."""
    both = table.withColumn("__late", F.lit(0)).unionByName(changes.withColumn("__late", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc("__late"), F.desc(order))
    return both.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r", "__late")


def delete_documents(gone: DataFrame, documents: DataFrame, chunks: DataFrame, embeddings: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the documents in ``gone`` and what hangs on them."""
    dead = chunks.join(gone.select("doc_id"), "doc_id", "left_semi").select("chunk_id")
    return documents.join(gone.select("doc_id"), "doc_id", "left_anti"), chunks.join(gone.select("doc_id"), "doc_id", "left_anti"), embeddings.join(dead, "chunk_id", "left_anti")


def index_scan(chunks: DataFrame, embeddings: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks of ready documents with their vectors, ordered by document and ordinal."""
    ready = documents.where("status = 'ready'").select("doc_id", "classification", "lang")
    return chunks.join(embeddings, "chunk_id").join(ready, "doc_id").orderBy("doc_id", "ordinal")
