"""Helpers that every corpus operator uses: staged tables, Arrow batches, skew-proof lookups."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts handed to one Python step at a time, in UTF-8 bytes; longer texts go alone.
BATCH_BYTES = 4 << 20
#: The same for steps that hold many times their texts while an executor's heap is at its largest.
SMALL_BYTES = 1 << 19

_own_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    conf = spark.sparkContext.getConf()
    if found := conf.get("spark.checkpoint.dir", None):
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        _own_dirs[app] = "file://" + tempfile.mkdtemp(prefix="lodestone-")
    return _own_dirs[app]


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of it: what follows does not
    depend on executors that computed it.  The staged table that it comes ``instead`` of, which
    nothing may read any more, is deleted."""
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.staged_at = path
    if instead is not None:
        drop_path(df.sparkSession, instead.staged_at)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a staged folder through Hadoop's file system API."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each piece is about ``limit`` bytes at most."""
    for batch in batches:
        lengths = batch.column(batch.schema.get_field_index(column))
        start, held = 0, 0
        for i, n in enumerate(pc.binary_length(lengths).to_pylist()):
            if i > start and held + (n or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += n or 0
        if batch.num_rows > start:
            yield batch.slice(start)


def release() -> None:
    """Give memory that is free, but held by allocators, back to the system: Python workers live on
    through all stages."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with free memory given back at the end of each task."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return whole


def map_texts(df: DataFrame, column: str, schema: str, step: Callable[[pa.RecordBatch], dict | None], limit: int = BATCH_BYTES, done: Callable[[], None] | None = None) -> DataFrame:
    """Apply ``step`` to pieces of ``df``; it returns columns by name (lists or arrays).  ``done`` is
    called at the end of each task, to free what the worker would hold on to."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    arrow = _arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for piece in slices(batches, column, limit):
                found = step(piece)
                if found is not None:
                    yield pa.RecordBatch.from_arrays(
                        [c if isinstance(c := found[f.name], pa.Array) else pa.array(c, f.type) for f in arrow], schema=arrow
                    )
        finally:
            if done is not None:
                done()

    return df.mapInArrow(released(run), fields)


def _arrow_schema(fields) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def lookup(left: DataFrame, key: str, right: DataFrame, weight: str, total: int, slots: int = 512) -> DataFrame:
    """Left join ``left`` with ``right`` (one row a key) so that no key's rows meet in one task.

    ``right.weight`` says how many rows of ``left`` carry the key; their sum is ``total`` at most.
    A key with over ``total / slots`` rows is hot: there are fewer than ``slots`` of them, whatever
    the input, so these rows of ``right`` are broadcast.  The rest is an ordinary shuffle join, in
    which the hot rows and rows without key are dealt evenly.  ``right`` must be cheap to read twice.
    (The salt of cold rows, always 0, is no literal, as the optimizer would take it out of the join.)
    """
    names = [c for c in right.columns if c != key]
    hot = right.where(F.col(weight) * slots > F.lit(total)).select(
        F.col(key).alias("__k"), F.struct(*names).alias("__hot")
    )
    cold = right.where(F.col(weight) * slots <= F.lit(total)).select(
        F.col(key).alias("__k"), F.pmod(F.xxhash64(key), F.lit(1)).alias("__salt"), F.struct(*names).alias("__cold")
    )
    marked = left.join(F.broadcast(hot), left[key] == F.col("__k"), "left").drop("__k")
    free = F.col("__hot").isNotNull() | F.col(key).isNull()
    marked = marked.withColumn("__salt", F.when(free, 1 + F.pmod(F.monotonically_increasing_id(), F.lit(1 << 40))).otherwise(0))
    marked = marked.withColumn("__k0", F.when(F.col(key).isNull(), _zero(left, key)).otherwise(F.col(key)))
    joined = marked.join(cold, (F.col("__k0") == F.col("__k")) & (marked["__salt"] == cold["__salt"]), "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return joined.select(*[F.col(c) for c in left.columns], *[found[c].alias(c) for c in names])


def _zero(left: DataFrame, key: str):
    return F.lit("").cast(left.schema[key].dataType) if left.schema[key].dataType.typeName() in ("string", "binary") else F.lit(0).cast(left.schema[key].dataType)
