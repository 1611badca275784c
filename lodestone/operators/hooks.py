"""Models from outside: callables that work on lists, applied batch by batch where the rows lie."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval

# ---- Fixed values ---------------------------------------------------------------------------
ATTEMPTS, FIRST_WAIT = 3, 0.4
# ---------------------------------------------------------------------------------------------


def retried(call: Callable, attempts: int = ATTEMPTS, wait: float = FIRST_WAIT, again: Callable[[Exception], bool] = lambda e: True) -> Callable:
    """``call`` with further attempts after errors that ``again`` allows, after doubling waits."""

    def run(*args):
        for k in range(attempts):
            try:
                return call(*args)
            except Exception as e:
                if k + 1 == attempts or not again(e):
                    raise
                time.sleep(wait * 2**k)

    return run


def embeddings(rows: DataFrame, model: Callable[[list[str]], list[list[float]]] | None = None, prefix: str = "", dim: int = 256, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(id, embedding)`` by ``model`` (texts in, vectors out; ``prefix`` is put before each text), or
    without one by hashes of character windows."""
    if model is None:
        return retrieval.hash_embeddings(rows, dim, id_col, text_col)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(list(model([prefix + (t or "") for t in part])))

    return rows.select(F.col(id_col).alias("id"), told(text_col).alias("embedding"))


def extracted(files: DataFrame, extract: Callable[[bytes], list]) -> DataFrame:
    """``(path, page_no, item, error)``: what ``extract`` (bytes in, one item a page out: texts, or
    images as bytes) finds in each file (``path, content``).  A file that makes it fail is told by
    its ``error`` and fails nothing else."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for path, content in zip(part["path"], part["content"], strict=True):
                try:
                    rows += [(path, k, x if isinstance(x, bytes) else str(x).encode(), None) for k, x in enumerate(extract(bytes(content)), 1)]
                except Exception as e:
                    rows.append((path, None, None, f"{type(e).__name__}: {e}"))
            out = pd.DataFrame(rows, columns=["path", "page_no", "item", "error"])
            yield out.assign(page_no=out["page_no"].astype("Int32"))

    return files.select("path", "content").mapInPandas(run, "path string, page_no int, item binary, error string")


def generated(prompts: DataFrame, model: Callable[[list[str]], list[str | None]]) -> DataFrame:
    """``prompts`` (``query_id, prompt``) with the model's ``answer``; blank ones are null."""

    @F.pandas_udf("string")
    def told(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(model(part.tolist()), dtype="object")

    return prompts.withColumn("answer", F.nullif(F.trim(told("prompt")), F.lit("")))
