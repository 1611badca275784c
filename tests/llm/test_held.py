"""What Python steps of the pipeline hold beside a batch of Arrow while they run over it."""

import tracemalloc
from collections import Counter

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from lodestone.llm import pii, sentencepiece

TEXT = "write to a.b@c.org or call the old house by the river now my dear friend " * 28
ROWS = 3000


@pytest.fixture
def steps(monkeypatch):
    """The functions given to mapInArrow, by their first output column."""
    found, old = {}, DataFrame.mapInArrow

    def keep(self, func, schema, *rest):
        out = old(self, func, schema, *rest)
        found[out.columns[0], len(out.columns)] = func
        return out

    monkeypatch.setattr(DataFrame, "mapInArrow", keep)
    return found


def held(func, **columns):
    """Peak MB of Python and NumPy, and what the step gives."""
    batch = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
    for _ in func(iter([batch.slice(0, 2)])):
        pass
    tracemalloc.start()
    rows = 0
    for out in func(iter([batch])):
        rows += out.num_rows
        last = out
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    return peak, rows, last


def test_little_is_held(spark, steps):
    texts, ids = pa.array([TEXT] * ROWS), pa.array(range(ROWS), pa.int64())
    assert texts.nbytes > 6e6
    docs = spark.createDataFrame([(1, TEXT)], "doc_id long, text string")

    phrases = spark.createDataFrame([("the river",), ("friend",)], "words string")
    assert pii.occurrences(docs, phrases).count() == 2
    peak, _, out = held(steps["key", 2], text=texts)
    assert Counter(out.column(1).to_pylist()) == {28 * ROWS: 2}
    assert peak < 20

    pii.entities(docs)
    peak, rows, _ = held(steps["row", 4], row=ids, id=ids, text=pa.array([TEXT[:2000].replace("@", " ")] * ROWS))
    assert rows == ROWS and peak < 4

    pii.masked(docs)
    peak, rows, out = held(steps["doc_id", 2], doc_id=ids, text=texts)
    assert rows == ROWS and out.column(1)[0].as_py() == TEXT.replace("a.b@c.org", "[email]")
    assert peak < 5

    sentencepiece.encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
    peak, rows, _ = held(steps["doc_id", 3], doc_id=ids, text=texts)
    assert rows == ROWS and peak < 6
