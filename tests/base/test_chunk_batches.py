"""Chunks leave the worker in batches of bounded size, and are the same whatever the size."""

import pyarrow as pa
import pytest

from lodestone.operators import ingest


@pytest.mark.parametrize("chars, rows", [(200, 10_000), (1 << 20, 2)])
def test_batches_are_bounded(spark, monkeypatch, chars, rows):
    body = "\n\n".join(f"Sentence number {k} of a paragraph. " * 12 for k in range(30))
    docs = spark.createDataFrame([(k, None if k == 3 else body * (k % 3), "en" if k % 2 else None) for k in range(12)], "doc_id long, text string, lang string").repartition(1)
    want = sorted(map(tuple, ingest.chunk_documents(docs).collect()), key=lambda r: r[:2])
    monkeypatch.setattr(ingest, "BATCH_CHARS", chars)
    monkeypatch.setattr(ingest, "BATCH_ROWS", rows)
    assert sorted(map(tuple, ingest.chunk_documents(docs).collect()), key=lambda r: r[:2]) == want and len(want) > 100
    spark_map, sizes = type(docs).mapInArrow, []

    def seen(df, run, schema):
        pages = [(k, [{"page_no": 1, "text": body, "confidence": 1.0}], None) for k in range(5)]
        batch = pa.RecordBatch.from_pylist([dict(zip(("doc_id", "pages", "lang"), p, strict=True)) for p in pages])
        sizes.extend((b.num_rows, sum(map(len, b["text"].to_pylist()))) for b in run(iter([batch])))
        return spark_map(df, run, schema)

    monkeypatch.setattr(type(docs), "mapInArrow", seen)
    ingest.chunk_documents(docs)
    assert len(sizes) > 5 and all(n <= rows and size <= chars + 2000 for n, size in sizes)
