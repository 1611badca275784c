"""Queries without SQL ask every benchmark item."""

import pytest

from lodestone import queries


@pytest.mark.parametrize("name", ["diverse_search", "ask_batch"])
def test_all_items_are_asked(spark, sf_dir, name):
    items = {r[0] for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id").collect()}
    got = {r.query_id for r in queries.QUERIES[name](spark, sf_dir).select("query_id").collect()}
    assert got == items and len(items) > 8


def test_snippets_of_all_items(spark, tmp_path):
    spark.createDataFrame([(k, f"text number {k} here") for k in range(90)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, f"number {k}") for k in range(90)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert queries.QUERIES["snippets"](spark, str(tmp_path)).count() == 90
