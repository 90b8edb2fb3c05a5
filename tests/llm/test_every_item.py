"""Every page and every chunk has a language code and a confidence."""

from pyspark.sql import functions as F

from corvane.llm import queries as llm


def test_items_without_words_have_a_row(spark, data):
    rows = llm.queries()["p3_items"](spark, data).cache()
    for source, table, key in (("page", "page_responses", "page_id"), ("chunk", "chunks", "chunk_id")):
        want = {str(r[0]) for r in spark.read.parquet(f"{data}/{table}.parquet").where(F.col(key).isNotNull()).select(key).distinct().collect()}
        got = [r["item_id"] for r in rows.where(F.col("source") == source).collect()]
        assert set(got) == want and len(got) == len(want)
    assert rows.where("lang is null or confidence is null or languages is null").count() == 0
    none = rows.where("lang = 'und'")
    assert none.count() > 0 and none.where("confidence <> 0 or size(languages) > 0").count() == 0
