"""The queries and the pipeline run as registered, and the pipeline's stages do what they say."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{k}" for k in range(1, 11)]


@pytest.mark.parametrize("name", ["op1_toxicity", "op6_fingerprints", "op10_license_scan"])
def test_query_gives_a_row_per_document(spark, name):
    assert QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    good = {r["doc_id"] for r in labels.filter("quality = 1").collect()}
    junk = {r["doc_id"] for r in labels.filter("quality = 0").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF).cache()
        assert after.columns == columns and 0 < after.count() <= before
        if name == "quality_classifier":
            ids = {r["doc_id"] for r in after.select("doc_id").collect()}
            had = {r["doc_id"] for r in docs.select("doc_id").collect()}
            assert len(good & ids) >= 0.95 * len(good & had) and len(junk & ids) <= 0.2 * len(junk & had)
        docs, before = after, after.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
    full = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert full.filter("n <> end or n > 2048").count() == 0
