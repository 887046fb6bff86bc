"""The pipeline's stages on awkward rows, and its run against plain versions."""

from __future__ import annotations

import brute
import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(brute.awkward(), brute.SCHEMA)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, docs, name, stage):
    wide = docs.selectExpr("*", "1 as score", "'x' as shared", "2 as start", "3 as length")
    got = stage(spark, wide, SF)
    if name == "best-fit packing":
        assert got.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    else:
        assert got.columns == wide.columns and 0 < got.count() <= docs.count()
    assert stage(spark, docs.where("false"), SF).count() == 0


def test_language_stage_rejects_only_what_has_no_language(spark, docs):
    got = corpus_pipeline.language_id(spark, docs, SF)
    kept = {r.doc_id for r in got.collect()}
    assert not kept & {4, 5, 6, 7} and {1, 2, 3, 8, 11, 12} <= kept
    assert got.where("lang is null").count() == 0


def test_one_document_of_each_group_stays(spark):
    rows = [(i, brute.prose(i % 7, 30 + i % 3)) for i in range(60)] + [(60, None), (61, ""), (61, ""), (None, brute.prose(50, 40)), (None, brute.prose(51, 60))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.SCHEMA)
    kept = [r.doc_id for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()]
    groups = brute.groups([r for r in rows[:62]], 5, 80)
    assert sorted(i for i in kept if i is not None) == sorted({root for _, root in groups.values()}) and kept.count(None) == 2


def test_texts_that_share_a_doc_id_are_different_documents(spark):
    one, two, other = (brute.prose(k, 40) for k in (70, 71, 72))
    rows = [(5, one), (5, two), (5, two), (3, two + " end"), (None, other), (9, other), (None, brute.prose(73, 40))]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], brute.SCHEMA)
    kept = corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(5, one), (3, two + " end"), (9, other), rows[-1]], key=str)


def test_run_equals_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    known = corpus_pipeline.language_id(spark, docs, SF).select("doc_id", "text").collect()
    texts = {r.doc_id: r.text for r in known}
    stay = {root for _, root in brute.groups(list(texts.items()), 5, 80).values()}
    clean = {i for i in stay if not brute.benchmark_hits(texts[i], items)[4]}
    placed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in placed.select("doc_id").distinct().collect()} == clean
    bins = placed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert bins.where("n <> end or n > 2048").count() == 0
