"""Corpus pipeline: raw documents to packed training sequences.

Each stage takes and returns the columns of `documents` (the last one returns sequence places) and works on all
rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from campaignlake.llm import decontamination, langid, ngram_join, packing, secret_scan
from campaignlake.llm.common import ship_package, staged, table

#: Documents without a letter, or of whose language the network is less sure than this, are rejected.
LEAST_SURE = 0.4


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a recognisable language; a missing `lang` is filled in. Without any labelled
    document there is nothing to learn, and all pass. Null, blank and letterless texts have no language; whole texts
    count, however long; repeated rows are judged alike and all kept."""
    ship_package(spark)
    network = langid.train(docs)
    if network is None:
        return docs
    spare = [f"_c{i}" for i in range(len(docs.columns))]
    text, lang = (spare[docs.columns.index(c)] for c in ("text", "lang"))
    judged = langid.predict(docs.toDF(*spare).withColumn("text", F.col(text)), network, spare)
    sure = judged.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SURE))
    return sure.withColumn(lang, F.coalesce(lang, "lang_pred")).select(*spare).toDF(*docs.columns)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates (five words, 0.8): the one with the smallest doc_id, those
    without one last. Rows are told apart by doc_id and text, so different texts with one doc_id are different
    documents; of rows equal in both one stays. An empty table stays empty."""
    ship_package(spark)
    named = docs.withColumn("_ngram_key", F.xxhash64("doc_id", "text"))
    groups = ngram_join.ngram_components(named.select(F.col("_ngram_key").alias("doc_id"), "text"), words=5, percent=80)
    owners = named.select(F.col("_ngram_key").alias("key"), F.col("doc_id").alias("owner")).distinct()
    first = F.struct(F.col("owner").isNull(), "owner", "key")
    kept = groups.withColumnRenamed("doc_id", "key").distinct().join(owners, "key").groupBy("component_id").agg(F.min(first).alias("first"))
    kept = kept.select(F.col("first.key").alias("_ngram_key"))
    own = Window.partitionBy("_ngram_key", "doc_id", F.crc32(F.encode("text", "UTF-8"))).orderBy(F.xxhash64(*docs.columns))
    rows = named.join(kept, "_ngram_key", "left_semi").withColumn("_ngram_n", F.row_number().over(own))
    return rows.where("_ngram_n = 1").select(*docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents that hold a window of the benchmark. Null and empty texts hold none; repeated rows go or stay
    together; an empty benchmark removes nothing."""
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; null, empty and other texts stay as they are, and no row goes."""
    return secret_scan.redacted(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents' tokens into sequences. A null or empty text is its closing token alone; repeated rows are
    packed each."""
    ship_package(spark)
    return packing.pack(packing.token_pieces(docs))


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", ngram_jaccard_join),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("best-fit packing", best_fit_packing),
]

#: No SQL: the first and last stages can't be expressed in it; tests/llm compares each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
