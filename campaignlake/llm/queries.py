"""Registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from campaignlake.llm import decontamination, fingerprints, html_wrappers, langid, ngram_join, packing, periodic_runs, quality, secret_scan, sharding, spelling, token_counts, warc_audit
from campaignlake.llm.common import shared_dir, table, text_column


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(table(spark, sf_dir, "documents"), words=4, percent=85)


def op2_weighted_sampling_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.document_fingerprints(table(spark, sf_dir, "documents"))


def op3_merkle_fixity_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages twice, the second time with one byte changed in the records of every 97th page_id, and audits."""
    records = warc_audit.archive_records(table(spark, sf_dir, "pages"))
    root = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    rot = F.when(F.col("page_id") % 97 == 5, F.regexp_replace("record", "^(WARC/1.0\r\nWARC-Type: resourc)e", "$1f"))
    warc_audit.write_archives(records, root, {"archive": F.col("record"), "replica": F.coalesce(rot, F.col("record"))})
    leaves, damaged = warc_audit.audit(spark, f"{root}/replica=archive", f"{root}/replica=replica")
    found = damaged.select("node", "other_digest")
    return leaves.join(found, "node", "left").select(
        F.regexp_extract("record_id", r"(\d+)$", 1).cast("long").alias("page_id"),
        "file",
        F.col("first").alias("start"),
        (F.col("last") - F.col("first")).alias("length"),
        "digest",
        F.coalesce("other_digest", "digest").alias("replica_digest"),
        F.col("other_digest").isNull().alias("intact"),
    )


def op4_bin_completion_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents")))


def op5_two_pass_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shuffles and writes the whole documents; the digests are of the shards as they are read back."""
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    sharding.write_shards(docs, "doc_id", 8, root)
    written = StructType([*docs.schema.fields, StructField("slot", LongType()), StructField("shard", IntegerType())])
    shards = spark.read.schema(written).parquet(root)
    text = text_column(shards)
    return shards.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_byte_cnn_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", "text", langid.in_fold(F.col("doc_id")).alias("held_out"))
    return langid.predict(rows, langid.train(docs), ["doc_id", "held_out"])


def op7_wrapper_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_wrappers.page_texts(table(spark, sf_dir, "pages"), ["page_id", "url"])


def op8_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(table(spark, sf_dir, "documents"))


def op9_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_suffix_array_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, benchmark, ["doc_id"], unnamed=True)


def op11_trie_pair_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.counted_words(table(spark, sf_dir, "documents"), slips=31))


def looped_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): of every tenth hash of doc_id, the words from one on repeat its first few; others as they are.
    A null doc_id has no hash."""
    h = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8"))
    words = F.when(h % 10 == 0, F.regexp_extract_all(docs["text"].cast("string"), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    rows = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), words.alias("_words")).withColumn("_n", F.size("_words"))
    # An empty array, like none, leaves the text as it is.
    n = F.when(F.col("_n") > 0, F.col("_n"))
    rows = rows.withColumn("_a", (F.col("_g") % n).cast("int"))
    rows = rows.withColumn("_p", (F.floor((F.col("_n") - F.col("_a")) / (3 + F.col("_g") % 8)) + 1).cast("int"))
    rest = F.col("_n") - F.col("_a")
    period = F.slice("_words", F.col("_a") + 1, F.col("_p"))
    repeated = F.slice(F.flatten(F.array_repeat(period, F.ceil(rest / F.col("_p")).cast("int"))), F.lit(1), rest)
    looped = F.array_join(F.concat(F.slice("_words", F.lit(1), F.col("_a")), repeated), " ")
    return rows.select("doc_id", F.when(F.col("_a").isNull(), F.col("text")).otherwise(looped).alias("text"))


def op12_tiled_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(looped_texts(table(spark, sf_dir, "documents")), ["doc_id"], texts=False)
    found = found.withColumn("_longest", periodic_runs.longest_run(F.col("runs")))
    start, period, length = F.col("_longest.start"), F.col("_longest.period"), -F.col("_longest._less")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), start.alias("start"), length.alias("length"), period.alias("period"),
        F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(periodic_runs.runs_text(F.col("runs")), 256).alias("runs_sha256"), F.col("collapsed").alias("collapsed_sha256"),
    )


def op13_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_counts(table(spark, sf_dir, "documents"), ["doc_id"])
    counted = counts.select("doc_id", "n_bytes", token_counts.total_tokens(F.col("counts")).alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 512)


QUERIES = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_weighted_sampling_fingerprints": op2_weighted_sampling_fingerprints,
    "op3_merkle_fixity_audit": op3_merkle_fixity_audit,
    "op4_bin_completion_packing": op4_bin_completion_packing,
    "op5_two_pass_shuffle": op5_two_pass_shuffle,
    "op6_byte_cnn_language_id": op6_byte_cnn_language_id,
    "op9_quadratic_discriminant": op9_quadratic_discriminant,
    "op10_suffix_array_decontamination": op10_suffix_array_decontamination,
    "op7_wrapper_extraction": op7_wrapper_extraction,
    "op8_credential_linking": op8_credential_linking,
    "op11_trie_pair_variants": op11_trie_pair_variants,
    "op12_tiled_periodic_runs": op12_tiled_periodic_runs,
    "op13_prefix_token_counts": op13_prefix_token_counts,
}
ORACLES: dict[str, str] = {
    "op3_merkle_fixity_audit": """
        WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / 2000.0) AS BIGINT)) AS files FROM pages),
        records AS (
            SELECT page_id, page_id % files AS file, url, html,
                'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10)
                || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
                || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10)
                || 'Content-Type: text/html' || chr(13) || chr(10)
                || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
                || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10) AS record
            FROM pages, n
        ),
        copies AS (
            SELECT *, CASE WHEN page_id % 97 = 5 THEN left(record, 28) || 'f' || substr(record, 30) ELSE record END AS replica
            FROM records
        )
        SELECT page_id, file,
            CAST(sum(strlen(record)) OVER (PARTITION BY file ORDER BY page_id, url, html) - strlen(record) AS BIGINT) AS start,
            CAST(strlen(record) AS BIGINT) AS length,
            sha256(record) AS digest, sha256(replica) AS replica_digest, record = replica AS intact
        FROM copies
    """,
    # crc32 of a text is computed from a table of the remainders of all bytes, by the reflected polynomial EDB88320.
    "op11_trie_pair_variants": """
        WITH RECURSIVE remainders AS (
            SELECT list(r ORDER BY b) AS t FROM (
                SELECT b, list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0],
                    lambda c, _: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS r
                FROM (SELECT unnest(range(256)) AS b))
        ),
        runs AS (
            SELECT doc_id, run, count(*) AS n FROM (
                SELECT doc_id, unnest(regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run
                FROM documents)
            WHERE length(run) >= 7 GROUP BY ALL
        ),
        coded AS (SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM runs),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
                lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]))) AS h
            FROM coded, remainders
        ),
        spelled AS (
            SELECT CASE WHEN h % 31 = 0 THEN left(run, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
            FROM hashed
        ),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        skips AS (
            SELECT word, i, left(word, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, unnest(range(length(word))) AS i FROM words)
        ),
        near AS (
            SELECT a.word, b.word AS other FROM skips a JOIN skips b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
            UNION SELECT s.word, w.word FROM skips s JOIN words w ON w.word = s.rest
            UNION SELECT w.word, s.word FROM skips s JOIN words w ON w.word = s.rest
        ),
        best AS (
            SELECT near.word, count(*) AS n_near, first(w.word ORDER BY w.n DESC, encode(w.word)) AS form, max(w.n) AS form_n
            FROM near JOIN words w ON w.word = near.other GROUP BY near.word
        ),
        judged AS (
            SELECT words.word, words.n, coalesce(n_near, 0) AS n_near,
                CASE WHEN form_n >= 10 * words.n THEN form END AS form, CASE WHEN form_n >= 10 * words.n THEN form_n END AS form_n
            FROM words LEFT JOIN best ON best.word = words.word
        ),
        chain AS (
            SELECT word, word AS root FROM judged WHERE form IS NULL
            UNION ALL SELECT judged.word, chain.root FROM chain JOIN judged ON judged.form = chain.word
        )
        SELECT judged.word, form, root, n, n_near, form_n FROM judged JOIN chain ON chain.word = judged.word
    """,
}
