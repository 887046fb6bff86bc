"""Batch documents: JSON objects holding one array of rows, one document per file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Row fields per batch type. All are read as text, so that row rules see what was sent.
ROW_FIELDS = {
    "players": ["email", "external_id", "registered_at", "language"],
    "events": ["player_id", "player_email", "type", "occurred_at", "dedup_key", "payload"],
    "transactions": [
        "player_id", "player_email", "type", "amount", "currency", "status", "external_ref",
        "occurred_at", "dedup_key",
    ],
    "answers": ["player_id", "player_email", "question_id", "answer_option_id", "answer_text", "occurred_at"],
    "rewards": [
        "player_id", "player_email", "reward_type", "reward_code", "status", "granted_at",
        "redeemed_at", "dedup_key",
    ],
}
# Text of a document that is no JSON of the expected shape.
BROKEN = "_corrupt_record"


def row_schema(batch_type: str) -> T.StructType:
    return T.StructType([T.StructField(f, T.StringType()) for f in ROW_FIELDS[batch_type]])


def document_schema(batch_type: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(batch_type, T.ArrayType(row_schema(batch_type))),
            T.StructField("version_id", T.StringType()),
            T.StructField(BROKEN, T.StringType()),
        ]
    )


def explode_documents(documents: DataFrame, batch_type: str) -> DataFrame:
    """One line per row: version_id, file, position and the text fields. A document without rows
    gives none; `split_documents` is what reports it."""
    return documents.select(
        F.col("version_id").try_cast("bigint").alias("version_id"), "file", "arrived",
        F.posexplode(batch_type).alias("position", "row"),
    ).select("version_id", "file", "arrived", "position", "row.*")


def split_documents(
    documents: DataFrame, batch_type: str, versions: DataFrame | None = None, max_rows: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """(readable documents, rejected ones as file, reason, version_id, text).

    A document is rejected when it is broken or of another shape, has no rows or more than
    `max_rows`, or names no version among `versions` (id). Every document is in exactly one part.
    """
    version = F.col("version_id").try_cast("bigint")
    known = F.lit(True)
    if versions is not None:
        documents = documents.withColumn("_version", version).join(
            versions.select(F.col("id").alias("_version"), F.lit(True).alias("_live")).distinct(), "_version", "left"
        )
        known = F.col("_live").isNotNull()
    size = F.coalesce(F.size(batch_type), F.lit(0))
    reason = (
        F.when(F.col(BROKEN).isNotNull() | (F.col(batch_type).isNull() & F.col("version_id").isNull()), "unreadable")
        .when(size < 1, "no rows")
        .when(F.lit(max_rows is not None) & (size > F.lit(max_rows)), "too many rows")
        .when(F.col("version_id").isNull(), "no version")
        .when(version.isNull() | ~known, "unknown version")
    )
    judged = documents.withColumn("reason", reason)
    text = F.coalesce(BROKEN, F.to_json(F.struct("version_id", batch_type)))
    good = judged.where(F.col("reason").isNull()).select("version_id", batch_type, BROKEN, "file", "arrived")
    return good, judged.where(F.col("reason").isNotNull()).select("file", "reason", "version_id", text.alias("text"))


def _with_origin(documents: DataFrame) -> DataFrame:
    return documents.withColumns(
        {"file": F.col("_metadata.file_path"), "arrived": F.col("_metadata.file_modification_time")}
    )


def _json(reader, batch_type: str):
    return reader.schema(document_schema(batch_type)).option("multiLine", True).option("columnNameOfCorruptRecord", BROKEN)


def read_documents(spark: SparkSession, path: str, batch_type: str, version_id: int | None = None) -> DataFrame:
    """Documents under `path`, readable or not. The version comes from the argument, the document, or a
    `version_id=…` directory."""
    docs = _with_origin(_json(spark.read, batch_type).json(path))
    if version_id is not None:
        docs = docs.withColumn("version_id", F.lit(str(version_id)))
    return docs


def stream_documents(
    spark: SparkSession, path: str, batch_type: str, max_files: int = 1000
) -> DataFrame:
    """The same documents as a stream; `max_files` bounds one micro-batch."""
    return _with_origin(_json(spark.readStream, batch_type).option("maxFilesPerTrigger", max_files).json(path))


def with_ordinal(rows: DataFrame) -> DataFrame:
    """Add `ord`: 0, 1, ... by arrival of the file and position inside it, without gaps.

    Rows are counted by file and files by the hour they arrived in; running sums then go over
    the hours, over the files of an hour, and rows take their place from their file's.
    """
    sizes = rows.groupBy("file", "arrived").agg((F.max("position") + 1).cast("bigint").alias("_rows"))
    sizes = sizes.withColumn("_hour", F.date_trunc("hour", "arrived"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    running = lambda total, window: F.coalesce(F.sum(total).over(window), F.lit(0))
    hours = sizes.groupBy("_hour").agg(F.sum("_rows").alias("_total"))
    starts = hours.select("_hour", running("_total", before.orderBy("_hour")).alias("_start"))
    inside = running("_rows", before.partitionBy("_hour").orderBy("arrived", "file"))
    first = sizes.withColumn("_inside", inside).join(starts, "_hour")
    return (
        rows.join(first.select("file", (F.col("_start") + F.col("_inside")).alias("_first")), "file")
        .withColumn("ord", F.col("_first") + F.col("position"))
        .drop("_first", "file", "arrived", "position")
    )
