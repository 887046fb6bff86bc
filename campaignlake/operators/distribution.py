"""Answer distribution per question, and answer correctness."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_counts(answers: DataFrame, start: Any = None, end: Any = None) -> DataFrame:
    """Answers per option in an inclusive time range. Counted map-side, so a popular option is cheap."""
    dtype = answers.schema["occurred_at"].dataType
    if start is not None:
        answers = answers.where(F.col("occurred_at") >= F.lit(start).cast(dtype))
    if end is not None:
        answers = answers.where(F.col("occurred_at") <= F.lit(end).cast(dtype))
    return answers.groupBy("answer_option_id").agg(F.count(F.lit(1)).alias("n"))


def answer_distribution(
    questions: DataFrame,
    options: DataFrame,
    answers: DataFrame,
    start: Any = None,
    end: Any = None,
    version_id: int | None = None,
) -> DataFrame:
    """Every option of every question with its answers and share; options without answers stay.

    The log is reduced to one row per option before it meets the catalogue, which is what keeps
    the range filter inside the join and the join small.
    """
    if version_id is not None:
        questions = questions.where(F.col("version_id") == version_id)
        # Ingestion only links answers to options of their own version; this prunes the log.
        answers = answers.where(F.col("version_id") == version_id)
    q = questions.select("version_id", F.col("id").alias("question_key"), "code", "text")
    o = options.select(
        F.col("question_id").alias("question_key"), F.col("id").alias("answer_option_id"), "label", "position"
    )
    counted = (
        q.join(o, "question_key")
        .join(answer_counts(answers, start, end), "answer_option_id", "left")
        .groupBy("version_id", "code", "text", "label", "position")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("answers_count"))
    )
    # Totals by a second aggregate rather than a window: no question is gathered in one task.
    asked = counted.groupBy("version_id", "code").agg(F.sum("answers_count").alias("asked"))
    share = F.col("answers_count").cast("decimal(20,0)") / F.nullif(F.col("asked"), F.lit(0)).cast("decimal(20,0)")
    return counted.join(asked, ["version_id", "code"]).select(
        "version_id",
        F.col("code").alias("question_id"),
        F.col("text").alias("question"),
        F.col("label").alias("answer"),
        "position",
        "answers_count",
        F.round(share, 4).cast("double").alias("percentage"),
    )


def answer_correctness(options: DataFrame, answers: DataFrame) -> DataFrame:
    """Per question: answers to graded options and the share of correct ones."""
    graded = options.where(F.col("is_correct").isNotNull()).select(
        F.col("id").alias("answer_option_id"), "is_correct"
    )
    counted = answers.groupBy("version_id", "question_id", "answer_option_id").agg(
        F.count(F.lit(1)).alias("n")
    )
    return (
        counted.join(graded, "answer_option_id")
        .groupBy("version_id", "question_id")
        .agg(
            F.sum("n").alias("answers"),
            F.coalesce(F.sum(F.when(F.col("is_correct"), F.col("n"))), F.lit(0)).alias("correct"),
        )
        .withColumn(
            "share",
            F.round(F.col("correct").cast("decimal(20,0)") / F.col("answers").cast("decimal(20,0)"), 4).cast(
                "double"
            ),
        )
    )
