"""Reading tables, shared staging and row numbering used by the operators of this subpackage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends this package to the executors, once for each application, so that their Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = Path(__file__).resolve().parents[1]
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{package.name}", "zip", package.parent, package.name)
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors reach: `spark.checkpoint.dir` of the session.

    Only where the setting is absent (tests, a single machine) a temporary folder is used.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="llm-stages-"))
        current = spark.sparkContext.getCheckpointDir()
    return current.rstrip("/")


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written once as Parquet in the shared folder and read back: lineage ends at replicated files,
    so a lost executor costs only its running tasks, and later jobs do not repeat the work before it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The text, null read as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def unit_hash(*cols: Column | str) -> Column:
    """Seedable hash of columns as a double in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)
