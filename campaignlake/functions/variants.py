"""Payload keys that a sheet source declares by path, read out of a variant.

A store that keeps variants writes every payload also as a Parquet variant, whose frequent paths Spark shreds into
columns of their own: a declared path is then read as such a column, and a new one needs neither a rewrite nor a parse.
Elsewhere the payload's text is parsed, once for all declared paths of a sheet.

Defined cases: a path that a payload lacks, a JSON null, a value that the type can't hold, a payload that is no JSON and
a null payload all read as NULL; numbers and objects read as text are JSON text, without trailing zeros; of a repeated
key the last value counts where the session allows them (`build_session` does), else the payload reads as NULL.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIANT_COLUMN = "payload_variant"


@dataclass(frozen=True)
class PayloadPath:
    """A path such as `$.device.os` or `$.tags[0]` and the SQL type that it is read as."""

    path: str
    type: str = "string"


def payload_variant(payload: Column) -> Column:
    return F.try_parse_json(payload)


def with_payload_paths(events: DataFrame, paths: Mapping[str, PayloadPath]) -> DataFrame:
    """`events` with a column for each declared path."""
    if not paths:
        return events
    if VARIANT_COLUMN not in events.columns:
        events = events.withColumn(VARIANT_COLUMN, payload_variant(F.col("payload")))
    return events.withColumns({name: F.try_variant_get(VARIANT_COLUMN, p.path, p.type) for name, p in paths.items()})
