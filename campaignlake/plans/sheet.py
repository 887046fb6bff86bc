"""Compile a sheet spec into one lazy DataFrame."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlake.operators.aggregates import aggregate
from campaignlake.operators.predicates import compare_columns, predicate
from campaignlake.plans.spec import SheetColumn, SheetSpec
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry, SourceDef

Tables = Mapping[str, DataFrame]


def scoped_source(source: SourceDef, tables: Tables, version_id: int | None) -> DataFrame:
    """Source rows of one version (all versions for None), with its declared joins."""
    rows = source.rows(tables[source.table]).alias(source.table)
    if version_id is not None:
        rows = rows.where(F.col(source.version_column) == version_id)
    for join in source.joins:
        condition = [compare_columns(F.col(a), op, F.col(b)) for a, op, b in join.on]
        rows = rows.join(tables[join.table].alias(join.alias), condition, join.how)
    return rows


def column_type(rows: DataFrame, column: str) -> T.DataType:
    return rows.select(F.col(column)).schema[0].dataType


def filtered_source(
    spec: SheetSpec, source: SourceDef, tables: Tables, version_id: int | None, settings: Settings
) -> DataFrame:
    """All given filters, and-ed; names outside the whitelist are ignored."""
    rows = scoped_source(source, tables, version_id)
    for alias, value in spec.filters.items():
        rule = source.filters.get(alias)
        if rule is not None:
            dtype = column_type(rows, rule.column)
            rows = rows.where(predicate(rule.op, F.col(rule.column), dtype, value, settings))
    return rows


def _aggregate_column(
    column: SheetColumn, source: SourceDef, rows: DataFrame, settings: Settings
) -> Column:
    if column.field is None:
        return aggregate(column.fn, None, None, settings)
    real = source.fields[column.field]
    dtype = column_type(rows, real)
    return aggregate(column.fn, _compared(F.col(real), dtype, settings), dtype, settings)


def _compared(column: Column, dtype: T.DataType, settings: Settings) -> Column:
    """A text as the settings compare it; groups and distinct counts use the same rule."""
    collated = settings.text_collation and isinstance(dtype, T.StringType)
    return F.collate(column, settings.text_collation) if collated else column


def _grouped(
    spec: SheetSpec, source: SourceDef, rows: DataFrame, per_version: bool, settings: Settings
) -> DataFrame:
    fields = {alias: source.fields[alias] for alias in spec.group_by}
    dims = {alias: _compared(F.col(f), column_type(rows, f), settings) for alias, f in fields.items()}
    keys = [c.alias(f"g{i}") for i, c in enumerate(dims.values())]
    if per_version:
        keys = [F.col(source.version_column).alias("version_id"), *keys]
    aggregates = [
        _aggregate_column(c, source, rows, settings).alias(f"c{i}")
        for i, c in enumerate(spec.columns)
        if c.fn
    ]
    grouped = rows.groupBy(*keys).agg(*aggregates) if aggregates else rows.select(*keys).distinct()
    position = {alias: f"g{i}" for i, alias in enumerate(dims)}
    if spec.sort:
        order = [F.col(position[s.column]) for s in spec.sort]
        grouped = grouped.orderBy(
            *(["version_id"] if per_version else []),
            *[c.desc() if s.descending else c.asc() for c, s in zip(order, spec.sort)],
        )
    picked = [
        F.col(f"c{i}") if c.fn else F.col(position[c.field]).alias(f"c{i}")
        for i, c in enumerate(spec.columns)
    ]
    return grouped.select(*(["version_id"] if per_version else []), *picked)


def _detail(
    spec: SheetSpec, source: SourceDef, rows: DataFrame, per_version: bool, ordered: bool
) -> DataFrame:
    if ordered:
        order = [
            F.col(source.fields[s.column]).desc() if s.descending else F.col(source.fields[s.column]).asc()
            for s in spec.sort
        ]
        lead = [F.col(source.version_column)] if per_version else []
        # The key breaks ties, and is the whole order of an unsorted sheet.
        rows = rows.orderBy(*lead, *order, F.col(source.key))
    lead = [F.col(source.version_column).alias("version_id")] if per_version else []
    picked = [F.col(source.fields[c.field]).alias(f"c{i}") for i, c in enumerate(spec.columns)]
    return rows.select(*lead, *picked)


def compile_sheet(
    spec: SheetSpec,
    tables: Tables,
    version_id: int | None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
    ordered: bool = True,
) -> DataFrame:
    """One DataFrame per sheet; nothing runs until it is written or read.

    `version_id=None` answers the sheet for every version in one pass, with a leading
    `version_id` column. `ordered=False` leaves out the detail sort when the reader needs none.
    """
    source = registry.sources[spec.source]
    rows = filtered_source(spec, source, tables, version_id, settings)
    per_version = version_id is None
    if spec.aggregated:
        sheet = _grouped(spec, source, rows, per_version, settings)
    else:
        sheet = _detail(spec, source, rows, per_version, ordered)
    return sheet.toDF(*(["version_id"] if per_version else []), *spec.header)


def sheet_row_count(
    spec: SheetSpec,
    tables: Tables,
    version_id: int | None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
) -> DataFrame:
    """Row count of the sheet as a one-row frame (one row per version for None)."""
    source = registry.sources[spec.source]
    rows = filtered_source(spec, source, tables, version_id, settings)
    lead = [F.col(source.version_column).alias("version_id")] if version_id is None else []
    if spec.group_by:
        dims = [F.col(source.fields[a]).alias(f"g{i}") for i, a in enumerate(spec.group_by)]
        rows = rows.select(*lead, *dims).distinct()
    else:
        rows = rows.select(*lead, F.col(source.key).alias("_key"))
    counted = F.count(F.lit(1)).alias("rows")
    if version_id is None:
        # A sheet of bare aggregates has one row whatever it reads.
        one = F.lit(1).cast("bigint").alias("rows")
        bare = spec.aggregated and not spec.group_by
        return rows.select("version_id").distinct().select("version_id", one) if bare else (
            rows.groupBy("version_id").agg(counted)
        )
    if spec.aggregated and not spec.group_by:
        return rows.agg(F.lit(1).cast("bigint").alias("rows"))
    return rows.agg(counted)
