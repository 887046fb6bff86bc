"""Aggregated sheets of one source in one pass over it.

Every row is tagged with the numbers of the sheets whose filters it passes and repeated for each, inside the scan's
stage; the partial aggregation there keeps one row for each sheet and group before anything is shuffled. A sheet's own
keys and metrics are null in the rows of the others.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from campaignlake.operators.aggregates import aggregate
from campaignlake.operators.predicates import predicate
from campaignlake.plans.sheet import Tables, column_type, compile_sheet, scoped_source
from campaignlake.plans.spec import SheetSpec
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry, SourceDef

COUNTS = ("count", "count_distinct")


def _condition(spec: SheetSpec, source: SourceDef, rows: DataFrame, settings: Settings) -> Column | None:
    """All filters of a sheet; None when it has none."""
    rules = [(source.filters[alias], value) for alias, value in spec.filters.items() if alias in source.filters]
    tests = [predicate(r.op, F.col(r.column), column_type(rows, r.column), value, settings) for r, value in rules]
    return reduce(lambda a, b: a & b, tests) if tests else None


def shared_aggregate(
    specs: Mapping[int, SheetSpec], source: SourceDef, tables: Tables, version_id: int, settings: Settings = DEFAULT_SETTINGS
) -> DataFrame:
    """(_sheet, g<sheet>_<n> for group keys, c<sheet>_<n> for metrics) of aggregated sheets of one source."""
    rows = scoped_source(source, tables, version_id)
    conditions = {number: _condition(spec, source, rows, settings) for number, spec in specs.items()}
    if all(c is not None for c in conditions.values()):
        rows = rows.where(reduce(lambda a, b: a | b, conditions.values()))
    tags = [F.lit(n) if c is None else F.when(c, F.lit(n)) for n, c in conditions.items()]
    tagged = rows.withColumn("_sheet", F.explode(F.array_compact(F.array(*tags))))
    keys, metrics = [], []
    for number, spec in specs.items():
        own = lambda c, number=number: F.when(F.col("_sheet") == number, c)
        keys += [own(F.col(source.fields[alias])).alias(f"g{number}_{i}") for i, alias in enumerate(spec.group_by)]
        for i, column in enumerate(spec.columns):
            if column.fn and column.field is None:
                metrics.append(F.count(own(F.lit(1))).alias(f"c{number}_{i}"))
            elif column.fn:
                real = source.fields[column.field]
                metrics.append(aggregate(column.fn, own(F.col(real)), column_type(rows, real), settings).alias(f"c{number}_{i}"))
    grouped = tagged.groupBy("_sheet", *keys)
    return grouped.agg(*metrics) if metrics else tagged.select("_sheet", *keys).distinct()


def sheet_of(shared: DataFrame, number: int, spec: SheetSpec) -> DataFrame:
    """One sheet out of the shared pass, as `compile_sheet` gives it."""
    rows = shared.where(F.col("_sheet") == number)
    position = {alias: f"g{number}_{i}" for i, alias in enumerate(spec.group_by)}
    if not spec.group_by:
        # A sheet of bare aggregates has one row whatever it reads; without rows its counts are 0.
        whole = lambda i, c: F.coalesce(F.max(f"c{number}_{i}"), F.lit(0)) if c.fn in COUNTS else F.max(f"c{number}_{i}")
        return rows.agg(*[whole(i, c).alias(f"c{number}_{i}") for i, c in enumerate(spec.columns)]).toDF(*spec.header)
    if spec.sort:
        rows = rows.orderBy(*[F.col(position[s.column]).desc() if s.descending else F.col(position[s.column]).asc() for s in spec.sort])
    return rows.select(*[f"c{number}_{i}" if c.fn else position[c.field] for i, c in enumerate(spec.columns)]).toDF(*spec.header)


@contextmanager
def shared_sheets(
    specs: Sequence[SheetSpec], tables: Tables, version_id: int, registry: Registry = DEFAULT_REGISTRY, settings: Settings = DEFAULT_SETTINGS
) -> Iterator[list[DataFrame]]:
    """The frames of all sheets. Aggregated sheets that read the same source share one pass, whose groups are kept
    until the block ends; detail sheets, lone ones and collated groups are compiled one by one."""
    by_source: dict[str, dict[int, SheetSpec]] = {}
    for number, spec in enumerate(specs):
        if spec.aggregated and settings.text_collation is None:
            by_source.setdefault(spec.source, {})[number] = spec
    frames: dict[int, DataFrame] = {}
    kept = []
    try:
        for name, group in by_source.items():
            if len(group) > 1:
                shared = shared_aggregate(group, registry.sources[name], tables, version_id, settings).persist()
                kept.append(shared)
                frames |= {number: sheet_of(shared, number, spec) for number, spec in group.items()}
        yield [frames[n] if n in frames else compile_sheet(spec, tables, version_id, registry, settings) for n, spec in enumerate(specs)]
    finally:
        for shared in kept:
            shared.unpersist()
