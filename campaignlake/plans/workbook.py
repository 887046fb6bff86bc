"""Workbook output: one directory per sheet plus a manifest, with optional summary sheets."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from itertools import accumulate, chain, count, filterfalse
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from campaignlake.ingest.ledger import (
    CANCELLED,
    COMPLETED,
    FAILED,
    PENDING,
    PROCESSING,
    ExportLedger,
    new_id,
    require_live_versions,
    utc_now,
)
from campaignlake.operators.quality import quality_report
from campaignlake.plans.guards import check_spec
from campaignlake.plans.shared import shared_sheets
from campaignlake.plans.sheet import Tables, sheet_row_count
from campaignlake.plans.spec import TRUE_VALUES, parse_spec
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry
from campaignlake.sources.tables import CampaignStore, HadoopPath

# Sheet names, headers and row labels of the summary sheets.
README = "README"
KPIS = "KPIs"
CONFIGURATION = "Configurazione_Richiesta"
DATA_QUALITY = "Data_Quality"
QUALITY_HEADER = ["Check", "Severity", "Occurrences", "Description"]
LABEL_HEADER, KPI_HEADER, CONFIG_HEADER = ["Label", "Value"], ["Metric", "Value"], ["Parameter", "Value"]
README_LABELS = {
    "Export ID": "export_id", "Version ID": "version_id", "Generated at": "generated", "Format": "format",
    "Sheets included": "sheets",
}
KPI_LABELS = {"Total": "total", "Format": "format", "Generated at": "generated"}
CONFIG_FIELDS = ("source", "columns", "group_by", "metrics", "sort", "filters")
SHEET_LABEL, NAMED_SHEET_LABEL = "Sheet {number} - {field}", "Sheet {number} ({name}) - {field}"
FORBIDDEN_IN_NAME = re.compile(r"[:\\/?*\[\]]")
FALLBACK_NAME = "Sheet"
MAX_NAME = 31
# What each requested format is written as.
WRITERS = {"xlsx": "csv", "csv": "csv", "parquet": "parquet", "json": "json"}


@dataclass(frozen=True)
class Sheet:
    name: str
    header: Sequence[str]
    rows: DataFrame


@dataclass(frozen=True)
class WrittenSheet:
    number: int
    name: str
    path: str
    header: Sequence[str]
    rows: int


def fitted(stem: str, suffix: str = "") -> str:
    """`stem` and suffix within the spreadsheet's bytes; only whole characters of the stem are left out."""
    room = MAX_NAME - len(suffix)
    widths = accumulate(len(character.encode()) for character in stem)
    return stem[: sum(width <= room for width in widths)] + suffix


def unique_sheet_names(names: Sequence[str]) -> list[str]:
    """Names a spreadsheet accepts: no forbidden characters, at most 31 bytes, repeats numbered from 2."""
    given: dict[str, None] = {}
    for name in names:
        stem = fitted(FORBIDDEN_IN_NAME.sub(" ", name).strip()) or FALLBACK_NAME
        spellings = chain([stem], (fitted(stem, f" ({n})") for n in count(2)))
        given[next(filterfalse(given.__contains__, spellings))] = None
    return list(given)


def memory_sheet(
    spark: SparkSession, name: str, header: Sequence[str], rows: Sequence[Sequence[Any]]
) -> Sheet:
    """A few fixed rows as a sheet. Cells are text, NULL stays NULL."""
    columns = [f"c{i}" for i in range(len(header))]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    data = [[None if cell is None else _cell(cell) for cell in row] for row in rows]
    return Sheet(name, list(header), spark.createDataFrame(data, schema).coalesce(1))


def _cell(value: Any) -> str:
    if isinstance(value, bool):
        return "1" if value else ""
    return str(value)


# --- summary sheets -----------------------------------------------------------------------------


def labelled(labels: Mapping[str, str], facts: Mapping[str, Any]) -> list[list[Any]]:
    return [[label, facts[fact]] for label, fact in labels.items()]


def kpi_rows(counts: Sequence[tuple[str, int]], facts: Mapping[str, Any]) -> list[list[Any]]:
    """One row per sheet by position, so two sheets of one name keep both rows."""
    return [list(pair) for pair in counts] + labelled(KPI_LABELS, {**facts, "total": sum(n for _, n in counts)})


def sheet_counts(
    params: Mapping[str, Any],
    tables: Tables,
    version_id: int | None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
    day: Any = None,
) -> DataFrame:
    """Rows of every sheet of a request before it is exported, and their total, as one frame."""
    counts = [
        sheet_row_count(spec, tables, version_id, registry, settings).select(
            *(["version_id"] if version_id is None else []),
            F.lit(number).alias("sheet_no"),
            F.lit(spec.name).alias("metric"),
            "rows",
        )
        for number, spec in enumerate(parse_spec(params, day, registry).sheets, start=1)
    ]
    each = reduce(DataFrame.unionByName, counts)
    lead = [] if version_id is not None else ["version_id"]
    # Every counted row also goes to the total's group, so no sheet is counted twice.
    total = F.struct(F.lit(len(counts) + 1).alias("sheet_no"), F.lit("Total").alias("metric"))
    both = each.select(*lead, "rows", F.explode(F.array(F.struct("sheet_no", "metric"), total)).alias("_at"))
    return both.groupBy(*lead, "_at").agg(F.sum("rows").alias("rows")).select(*lead, "_at.sheet_no", "_at.metric", "rows")


def settings_of(params: Mapping[str, Any]) -> Iterator[tuple[str, Any]]:
    """A request flattened to (label, value): its parameters, and the fields of each of its sheets."""
    for parameter, value in params.items():
        match parameter, value:
            case "format", _:
                continue
            case "sheets", list() | tuple():
                for number, sheet in enumerate(value, start=1):
                    fields = sheet if isinstance(sheet, Mapping) else {}
                    shape = SHEET_LABEL if fields.get("name") is None else NAMED_SHEET_LABEL
                    for field in filter(lambda f: fields.get(f) is not None, CONFIG_FIELDS):
                        yield shape.format(number=number, name=fields.get("name"), field=field), one_line(fields[field])
            case _, str() | int() | float():
                yield parameter, value
            case _:
                yield parameter, json.dumps(value)


def one_line(value: Any, inner: bool = False) -> Any:
    """A value in one cell: lists joined by comma, objects as `key: value`, anything inside them as compact JSON."""
    match value:
        case bool() if inner:
            return _cell(value)
        case str() | int() | float():
            return str(value) if inner else value
        case _ if inner:
            return json.dumps(value, separators=(",", ":"))
        case Mapping():
            return ", ".join(f"{key}: {one_line(part, True)}" for key, part in value.items())
        case list() | tuple():
            return ", ".join(one_line(part, True) for part in value)
    return json.dumps(value)


def configuration_rows(params: Mapping[str, Any]) -> list[list[Any]]:
    """The request as it came, one row per parameter and per sheet field."""
    return [list(pair) for pair in settings_of(params)]


def quality_sheet(tables: Tables, version_id: int) -> Sheet:
    report = quality_report(tables["events"], tables["players"], version_id)
    return Sheet(
        DATA_QUALITY, QUALITY_HEADER, report.select("check", "severity", "occurrences", "description")
    )


# --- sink -----------------------------------------------------------------------------------------


@contextmanager
def data_sheets(
    params: Mapping[str, Any],
    tables: Tables,
    version_id: int,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
    day: Any = None,
) -> Iterator[list[Sheet]]:
    """The sheets of a request, to be written inside the block: aggregated ones of a source share a pass over it."""
    check_spec(params, settings, registry)
    specs = parse_spec(params, day, registry).sheets
    with shared_sheets(specs, tables, version_id, registry, settings) as frames:
        yield [Sheet(spec.name, spec.header, rows) for spec, rows in zip(specs, frames)]


def _writable(rows: DataFrame, kind: str) -> DataFrame:
    """Positional column names, because labels may repeat; NULL cells become empty text in CSV."""
    rows = rows.toDF(*[f"c{i}" for i in range(len(rows.columns))])
    if kind != "csv":
        return rows
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in rows.columns]
    return rows.select(*cells)


def write_sheet(rows: DataFrame, path: str, kind: str) -> int:
    """Write one sheet and return its rows, counted while they are written.

    Part files keep the sheet's order by file name and hold data only; the manifest has the header.
    """
    seen = Observation()
    counted = _writable(rows, kind).observe(seen, F.count(F.lit(1)).alias("rows"))
    writer = counted.write.mode("overwrite")
    if kind == "csv":
        writer.option("emptyValue", "").csv(path)
    else:
        writer.format(kind).save(path)
    return seen.get["rows"]


def write_workbook(
    spark: SparkSession, sheets: Sequence[Sheet], path: str, kind: str = "csv", parallel: int = 4
) -> list[WrittenSheet]:
    """Write every sheet, a few at a time; the cluster shares its slots between them."""
    names = unique_sheet_names([s.name for s in sheets])

    def write(item: tuple[int, Sheet, str]) -> WrittenSheet:
        number, sheet, name = item
        target = f"{path}/{number:02d}_{re.sub(r'[^0-9A-Za-z_-]+', '_', name)}"
        return WrittenSheet(number, name, target, sheet.header, write_sheet(sheet.rows, target, kind))

    items = list(zip(range(1, len(sheets) + 1), sheets, names))
    with ThreadPoolExecutor(max_workers=parallel) as pool:
        return list(pool.map(write, items))


MANIFEST = T.StructType(
    [
        T.StructField("sheet_no", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("header", T.ArrayType(T.StringType())),
        T.StructField("rows", T.LongType()),
    ]
)


def manifest_frame(spark: SparkSession, written: Sequence[WrittenSheet]) -> DataFrame:
    data = [(w.number, w.name, w.path, list(w.header), w.rows) for w in written]
    return spark.createDataFrame(data, MANIFEST).coalesce(1)


def read_sheet(spark: SparkSession, path: str, sheet_no: int) -> DataFrame:
    """A written CSV sheet with its header."""
    entry = spark.read.schema(MANIFEST).json(f"{path}/manifest").where(F.col("sheet_no") == sheet_no).first()
    columns = ", ".join(f"c{i} STRING" for i in range(len(entry["header"])))
    return spark.read.schema(columns).csv(entry["path"]).toDF(*entry["header"])


def export_workbook(
    spark: SparkSession,
    params: Mapping[str, Any],
    tables: Tables,
    version_id: int,
    path: str,
    export_id: str | None = None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
    now: datetime | None = None,
) -> list[WrittenSheet]:
    """Spec to workbook directory. A rerun with the same path replaces the former output.

    Data sheets are written first, because the KPI sheet reports the rows that were written; the
    sheet numbers keep the reading order: README, KPIs, configuration, data sheets, data quality.
    """
    export_id, now = export_id or new_id(), now or utc_now()
    fmt = str(params.get("format") or "xlsx")
    with data_sheets(params, tables, version_id, registry, settings, now.date()) as data:
        HadoopPath(spark, path).delete()
        if params.get("include_summary") not in TRUE_VALUES:
            written = write_workbook(spark, data, path, WRITERS[fmt])
        else:
            written = _with_summary(spark, data, params, tables, version_id, path, export_id, fmt, now)
    manifest_frame(spark, written).write.mode("overwrite").json(f"{path}/manifest")
    return written


def _with_summary(
    spark: SparkSession,
    data: Sequence[Sheet],
    params: Mapping[str, Any],
    tables: Tables,
    version_id: int,
    path: str,
    export_id: str,
    fmt: str,
    now: datetime,
) -> list[WrittenSheet]:
    body = write_workbook(spark, [*data, quality_sheet(tables, version_id)], f"{path}/data", WRITERS[fmt])
    counts = [(sheet.name, done.rows) for sheet, done in zip(data, body)]
    facts = {
        "export_id": export_id, "version_id": version_id, "format": fmt, "generated": now.isoformat(),
        "sheets": ", ".join(name for name, _ in counts),
    }
    front = [
        memory_sheet(spark, README, LABEL_HEADER, labelled(README_LABELS, facts)),
        memory_sheet(spark, KPIS, KPI_HEADER, kpi_rows(counts, facts)),
        memory_sheet(spark, CONFIGURATION, CONFIG_HEADER, configuration_rows(params)),
    ]
    head = write_workbook(spark, front, f"{path}/summary", WRITERS[fmt])
    names = unique_sheet_names([w.name for w in front] + [s.name for s in data] + [DATA_QUALITY])
    return [
        WrittenSheet(number, name, w.path, w.header, w.rows)
        for number, (name, w) in enumerate(zip(names, [*head, *body]), start=1)
    ]


def export_directory(store: CampaignStore, export_id: str) -> str:
    return store.path(f"exports/{export_id}")


def run_export(
    store: CampaignStore,
    params: Mapping[str, Any],
    version_id: int,
    export_id: str | None = None,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
) -> str:
    """Check, export and record in the ledger; returns the export id.

    A completed or cancelled export is not run again; a failed one may be.
    """
    check_spec(params, settings, registry)
    if settings.check_versions:
        require_live_versions(store, [version_id])
    export_id, ledger = export_id or new_id(), ExportLedger(store)
    before = ledger.state(export_id)
    if before is not None and before["status"] in (COMPLETED, CANCELLED):
        return export_id
    created = before["created_at"] if before else utc_now()
    entry = {
        "version_id": version_id,
        "params": json.dumps(dict(params)),
        "format": str(params.get("format") or "xlsx"),
        "created_at": created,
        "attempts": (before["attempts"] or 0) if before else 0,
    }
    if before is None:
        ledger.write(export_id, status=PENDING, progress=0, **entry)
    entry["attempts"] += 1
    entry["started_at"] = utc_now()
    ledger.write(export_id, status=PROCESSING, progress=0, **entry)
    path = export_directory(store, export_id)
    try:
        written = export_workbook(
            store.spark, params, store.tables([version_id]), version_id, path, export_id, registry, settings
        )
    except Exception as error:
        ledger.write(
            export_id, status=FAILED, error_message=str(error), completed_at=utc_now(), **entry
        )
        raise
    total = sum(w.rows for w in written)
    ledger.write(
        export_id, status=COMPLETED, progress=100, total_rows=total, processed_rows=total, file_path=path,
        file_size=HadoopPath(store.spark, path).size(), completed_at=utc_now(), **entry,
    )
    return export_id


def cancel_export(store: CampaignStore, export_id: str) -> bool:
    """Cancel an export that has not started: only a pending one changes state."""
    ledger = ExportLedger(store)
    state = ledger.state(export_id)
    if state is None or state["status"] != PENDING:
        return False
    kept = {k: v for k, v in state.items() if k not in ("export_id", "seq", "status", "completed_at")}
    ledger.write(export_id, status=CANCELLED, completed_at=utc_now(), **kept)
    HadoopPath(store.spark, export_directory(store, export_id)).delete()
    return True
