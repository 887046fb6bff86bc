"""Import and export ledgers: append-only state rows, the newest per job wins."""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake import schemas
from campaignlake.sources.tables import CampaignStore, latest, live_versions

# Job states.
PENDING, PROCESSING, COMPLETED, FAILED, CANCELLED = (
    "pending", "processing", "completed", "failed", "cancelled"
)


def utc_now() -> datetime:
    """Wall clock, whole seconds, evaluated once per job on the driver."""
    return datetime.now(timezone.utc).replace(microsecond=0)


def new_id() -> str:
    return str(uuid.uuid4())


class Ledger:
    def __init__(self, store: CampaignStore, table: str, key: str):
        self.store, self.table, self.key = store, table, key

    def write(self, job_id: str, **values: Any) -> None:
        schema = schemas.TABLES[self.table]
        row = {**values, self.key: job_id, "seq": time.time_ns()}
        data = [tuple(row.get(name) for name in schema.fieldNames())]
        self.store.append(self.store.spark.createDataFrame(data, schema).coalesce(1), self.table)

    def state(self, job_id: str) -> dict[str, Any] | None:
        found = latest(self.store.read(self.table).where(F.col(self.key) == job_id), self.key).first()
        return found.asDict() if found else None


class ImportLedger(Ledger):
    def __init__(self, store: CampaignStore):
        super().__init__(store, "import_log", "import_id")

    def last_ids(self) -> dict[str, int]:
        """Highest id per table that any import reserved, whatever became of it."""
        entries = self.store.read(self.table).select(F.explode("last_ids").alias("table", "last"))
        return {r["table"]: r["last"] for r in entries.groupBy("table").agg(F.max("last").alias("last")).collect()}

    def first_ids(self, tables: Iterable[str]) -> dict[str, int]:
        """First id per table that no import has reserved; a table is only scanned when no import
        has reserved an id of it yet."""
        known = self.last_ids()
        scanned = lambda table: self.store.read(table).agg(F.max("id")).first()[0] or 0
        return {table: (known[table] if table in known else scanned(table)) + 1 for table in tables}

    def unfinished(self) -> list[dict[str, Any]]:
        """Imports that a driver began and neither completed nor recorded as failed."""
        log = latest(self.store.read(self.table), self.key)
        return [r.asDict() for r in log.where(F.col("status") == PROCESSING).collect()]


class ExportLedger(Ledger):
    def __init__(self, store: CampaignStore):
        super().__init__(store, "export_log", "export_id")


def export_timings(log: DataFrame) -> DataFrame:
    """Newest export states with queue latency and duration in seconds."""
    return latest(log, "export_id").withColumns(
        {
            "queue_seconds": F.expr("timestampdiff(SECOND, created_at, started_at)"),
            "duration_seconds": F.expr("timestampdiff(SECOND, started_at, completed_at)"),
        }
    )


def version_row(attributes: dict[str, Any], version_id: int, now: datetime) -> tuple:
    """A new version: generated uuid, status `draft` unless given."""
    row = {
        **attributes,
        "id": version_id,
        "uuid": attributes.get("uuid") or new_id(),
        "status": attributes.get("status") or "draft",
        "created_at": now,
        "updated_at": now,
    }
    return tuple(row.get(name) for name in schemas.VERSIONS.fieldNames())


class UnknownVersion(ValueError):
    """A batch or export names a version that does not exist or is soft-deleted."""


def require_live_versions(store: CampaignStore, versions: Iterable[int | None]) -> None:
    """Refuse versions that are not there or soft-deleted. The versions table is a small dimension."""
    live = {r["id"] for r in live_versions(store.read("versions")).select("id").collect()}
    if unknown := sorted({str(v) for v in versions if v not in live}):
        raise UnknownVersion(f"no live version {', '.join(unknown)}")


def create_version(store: CampaignStore, attributes: dict[str, Any]) -> int:
    """Append a version and return its id. The versions table is a small dimension."""
    with store.lock:
        last = store.read("versions").agg(F.max("id")).first()[0]
        version_id = (last or 0) + 1
        row = version_row(attributes, version_id, utc_now())
        store.append(store.spark.createDataFrame([row], schemas.VERSIONS).coalesce(1), "versions")
        return version_id
