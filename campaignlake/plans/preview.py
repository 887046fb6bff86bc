"""Synchronous reads: sheet preview and player pages. Every one is a bounded top-k."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from campaignlake.functions.normalize import iso8601
from campaignlake.plans.guards import check_spec
from campaignlake.plans.shared import shared_sheets
from campaignlake.plans.sheet import Tables, filtered_source
from campaignlake.plans.spec import SheetSpec, parse_spec
from campaignlake.settings import DEFAULT_SETTINGS, Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY, Registry

# Page size limits of the player listing.
DEFAULT_PAGE, MAX_PAGE = 50, 200


def preview_frame(sheet: DataFrame, limit: int) -> DataFrame:
    """One row more than shown, which is all that proves truncation."""
    return sheet.limit(limit + 1)


def preview(
    params: Mapping[str, Any],
    tables: Tables,
    version_id: int,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
    day: date | str | None = None,
) -> list[dict[str, Any]]:
    """First rows of every sheet, keyed by header; a repeated label keeps its last value."""
    check_spec(params, settings, registry)
    specs, shown = parse_spec(params, day, registry).sheets, []
    with shared_sheets(specs, tables, version_id, registry, settings) as sheets:
        for spec, sheet in zip(specs, sheets):
            rows = preview_frame(sheet, settings.preview_rows).collect()
            shown.append(
                {
                    "name": spec.name,
                    "header": spec.header,
                    "rows": [dict(zip(spec.header, row)) for row in rows[: settings.preview_rows]],
                    "truncated": len(rows) > settings.preview_rows,
                }
            )
    return shown


def sheet_page(
    spec: SheetSpec,
    tables: Tables,
    version_id: int,
    after: int | None = None,
    size: int = 1000,
    registry: Registry = DEFAULT_REGISTRY,
    settings: Settings = DEFAULT_SETTINGS,
) -> DataFrame:
    """Next `size` rows of an unsorted detail sheet after a known key, with that key as `_key`.

    For readers that page through a sheet; a bulk read or an export needs no paging.
    """
    if spec.aggregated or spec.sort:
        raise ValueError("only unsorted detail sheets can be paged by key")
    source = registry.sources[spec.source]
    rows = filtered_source(spec, source, tables, version_id, settings)
    if after is not None:
        rows = rows.where(F.col(source.key) > after)
    picked = [F.col(source.fields[c.field]).alias(f"c{i}") for i, c in enumerate(spec.columns)]
    page = rows.orderBy(source.key).select(F.col(source.key).alias("_key"), *picked).limit(size)
    return page.toDF("_key", *spec.header)


def player_listing(players: DataFrame, users: DataFrame, version_id: int | None) -> DataFrame:
    """Public view of a version's players; a player without a user keeps a NULL e-mail."""
    scoped = players if version_id is None else players.where(F.col("version_id") == version_id)
    email = users.select(F.col("id").alias("user_id"), "email")
    lead = ["version_id"] if version_id is None else []
    return scoped.join(email, "user_id", "left").select(
        *lead,
        F.col("id"),
        "email",
        iso8601(F.col("registered_at")).alias("registered_at"),
        "total_score",
        "language",
    )


def checked_page_size(per_page: int) -> int:
    if not 1 <= per_page <= MAX_PAGE:
        raise ValueError(f"a page holds 1 to {MAX_PAGE} rows, not {per_page}")
    return per_page


def player_page(
    players: DataFrame, users: DataFrame, version_id: int, page: int = 1, per_page: int = DEFAULT_PAGE
) -> DataFrame:
    """Offset page, ordered by id. The page is cut before the e-mail join."""
    size = checked_page_size(per_page)
    ids = (
        players.where(F.col("version_id") == version_id)
        .orderBy("id")
        .offset((max(page, 1) - 1) * size)
        .limit(size)
    )
    return player_listing(ids, users, version_id).orderBy("id")


def player_count(players: DataFrame, version_id: int) -> DataFrame:
    """Total behind the pages, as one row."""
    return players.where(F.col("version_id") == version_id).agg(F.count(F.lit(1)).alias("total"))


def player_keyset_page(
    players: DataFrame, users: DataFrame, version_id: int, after_id: int, per_page: int = DEFAULT_PAGE
) -> DataFrame:
    """Next page after a known id; the id filter reaches the scan, so no page gets slower."""
    ids = (
        players.where((F.col("version_id") == version_id) & (F.col("id") > after_id))
        .orderBy("id")
        .limit(checked_page_size(per_page))
    )
    return player_listing(ids, users, version_id).orderBy("id")
