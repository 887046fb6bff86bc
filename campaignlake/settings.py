"""Tunable limits and compatibility switches."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    # Most rows of one request document; None sets no limit. It never applies to a whole load of documents.
    max_batch_rows: int | None = None
    # Imports and exports name versions that exist and are not soft-deleted.
    check_versions: bool = True
    # An import of events adds the scores of the new ones to their players' total_score.
    maintain_scores: bool = True
    # Relative error that distinct counts of sheets may have; None counts exactly.
    approx_distinct: float | None = None
    # The published defaults of the limits below.
    chunk_size: int = 1000
    max_sheets: int = 10
    max_sheet_name: int = 31
    preview_rows: int = 100

    # `sum` keeps cents by default; True truncates every sum to a whole number.
    compat_int_sum: bool = False
    # A date-only upper bound means midnight by default; True extends it to the whole day.
    inclusive_end_day: bool = False
    # Collation for text filters and grouping, e.g. "UNICODE_CI_AI"; None compares bytes.
    text_collation: str | None = None


DEFAULT_SETTINGS = Settings()
