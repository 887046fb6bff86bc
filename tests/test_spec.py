"""Spec parsing and guards; no Spark job runs here."""

from __future__ import annotations

import pytest

from campaignlake.plans.guards import check_spec
from campaignlake.sources.registry import JoinDef
from campaignlake.plans.spec import SortKey, SpecError, parse_spec, sort_entry, source_of
from campaignlake.plans.workbook import README_LABELS, configuration_rows, kpi_rows, labelled, unique_sheet_names


def one(sheet, **params):
    return parse_spec({"sheets": [sheet], **params}, "2026-07-01").sheets[0]


def test_source_resolution():
    assert source_of({"source": "answers", "name": "players"}) == "answers"
    assert source_of({"name": "players"}) == "players"
    assert source_of({"name": "events_summary"}) == "events"
    # The name map is case-sensitive.
    with pytest.warns(UserWarning, match="case-sensitive"):
        assert source_of({"name": "Players"}) == "events"
    assert source_of({}) == "events"


def test_metrics_and_dims_become_columns_and_dates_become_filters():
    sheet = one(
        {"source": "transactions", "group_by": ["currency", "status"], "metrics": ["sum_amount"]},
        date_from="2025-03-09", date_to="2025-11-30",
    )
    assert sheet.header == ["currency", "status", "sum_amount"]
    assert sheet.group_by == ("currency", "status")
    assert sheet.filters == {"occurred_from": "2025-03-09", "occurred_to": "2025-11-30"}
    assert sheet.aggregated


def test_own_dates_win_and_players_take_no_dates():
    own = one({"source": "events", "filters": {"occurred_from": "2026-02-01"}}, date_from="2026-01-01")
    assert own.filters == {"occurred_from": "2026-02-01"}
    assert one({"source": "players"}, date_from="2026-01-01").filters == {}


def test_defaults_labels_and_names():
    assert one({"source": "players"}).header == ["player_id", "email", "registered_at", "total_score"]
    assert one({"source": "events"}).name == "2026-07-01 — Foglio 1"
    fallback = parse_spec({"date_from": "2026-01-01"}, "2026-07-01").sheets
    assert [s.name for s in fallback] == ["Events"] and fallback[0].filters == {}
    labels = one({"source": "events", "columns": [{"fn": "count"}, {"fn": "avg", "field": "payload.score"},
                                                  {"fn": "max", "field": "score", "as": "top"}]}).header
    assert labels == ["count_all", "avg_score", "top"]
    assert one({"source": "events", "columns": [{"field": "id", "as": "ID"}]}).header == ["ID"]


def test_sort_forms():
    assert sort_entry("score:DESC") == ("score", "desc")
    assert sort_entry({"column": "payload.score"}) == ("score", "asc")
    sheet = one({"source": "events", "sort": ["score:down", {"direction": "desc"}, "id"]})
    assert sheet.sort == (SortKey("score"), SortKey("id"))


INVALID = {
    "source that is none": {"source": "weather"},
    "column of another source": {"source": "players", "columns": ["amount"]},
    "average of a text": {"source": "transactions", "columns": [{"fn": "avg", "field": "currency"}]},
    "function that is none": {"source": "transactions", "columns": [{"fn": "mode", "field": "amount"}]},
    "metric that is none": {"source": "answers", "metrics": ["hit_rate"], "group_by": ["question_id"]},
    "metric without its field": {"source": "answers", "metrics": ["sum_amount"]},
    "filter of another source": {"source": "players", "filters": {"currency": "EUR"}},
    "date that is none": {"source": "transactions", "filters": {"occurred_to": "31/31/31"}},
    "sort by what is not there": {"source": "players", "sort": ["amount"]},
    "sort upside": {"source": "players", "sort": [{"column": "total_score", "direction": "upside"}]},
    "plain column beside the groups": {"source": "transactions", "columns": ["status", {"fn": "count"}], "group_by": ["currency"]},
    "plain column beside a sum": {"source": "transactions", "columns": ["status", {"fn": "sum", "field": "amount"}]},
    "group that is none": {"source": "answers", "group_by": ["mood"]},
    "sort by an ungrouped field": {"source": "transactions", "group_by": ["currency"], "sort": ["amount"]},
    "name of 40 letters": {"source": "players", "name": "leaderboard" * 4},
    "text for a list": {"source": "players", "columns": "email"},
}


@pytest.mark.parametrize("sheet", INVALID.values(), ids=INVALID.keys())
def test_guards_reject(sheet):
    with pytest.raises(SpecError):
        check_spec({"sheets": [sheet]})


@pytest.mark.parametrize(
    "params",
    [{"format": "pdf"}, {"date_from": "x"}, {"sheets": [{}] * 11}, {"sheets": "events"},
     {"include_summary": "perhaps"}],
    ids=["format", "date", "too many sheets", "sheets not a list", "summary"],
)
def test_guards_reject_requests(params):
    with pytest.raises(SpecError):
        check_spec(params)


def test_guards_report_every_finding():
    with pytest.raises(SpecError) as caught:
        check_spec({"sheets": [{"source": "events", "columns": ["a", "b"], "sort": ["c"]}]})
    assert len(caught.value.errors["sheets.0.columns"]) == 2 and "sheets.0.sort" in caught.value.errors


def test_guards_accept_a_request_over_all_sources():
    check_spec(
        {
            "date_from": "2025-03-09", "include_summary": True,
            "sheets": [
                {"source": "players", "sort": [{"column": "registered_at"}], "columns": [{"field": "email", "as": "Mail"}]},
                {"source": "transactions", "group_by": ["currency"], "columns": ["currency", {"fn": "max", "field": "amount"}]},
                {"source": "answers", "name": "Replies"},
                {"source": "events", "filters": {"type": ["opened", "closed"]}},
            ],
        }
    )


def test_sheet_names():
    assert unique_sheet_names(["Events", "Events", "Events"]) == ["Events", "Events (2)", "Events (3)"]
    assert unique_sheet_names(["a/b:c", "", "[]", "x" * 40, "x" * 40]) == [
        "a b c", "Sheet", "Sheet (2)", "x" * 31, "x" * 27 + " (2)",
    ]
    assert len(unique_sheet_names(["à" * 20])[0].encode()) <= 31


def test_summary_rows():
    facts = {"export_id": "e1", "version_id": 3, "format": "csv", "generated": "now", "sheets": "A, B"}
    assert labelled(README_LABELS, facts)[-1] == ["Sheets included", "A, B"]
    assert kpi_rows([("A", 2), ("A", 3)], facts) == [["A", 2], ["A", 3], ["Total", 5], ["Format", "csv"], ["Generated at", "now"]]
    rows = configuration_rows(
        {"date_to": None, "format": "csv", "include_summary": False, "sheets": [
            {"filters": {"status": ["open", "done"], "level": 2, "old": True}, "sort": ["level:desc", {"column": "id"}]}, "no sheet",
            {"name": "Late", "source": "players"}]}
    )
    assert rows == [
        ["date_to", "null"],
        ["include_summary", False],
        ["Sheet 1 - sort", 'level:desc, {"column":"id"}'],
        ["Sheet 1 - filters", 'status: ["open","done"], level: 2, old: 1'],
        ["Sheet 3 (Late) - source", "players"],
    ]


def test_summary_flag():
    assert [parse_spec({"include_summary": v}).include_summary for v in (True, "1", 0, "0", None)] == [
        True, True, False, False, False,
    ]



def test_joins_need_an_equality():
    with pytest.raises(ValueError, match="equality"):
        JoinDef("users", "u", (("u.id", "<", "players.user_id"),))
