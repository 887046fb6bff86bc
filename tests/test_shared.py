"""Aggregated sheets of one source in one pass over it."""

from __future__ import annotations

import random
import re

from suite import standins as st
from suite.layout import FIVE_SHEETS

from campaignlake.plans.preview import preview
from campaignlake.plans.shared import shared_aggregate, shared_sheets, sheet_of
from campaignlake.plans.sheet import compile_sheet
from campaignlake.plans.spec import parse_spec
from campaignlake.settings import Settings
from campaignlake.sources.registry import DEFAULT_REGISTRY

SMALL = "/root/testdata/sf0.001"


def cells(frame):
    return frame.columns, sorted((tuple(r) for r in frame.collect()), key=str)


def random_request(rnd):
    sheets = []
    for number in range(rnd.randint(2, 6)):
        source = rnd.choice(["events", "events", "transactions"])
        known = DEFAULT_REGISTRY.sources[source]
        groups = rnd.sample([f for f in known.fields if f in ("type", "language", "status", "currency", "score")], rnd.randint(0, 2))
        metrics = [
            {"fn": fn, **({} if field == "*" else {"field": field}), "as": f"m{i}"}
            for i, (fn, field) in enumerate(rnd.sample([(fn, f) for fn, fields in known.aggregatable.items() for f in fields], rnd.randint(1, 3)))
        ]
        filters = {"type": rnd.sample(["click", "view", "spend", "purchase", "none"], 2)} if rnd.random() < 0.6 else {}
        sheets.append({"name": f"s{number}", "source": source, "group_by": groups, "columns": [*groups, *metrics], "filters": filters})
    sheets.append({"name": "detail", "source": "events", "columns": ["id", "type"], "filters": {"type": ["click"]}})
    return {"sheets": sheets}


def test_shared_sheets_equal_those_compiled_alone(spark):
    tables = st.tables(spark, SMALL)
    for seed in range(6):
        specs = parse_spec(random_request(random.Random(seed))).sheets
        with shared_sheets(specs, tables, 1) as frames:
            for spec, frame in zip(specs, frames, strict=True):
                assert cells(frame) == cells(compile_sheet(spec, tables, 1)), (seed, spec)
    spec = parse_spec(FIVE_SHEETS).sheets
    with shared_sheets(spec, tables, 1, settings=Settings(text_collation="UNICODE_CI_AI")) as frames:
        assert not any("_sheet" in f._jdf.queryExecution().toString() for f in frames)


def test_five_sheets_read_their_source_once(spark):
    tables = st.tables(spark, SMALL)
    specs = dict(enumerate(parse_spec(FIVE_SHEETS).sheets))
    shared = shared_aggregate(specs, DEFAULT_REGISTRY.sources["events"], tables, 1)
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Scan parquet", plan)) == 1
    # Rows are repeated below the partial aggregation, so the groups and not the rows are shuffled.
    assert plan.index("Exchange") < plan.index("Generate explode") < plan.index("Scan parquet")
    shared.persist()
    try:
        for number, spec in specs.items():
            alone = sheet_of(shared, number, spec)._jdf.queryExecution().executedPlan().toString()
            assert "InMemoryTableScan" in alone
    finally:
        shared.unpersist()
    before = spark._jsc.getPersistentRDDs().size()
    assert len(preview(FIVE_SHEETS, tables, 1)) == 5 and spark._jsc.getPersistentRDDs().size() == before
