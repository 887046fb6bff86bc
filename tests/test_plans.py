"""Physical plans: what is pushed down, what is shuffled, and how hot keys are treated."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

from campaignlake.ingest import jobs
from campaignlake.operators.dedup import new_rows
from campaignlake.operators.quality import quality_counts
from campaignlake.operators.resolve import resolve_players
from campaignlake.plans.sheet import compile_sheet
from campaignlake.plans.spec import parse_spec
from suite import standins as st

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def conf(spark):
    """Set session settings for one test."""
    before = {}

    def put(**values):
        for key, value in values.items():
            name = "spark.sql." + key.replace("__", ".")
            before.setdefault(name, spark.conf.get(name, None))
            spark.conf.set(name, value)

    yield put
    for name, value in before.items():
        spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "events")
    st.table(spark, SF, "events").withColumns(
        {"payload_language": F.lit("it"), "payload_utm_source": F.lit("x"), "payload_score": F.lit(1)}
    ).write.partitionBy("version_id").parquet(path)
    tables = {"events": spark.read.parquet(path)}
    spec = parse_spec(
        {"date_from": "2024-01-10",
         "sheets": [{"source": "events", "group_by": ["language"], "metrics": ["count"], "filters": {"type": "click"}}]}
    ).sheets[0]
    text = plan(compile_sheet(spec, tables, 1))
    assert "isnotnull(version_id" in text and re.search(r"PartitionFilters: \[.*version_id.* = 1", text)
    assert "In(type" in text or "EqualTo(type,click)" in text
    assert "GreaterThanOrEqual(occurred_at" in text
    assert "payload:" not in text.split("ReadSchema")[1].split("\n")[0]


def test_preview_of_a_sorted_sheet_is_a_top_k(spark):
    spec = parse_spec({"sheets": [{"source": "events", "sort": ["score:desc"]}]}).sheets[0]
    text = plan(compile_sheet(spec, st.tables(spark, SF), 1).limit(101))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


def test_new_rows_shuffles_the_batch_once_and_cuts_hot_keys_before(spark, conf):
    conf(autoBroadcastJoinThreshold="-1", adaptive__enabled="false")
    batch = jobs.event_candidates(st.event_batch(spark, SF)).drop("player_email")
    text = plan(new_rows(batch, st.stored_keys(spark, SF)))
    wide = [line for line in text.splitlines() if line.startswith("Arguments: hashpartitioning(version_id")]
    # The batch, the stored keys and the batch's own keys (partial distinct first): no second pass
    # over the wide rows, because the collapse and the anti-join share their clustering.
    assert len(wide) <= 4
    tree = text.split("\n\n")[0]
    anti = tree[tree.index("LeftAnti"):]
    window, limit = anti.index("Window ("), anti.index("WindowGroupLimit")
    assert window < limit < anti.index("Exchange")


def test_no_python_in_the_plans(spark):
    batch = jobs.event_candidates(st.event_batch(spark, SF))
    known = jobs.resolved_rows(batch, st.table(spark, SF, "players"), st.table(spark, SF, "users"))
    text = plan(new_rows(known, st.stored_keys(spark, SF), wanted=batch))
    assert "Python" not in text and "CartesianProduct" not in text and "NestedLoop" not in text


def test_a_small_batch_filters_big_tables_without_shuffling_them(spark):
    batch = jobs.event_candidates(st.event_batch(spark, SF).limit(20))
    text = final_plan(new_rows(batch, st.stored_keys(spark, SF)))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text.split("Initial Plan")[0]


HOT = dict(
    autoBroadcastJoinThreshold="-1",
    adaptive__autoBroadcastJoinThreshold="-1",
    adaptive__skewJoin__skewedPartitionThresholdInBytes="8k",
    adaptive__skewJoin__skewedPartitionFactor="1.5",
    adaptive__advisoryPartitionSizeInBytes="8k",
    shuffle__partitions="16",
)


def hot_events(spark):
    """Forty per cent of the events belong to player 7."""
    events = spark.range(0, 60000, 1, 8).select(
        F.col("id"), F.lit(1).cast("bigint").alias("version_id"),
        F.when(F.col("id") % 5 < 2, 7).otherwise(F.col("id") % 500).cast("bigint").alias("player_id"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(hours=(F.col("id") % 48).cast("int"))).alias("occurred_at"),
        F.lit("[]").alias("payload"),
    )
    return events


def test_hot_player_is_split_in_the_quality_join(spark, conf):
    conf(**HOT)
    players = spark.range(500).select(
        "id", F.lit(1).cast("bigint").alias("version_id"), F.lit("2024-01-02").cast("timestamp").alias("registered_at")
    )
    counted = quality_counts(hot_events(spark), players)
    assert "skew=true" in final_plan(counted)
    row = counted.first()
    assert (row.missing_language, row.empty_payload, row.invalid_event_order) == (60000, 60000, 30000)


def test_hot_player_is_looked_up_once_and_split_in_the_join_back(spark, conf):
    conf(**HOT)
    batch = hot_events(spark).withColumns({"player_email": F.lit(None).cast("string"), "ord": F.col("id")})
    players = spark.range(400).select("id", F.lit(1).cast("bigint").alias("version_id"), F.col("id").alias("user_id"))
    users = spark.range(400).select("id", F.concat(F.lit("u"), "id").alias("email"))
    resolved = resolve_players(batch, players, users)
    assert "skew=true" in final_plan(resolved)
    assert resolved.count() == 60000
    missing = batch.where("player_id >= 400").count()
    assert resolved.where("resolved_id is null").count() == missing
