"""The physical plans that carry the scale: what shuffles, what is limited before, what is pruned."""

import re
import warnings
from datetime import date

import pytest
from pyspark.sql import functions as F

from trailpack.operators.histories import (
    EARLY_LIMIT,
    build_histories_for_impressions,
    customer_timelines,
    newest_per_day,

    packed_histories,
)
from trailpack.operators.asked import of_asked_customers
from trailpack.operators.impressions import normalize_impressions, slice_impressions_last_n_days
from trailpack.plans.testbed import event_feeds
from trailpack.operators.actions import build_actions_union
from trailpack.plans.training import build_training_inputs

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def histories(spark, n=10):
    feeds = event_feeds(spark, SF)
    actions = build_actions_union(feeds["clicks"], feeds["atc"], feeds["orders"])
    return packed_histories(
        actions, normalize_impressions(feeds["impressions"]), max_actions=n, lookback_days=7
    )


def test_limit_runs_before_the_first_shuffle(spark, no_broadcast):
    text = plan(histories(spark, 1000))
    final, partial = text.index("Final"), text.index("Partial")
    assert final < text.index("hashpartitioning(customer_id", final) < partial


def test_long_histories_warn_until_the_setting_allows_them(spark):
    before = spark.conf.get(EARLY_LIMIT)
    with pytest.warns(UserWarning, match="windowGroupLimitThreshold"):
        assert "Partial" not in plan(histories(spark, 1001))
    spark.conf.set(EARLY_LIMIT, "1001")
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            assert "Partial" in plan(histories(spark, 1001))
    finally:
        spark.conf.set(EARLY_LIMIT, before)


def test_history_shuffles_and_sorts(spark, no_broadcast):
    text = plan(histories(spark))
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", text)
    kinds = {re.sub(r"#\d+L?", "", e) for e in exchanges}
    # By (customer, day, salt), by customer, and the distinct contexts; the map of asked customers moves no actions.
    assert {k for k in kinds if "customer_id" in k} == {"customer_id, day, salt", "customer_id", "as_of_date, customer_id"}
    customer_stage = text[: text.index("REPARTITION_BY_COL")]
    assert len(re.findall(r"\bSort \[", customer_stage)) == 1
    assert "Join" not in text and "CartesianProduct" not in text


def test_packing_streams_over_sorted_customers_in_the_job(spark, no_broadcast):
    setting = "spark.sql.execution.useObjectHashAggregateExec"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")
    try:
        text = plan(histories(spark))
    finally:
        spark.conf.set(setting, before)
    customer_stage = text[: text.index("REPARTITION_BY_COL")]
    assert "SortAggregate" in customer_stage
    assert len(re.findall(r"\bSort \[", customer_stage)) == 1


def test_no_nested_loops_in_the_whole_plan(spark, no_broadcast):
    feeds = event_feeds(spark, SF)
    impressions = slice_impressions_last_n_days(feeds["impressions"], 14)
    out = build_training_inputs(impressions, feeds["clicks"], feeds["atc"], feeds["orders"])
    text = plan(out)
    assert "NestedLoop" not in text and "Cartesian" not in text and "Python" not in text
    assert text.count("SortMergeJoin") == 1


def test_bounds_reach_a_typed_scan(spark, tmp_path):
    path = str(tmp_path / "actions")
    feeds = event_feeds(spark, SF)
    build_actions_union(feeds["clicks"], feeds["atc"], feeds["orders"]).write.parquet(path)
    contexts = normalize_impressions(feeds["impressions"])
    given = (date(2024, 1, 10), date(2024, 1, 20))
    out = build_histories_for_impressions(
        spark.read.parquet(path), contexts, max_actions=5, lookback_days=3, as_of_range=given
    )
    pushed = re.search(r"PushedFilters: \[([^\]]*occurred_at[^\]]*)\]", plan(out)).group(1)
    assert "GreaterThanOrEqual(occurred_at,2024-01-07" in pushed
    assert "LessThan(occurred_at,2024-01-20" in pushed
    columns = re.search(r"ReadSchema: (struct<[^>]*occurred_at[^>]*>)", plan(out)).group(1)
    assert "source" not in columns and "action_date" not in columns


def test_contexts_read_two_columns(spark, tmp_path):
    path = str(tmp_path / "impressions")
    feeds = event_feeds(spark, SF)
    normalize_impressions(feeds["impressions"]).write.parquet(path)
    out = build_training_inputs(
        spark.read.parquet(path), feeds["clicks"], feeds["atc"], feeds["orders"], max_actions=5
    )
    schemas = re.findall(r"ReadSchema: (struct<as_of_date[^\n]*)", plan(out))
    wide = [x for x in schemas if "impressions" in x]
    assert len(wide) == 1  # the join side; contexts and day bounds read keys only
    # The day bounds and the number of asked customers come from one pass.
    assert set(schemas) - set(wide) == {"struct<as_of_date:date,customer_id:bigint>"}


def test_hot_context_is_split_by_aqe(spark, no_broadcast):
    """A (day, customer) with most impression rows: AQE splits its join partition."""
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10KB",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    hot = spark.range(0, 60_000, 1, 8).select(
        F.lit("2025-08-15").alias("dt"),
        F.col("id").cast("string").alias("ranking_id"),
        F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(F.lit(7)).alias("customer_id"),
        F.expr("array(named_struct('item_id', int(id), 'is_order', true))").alias("impressions"),
    )
    feeds = event_feeds(spark, SF)
    out = build_training_inputs(
        hot, feeds["clicks"], feeds["atc"], feeds["orders"], max_actions=3, lookback_days=600
    )
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        execution = out.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"), F.max("actions").alias("a"))
        rows = {r.customer_id: (r.n, r.a) for r in execution.where("customer_id < 10").collect()}
        assert rows[7][0] == 40_000 and any(rows[7][1])
        collected = out.select("customer_id", "ranking_id", "actions")
        collected.collect()
        assert "SortMergeJoin(skew=true)" in plan(collected)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_only_actions_of_asked_customers_are_shuffled(spark):
    """20 of 20 000 customers are asked for: their actions alone pass the map of asked customers."""
    day = date(2025, 8, 15)
    actions = spark.range(200_000).select(
        (F.col("id") % 20_000).alias("customer_id"),
        F.col("id").cast("int").alias("item_id"),
        F.lit("2025-08-14 10:00:00").cast("timestamp").alias("occurred_at"),
        F.lit(1).alias("action_type"),
        F.lit("clicks").alias("source"),
        F.lit("2025-08-14").cast("date").alias("action_date"),
    )
    contexts = spark.range(20).select(F.lit(day).alias("as_of_date"), (F.col("id") * 1000).alias("customer_id"))
    kept = of_asked_customers(actions, contexts)
    assert 200 <= kept.count() < 400
    assert "Join" not in plan(kept).split("Subquery")[0]
    built = packed_histories(actions, contexts, max_actions=6, lookback_days=7)
    assert sorted(r.customer_id for r in built.where("size(actions) = 6").collect()) == [1000 * i for i in range(20)]


def test_a_customer_gathers_at_most_n_entries_per_day_asked_for(spark):
    actions = spark.range(5000).select(
        F.lit(1).cast("bigint").alias("customer_id"),
        F.col("id").cast("int").alias("item_id"),
        (F.lit("2025-08-14").cast("timestamp") - F.make_dt_interval(F.col("id") % 300)).alias("occurred_at"),
        F.lit(1).alias("action_type"),
    )
    contexts = spark.createDataFrame(
        [(date(2025, 8, 15), 1), (date(2025, 8, 1), 1), (date(2025, 7, 31), 1)], "as_of_date date, customer_id bigint"
    )
    newest = newest_per_day(actions, 10)
    row = customer_timelines(newest, contexts, 10, 365).first()
    assert len(row.entries) <= 30 and len(row.asked) == 3
    assert all(a.length == 10 for a in row.asked)
