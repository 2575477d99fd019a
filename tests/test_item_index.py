import re

import pytest
from frames import actions_df, at, collected, contexts_df
from test_plans import plan

from trailpack.operators.histories import build_histories_for_impressions
from trailpack.operators.item_index import build_item_index, item_frequencies, numbered, with_item_index
from pyspark.sql import functions as F


def items(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "item_id int")


def rows(index):
    return sorted((r.item_index, r.item_id, r.frequency) for r in index.collect())


def test_frequent_items_come_first_and_ties_go_by_id(spark):
    index = build_item_index(item_frequencies(items(spark, 5, 9, 9, None, 0), items(spark, 7, 5, 9, 3)))
    assert rows(index) == [(2, 9, 3), (3, 5, 2), (4, 3, 1), (5, 7, 1)]
    assert index.dtypes == [("item_id", "bigint"), ("item_index", "int"), ("frequency", "bigint")]
    assert rows(build_item_index(item_frequencies(items(spark)))) == []


def test_old_numbers_stay_when_new_items_come(spark):
    first = build_item_index(item_frequencies(items(spark, 1, 1, 2)))
    again = build_item_index(item_frequencies(items(spark, 4, 3, 3, 3, 2, 2)), first)
    assert rows(again) == [(2, 1, 0), (3, 2, 2), (4, 3, 3), (5, 4, 1)]
    assert rows(build_item_index(item_frequencies(items(spark, 8)), again.where("false"))) == [(2, 8, 1)]


def test_numbers_have_no_gaps_over_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled"), spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        data = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"))
        got = numbered(data, [F.desc("k")], "n", 10).orderBy("n").collect()
        want = sorted((r.k for r in data.collect()), reverse=True)
        assert [(r.k, r.n) for r in got] == [(k, 10 + i) for i, k in enumerate(want)]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before[0])
        spark.conf.set("spark.sql.shuffle.partitions", before[1])


def test_no_window_and_no_single_partition(spark):
    index = build_item_index(item_frequencies(items(spark, *range(1, 50))))
    text = plan(index)
    assert "Window" not in text and "SinglePartition" not in text and not re.search(r"Exchange rangepartitioning", text)


def test_unknown_and_missing_items(spark):
    index = build_item_index(item_frequencies(items(spark, 6, 6, 4)))
    got = with_item_index(items(spark, 4, 6, None, 0, 8), index).collect()
    assert sorted(got, key=str) == sorted([(4, 3), (6, 2), (None, 1), (0, 1), (8, 1)], key=str)


@pytest.mark.parametrize("drop_repeats", [False, True])
def test_histories_keep_the_order_of_their_items(spark, drop_repeats):
    """Ties are broken by item id, not by the items' numbers; padding stays 0."""
    when = at("2025-08-14 00:00")
    actions = actions_df(spark, [(1, 30, 1, when), (1, 20, 1, when), (1, None, 1, when), (1, 99, 1, at("2025-08-13 08:00"))])
    index = build_item_index(item_frequencies(items(spark, 30, 20, 20)))
    contexts = contexts_df(spark, [(at("2025-08-15 00:00").date(), 1)])
    got = build_histories_for_impressions(
        actions, contexts, max_actions=6, lookback_days=7, item_index=index, drop_repeats=drop_repeats
    )
    assert list(collected(got).values()) == [([3, 2, 1, 1, 0, 0], [1, 1, 1, 1, 0, 0])]
