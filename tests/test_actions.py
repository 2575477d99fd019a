import pytest
from frames import at, feeds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailpack.operators.actions import build_actions_union, click_actions, order_actions
from trailpack.schemas import actions_union_schema


def test_union_of_three_feeds(spark):
    _, clicks, atc, orders = feeds(
        spark,
        clicks=[("dt=2030-01-01", 1, 10, "2025-08-14 10:11:12")],
        atc=[("x", 2, 20, "s", "2025-08-13 09:00:00")],
        orders=[("2025-08-12", 3, 30)],
    )
    out = build_actions_union(clicks, atc, orders)
    assert [(f.name, f.dataType) for f in out.schema] == [
        (f.name, f.dataType) for f in actions_union_schema
    ]
    # The day comes from the event time, not from dt.
    assert {tuple(r) for r in out.collect()} == {
        (1, 10, at("2025-08-14 10:11:12"), 1, "clicks", at("2025-08-14").date()),
        (2, 20, at("2025-08-13 09:00:00"), 2, "atc", at("2025-08-13").date()),
        (3, 30, at("2025-08-12 00:00:00"), 3, "orders", at("2025-08-12").date()),
    }


def test_duplicates_stay(spark):
    _, clicks, atc, orders = feeds(spark, orders=[("2025-08-12", 3, 30)] * 3)
    assert build_actions_union(clicks, atc, orders).count() == 3


def test_typed_inputs(spark):
    clicks = spark.sql(
        "SELECT '1' AS customer_id, 10L AS item_id, TIMESTAMP '2025-08-14 10:00:00' AS click_time "
        "UNION ALL SELECT '2', 11L, NULL"
    )
    rows = click_actions(clicks).orderBy("customer_id").collect()
    assert [(r.customer_id, r.item_id, r.occurred_at) for r in rows] == [
        (1, 10, at("2025-08-14 10:00")),
        (2, 11, None),
    ]
    ntz = clicks.withColumn("click_time", F.col("click_time").cast("timestamp_ntz"))
    assert click_actions(ntz).schema["occurred_at"].dataType == T.TimestampType()
    orders = spark.sql("SELECT 1 AS customer_id, DATE '2025-08-12' AS order_date, 5 AS config_id")
    assert order_actions(orders).first().occurred_at == at("2025-08-12 00:00")


def test_null_order_date_stays_null(spark):
    *_, orders = feeds(spark, orders=[(None, 1, 5)])
    row = order_actions(orders).first()
    assert row.occurred_at is None and row.action_date is None


def test_bad_values_are_null_or_raise(spark):
    clicks = spark.createDataFrame(
        [("zz", "99999999999", "not a time")], "customer_id string, item_id string, click_time string"
    )
    row = click_actions(clicks).first()
    assert (row.customer_id, row.item_id, row.occurred_at, row.action_date) == (None,) * 4
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        click_actions(clicks, strict=True).collect()
