"""The four feeds, derived row by row from the driver's tables (see FIXTURES.md).

Nothing is grouped here: a view event is one impression row and an order is one impression row, so a
hot user or customer costs many rows, never one large one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_SHOWN = 5


def use_utc(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _shown(count: Column, item, is_order) -> Column:
    """``count`` items (0 to MAX_SHOWN - 1) built from their position."""
    positions = F.slice(F.sequence(F.lit(0), F.lit(MAX_SHOWN - 1)), F.lit(1), count.cast("int"))
    return F.transform(
        positions,
        lambda j: F.struct(
            item(j).cast("int").alias("item_id"), is_order(j).cast("boolean").alias("is_order")
        ),
    )


def _of_type(events: DataFrame, *event_types: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.where(F.col("event_type").isin(*event_types)).select(
        "event_id", "event_type", "ts", F.col("user_id").alias("customer_id"), k.alias("k")
    )


def event_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Family A: clicks, sign-ups as add-to-carts (to the hour) and purchases; views as impressions; errors as bad clicks."""
    day = F.to_date("ts").cast("string")
    item = (F.col("k") + 1).alias
    events = table(spark, sf_dir, "events")
    views = _of_type(events, "view")
    event_id = F.col("event_id")
    impressions = views.select(
        # Every other day in the prefixed form.
        F.when(event_id % 2 == 0, F.concat(F.lit("dt="), day)).otherwise(day).alias("dt"),
        F.concat(F.lit("r-"), event_id.cast("string")).alias("ranking_id"),
        "customer_id",
        _shown(
            event_id % MAX_SHOWN,
            lambda j: 1 + (F.col("k") + 17 * j) % 100,
            lambda j: (event_id + j) % 7 == 0,
        ).alias("impressions"),
    )
    # Errors are bad clicks, a quarter each: no customer, item 0, no item, no time.
    bad = {n: (F.col("event_type") == "error") & (event_id % 4 == n) for n in range(4)}
    clicks = _of_type(events, "click", "error").select(
        day.alias("dt"),
        F.when(~bad[0], F.col("customer_id")).alias("customer_id"),
        F.when(bad[1], 0).when(~bad[2], F.col("k") + 1).alias("item_id"),
        F.when(~bad[3], F.col("ts")).alias("click_time"),
    )
    atc = _of_type(events, "signup").select(
        day.alias("dt"),
        "customer_id",
        item("config_id"),
        F.lit(None).cast("string").alias("simple_id"),
        F.date_trunc("hour", "ts").alias("occurred_at"),
    )
    orders = _of_type(events, "purchase").select(
        day.alias("order_date"), "customer_id", item("config_id")
    )
    return {"impressions": impressions, "clicks": clicks, "atc": atc, "orders": orders}


def order_feeds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Family B: shipped lineitems as orders, orders as impressions; no clicks, no add-to-carts."""
    placed = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("customer_id"), "o_orderdate"
    )
    key = F.col("o_orderkey")
    impressions = placed.select(
        F.to_date("o_orderdate").cast("string").alias("dt"),
        F.concat(F.lit("r-"), key.cast("string")).alias("ranking_id"),
        "customer_id",
        _shown(
            key % MAX_SHOWN,
            lambda j: 1 + (7 * key + 13 * j) % 2000,
            lambda j: (key + j) % 5 == 0,
        ).alias("impressions"),
    )
    shipped = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = shipped.join(placed, shipped["l_orderkey"] == placed["o_orderkey"]).select(
        F.to_date("l_shipdate").alias("order_date"),
        "customer_id",
        (F.col("l_partkey") + 1).cast("int").alias("config_id"),
    )
    none = placed.where(F.lit(False))
    clicks = none.select(
        F.lit("").alias("dt"),
        "customer_id",
        F.lit(0).alias("item_id"),
        F.lit("").alias("click_time"),
    )
    atc = none.select(
        F.lit("").alias("dt"),
        "customer_id",
        F.lit(0).alias("config_id"),
        F.lit("").alias("simple_id"),
        F.lit("").alias("occurred_at"),
    )
    return {"impressions": impressions, "clicks": clicks, "atc": atc, "orders": orders}
