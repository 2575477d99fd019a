"""Do the feeds fit together: was an ordered item clicked, put in a cart or shown to the customer before?

Orders know their day only, so days are what is compared: what happened on the order's own day counts as before it (lag 0). Both
sides are counted per (customer, item, day) before the shuffle and meet in a sorted union, the latest day of an earlier
sign being carried forward; nothing is paired, and a (customer, item) with a third of all rows arrives as one row per day.

Defined results: orders without a customer, item or day have no earlier sign by definition; they are counted as missing, with null
lags. Rows of the other feeds without one of them are no sign for any order. Repeated rows count each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import ACTION_ATC, ACTION_CLICK, ACTION_ORDER
from .impressions import explode_items

# What can come before an order.
SIGNS = ("click", "atc", "impression")


def _signs(actions: DataFrame, impressions: DataFrame) -> dict[str, DataFrame]:
    keys = ("customer_id", "item_id", "day")

    def acted(code: int) -> DataFrame:
        return actions.where(F.col("action_type") == code).select("customer_id", "item_id", F.col("action_date").alias("day"))

    shown = explode_items(impressions).select("customer_id", F.col("impression_item_id").alias("item_id"), F.col("as_of_date").alias("day"))
    return {
        "order": acted(ACTION_ORDER).select(*keys),
        "click": acted(ACTION_CLICK).select(*keys),
        "atc": acted(ACTION_ATC).select(*keys),
        "impression": shown.select(*keys),
    }


def signs_before_orders(actions: DataFrame, impressions: DataFrame) -> DataFrame:
    """One row per (customer_id, item_id, day) with orders: their number, and per sign the days since its latest one.

    ``impressions`` are normalised. ``lag_days`` is the least of the three lags, null where nothing came before.
    """
    feeds = _signs(actions, impressions)
    marked = reduce(
        DataFrame.unionByName,
        [feed.select("*", *[F.lit(int(kind == name)).alias(f"n_{name}") for name in feeds]) for kind, feed in feeds.items()],
    )
    days = marked.groupBy("customer_id", "item_id", "day").agg(*[F.sum(f"n_{name}").alias(f"n_{name}") for name in feeds])
    until_day = Window.partitionBy("customer_id", "item_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    known = F.col("customer_id").isNotNull() & F.col("item_id").isNotNull() & F.col("day").isNotNull()
    latest = {name: F.max(F.when(F.col(f"n_{name}") > 0, F.col("day"))).over(until_day) for name in SIGNS}
    lags = days.withColumns({f"{name}_lag": F.when(known, F.datediff("day", day)) for name, day in latest.items()})
    return lags.where("n_order > 0").select(
        "customer_id",
        "item_id",
        "day",
        F.col("n_order").alias("orders"),
        *[f"{name}_lag" for name in SIGNS],
        F.least(*[f"{name}_lag" for name in SIGNS]).alias("lag_days"),
    )


def orders_without_prior_action(actions: DataFrame, impressions: DataFrame) -> DataFrame:
    """Per order day: orders, how many of them nothing came before, how many something on the day itself, and the longest lag."""
    orders, lag = F.col("orders"), F.col("lag_days")

    def orders_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, orders)), F.lit(0).cast("bigint"))

    return signs_before_orders(actions, impressions).groupBy("day").agg(
        F.sum(orders).alias("orders"),
        orders_where(lag.isNull()).alias("without_prior"),
        *[orders_where(F.col(f"{name}_lag").isNull()).alias(f"without_{name}") for name in SIGNS],
        orders_where(lag == 0).alias("same_day"),
        F.max(lag).alias("longest_lag"),
    )
