"""Clicks, add-to-carts and orders as one typed action table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import lenient_cast
from ..schemas import ACTION_ATC, ACTION_CLICK, ACTION_ORDER


def _actions(
    feed: DataFrame,
    item: str,
    occurred_at: Column,
    code: int,
    source: str,
    strict: bool,
    keep: tuple[str, ...],
) -> DataFrame:
    return feed.select(
        lenient_cast(F.col("customer_id"), "bigint", strict).alias("customer_id"),
        lenient_cast(F.col(item), "int", strict).alias("item_id"),
        occurred_at.alias("occurred_at"),
        F.lit(code).alias("action_type"),
        F.lit(source).alias("source"),
        # The day always follows from the event time; the feed's own dt is not trusted.
        F.to_date(occurred_at).alias("action_date"),
        *keep,
    )


def click_actions(
    clicks: DataFrame, *, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    at = lenient_cast(F.col("click_time"), "timestamp", strict)
    return _actions(clicks, "item_id", at, ACTION_CLICK, "clicks", strict, keep)


def atc_actions(
    atc: DataFrame, *, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    at = lenient_cast(F.col("occurred_at"), "timestamp", strict)
    return _actions(atc, "config_id", at, ACTION_ATC, "atc", strict, keep)


def order_actions(
    orders: DataFrame, *, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    # Orders know their day only and count as midnight. A null day stays null.
    at = lenient_cast(F.col("order_date"), "date", strict).cast("timestamp")
    return _actions(orders, "config_id", at, ACTION_ORDER, "orders", strict, keep)


def build_actions_union(
    clicks_df: DataFrame, atc_df: DataFrame, orders_df: DataFrame, *, strict: bool = False
) -> DataFrame:
    """All three feeds in one table; duplicates are kept."""
    return (
        click_actions(clicks_df, strict=strict)
        .unionByName(atc_actions(atc_df, strict=strict))
        .unionByName(order_actions(orders_df, strict=strict))
    )


def daily_action_counts(actions: DataFrame) -> DataFrame:
    """(customer_id, action_date, n): what the counting operators need of the action table.

    The count combines before the shuffle, so a customer with a third of all actions arrives as one
    row per day and map task.
    """
    return (
        actions.where("customer_id IS NOT NULL AND action_date IS NOT NULL")
        .groupBy("customer_id", "action_date")
        .agg(F.count(F.lit(1)).alias("n"))
    )
