"""Impressions, the (day, customer) contexts they ask for, and the train window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.casts import day_of_text, lenient_cast


def as_of_day(impressions: DataFrame, strict: bool = False) -> Column:
    """The day of an impression; ``as_of_date`` wins where both forms are present."""
    if "as_of_date" in impressions.columns:
        return lenient_cast(F.col("as_of_date"), "date", strict)
    if "dt" in impressions.columns:
        return day_of_text(F.col("dt"), strict)
    raise ValueError("impressions: expected either 'dt' or 'as_of_date' among the columns")


def normalize_impressions(
    impressions_df: DataFrame, *, strict: bool = False, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Raw or already normalised impressions as (as_of_date, ranking_id, customer_id, impressions)."""
    return impressions_df.select(
        as_of_day(impressions_df, strict).alias("as_of_date"),
        F.col("ranking_id").cast("string").alias("ranking_id"),
        lenient_cast(F.col("customer_id"), "bigint", strict).alias("customer_id"),
        F.col("impressions"),
        *keep,
    )


def explode_items(nested: DataFrame, *carry: str) -> DataFrame:
    """One row per shown item. Rows with a null or empty list have none and vanish."""
    keys = ["as_of_date", "ranking_id", "customer_id"]
    return nested.select(*keys, F.explode("impressions").alias("shown"), *carry).select(
        *keys,
        F.col("shown.item_id").cast("int").alias("impression_item_id"),
        F.col("shown.is_order").cast("boolean").alias("is_order"),
        *carry,
    )


def explode_impressions(impressions_df: DataFrame) -> DataFrame:
    return explode_items(normalize_impressions(impressions_df))


def contexts_of(impressions: DataFrame) -> DataFrame:
    """Distinct (as_of_date, customer_id)."""
    return impressions.select("as_of_date", "customer_id").distinct()


def slice_impressions_last_n_days(impressions: DataFrame, n_days: int) -> DataFrame:
    """Rows of the newest ``n_days`` days, counted back from the newest day present.

    The newest day is a scalar subquery over the day column alone: no driver round trip, and the
    filter prunes partitions and row groups at run time.
    """
    day = as_of_day(impressions)
    newest = impressions.select(day.alias("day")).agg(F.max("day")).scalar()
    return impressions.where(day >= F.date_sub(newest, n_days - 1))
