"""Histories joined back on to the impressions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .impressions import explode_items, normalize_impressions


CONTEXT = ["as_of_date", "customer_id"]


def attach_histories(impressions: DataFrame, histories: DataFrame) -> DataFrame:
    """Every normalised impression row with all history columns of its (day, customer).

    Impressions without a day or customer match nothing and get null arrays.

    Both sides must shuffle here, or AQE cannot split a context that holds a large share of the
    impressions. Where all impressions are of one literal day, that day drops out of the join keys and
    the histories would stay partitioned by customer; the hash keeps the full key alive.
    """
    carried = [c for c in histories.columns if c not in CONTEXT]
    # Of one type on both sides: equal values of different types hash differently.
    key = F.xxhash64(
        F.col("as_of_date").try_cast("date"), F.col("customer_id").try_cast("bigint")
    )
    return (
        impressions.withColumn("_context", key)
        .join(histories.withColumn("_context", key), [*CONTEXT, "_context"], "left")
        .select("as_of_date", "ranking_id", "customer_id", "impressions", *carried)
    )


def join_impressions_with_histories(impressions_df: DataFrame, histories_df: DataFrame) -> DataFrame:
    """Raw or normalised impressions with ``actions`` and ``action_types``."""
    raw = "dt" in impressions_df.columns or "as_of_date" not in impressions_df.columns
    impressions = normalize_impressions(impressions_df) if raw else impressions_df
    histories = histories_df.select(*CONTEXT, "actions", "action_types")
    return attach_histories(impressions, histories)


def build_training_examples(
    impressions_df: DataFrame, histories_df: DataFrame, *, explode: bool = False
) -> DataFrame:
    nested = join_impressions_with_histories(impressions_df, histories_df)
    return explode_items(nested, "actions", "action_types") if explode else nested
