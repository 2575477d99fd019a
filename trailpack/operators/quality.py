"""Quality of the action table: counters and the gate on them."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACTION_COLUMNS = (
    "customer_id",
    "item_id",
    "action_type",
    "occurred_at",
    "action_date",
    "source",
)


@dataclass(frozen=True)
class QualityReport:
    rows: int
    null_customer_ids: int
    future_actions: int
    # Groups of equal rows, not surplus rows; None where they were not asked for.
    duplicate_action_rows: int | None
    # Item id 0 cannot be told from padding; an undated action is in no history.
    zero_item_ids: int = 0
    undated_actions: int = 0

    def as_dict(self) -> dict[str, int | None]:
        return asdict(self)


def duplicate_groups(actions: DataFrame) -> DataFrame:
    """Distinct action rows that occur more than once, with their number of copies."""
    return (
        actions.groupBy(*ACTION_COLUMNS)
        .agg(F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def quality_counters(actions: DataFrame, now: Column | None = None) -> DataFrame:
    """All counters as one row, from one scan and one shuffle.

    Equal rows collapse before the shuffle, so a group of copies costs one row per map task.
    """
    now = F.current_timestamp() if now is None else now
    copies = F.col("copies")

    def rows_where(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, copies)), F.lit(0).cast("bigint"))

    return (
        actions.groupBy(*ACTION_COLUMNS)
        .agg(F.count(F.lit(1)).alias("copies"))
        .agg(
            F.coalesce(F.sum(copies), F.lit(0).cast("bigint")).alias("rows"),
            rows_where(F.col("customer_id").isNull()).alias("null_customer_ids"),
            rows_where(F.col("occurred_at") > now).alias("future_actions"),
            F.count_if(copies > 1).alias("duplicate_action_rows"),
            rows_where(F.col("item_id") == 0).alias("zero_item_ids"),
            rows_where(F.col("occurred_at").isNull()).alias("undated_actions"),
        )
    )


def gate_counters(actions: DataFrame, now: Column | None = None) -> DataFrame:
    """The counters without duplicates: what the gate needs, with one row per task to shuffle."""
    now = F.current_timestamp() if now is None else now
    return actions.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("customer_id").isNull()).alias("null_customer_ids"),
        F.count_if(F.col("occurred_at") > now).alias("future_actions"),
        F.count_if(F.col("item_id") == 0).alias("zero_item_ids"),
        F.count_if(F.col("occurred_at").isNull()).alias("undated_actions"),
        F.lit(None).cast("bigint").alias("duplicate_action_rows"),
    )


def actions_quality_report(
    actions_union_df: DataFrame, *, now: Column | None = None, duplicates: bool = True
) -> QualityReport:
    counters = quality_counters if duplicates else gate_counters
    return QualityReport(**counters(actions_union_df, now).first().asDict())


def assert_quality_or_fail(report: QualityReport, *, allow_future_actions: int = 0) -> None:
    """Raise on a null customer or on too many future actions. Duplicates never fail."""
    if report.null_customer_ids > 0:
        raise ValueError(f"{report.null_customer_ids} actions without a customer_id")
    if report.future_actions > allow_future_actions:
        raise ValueError(
            f"{report.future_actions} actions in the future, {allow_future_actions} allowed"
        )
