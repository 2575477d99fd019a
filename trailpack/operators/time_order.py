"""Are a feed's rows in the order of their times, customer by customer, as they stand in its files?

A customer's rows are never brought together. Files are cut into pieces of consecutive rows, and a (customer, piece) is summed up as a
segment: first, last and greatest time. Segments in file order give every segment the time that the ones before it have
reached (their greatest) and ended with (their last one's last), which is all that its rows need to be judged inside the piece.

Defined results: rows without a time are counted as ``untimed`` and passed over. Rows without a customer are one customer, null. Equal
times are in order. A feed without rows gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Consecutive rows of a file that make a piece.
PIECE_ROWS = 1_000_000


def file_position() -> tuple[Column, Column]:
    """(file, row in it) of a table read from Parquet: the order in which its rows were written."""
    return F.col("_metadata.file_path"), F.col("_metadata.row_index")


def placed(feed: DataFrame, customer: str, time: str, position: tuple[Column, Column], piece_rows: int) -> DataFrame:
    file, row = position
    return feed.select(
        F.col(customer).alias("customer_id"),
        F.col(time).cast("timestamp").alias("at"),
        F.struct(file.alias("file"), F.floor(row / piece_rows).alias("number")).alias("piece"),
        row.alias("row"),
    )


def segments(rows: DataFrame) -> DataFrame:
    """One row per (customer, piece), summed up in the tasks before the shuffle, with what was ``reached`` and ``ended`` before."""
    summed = rows.where("at IS NOT NULL").groupBy("customer_id", "piece").agg(
        F.max("at").alias("greatest"), F.max_by("at", "row").alias("last")
    )
    before = Window.partitionBy("customer_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    return summed.select(
        "customer_id", "piece", F.max("greatest").over(before).alias("reached"), F.last("last").over(before).alias("ended")
    )


def judged_rows(
    feed: DataFrame, *, customer: str, time: str, position: tuple[Column, Column] | None = None, piece_rows: int = PIECE_ROWS
) -> DataFrame:
    """customer_id, at, piece, row, late_by (seconds behind the greatest time before, null if none), steps_back."""
    rows = placed(feed, customer, time, position or file_position(), piece_rows)
    known = segments(rows).select(F.col("customer_id").alias("c"), F.col("piece").alias("p"), "reached", "ended")
    joined = rows.join(known, F.col("customer_id").eqNullSafe(F.col("c")) & (F.col("piece") == F.col("p")), "left").drop("c", "p")
    before = Window.partitionBy("customer_id", "piece").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.greatest("reached", F.max("at").over(before))
    ended = F.coalesce(F.last("at", ignorenulls=True).over(before), F.col("ended"))
    return joined.select(
        "customer_id",
        "at",
        "piece",
        "row",
        F.when(F.col("at") < reached, F.unix_micros(reached) - F.unix_micros("at")).alias("late_micros"),
        F.coalesce(F.col("at") < ended, F.lit(False)).alias("steps_back"),
    )


def time_order_report(feed: DataFrame, **options) -> DataFrame:
    """Per customer: rows, untimed, out_of_order (earlier than some row before), steps_back (earlier than the row before), worst_micros.

    Customers whose rows are all in order and timed are left out.
    """
    report = judged_rows(feed, **options).groupBy("customer_id").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col("at").isNull()).alias("untimed"),
        F.count("late_micros").alias("out_of_order"),
        F.count_if("steps_back").alias("steps_back"),
        F.coalesce(F.max("late_micros"), F.lit(0).cast("bigint")).alias("worst_micros"),
    )
    return report.where("out_of_order > 0 OR untimed > 0")
