"""Uniform samples of a fixed size per day, the same rows on any partitioning.

Every row draws a hash of the seed and its key, and a day keeps the ``k`` smallest draws. The smallest of the parts hold the
smallest of the whole: rows are limited inside each map task, then per (day, salt), then per day, so a day with a third of all
rows reaches its last task as ``k`` rows per salt.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import hash_key
from .histories import DEFAULT_SALTS, EARLY_LIMIT


def sample_per_day(
    rows: DataFrame, k: int, seed: int, *, key: tuple[str, ...], day: str = "as_of_date", salts: int = DEFAULT_SALTS
) -> DataFrame:
    """``k`` rows of every day, or all where it has fewer; without replacement.

    ``key`` names what tells rows apart: rows equal in it draw alike and follow one another by their other columns; equal rows
    are separate rows. Null keys draw as empty text; a null day is a day. An empty table gives an empty sample.
    """
    if k > int(rows.sparkSession.conf.get(EARLY_LIMIT)):
        warnings.warn(f"{EARLY_LIMIT} is below k={k}: days are cut to it only after the shuffle.", stacklevel=2)
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (day, *key)]
    drawn = rows.select("*", hash_key(seed, *parts).alias("_draw"), (F.spark_partition_id() % F.lit(salts)).alias("_salt"))
    order = [F.col("_draw"), *[F.col(f"`{c}`") for c in rows.columns]]
    nth = F.row_number().over
    for piece in ([day, "_salt"], [day]):
        drawn = drawn.withColumn("_nth", nth(Window.partitionBy(*piece).orderBy(*order))).where(F.col("_nth") <= k).drop("_nth")
    return drawn.drop("_draw", "_salt")
