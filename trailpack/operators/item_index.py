"""A dense index of items for embedding tables: numbers without gaps, frequent items first, kept when new items come.

Numbers are given without bringing the items together: the counted items are split into ranges of the wanted order, the table is
written once with each row's place in its range, and the ranges' sizes, summed up in order, are the offsets of a second pass.

Defined results: null items and item 0 (padding) have no index. Ties of frequency go by item id. With ``previous``, its items keep
their index, also those that no longer occur (frequency 0), and new ones follow its greatest. An empty input gives an empty index.
"""

from __future__ import annotations

from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sinks.writers import stored

#: Index 0 is padding and 1 stands for items that the index does not know.
UNKNOWN_INDEX, FIRST_INDEX = 1, 2

# monotonically_increasing_id has the task's number above the row's place in it.
_PLACE_BITS = 33


def item_frequencies(*tables: DataFrame, item: str = "item_id") -> DataFrame:
    """(item_id, frequency) over all rows of the tables; counted in the tasks before the shuffle."""
    items = reduce(DataFrame.unionByName, [t.select(F.col(item).cast("bigint").alias("item_id")) for t in tables])
    return items.where("item_id <> 0").groupBy("item_id").agg(F.count(F.lit(1)).alias("frequency"))


def numbered(df: DataFrame, order: list[Column], name: str, start: Column | int = 0) -> DataFrame:
    """``df`` with a column of consecutive numbers from ``start`` on, in the given order (which must tell all rows apart)."""
    place = F.monotonically_increasing_id().alias(name)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Range bounds come from a sample: written once, so that both passes see the same ranges.
    held = stored(ranged.select(*df.columns, place))
    part, at = F.shiftright(name, _PLACE_BITS), F.col(name).bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    # One row per range, whatever the number of items.
    sizes = sorted(held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets = accumulate([r["n"] for r in sizes], initial=0)
    firsts = df.sparkSession.createDataFrame(
        [(r["part"], offset) for r, offset in zip(sizes, offsets, strict=False)], "part bigint, offset bigint"
    )
    start = F.lit(start) if isinstance(start, int) else start
    return held.join(firsts, part == F.col("part")).select(*df.columns, (start + F.col("offset") + at).alias(name))


def build_item_index(frequencies: DataFrame, previous: DataFrame | None = None) -> DataFrame:
    """(item_id, item_index, frequency). ``previous``: an earlier result, whose numbers stay."""
    order = [F.desc("frequency"), F.asc("item_id")]
    as_int = F.col("item_index").cast("int").alias("item_index")
    if previous is None:
        return numbered(frequencies, order, "item_index", FIRST_INDEX).select("item_id", as_int, "frequency")
    known = previous.select("item_id", "item_index")
    counts = frequencies.withColumnRenamed("frequency", "counted")
    kept = known.join(counts, "item_id", "left").select(
        "item_id", as_int, F.coalesce("counted", F.lit(0).cast("bigint")).alias("frequency")
    )
    start = known.agg(F.coalesce(F.max("item_index") + 1, F.lit(FIRST_INDEX)).cast("bigint")).scalar()
    new = frequencies.join(known, "item_id", "left_anti")
    return kept.unionByName(numbered(new, order, "item_index", start).select("item_id", as_int, "frequency"))


def with_item_index(df: DataFrame, item_index: DataFrame, item: str = "item_id") -> DataFrame:
    """``df`` with ``item_index``; 1 where the item is null or unknown.

    A left join on the item, so that Spark splits a hot item's rows over tasks.
    """
    known = item_index.select(F.col("item_id").alias("known_item"), "item_index")
    joined = df.join(known, F.col(item) == F.col("known_item"), "left")
    return joined.select(*df.columns, F.coalesce("item_index", F.lit(UNKNOWN_INDEX)).alias("item_index"))
