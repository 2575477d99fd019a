"""Seeded feeds of any size, generated on the executors from a table of customers.

Every value is a hash of seed, customer, day and slot, so the same call gives the same rows on any
cluster and partitioning.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.draws import chance, draw, hash_key

ITEMS_PER_IMPRESSION = 10
MAX_CLICKS = 4
ORDER_LABEL_PER_MILLE = 150
ATC_PER_MILLE = 600
ORDER_PER_MILLE = 400
ATC_HOUR = 11


def synthetic_feeds(
    customers: DataFrame, *, first_day: date, days: int = 30, items: int = 200, seed: int = 7
) -> dict[str, DataFrame]:
    """Raw feeds for each ``customer_id`` of ``customers`` and each of ``days`` days.

    Ten items per impression; one to four clicks one to three days back; at times an add-to-cart one
    to five days back and an order two to seven days back.
    """
    last_day = first_day + timedelta(days=days - 1)
    base = customers.select(
        F.col("customer_id").cast("bigint").alias("customer_id"),
        F.explode(F.sequence(F.lit(first_day), F.lit(last_day))).alias("day"),
    )
    day, customer = F.col("day"), F.col("customer_id")

    def key(use: str, slot: Column | None = None) -> Column:
        return hash_key(seed, F.lit(use), customer, day, F.lit(0) if slot is None else slot)

    def item(use: str, slot: Column | None = None) -> Column:
        return draw(1, items, key(use, slot)).cast("int")

    def days_back(low: int, high: int, use: str, slot: Column | None = None) -> Column:
        return F.date_sub(day, draw(low, high, key(use, slot)).cast("int"))

    def at_hour(on: Column, hour: Column) -> Column:
        return F.concat(on.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":00:00"))

    def prefixed(on: Column) -> Column:
        return F.concat(F.lit("dt="), on.cast("string"))

    impressions = base.select(
        day.cast("string").alias("dt"),
        F.concat_ws("-", F.lit("r"), day.cast("string"), customer.cast("string")).alias("ranking_id"),
        customer,
        F.transform(
            F.sequence(F.lit(0), F.lit(ITEMS_PER_IMPRESSION - 1)),
            lambda slot: F.struct(
                item("shown", slot).alias("item_id"),
                chance(ORDER_LABEL_PER_MILLE, key("label", slot)).alias("is_order"),
            ),
        ).alias("impressions"),
    )

    clicks = (
        base.withColumn("n", draw(1, MAX_CLICKS, key("clicks")).cast("int"))
        .withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n"))))
        .withColumn("clicked", days_back(1, 3, "click day", F.col("slot")))
        .select(
            prefixed(F.col("clicked")).alias("dt"),
            customer,
            item("click item", F.col("slot")).alias("item_id"),
            at_hour(F.col("clicked"), draw(0, 23, key("click hour", F.col("slot")))).alias("click_time"),
        )
    )

    atc = (
        base.where(chance(ATC_PER_MILLE, key("atc")))
        .withColumn("added", days_back(1, 5, "atc day"))
        .select(
            prefixed(F.col("added")).alias("dt"),
            customer,
            item("atc item").alias("config_id"),
            F.lit(None).cast("string").alias("simple_id"),
            at_hour(F.col("added"), F.lit(ATC_HOUR)).alias("occurred_at"),
        )
    )

    orders = base.where(chance(ORDER_PER_MILLE, key("order"))).select(
        days_back(2, 7, "order day").cast("string").alias("order_date"),
        customer,
        item("order item").alias("config_id"),
    )
    return {"impressions": impressions, "clicks": clicks, "atc": atc, "orders": orders}


def write_feeds(
    feeds: dict[str, DataFrame], base: str, rows_per_file: int | None = None, layout: str = "lines"
) -> None:
    """Each feed as JSON under ``base/<feed>``.

    ``lines``: Spark sizes the files, unless ``rows_per_file`` bounds them. ``array``: one JSON array per file, of about
    ``rows_per_file`` rows (1000 if not given).
    """
    if layout not in ("lines", "array"):
        raise ValueError(f"layout must be 'lines' or 'array', not {layout!r}")
    for name, feed in feeds.items():
        path = f"{base.rstrip('/')}/{name}"
        if layout == "array":
            size = rows_per_file or 1000
            files = max(1, -(-feed.count() // size))
            record = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
            part = F.pmod(F.xxhash64(record), F.lit(files))
            arrays = feed.select(part.alias("part"), record.alias("record")).groupBy("part")
            text = F.concat(F.lit("[\n"), F.array_join(F.collect_list("record"), ",\n"), F.lit("\n]"))
            rows = arrays.agg(text.alias("value")).drop("part")
            rows.write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
            continue
        writer = feed.write.mode("overwrite").option("ignoreNullFields", "false")
        if rows_per_file:
            writer = writer.option("maxRecordsPerFile", rows_per_file)
        writer.json(path)
