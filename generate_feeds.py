"""Write seeded feeds of any size as JSON, for trials of the job.

    spark-submit --py-files trailpack.zip generate_feeds.py --out /data/feeds --days 30 --customers 50
"""

from __future__ import annotations

import argparse
from datetime import date, timedelta

from pyspark.sql import SparkSession

from trailpack.sources.synthetic import synthetic_feeds, write_feeds


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Generate impressions, clicks, add-to-carts and orders")
    p.add_argument("--out", required=True)
    p.add_argument("--days", type=int, default=30)
    p.add_argument("--first-day", type=date.fromisoformat, help="default: so that the last day is yesterday")
    p.add_argument("--customers", type=int, default=50)
    p.add_argument("--items", type=int, default=200)
    p.add_argument("--seed", type=int, default=7)
    p.add_argument("--batch-size", type=int, help="rows per file")
    p.add_argument("--layout", default="lines", choices=("lines", "array"))
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("trailpack-generate").getOrCreate()
    customers = spark.range(1, a.customers + 1).withColumnRenamed("id", "customer_id")
    first = a.first_day or date.today() - timedelta(days=a.days)
    feeds = synthetic_feeds(customers, first_day=first, days=a.days, items=a.items, seed=a.seed)
    write_feeds(feeds, a.out, a.batch_size, a.layout)


if __name__ == "__main__":
    main()
