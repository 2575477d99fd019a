"""A handful of rows in the shape of the real feeds."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

from ..schemas import FEED_SCHEMAS


def demo_inputs(spark: SparkSession, today: date | None = None) -> dict[str, DataFrame]:
    """Three customers over four days, each with a case of its own.

    Customer 7 has more actions than a history of four holds, two of them at one time. Customer 8 is shown an empty
    list and acted on the day itself only, which no history of that day may have. Customer 9 never acted.
    """
    today = today or date.today()

    def day(back: int) -> str:
        return str(today - timedelta(days=back))

    def click(customer: int, item: int, back: int, hour: int) -> tuple:
        return day(back), customer, item, f"{day(back)} {hour:02d}:30:00"

    rows = {
        "impressions": [
            (f"dt={day(0)}", "home-7", 7, [(501, False), (502, True), (503, False)]),
            (f"dt={day(1)}", "search-7", 7, [(504, True)]),
            (day(0), "home-8", 8, []),
            (day(0), "home-9", 9, [(505, False), (506, False)]),
        ],
        "clicks": [
            click(7, 601, 1, 9),
            click(7, 602, 1, 9),
            click(7, 603, 2, 20),
            click(7, 604, 3, 7),
            click(8, 605, 0, 10),
        ],
        "atc": [(day(2), 7, 611, "size-m", f"{day(2)} 21:00:00")],
        "orders": [(day(3), 7, 621)],
    }
    return {name: spark.createDataFrame(rows[name], schema) for name, schema in FEED_SCHEMAS.items()}
