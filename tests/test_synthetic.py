from datetime import date, timedelta

from pyspark.sql import functions as F

from trailpack.sources.demo import demo_inputs
from trailpack.sources.readers import read_clicks, read_impressions
from trailpack.sources.synthetic import synthetic_feeds, write_feeds
from trailpack.schemas import FEED_SCHEMAS

FIRST = date(2025, 8, 1)


def made(spark, seed=7, parts=3):
    customers = spark.range(100, 150, 1, parts).withColumnRenamed("id", "customer_id")
    return synthetic_feeds(customers, first_day=FIRST, days=30, items=200, seed=seed)


def bag(df):
    return sorted(map(str, df.collect()))


def test_shape(spark):
    feeds = made(spark)
    for name, schema in FEED_SCHEMAS.items():
        assert [(f.name, f.dataType.simpleString()) for f in feeds[name].schema] == [
            (f.name, f.dataType.simpleString()) for f in schema
        ]
    impressions = feeds["impressions"]
    assert impressions.count() == 1500
    assert impressions.where("size(impressions) <> 10").count() == 0
    items = impressions.select(F.inline("impressions"))
    low, high, share = items.agg(
        F.min("item_id"), F.max("item_id"), F.avg(F.col("is_order").cast("int"))
    ).first()
    assert (low, high) == (1, 200) and 0.13 < share < 0.17


def test_rates_and_days(spark):
    feeds = made(spark)
    assert 2.4 < feeds["clicks"].count() / 1500 < 2.6
    assert 0.55 < feeds["atc"].count() / 1500 < 0.65
    assert 0.35 < feeds["orders"].count() / 1500 < 0.45
    days = feeds["clicks"].agg(F.min(F.substring("click_time", 1, 10)), F.max(F.substring("click_time", 1, 10))).first()
    assert tuple(days) == (str(FIRST - timedelta(3)), str(FIRST + timedelta(28)))
    assert feeds["clicks"].where("concat('dt=', substr(click_time, 1, 10)) <> dt").count() == 0
    assert feeds["atc"].where("substr(occurred_at, 12) <> '11:00:00'").count() == 0
    assert feeds["orders"].agg(F.max("order_date")).first()[0] <= str(FIRST + timedelta(27))


def test_seed_decides_not_partitioning(spark):
    for name in FEED_SCHEMAS:
        assert bag(made(spark)[name]) == bag(made(spark, parts=8)[name])
        assert bag(made(spark)[name]) != bag(made(spark, seed=8)[name])


def test_written_feeds_read_back(spark, tmp_path):
    feeds = made(spark)
    write_feeds(feeds, str(tmp_path), rows_per_file=100)
    assert len(list((tmp_path / "impressions").glob("*.json"))) >= 15
    back, bad = read_impressions(spark, str(tmp_path / "impressions"), layout="lines")
    assert bag(back) == bag(feeds["impressions"]) and bad.count() == 0
    assert bag(read_clicks(spark, str(tmp_path / "clicks"), layout="lines")[0]) == bag(feeds["clicks"])


def test_demo(spark):
    demo = demo_inputs(spark, date(2025, 8, 17))
    assert {n: df.count() for n, df in demo.items()} == {"impressions": 4, "clicks": 5, "atc": 1, "orders": 1}
    assert all(demo[n].schema == s for n, s in FEED_SCHEMAS.items())
