import pytest
from pyspark.sql import functions as F
from test_plans import plan

from trailpack.functions.draws import hash_key
from trailpack.operators.histories import EARLY_LIMIT
from trailpack.operators.sampling import sample_per_day


def shown(spark, parts=3):
    """Day 1 has 3000 rows, day 2 has four, day 3 has five equal ones, and there is a null day."""
    days = F.expr("CASE WHEN id < 3000 THEN 1 WHEN id < 3004 THEN 2 WHEN id < 3009 THEN 3 END")
    key = F.when(F.col("id").between(3004, 3008), 1).otherwise(F.col("id"))
    return spark.range(3012).select(days.alias("as_of_date"), key.alias("key"), F.array(key).alias("more")).repartition(parts)


def test_exact_size_and_the_same_rows_on_any_partitioning(spark):
    got = [sorted(sample_per_day(shown(spark, p), 10, 5, key=("key",), salts=s).collect(), key=str) for p, s in [(1, 1), (7, 3), (40, 32)]]
    assert got[0] == got[1] == got[2]
    by_day = {d: [r.key for r in got[0] if r.as_of_date == d] for d in (1, 2, 3, None)}
    assert [len(by_day[d]) for d in (1, 2, 3, None)] == [10, 4, 5, 3] and len(set(by_day[1])) == 10
    other = sample_per_day(shown(spark), 10, 6, key=("key",)).where("as_of_date = 1").collect()
    assert {r.key for r in other} != set(by_day[1])


def test_the_smallest_draws_stay(spark):
    drawn = shown(spark).where("as_of_date = 1").withColumn("d", hash_key(5, F.col("as_of_date"), F.col("key")))
    want = {r.key for r in drawn.orderBy("d").limit(25).collect()}
    assert {r.key for r in sample_per_day(shown(spark), 25, 5, key=("key",)).where("as_of_date = 1").collect()} == want


def test_draws_are_uniform(spark):
    """Over many seeds every row comes about equally often."""
    rows = spark.range(20).select(F.lit(1).alias("as_of_date"), F.col("id").alias("key"))
    picked = [r.key for seed in range(60) for r in sample_per_day(rows, 5, seed, key=("key",)).collect()]
    assert len(picked) == 300 and all(4 <= picked.count(k) <= 28 for k in range(20))


def test_a_hot_day_is_limited_in_the_map_tasks_and_per_salt(spark):
    text = plan(sample_per_day(shown(spark), 10, 5, key=("key",)))
    limits = [line for line in text.splitlines() if "WindowGroupLimit" in line]
    assert sum("Partial" in x for x in limits) == 2 and sum("_salt" in x for x in limits) == 2
    first_exchange = text.rindex("hashpartitioning(as_of_date")
    assert "_salt" in text[first_exchange : first_exchange + 60] and "Partial" in text[first_exchange:]


def test_large_samples_warn_and_empty_tables_are_empty(spark):
    with pytest.warns(UserWarning, match=EARLY_LIMIT):
        sample_per_day(shown(spark), 5000, 1, key=("key",))
    assert sample_per_day(shown(spark).where("false"), 3, 1, key=("key",)).collect() == []
