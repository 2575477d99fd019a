import pytest
from pyspark.sql import functions as F

from trailpack.operators import asked
from trailpack.operators.asked import asked_filter, of_asked_customers, words_for


def people(spark, start, n, step=1):
    return spark.range(start, start + n * step, step, 4).select(F.col("id").alias("customer_id"))


def passed(spark, asked_rows, unasked):
    return of_asked_customers(unasked, asked_rows).count()


@pytest.mark.parametrize("n", [1000, 100_000, 4_000_000])
def test_few_others_pass_whatever_is_asked(spark, n):
    contexts = people(spark, 0, n)
    assert passed(spark, contexts, people(spark, 0, min(n, 50_000))) == min(n, 50_000)
    assert passed(spark, contexts, people(spark, 10**10, 200_000, 3)) < 0.05 * 200_000


def test_size_follows_the_number_up_to_a_bound(spark, monkeypatch):
    def words(n):
        return people(spark, 0, 1).select(words_for(people(spark, 0, n)).alias("w")).first().w

    assert words(0) == words(10) == asked.LEAST_WORDS
    for n in (300_000, 2_000_000):
        assert 0.8 * n * asked.BITS_EACH <= 64 * words(n) <= 2.4 * n * asked.BITS_EACH
    monkeypatch.setattr(asked, "MOST_WORDS", 1 << 15)
    assert words(2_000_000) == 1 << 15
    # Too small for what is asked: nothing that is asked for is lost.
    assert passed(spark, people(spark, 0, 2_000_000), people(spark, 0, 10_000, 100)) == 10_000


def test_null_and_no_customers(spark):
    none = spark.createDataFrame([(None,), (None,)], "customer_id bigint")
    assert passed(spark, none, people(spark, 0, 100).unionByName(none)) == 0
    assert passed(spark, people(spark, 0, 0), people(spark, 0, 100)) == 0
    rows = asked_filter(none, F.lit(asked.LEAST_WORDS).cast("bigint")).first()["rows"]
    assert len(rows) == asked.LEAST_WORDS // asked.ROW and {len(r) for r in rows} == {asked.ROW}
