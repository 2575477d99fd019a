"""Which customers are asked for: a filter whose size follows their number, looked up where the actions are scanned.

A semi join would need a broadcast of all asked customers, or leave the actions clustered by customer with a hot one in one task. Here
a customer has one word of 64 bits, and four bits in it (a blocked Bloom filter). It never loses an asked customer; with
some twelve bits for each, it lets one or two in a hundred others through.

The filter is one value of at most ``MOST_WORDS`` words, 64 MB: that bounds what reaches the driver and the tasks, and is enough for some
forty million customers. With more it lets more through, and those are dropped where customers meet their contexts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits per asked customer, and bits that each of them sets.
BITS_EACH, SET_EACH = 12, 4
#: Words of 64 bits: least (an eighth of a megabyte) and most, both powers of two.
LEAST_WORDS, MOST_WORDS = 1 << 14, 1 << 23
#: Words that are kept together; the filter is an array of such rows.
ROW = 1 << 10

_CUSTOMER = "cast(customer_id AS bigint)"


def _word(words: Column) -> Column:
    return F.pmod(F.xxhash64(F.expr(_CUSTOMER)), words)


def _mask() -> Column:
    """The bits of a customer within its word, from another hash than the word's."""
    mask = F.lit(0).cast("bigint")
    for i in range(SET_EACH):
        mask = mask.bitwiseOR(F.expr(f"shiftleft(1L, cast((shiftright(xxhash64({_CUSTOMER}, 1), {6 * i})) & 63 AS int))"))
    return mask


def words_for(contexts: DataFrame) -> Column:
    """A power of two, from the approximate number of asked customers, as a subquery."""
    wanted = F.approx_count_distinct(F.expr(_CUSTOMER)) * F.lit(BITS_EACH / 64)
    power = F.ceil(F.log2(F.greatest(wanted, F.lit(1.0)))).cast("int")
    words = F.least(F.greatest(F.pow(F.lit(2.0), power).cast("bigint"), F.lit(LEAST_WORDS)), F.lit(MOST_WORDS))
    return contexts.agg(words.cast("bigint").alias("words")).scalar()


def asked_filter(contexts: DataFrame, words: Column) -> DataFrame:
    """One row, one array of rows of ``ROW`` words."""
    asked = contexts.where("customer_id IS NOT NULL").select(_word(words).alias("word"), _mask().alias("set"))
    every = contexts.sparkSession.range(MOST_WORDS // ROW).where(F.col("id") < words / ROW)
    blank = every.select(F.explode(F.sequence(F.col("id") * ROW, F.col("id") * ROW + (ROW - 1))).alias("word"), F.lit(0).cast("bigint").alias("set"))
    dense = asked.unionByName(blank).groupBy("word").agg(F.bit_or("set").alias("set"))
    rows = dense.groupBy(F.shiftright("word", 10).alias("row")).agg(F.sort_array(F.collect_list(F.struct("word", "set")))["set"].alias("sets"))
    return rows.agg(F.sort_array(F.collect_list(F.struct("row", "sets")))["sets"].alias("rows"))


def of_asked_customers(actions: DataFrame, contexts: DataFrame) -> DataFrame:
    """The actions of customers with a context, and few others, without a join or a shuffle of actions."""
    words = words_for(contexts)
    word, mask = _word(words), _mask()
    row = F.get(asked_filter(contexts, words).scalar(), F.shiftright(word, 10).cast("int"))
    held = F.get(row, word.bitwiseAND(F.lit(ROW - 1)).cast("int"))
    return actions.where(F.col("customer_id").isNotNull() & (held.bitwiseAND(mask) == mask))
