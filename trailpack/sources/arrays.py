"""Elements of JSON arrays in files of any size, read by many tasks.

A file that holds one JSON array has no line that means anything, so no reader can begin in its middle. But what a piece of it does is
known without what comes before, up to one bit and a number: whether it begins inside a string, and how deep. Each file is read as the
chunks that end with a closing brace, wherever its splits fall. For both answers to the first question a chunk has its change of
depth, and its number of quotes tells which answer holds at its end. These small state maps are added up in file order inside each split,
the splits' sums are added up in file order over the file (a row per split), and then every chunk knows where it begins. An element
ends with the brace that leads back to the depth of the array.

Defined results: empty arrays and blank files have no elements. An object that is a file of its own is one element. Elements that are no
objects go with the one after them and spoil it, for the parser to reject; what stands after the last object, also of an
unfinished file, is an element by itself. A file with several JSON values raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sinks.writers import stored

CLOSING = "}"
# Text in quotes, also where the quote is not closed; and the end of one that was opened before.
_QUOTED = r'(?s)"(?:[^"\\]++|\\.)*+(?:"|$)'
_QUOTED_BEFORE = r'(?s)^(?:[^"\\]++|\\.)*+(?:"|$)'
_ESCAPED = r"(?s)\\."
# Two values side by side without a comma: a bracket closes and another opens.
_SIDE_BY_SIDE = r"[}\]]\s*[{\[]"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per closing brace: file, block (where its split begins), at (its order), value, and its state maps."""
    raw = spark.read.option("lineSep", CLOSING).text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.col("_metadata.file_size").alias("size"),
        F.monotonically_increasing_id().alias("at"),
        "value",
    )
    outside = F.regexp_replace("value", _QUOTED, "")
    inside = F.regexp_replace(F.regexp_replace("value", _QUOTED_BEFORE, ""), _QUOTED, "")
    cut = raw.select(
        "*", outside.alias("bare_0"), inside.alias("bare_1"), (_count(F.regexp_replace("value", _ESCAPED, ""), '"') % 2).alias("turns")
    )

    def side_by_side(bare: str) -> Column:
        return F.regexp_like(F.concat(F.lit(CLOSING), bare), F.lit(_SIDE_BY_SIDE))

    return cut.select(
        "file", "block", "size", "at", "value", "turns",
        *[(_count(F.col(f"bare_{s}"), "[{") - _count(F.col(f"bare_{s}"), "]}")).alias(f"depth_{s}") for s in (0, 1)],
        *[side_by_side(f"bare_{s}").alias(f"several_{s}") for s in (0, 1)],
        F.regexp_like("bare_0", F.lit(_SIDE_BY_SIDE)).alias("several_first"),
        F.regexp_like("value", F.lit(r"^\s*\[")).alias("opens"),
        (F.octet_length("value") + 1).alias("bytes"),
    )


def _placed(held: DataFrame, *extra: str) -> DataFrame:
    """Chunks with, for both states s in which their split may begin: their own state, and the depth added before them and after."""
    in_split = Window.partitionBy("file", "block").orderBy("at")
    before, until = in_split.rowsBetween(Window.unboundedPreceding, -1), in_split.rowsBetween(Window.unboundedPreceding, 0)
    turned = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2
    rows = held.select("file", "block", "size", "at", "turns", "depth_0", "depth_1", "bytes", "opens", *extra, turned.alias("turned"))
    for s in (0, 1):
        own = (F.col("turned") + s) % 2
        ended = (own + F.col("turns")) % 2
        # The closing brace counts where it is outside of strings.
        change = F.when(own == 0, F.col("depth_0")).otherwise(F.col("depth_1")) - F.when(ended == 0, 1).otherwise(0)
        rows = rows.withColumn(f"change_{s}", change)
    return rows.select("*", *[F.sum(f"change_{s}").over(until).alias(f"after_{s}") for s in (0, 1)])


def _splits(rows: DataFrame) -> DataFrame:
    """One row per split: the state and depth it begins with; ``finished`` says whether the file's last chunk has its brace."""
    sums = rows.groupBy("file", "block").agg(
        F.sum("turns").alias("turns"), *[F.sum(f"change_{s}").alias(f"change_{s}") for s in (0, 1)], F.sum("bytes").alias("bytes"),
        F.max("size").alias("size"), F.max("at").alias("last"), F.min_by("opens", "at").alias("opens"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("file")
    state = F.coalesce(F.sum("turns").over(before), F.lit(0)) % 2
    staged = sums.withColumn("state", state)
    staged = staged.withColumn("change", F.when(F.col("state") == 0, F.col("change_0")).otherwise(F.col("change_1")))
    return staged.select(
        F.col("file").alias("f"), F.col("block").alias("b"), "state",
        F.coalesce(F.sum("change").over(before), F.lit(0)).alias("depth"),
        F.max_by("last", "block").over(whole).alias("last"),
        F.min("block").over(whole).alias("first_block"),
        # Elements stand at depth 1 of an array; a file without one is an element at depth 0.
        F.when(F.min_by("opens", "block").over(whole), 1).otherwise(0).alias("base"),
        (F.sum("bytes").over(whole) == F.col("size")).alias("finished"),
    )


def array_elements(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, value): the text of each element of the arrays in the files."""
    held = stored(chunks(spark, path))
    splits = stored(_splits(_placed(held)))
    same_split = (F.col("file") == F.col("f")) & (F.col("block") == F.col("b"))

    begun = _placed(held, "several_0", "several_1", "several_first").join(splits, same_split)
    inside = (F.col("turned") + F.col("state")) % 2
    first = (F.col("block") == F.col("first_block")) & (F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) == 1)
    wrong = F.when(inside == 1, F.col("several_1")).when(F.col("first"), F.col("several_first")).otherwise(F.col("several_0"))
    several = begun.withColumn("first", first).where(wrong).select("file").limit(1).collect()
    if several:
        raise ValueError(f"{several[0]['file']} holds several JSON values; read it with layout='lines'")

    joined = _placed(held, "value").drop("opens").join(splits, same_split)
    ended = (F.col("turned") + F.col("state") + F.col("turns")) % 2 == 0
    depth = F.col("depth") + F.when(F.col("state") == 0, F.col("after_0")).otherwise(F.col("after_1"))
    open_end = (F.col("at") == F.col("last")) & ~F.col("finished")
    marked = joined.select(
        "file", "block", "at",
        F.when(open_end, F.col("value")).otherwise(F.concat("value", F.lit(CLOSING))).alias("text"),
        (~open_end & ended & (depth <= F.col("base"))).alias("ends"),
    )
    # An element is named by the last end before it: in its split, or in one of the splits before.
    in_split = Window.partitionBy("file", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    end_at = F.when(F.col("ends"), F.struct("block", "at"))
    ends = marked.groupBy("file", "block").agg(F.max(end_at).alias("end"))
    over_file = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    earlier = ends.select(F.col("file").alias("f"), F.col("block").alias("b"), F.max("end").over(over_file).alias("earlier"))
    named = marked.withColumn("own", F.max(end_at).over(in_split)).join(earlier, same_split)
    element = F.coalesce("own", "earlier", F.struct(F.lit(-1).cast("bigint").alias("block"), F.lit(-1).cast("bigint").alias("at")))
    parts = named.select("file", element.alias("element"), F.struct("block", "at", "text").alias("part")).groupBy("file", "element")
    whole = parts.agg(F.array_join(F.transform(F.sort_array(F.collect_list("part")), lambda p: p["text"]), "").alias("text"))
    first_one = F.col("element.block") == -1
    value = F.when(first_one, F.regexp_replace("text", r"^\s*\[?\s*", "")).otherwise(F.regexp_replace("text", r"^[\s,]*", ""))
    # After the last element nothing but the closing bracket is left.
    return whole.select("file", value.alias("value")).where(~F.regexp_like("value", F.lit(r"^\s*\]?\s*$")))
