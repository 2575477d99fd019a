"""Chat formatting: logged snapshots of a growing conversation collapse into the longest one, which is rendered.

A conversation's turns are ordered by (turn, role, text). Its prefix of k turns has as hash the XOR of k turn hashes,
each of which holds its place. A conversation goes if its own hash is that of a shorter prefix of another one (anti-join),
or if an equal conversation has a smaller conv_id. DataFrame functions only.

Defined results: turns with a null conv_id form one conversation; equal turns and repeated rows are turns of their own;
a null role or text differs from an empty one when conversations are compared and is empty when rendered; further
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

# The marks of the chat format.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(conversations: DataFrame) -> DataFrame:
    """One row per turn: its place, the turns of its conversation, and the hash (two of 64 bits) of all turns up to it."""
    own = Window.partitionBy("conv_id")
    order = own.orderBy("turn", "role", "text")
    parts = ("place", F.isnull("role"), "role", F.isnull("text"), "text")
    running = lambda c: F.bit_xor(c).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        conversations.select("conv_id", "turn", "role", "text")
        .withColumns({"place": F.row_number().over(order).cast("long"), "n_turns": F.count(F.lit(1)).over(own)})
        .withColumns({"h1": F.xxhash64(*parts), "h2": F.xxhash64(F.lit("second"), *parts)})
        .withColumns({"h1": running("h1"), "h2": running("h2")})
    )


def format_chats(conversations: DataFrame) -> DataFrame:
    """Per maximal conversation: conv_id, n_turns, n_copies (equal ones, itself included), rendered."""
    turns = stored(prefixes(conversations))
    whole = (
        turns.where("place = n_turns")
        .groupBy("n_turns", "h1", "h2")
        .agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    )
    shorter = turns.where("place < n_turns").select(F.col("place").alias("n_turns"), "h1", "h2").distinct()
    maximal = whole.join(shorter, ["n_turns", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("kept_id"), "n_copies")
    lines = F.transform(
        F.sort_array("turns"),
        lambda t: F.concat(F.lit(OPEN), F.coalesce(t["role"], F.lit("")), F.lit("\n"), F.coalesce(t["text"], F.lit("")), F.lit(CLOSE + "\n")),
    )
    return (
        turns.join(maximal, turns["conv_id"].eqNullSafe(maximal["kept_id"]))
        .groupBy("conv_id", "n_turns", "n_copies")
        .agg(F.collect_list(F.struct("place", "role", "text")).alias("turns"))
        .select("conv_id", "n_turns", "n_copies", F.concat_ws("", lines).alias("rendered"))
    )
