"""Best-fit decreasing packing of tokenised documents into sequences of a fixed length.

Piece lengths are whole numbers up to the sequence length, so the number of pieces of each length says all that
best-fit decreasing needs: the plan over the whole corpus is made from at most ``length`` counts. A segment tree over
the remaining capacities finds the tightest class of open sequences; sequences with equal contents stay together as
one range of numbers. Each piece then takes its place in the plan from its rank among the pieces of its length.

Defined results: a null text is empty, and an empty text is one piece that holds the end id alone. Repeated rows and a null
doc_id are packed like others. Other columns are ignored. Without documents there are no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, tokenizer_path

END_ID = 2
#: Pieces of one length that one task ranks, on average.
RANKED_TOGETHER = 100_000

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of n ids: all but the first are full."""
    first = n if n <= length else n % length or length
    return [(0, first)] + [(at, length) for at in range(first, n, length)]


def pieces_of(documents: DataFrame, path: str, length: int) -> DataFrame:
    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = encoder(path).encode, END_ID.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = encode(text) + end
                for k, (start, n) in enumerate(cut(len(ids) // 4, length)):
                    rows.append((doc_id, k, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)])))
            made = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Null ids travel as null, not as floating-point numbers.
    return texts.mapInArrow(_with_ids(pieces), PIECES)


def _with_ids(function):
    """``function`` over pandas batches whose doc_id is a nullable integer."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        frames = (b.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get) for b in batches)
        for made in function(frames):
            yield pa.RecordBatch.from_pandas(made, schema=schema, preserve_index=False)

    return run


class OpenSequences:
    """Ranges of open sequences by remaining capacity; the segment tree counts the ranges below each node."""

    def __init__(self, length: int):
        self.size = 1 << length.bit_length()
        self.tree = [0] * (2 * self.size)
        self.ranges: dict[int, list[tuple[int, int]]] = {}

    def put(self, capacity: int, first: int, n: int) -> None:
        if n:
            self.ranges.setdefault(capacity, []).append((first, n))
            self._count(capacity, 1)

    def take(self, capacity: int) -> tuple[int, int]:
        self._count(capacity, -1)
        return self.ranges[capacity].pop()

    def _count(self, capacity: int, by: int) -> None:
        i = self.size + capacity
        while i:
            self.tree[i] += by
            i //= 2

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open sequence has."""
        i = self.size + need
        while not self.tree[i]:
            while i & 1:  # a right child: nothing further right below its parent
                i //= 2
            if i == 0:
                return None
            i += 1
            if i & (i - 1) == 0:  # beyond the last node of a level
                return None
        while i < self.size:
            i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.size


def plan(counts: dict[int, int], length: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over all pieces, by counts.

    Rows (length, from_rank, to_rank, first_sequence, per_sequence, offset): of the pieces of that length, those with ranks in
    [from_rank, to_rank) fill sequences from first_sequence on, per_sequence in each, from that offset on.
    """
    spaces, rows, made = OpenSequences(length), [], 0
    for size in sorted(counts, reverse=True):
        rank, left = 0, counts[size]
        while left:
            capacity = spaces.tightest(size)
            if capacity is None:
                capacity, n = length, math.ceil(left / (length // size))
                first, made = made, made + n
            else:
                first, n = spaces.take(capacity)
            # No open sequence is between size and capacity, so the next piece goes to the same one while it fits.
            each = capacity // size
            full = min(n, left // each)
            if full:
                rows.append((size, rank, rank + full * each, first, each, length - capacity))
                spaces.put(capacity - each * size, first, full)
                rank, left, first, n = rank + full * each, left - full * each, first + full, n - full
            if n and 0 < left < each:
                rows.append((size, rank, rank + left, first, left, length - capacity))
                spaces.put(capacity - left * size, first, 1)
                rank, left, first, n = rank + left, 0, first + 1, n - 1
            spaces.put(capacity, first, n)
    return rows


def pack(documents: DataFrame, length: int = 1024, path: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece."""
    spark = documents.sparkSession
    pieces = stored(pieces_of(documents, path or tokenizer_path(), length))
    buckets = max(1, math.ceil(pieces.count() / RANKED_TOGETHER))
    pieces = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = pieces.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = stored(counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    # At most ``length`` rows.
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.createDataFrame(
        plan(totals, length), "length long, from_rank long, to_rank long, first long, each long, at long"
    )
    own = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = pieces.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("own") + F.col("before"))
    # The plan's size is bounded by the sequence length, whatever the corpus.
    placed = ranked.join(
        F.broadcast(places.withColumnRenamed("length", "size")),
        (F.col("length") == F.col("size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")),
    )
    within = F.col("rank") - F.col("from_rank")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first") + F.floor(within / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("at") + within % F.col("each") * F.col("length")).alias("offset"),
    )
