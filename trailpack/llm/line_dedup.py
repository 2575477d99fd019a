"""Line de-duplication: documents probe compact arrays that a sharded minimal perfect hash indexes.

A line's key has all white space of ``[\\x20\\x09-\\x0D]`` stripped at both ends and A-Z in lower case. Keys of at least
``min_chars`` code points in at least ``min_docs`` documents lose all their lines but those of the largest doc_id.

1. Keys (as two 64-bit hashes) are counted by document, with partial sums before the shuffle.
2. The repeated keys are dealt into shards of about ``SHARD_KEYS``. A shard's minimal perfect hash is a stack of bit arrays: a
   key that is alone at its bit of a level stays there, the others try the next level; a key's index is the number of bits set
   before its own. Three arrays hold, at that index, a fingerprint (the second hash), the number of documents and the largest
   doc_id.
3. A document's distinct keys go to their shards as bare hashes, look up the arrays, and come back as lists of keys to drop.
   Shards that many documents probe are copied, and their probes split over the copies.

Defined results: a null or empty text is one empty line. Rows with a null doc_id count for no key and lose no line. Rows that
repeat a doc_id count as one document and lose the same lines. Columns other than doc_id and text pass through untouched.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

SPACES = " \t\n\x0b\x0c\r"
SHARD_KEYS = 50_000
#: Probes that one task looks up at a time, on average.
PROBES = 400_000
#: Bits of a level for each key that is left.
SPREAD = 2

INDEX = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, holders binary"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACES)))


def mixed(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    """A hash of both halves of a key for each level, by the finaliser of splitmix64 (its fixed constants)."""
    x = h1 + (h2 | np.uint64(1)) * np.uint64(2 * level + 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash of distinct pairs of 64-bit hashes, as bit arrays one below the other."""

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(bits, dtype=np.int64)])

    @classmethod
    def of(cls, h1: np.ndarray, h2: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(h1):
            size = max(8, SPREAD * len(h1))
            at = (mixed(h1, h2, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            left = ~alone[at]
            h1, h2 = h1[left], h2[left]
        return cls(sizes, np.concatenate(levels) if levels else np.zeros(0, bool))

    def index(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        """Index of each key; -1, or any index, for a key that is not in it."""
        found, open_, start = np.full(len(h1), -1, np.int64), np.arange(len(h1)), 0
        for level, size in enumerate(self.sizes):
            at = start + (mixed(h1[open_], h2[open_], level) % np.uint64(size)).astype(np.int64)
            here = self.bits[at]
            found[open_[here]] = self.before[at[here]]
            open_, start = open_[~here], start + size
        return found


def unsigned(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64).view(np.uint64)


def build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    """One shard's arrays from its distinct keys (shard, h1, h2, docs, holder)."""
    h1, h2 = unsigned(keys["h1"]), unsigned(keys["h2"])
    hash_ = PerfectHash.of(h1, h2)
    at = hash_.index(h1, h2)
    arrays = np.empty(len(keys), np.uint64), np.empty(len(keys), np.int64), np.empty(len(keys), np.int64)
    for array, values in zip(arrays, (h2, keys["docs"], keys["holder"]), strict=True):
        array[at] = values
    packed = np.packbits(hash_.bits)
    row = (keys["shard"].iloc[0], hash_.sizes, packed.tobytes(), *(a.tobytes() for a in arrays))
    return pd.DataFrame([row], columns=["shard", "sizes", "bits", "fingerprints", "counts", "holders"])


def probe_shard(probes: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
    """(doc_id, h1) of the probes whose key is in the shard and is held by a larger doc_id."""
    if index.empty or probes.empty:
        return pd.DataFrame({"doc_id": [], "h1": []}, dtype="int64")
    row = index.iloc[0]
    sizes = [int(x) for x in row["sizes"]]
    hash_ = PerfectHash(sizes, np.unpackbits(np.frombuffer(row["bits"], np.uint8), count=sum(sizes)).astype(bool))
    fingerprints, holders = (np.frombuffer(row[n], t) for n, t in (("fingerprints", np.uint64), ("holders", np.int64)))
    h1, h2 = unsigned(probes["h1"]), unsigned(probes["h2"])
    at = hash_.index(h1, h2)
    hit = (at >= 0) & (fingerprints[at] == h2) & (holders[at] > probes["doc_id"].to_numpy())
    return probes.loc[hit, ["doc_id", "h1"]]


def hashed(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def dropped_keys(documents: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(doc_id, dropped): per document, the first hashes of the keys whose lines it loses. Documents without any are absent."""
    own = F.filter(F.transform(F.split("text", "\n", -1), line_key), lambda k: F.length(k) >= min_chars)
    h1, h2 = hashed(F.col("key"))
    keys = (
        documents.where("doc_id is not null and text is not null")
        .select("doc_id", F.explode(F.array_distinct(own)).alias("key"))
        .select("doc_id", h1.alias("h1"), h2.alias("h2"))
    )
    # Only rows that repeat a doc_id need the wider shuffle that makes (key, document) distinct.
    if documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        keys = keys.distinct()
    keys = stored(keys)
    repeated = stored(
        keys.groupBy("h1", "h2")
        .agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("holder"))
        .where(F.col("docs") >= min_docs)
    )
    shards = max(1, math.ceil(repeated.count() / SHARD_KEYS))
    shard = F.pmod(F.col("h1"), F.lit(shards)).cast("int")
    repeated = repeated.withColumn("shard", shard)
    index = stored(repeated.groupBy("shard").applyInPandas(build_shard, INDEX))
    # A shard's probes are the documents of its keys and its part of all other keys; so many copies keep a task's part small.
    most = repeated.groupBy("shard").agg(F.sum("docs").alias("n")).agg(F.max("n")).first()[0] or 0
    copies = max(1, math.ceil((most + keys.count() / shards) / PROBES))
    probes = keys.withColumns({"shard": shard, "copy": F.pmod(F.xxhash64("doc_id"), F.lit(copies)).cast("int")})
    copied = index.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    found = (
        probes.groupBy("shard", "copy")
        .cogroup(copied.groupBy("shard", "copy"))
        .applyInPandas(probe_shard, "doc_id long, h1 long")
    )
    return found.groupBy("doc_id").agg(F.collect_set("h1").alias("dropped"))


def with_kept_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(row, lines, kept): the document's columns as a struct, its lines, and those of them that stay."""
    drops = dropped_keys(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), min_chars, min_docs)
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"))
    lines = F.split(F.coalesce(F.col("row.text"), F.lit("")), "\n", -1)

    def stays(line: Column) -> Column:
        key = line_key(line)
        return (F.length(key) < min_chars) | ~F.array_contains("dropped", hashed(key)[0])

    return (
        rows.join(drops, "doc_id", "left")
        .select("row", "dropped", lines.alias("lines"))
        .select("row", "lines", F.when(F.isnull("dropped"), F.col("lines")).otherwise(F.filter("lines", stays)).alias("kept"))
    )


def dedup_lines(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents, with the lines that stay as their text; a null text stays null."""
    kept = with_kept_lines(documents, min_chars, min_docs)
    text = F.when(F.isnotnull("row.text"), F.concat_ws("\n", "kept"))
    return kept.select(*((text if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in documents.columns))


def line_report(documents: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256, and the kept_text itself."""
    return with_kept_lines(documents, min_chars, min_docs).select(
        "row.doc_id",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("kept")).cast("long").alias("n_dropped"),
        F.sha2(F.concat_ws("\n", "kept"), 256).alias("kept_sha256"),
        F.concat_ws("\n", "kept").alias("kept_text"),
    )
