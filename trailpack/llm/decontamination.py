"""Benchmark decontamination: MinHash containment search for short test items inside long documents.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``, with A-Z in lower case; a shingle is five of them (a shorter item or
document is one shingle). An item is contained in a document that has at least ``THRESHOLD`` of the item's distinct shingles.

Items are partitioned by size, in powers of two of their distinct shingles. All items of a partition have sketches of the same
length: their floor((1 - THRESHOLD) * largest size) + 1 least shingle hashes, or all of them. A document that contains an item lacks
fewer shingles than its sketch has, so it has one of the sketch at least: the search misses no pair. Documents are not sketched,
however long: all their shingles are looked up among the sketches. Candidate pairs are verified by the exact share of the item's
shingles, by their words.

The items are the query set, searched against all documents in blocks of about ``BLOCK_BYTES`` of text; a block goes to all tasks.

Defined results: items and documents without words (or null) match nothing. Repeated items and documents match each. Pairs are found
for null ids too. Columns other than ids and text are ignored.
"""

from __future__ import annotations

import functools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, THRESHOLD = 5, 0.8
BLOCK_BYTES = 8_000_000
#: Bits of the filter in front of the sketches' table.
FILTER_BITS = 24
#: Odd numbers whose powers, modulo 2 to the 64, make a word's hash from its bytes.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

MATCH = "doc_id string, item_id string, n_shared long, n_item long, containment double"


def powers(base: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, base, np.uint64), dtype=np.uint64)])


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Word and shingle hashes of a text's bytes, by array operations."""

    def __init__(self) -> None:
        self.up, self.down = powers(BASE, 1 << 16), powers(INVERSE, 1 << 16)

    def words(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each word of lower-cased bytes."""
        raw = np.frombuffer(data, np.uint8)
        inside = ~((raw == 32) | ((raw >= 9) & (raw <= 13)))
        edges = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        if not len(starts):
            return np.zeros(0, np.uint64), starts, ends
        if len(raw) >= len(self.up):
            self.up, self.down = powers(BASE, 2 * len(raw)), powers(INVERSE, 2 * len(raw))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], dtype=np.uint64)])
        return mixed((sums[ends] - sums[starts]) * self.down[starts]), starts, ends

    def shingles(self, data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, start, end) of each shingle; one of all words if there are fewer than SHINGLE."""
        hashes, starts, ends = self.words(data)
        k = min(SHINGLE, len(hashes))
        if not k:
            return hashes, starts, ends
        n = len(hashes) - k + 1
        found = np.full(n, k, np.uint64)
        for j in range(k):
            found = mixed(found + hashes[j : j + n])
        return found, starts[:n], ends[k - 1 :]


def spelled(data: bytes, start: int, end: int) -> bytes:
    return b" ".join(data[start:end].split())


def sketch_size(n: int) -> int:
    """Sketch length of an item with n distinct shingles, by the largest size of its partition."""
    largest = 1 << max(0, n - 1).bit_length()
    return min(n, math.floor((1 - THRESHOLD) * largest + 1e-9) + 1)


class Sketches:
    """Items of a block: their shingles, and the table from sketch hashes to items."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        hasher = Hasher()
        self.items: list[tuple[str | None, set[bytes]]] = []
        by_hash: dict[int, list[int]] = defaultdict(list)
        for item_id, text in items:
            data = (text or "").encode().lower()
            hashes, starts, ends = hasher.shingles(data)
            own = {spelled(data, s, e): int(h) for h, s, e in zip(hashes, starts.tolist(), ends.tolist(), strict=True)}
            if own:
                for h in sorted(set(own.values()))[: sketch_size(len(own))]:
                    by_hash[h].append(len(self.items))
                self.items.append((item_id, set(own)))
        self.by_hash = dict(by_hash)
        self.hashes = np.array(sorted(by_hash), np.uint64)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[self.hashes >> np.uint64(64 - FILTER_BITS)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Positions of the hashes that a sketch has."""
        some = np.flatnonzero(self.filter[hashes >> np.uint64(64 - FILTER_BITS)])
        at = np.searchsorted(self.hashes, hashes[some])
        return some[self.hashes[np.minimum(at, len(self.hashes) - 1)] == hashes[some]] if len(self.hashes) else some

    def matches(self, hasher: Hasher, text: str) -> Iterator[tuple[str | None, int, int]]:
        """(item_id, shared shingles, shingles) of the items that the text contains."""
        data = text.encode().lower()
        hashes, starts, ends = hasher.shingles(data)
        near = sorted({i for h in np.unique(hashes[self.hits(hashes)]).tolist() for i in self.by_hash[h]})
        if not near:
            return
        # A document's shingles are spelled out only where some item may have them.
        wanted = np.array(sorted({int(h) for h in self.item_hashes(hasher, near)}), np.uint64)
        at = np.flatnonzero(np.isin(hashes, wanted))
        own = {spelled(data, starts[i], ends[i]) for i in at.tolist()}
        for i in near:
            item_id, shingles = self.items[i]
            shared = len(shingles & own)
            if shared >= THRESHOLD * len(shingles) - 1e-9:
                yield item_id, shared, len(shingles)

    def item_hashes(self, hasher: Hasher, numbers: list[int]) -> Iterator[int]:
        for i in numbers:
            for s in self.items[i][1]:
                yield hasher.shingles(s)[0][0]


def item_blocks(benchmark: DataFrame) -> Iterator[Broadcast]:
    """The items as broadcast lists of (item_id, text), each of about BLOCK_BYTES."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = max(1, math.ceil(size / BLOCK_BYTES))
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        yield benchmark.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in rows])


def find_contained(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment: the pairs at THRESHOLD or more."""
    # Ids travel as text, so that null and large ones stay what they are.
    texts = documents.where("text is not null").select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def search(batches: Iterator[pd.DataFrame], block: Broadcast) -> Iterator[pd.DataFrame]:
        sketches, hasher = Sketches(block.value), Hasher()
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                rows += [(doc_id, item, n, of, n / of) for item, n, of in sketches.matches(hasher, text)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in MATCH.split(", ")])

    found = [texts.mapInPandas(functools.partial(search, block=block), MATCH) for block in item_blocks(benchmark)]
    pairs = functools.reduce(DataFrame.unionByName, found)
    ids = (F.col(c).cast("long").alias(c) for c in ("doc_id", "item_id"))
    return pairs.select(*ids, "n_shared", "n_item", "containment")


def clean_of(block: Broadcast):
    """A column function of the text: whether it contains no item of the block."""

    @F.pandas_udf("boolean")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        sketches, hasher = Sketches(block.value), Hasher()
        for texts in batches:
            yield pd.Series([next(sketches.matches(hasher, t or ""), None) is None for t in texts], dtype=bool)

    return clean


def without_contained(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that contain no item, judged row by row where they lie."""
    for block in item_blocks(benchmark):
        documents = documents.where(clean_of(block)("text"))
    return documents
