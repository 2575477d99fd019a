"""SimHash near-duplicates with Golay-code fuzzy hashing.

A fingerprint's 64 bits are three segments of at most 23 bits. The binary Golay code of length 23 is perfect: every segment decodes to
one codeword, of which 12 bits are the index. A segment's near indices are those of itself and of its neighbours at one bit; two
segments at one bit share an index. Three differing bits over three segments leave either

* one segment equal and another at one bit or none: the key is the equal segment and an index of the other; or
* one bit in each: the key is an index of the first, one of the second, and the half of the third that is equal.

Distinct fingerprints meet by key in sorted runs. In a run, links of three bits or fewer are verified and a spanning forest of them is
passed on, never all pairs; components of the forest are the components of all links.

Defined results: a text without words, or null, has fingerprint zero and is linked like any other. Rows that repeat a doc_id have one
row each. Null doc_ids are not counted for component_id; a group of none but null ids has a null component_id. Other columns are
ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored

SEED, SHINGLE, MOST = 42, 3, 3
#: Lowest bit and width of each segment.
SEGMENTS = ((0, 21), (21, 21), (42, 22))
# The generator polynomial of the binary Golay code, and its length and check bits.
GENERATOR, LENGTH, CHECKS = 0xC75, 23, 11


def fingerprint(text: str | None) -> int:
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words))) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(SHINGLE, len(words))
    digest, n = xxhash.xxh64_intdigest, len(words) - k + 1
    spans = zip(starts[:n].tolist(), ends[k - 1 :].tolist(), strict=True)
    return majority(np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n))


def majority(hashes: np.ndarray) -> int:
    """The bits set in more than half of the hashes."""
    n, block = len(hashes), 255
    padded = np.zeros(-(-n // block) * block, "<u8")
    padded[:n] = hashes
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.reshape(-1, block, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


@functools.cache
def syndrome_tables() -> tuple[list[np.ndarray], np.ndarray]:
    """Syndromes of each byte of a 23-bit vector, and the error of each syndrome."""

    def syndrome(v: int) -> int:
        for bit in range(LENGTH - 1, CHECKS - 1, -1):
            if v >> bit & 1:
                v ^= GENERATOR << (bit - CHECKS)
        return v

    parts = [np.array([syndrome(v << shift) if v << shift < 1 << LENGTH else 0 for v in range(256)], np.int64) for shift in (0, 8, 16)]
    single = [0] + [1 << i for i in range(LENGTH)]
    errors = np.zeros(1 << CHECKS, np.int64)
    for e in {a | b | c for a in single for b in single for c in single}:
        errors[syndrome(e)] = e
    return parts, errors


def index(v: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword next to each 23-bit vector."""
    parts, errors = syndrome_tables()
    s = parts[0][v & 255] ^ parts[1][v >> 8 & 255] ^ parts[2][v >> 16]
    return (v ^ errors[s]) >> CHECKS


def near(segment: np.ndarray, width: int) -> list[np.ndarray]:
    """Columns of the indices of each segment and its neighbours; -1 where a column repeats an earlier one."""
    flips = np.array([0] + [1 << i for i in range(width)], np.int64)
    found = np.sort(index(segment[:, None] ^ flips[None, :]), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    found = -np.sort(-found, axis=1)
    return [found[:, j] for j in range(int((found >= 0).sum(axis=1).max(initial=0)))]


def keys(prints: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row numbers) for all keys of the fingerprints."""
    parts = [(prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    nears = [near(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    family = 0
    for i in range(3):
        for j in range(3):
            if i != j:
                for column in nears[j]:
                    rows = np.flatnonzero(column >= 0)
                    yield (family << 40) | (parts[i][rows] << 12) | column[rows], rows
                family += 1
    for half in (parts[2] & 0x7FF, parts[2] >> 11):
        for a in nears[0]:
            for b in nears[1]:
                rows = np.flatnonzero((a >= 0) & (b >= 0))
                yield (family << 40) | (half[rows] << 24) | (a[rows] << 12) | b[rows], rows
        family += 1


def emit_keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        all_prints = batch["print"].to_numpy(np.int64)
        for start in range(0, len(all_prints), 2000):
            prints = all_prints[start : start + 2000]
            found = list(keys(prints.view(np.uint64)))
            yield pd.DataFrame({"key": np.concatenate([k for k, _ in found]), "print": prints[np.concatenate([r for _, r in found])]})


def forest(prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of a spanning forest over the fingerprints at MOST bits or fewer: each found one looks among those left."""
    left = np.unique(prints)
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            close = np.bitwise_count((left ^ x).view(np.uint64)) <= MOST
            for y in left[close].tolist():
                yield int(x), y
                queue.append(y)
            left = left[~close]


def link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within runs of equal keys, from rows sorted by key; a run may go on in the next batch."""
    key_rest, print_rest = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def links(key: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        edges = np.flatnonzero(np.diff(key)) + 1
        bounds = np.concatenate([[0], edges, [len(key)]])
        several = np.flatnonzero(np.diff(bounds) > 1)
        found = [e for i in several for e in forest(prints[bounds[i] : bounds[i + 1]])]
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    for batch in batches:
        key = np.concatenate([key_rest, batch["key"].to_numpy(np.int64)])
        prints = np.concatenate([print_rest, batch["print"].to_numpy(np.int64)])
        cut = np.searchsorted(key, key[-1]) if len(key) else 0
        yield links(key[:cut], prints[:cut])
        key_rest, print_rest = key[cut:], prints[cut:]
    yield links(key_rest, print_rest)


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id, print: the fingerprint as a signed number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            prints = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": batch["id"], "print": prints})

    # doc_id travels as text, so that null and large ids stay what they are.
    made = documents.select(F.col("doc_id").cast("string").alias("id"), "text").mapInPandas(run, "id string, print long")
    return made.select(F.col("id").cast("long").alias("doc_id"), "print")


def near_duplicates(documents: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id: the smallest doc_id that links reach."""
    prints = stored(fingerprints(documents))
    classes = stored(prints.groupBy("print").agg(F.min("doc_id").alias("least")))
    keyed = classes.select("print").mapInPandas(emit_keys, "key long, print long")
    runs = keyed.repartition(F.col("key")).sortWithinPartitions("key")
    links = runs.mapInPandas(link_runs, "a long, b long")
    labels = components(links)
    component = F.coalesce("component", "print")
    known = stored(classes.join(labels.withColumnRenamed("node", "print"), "print", "left").select("print", "least", component.alias("component")))
    roots = known.groupBy("component").agg(F.min("least").alias("component_id"))
    by_print = known.join(roots, "component").select("print", "component_id")
    return prints.join(by_print, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents whose doc_id is their component's, which is one of each component.

    A doc_id that rows repeat counts as one document: it stays if it is the least of any of its rows' components, with one
    row. Rows with a null doc_id stay.
    """
    ids = near_duplicates(documents)
    least = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    gone = ids.groupBy("doc_id").agg(F.max(least).alias("stays")).where("not stays").select("doc_id")
    kept = documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
    if documents.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        # Of rows that repeat a doc_id, the one with the least text.
        row = F.struct(*(F.col(f"`{c}`") for c in kept.columns)).alias("row")
        known = kept.where("doc_id is not null").select("doc_id", row).groupBy("doc_id")
        known = known.agg(F.min_by("row", F.struct(F.coalesce("row.text", F.lit("")), F.xxhash64("row"))).alias("row")).select("row.*")
        kept = known.unionByName(kept.where("doc_id is null"))
    return kept
