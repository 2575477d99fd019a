"""Near copies that one SimHash of three-word shingles does not link: word fingerprints, Golay keys, exact shingles.

SimHash tells angles, and few changed words turn the vector of a text's shingles far, that of its words little. So a text has three
fingerprints of 64 bits over its distinct words. Of each, two of the three segments (``simhash.SEGMENTS``) make a key, as Golay indices of
themselves or a neighbour at one bit: fingerprints that differ in up to five bits share one in any case, those at six to ``MOST`` mostly.
In a run of equal keys a tree of the nearest fingerprints is passed on, never all pairs, and a link of the tree holds only if the
five-word shingles of both whole texts have a Jaccard similarity of ``SIMILARITY`` or more. Components are found as for ``simhash``.

Defined results: texts without words, or null, and rows with a null doc_id are no near copies and stay. Shorter texts than five words
have one shingle, all their words. Of a component the row with the least doc_id stays (of equal ones any, but one). Very long texts are
read whole. An empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, stored
from .simhash import SEGMENTS, majority, near

SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints of a text, and most differing bits of one in a link that is looked at.
PRINTS, MOST = 3, 10
#: Rows of a run that counts as short.
SHORT = 8


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: A-Z and ASCII white space only


def word_prints(text: str | None) -> list[int] | None:
    """The fingerprints of the distinct words; None without words."""
    import xxhash

    words = set(words_of(text))
    if not words:
        return None
    return [majority(np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))) for seed in range(PRINTS)]


def pair_keys(prints: np.ndarray, which: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(key, row numbers): indices of two segments, for all three pairs of segments."""
    parts = [(prints >> np.uint64(low)).astype(np.int64) & ((1 << width) - 1) for low, width in SEGMENTS]
    nears = [near(p, width) for p, (_, width) in zip(parts, SEGMENTS, strict=True)]
    for family, (i, j) in enumerate(((0, 1), (0, 2), (1, 2))):
        for a in nears[i]:
            for b in nears[j]:
                rows = np.flatnonzero((a >= 0) & (b >= 0))
                yield ((3 * which + family) << 40) | (a[rows] << 12) | b[rows], rows


def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """key, row, print of the texts that have words."""
    for batch in batches:
        for start in range(0, len(batch), 1000):
            part = batch.iloc[start : start + 1000]
            made = [(r, p) for r, p in zip(part["row"], map(word_prints, part["text"]), strict=True) if p is not None]
            rows = np.array([r for r, _ in made], np.int64)
            for which in range(PRINTS):
                prints = np.array([p[which] for _, p in made], np.uint64)
                found = list(pair_keys(prints, which)) if len(rows) else []
                if found:
                    at = np.concatenate([r for _, r in found])
                    yield pd.DataFrame({"key": np.concatenate([k for k, _ in found]), "row": rows[at], "print": prints[at].view(np.int64)})


def nearest_tree(rows: np.ndarray, prints: np.ndarray) -> Iterator[tuple[int, int]]:
    """Links of trees over the rows, each to the nearest fingerprint that is in a tree already, at MOST bits or fewer."""
    prints = prints.view(np.uint64)
    least = np.full(len(rows), 99)
    nearest = np.zeros(len(rows), np.int64)
    left = np.ones(len(rows), bool)
    for _ in range(len(rows)):
        x = int(np.argmin(np.where(left, least, 100)))
        if least[x] <= MOST:
            yield int(rows[nearest[x]]), int(rows[x])
        left[x] = False
        bits = np.bitwise_count(prints ^ prints[x])
        closer = left & (bits < least)
        least[closer], nearest[closer] = bits[closer], x


def link_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links within runs of equal keys, from rows sorted by key and row; a run may go on in the next batch."""
    rest = [np.zeros(0, np.int64)] * 3

    def links(key: np.ndarray, row: np.ndarray, prints: np.ndarray) -> pd.DataFrame:
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(key)) + 1, [len(key)]])
        # Most short runs are chance meetings without a link: all their pairs are looked at together, one distance in the run at a time.
        linked = np.diff(bounds) > SHORT
        run = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        for step in range(1, min(SHORT, len(key))):
            close = np.bitwise_count((prints[step:] ^ prints[:-step]).view(np.uint64)) <= MOST
            linked[run[step:][close & (run[step:] == run[:-step])]] = True
        found = set()
        for i in np.flatnonzero(linked):
            own = slice(bounds[i], bounds[i + 1])
            found.update((min(e), max(e)) for e in nearest_tree(row[own], prints[own]))
        return pd.DataFrame(list(found), columns=["a", "b"], dtype="int64")

    for batch in batches:
        joined = [np.concatenate([r, batch[c].to_numpy(np.int64)]) for r, c in zip(rest, ("key", "row", "print"), strict=True)]
        cut = int(np.searchsorted(joined[0], joined[0][-1])) if len(joined[0]) else 0
        yield links(*(x[:cut] for x in joined))
        rest = [x[cut:] for x in joined]
    yield links(*rest)


def shingles(text: str | None) -> set[bytes]:
    words = words_of(text)
    return {b" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))} if words else set()


def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) whose texts are at SIMILARITY."""
    for batch in batches:
        kept = []
        for i in range(batch.num_rows):
            x, y = (shingles(batch.column(c)[i].as_py()) for c in ("text_a", "text_b"))
            both = len(x & y)
            kept.append(both >= SIMILARITY * (len(x) + len(y) - both) > 0)
        yield pa.record_batch([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept, pa.bool_()))


def without_near_copies(documents: DataFrame) -> DataFrame:
    """One row of each component of near copies, and all other rows, with the columns of ``documents``."""
    held = stored(documents.select(F.struct("*").alias("all"), F.monotonically_increasing_id().alias("row")))
    texts = held.where("all.doc_id is not null and all.text is not null").select("row", F.col("all.text").alias("text"))
    keyed = texts.mapInPandas(emit, "key long, row long, print long")
    runs = keyed.repartition(F.col("key")).sortWithinPartitions("key", "row")
    links = stored(runs.mapInPandas(link_runs, "a long, b long").distinct())
    side = lambda c: texts.select(F.col("row").alias(c), F.col("text").alias(f"text_{c}"))
    verified = links.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(alike, "a long, b long")
    labels = stored(components(verified))
    ids = held.select("row", F.col("all.doc_id").alias("doc_id")).join(labels, F.col("row") == F.col("node"))
    stays = ids.groupBy("component").agg(F.min(F.struct("doc_id", "row")).alias("least"))
    gone = ids.join(stays, "component").where(F.col("row") != F.col("least.row")).select("row")
    return held.join(gone, "row", "left_anti").select("all.*")
