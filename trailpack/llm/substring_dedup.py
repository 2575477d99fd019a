"""Substring de-duplication by MinHash of all windows of ``LEAST_WORDS`` words.

Passages are pasted into the middle of other text, where line breaks say nothing. So every run of ``LEAST_WORDS`` words is a
paragraph of its own. Words are those of ``[^\\x20\\x09-\\x0D]+``, with A-Z in lower case.

1. A window's key is the least hash of its shingles of ``SEED`` words. Neighbouring windows mostly share it, so a text has about a key
   for each six words. Equal windows have equal keys, whatever surrounds them.
2. Keys of several documents are marked in a bit map of fixed size. A second scan brings out the windows of marked keys, with a
   hash of all their words. No repeated window is missed. Neighbouring windows of one key travel as one row, a run, to the task
   that has all runs of that key; a key with more than ``MOST_OF_KEY`` windows is not gathered but aggregated window by window.
3. Of a window in at least two documents the first place (least doc_id, then place) stays and the others are removed. The removed
   windows of a text are joined word by word, so that a repeated passage of ``LEAST_WORDS`` or more is reported whole.
4. Near copies: equal runs of a text and one kept text, in one order, are joined with what lies between them, where the five-word
   shingles of the runs are at a Jaccard similarity of ``SIMILARITY`` in the whole region. Of any two passages of 40 words or more at
   that similarity some run of ``LEAST_WORDS`` words is equal, so that none is missed altogether. What lies between goes only if it is
   not itself the kept place of a passage that is removed elsewhere: each word of a repeated passage is left in one text at least.

Removed and kept spans of a text may share words, where a kept passage overlaps with one that is removed; those words are removed. A
window that overlaps with its own first place is kept with it.

A passage that repeats inside one document only is not reported. Very long texts are read whole, and their spans found by one task.

Defined results: null and empty texts have no windows; an empty table has no rows. Rows with a null doc_id are left out. Rows that repeat a doc_id and text count
once; texts of one doc_id are told apart. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .decontamination import Hasher, mixed

SHINGLE, SIMILARITY = 5, 0.8
#: Words of the shingles whose least hash is a window's key.
SEED = 10
LEAST_WORDS = 20
#: Most bits of the map that marks keys for the second scan; a fuller map lets more through, which costs time only.
MAP_BITS = 26
#: Rows that a task passes on at once.
ROWS = 100_000
#: Most windows of a run, and of a key whose runs one task looks at together.
MOST_OF_RUN, MOST_OF_KEY = 256, 2_000_000

#: A run: neighbouring windows of one key, from ``place`` on; start and finish in characters, of the first window.
RUN = "key long, doc_id long, copy int, place int, start int, finish int, windows binary"
#: A window of a run: its hash, and how far its start and finish lie behind those of the window before.
ENTRY = np.dtype([("hash", "<u8"), ("start", "u1"), ("finish", "u1")])
#: Neighbouring windows whose first places are neighbours too; n_docs is the most of them.
JUDGED = (
    "doc_id long, copy int, place int, n_windows int, start int, finish int, n_docs long, kept_doc_id long, kept_copy int, kept_place int"
)
SPAN = "doc_id long, start long, n_chars long, n_words long, removed boolean, n_docs long, kept_doc_id long"


def names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def window_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, hash) of each window of LEAST_WORDS words."""
    n = len(words) - LEAST_WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    half = words[: 1 - SHINGLE].copy()
    for j in range(1, SHINGLE):
        half = mixed(half + words[j : len(half) + j])
    seeds = mixed(half[: SHINGLE - SEED] + half[SEED - SHINGLE :] * np.uint64(3))
    hashes = mixed(seeds[:n] + seeds[LEAST_WORDS - SEED :] * np.uint64(5))
    # The least of the first 1, 2, 4 and more of each window's shingles.
    least, reach, shingles = seeds, 1, LEAST_WORDS - SEED + 1
    while reach < shingles:
        step = min(reach, shingles - reach)
        least = np.minimum(least[:-step], least[step:])
        reach += step
    return least, hashes


def summed(key: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """The distinct keys, and the sums of their counts."""
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    return [key[first], *(np.add.reduceat(n[order], first) if len(first) else n for n in counts)]


def key_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(key, n_texts, n_windows) of the texts' distinct keys."""
    hasher = Hasher()
    for batch in batches:
        parts, held = [], 0
        for i, text in enumerate(batch["text"], 1):
            keys = window_keys(hasher.words(text.encode().lower())[0])[0]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
            own, n = summed(keys[first], np.diff(first, append=len(keys)))
            parts.append((own, np.ones(len(own), np.int64), n))
            held += len(own)
            if held >= ROWS or i == len(batch):
                key, n_texts, n_windows = summed(*(np.concatenate(x) for x in zip(*parts, strict=True)))
                yield pd.DataFrame({"key": key.view(np.int64), "n_texts": n_texts, "n_windows": n_windows})
                parts, held = [], 0


def bit_map(keys: DataFrame) -> tuple[np.ndarray, int]:
    """A map of at most 2 ** MAP_BITS bits with those of ``keys`` set, and the shift that leads from a key to its bit."""
    n = keys.count()
    bits = min(MAP_BITS, max(10, math.ceil(math.log2(16 * n + 1))))
    at = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("at"))
    own = at.select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 AS int))").alias("bit"))
    # At most 2 ** (MAP_BITS - 6) rows.
    words = own.groupBy("word").agg(F.bit_or("bit").alias("bits"))
    table = words.toPandas()
    found = np.zeros(1 << (bits - 6), np.uint64)
    found[table["word"].to_numpy(np.int64)] = table["bits"].to_numpy(np.int64).view(np.uint64)
    return np.unpackbits(found.view(np.uint8), bitorder="little").astype(bool), 64 - bits


def run_batches(texts: list[tuple], parts: list[tuple[np.ndarray, ...]], most: int) -> Iterator[pa.RecordBatch]:
    """RUN with at most ``most`` windows, from the texts' (doc_id, copy) and their windows' (key, hash, place, start, finish)."""
    text = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    key, hashes, place, start, finish = (np.concatenate(x) for x in zip(*parts, strict=True))
    steps = [np.diff(x, prepend=x[:1]) for x in (start, finish)]
    new = (np.diff(text, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 1) | (place % most == 0)
    new[1:] |= key[1:] != key[:-1]
    for x in steps:
        new |= x > 255
    entries = np.zeros(len(key), ENTRY)
    entries["hash"] = hashes
    for c, x in zip(("start", "finish"), steps, strict=True):
        entries[c] = np.where(new, 0, x)
    first = np.flatnonzero(new)
    bounds = np.append(first, len(key))
    doc_id, copy = (np.array(x) for x in zip(*texts, strict=True))
    for low in range(0, len(first), ROWS):
        at = first[low : low + ROWS]
        own = bounds[low : low + len(at) + 1]
        offsets = ((own - own[0]) * ENTRY.itemsize).astype(np.int32)
        data = [pa.py_buffer(offsets), pa.py_buffer(entries[own[0] : own[-1]].tobytes())]
        columns = [pa.array(key[at].view(np.int64)), pa.array(doc_id[text[at]], pa.int64()), pa.array(copy[text[at]], pa.int32())]
        columns += [pa.array(x[at], pa.int32()) for x in (place, start, finish)]
        yield pa.record_batch([*columns, pa.Array.from_buffers(pa.binary(), len(at), [None, *data])], names(RUN))


def runs(documents: DataFrame, marks: np.ndarray, shift: int, large: np.ndarray, of_large: bool) -> DataFrame:
    """RUN for the windows whose key is marked and not among the ``large`` ones; or, ``of_large``, for each window of these, with
    its own hash as the key."""
    shared = documents.sparkSession.sparkContext.broadcast((marks, large))  # 2 ** MAP_BITS at most, and few keys

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        marked, many = shared.value
        for batch in batches:
            texts, parts, held = [], [], 0
            columns = (batch.column("doc_id").to_pylist(), batch.column("copy").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist())
            for i, (doc_id, copy, text) in enumerate(zip(*columns, strict=True), 1):
                data = text.lower()  # bytes: A-Z only
                words, starts, ends = hasher.words(data)
                keys, hashes = window_keys(words)
                at = np.flatnonzero(marked[keys >> np.uint64(shift)])
                if len(many):
                    at = at[np.isin(keys[at], many) == of_large]
                if len(at):
                    if not data.isascii():
                        chars = np.concatenate([[0], np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)])
                        starts, ends = chars[starts], chars[ends]
                    texts.append((doc_id, copy))
                    parts.append(((hashes if of_large else keys)[at], hashes[at], at, starts[at], ends[at + LEAST_WORDS - 1]))
                    held += len(at)
                if parts and (held >= ROWS or i == len(columns[0])):
                    yield from run_batches(texts, parts, 1 if of_large else MOST_OF_RUN)
                    texts, parts, held = [], [], 0

    return documents.mapInArrow(scan, RUN)


def judged_runs(rows: dict[str, np.ndarray], windows: np.ndarray) -> pa.RecordBatch:
    """JUDGED for the windows in at least two documents, from all runs of some keys, sorted by key and doc_id."""
    row = np.repeat(np.arange(len(rows["key"])), rows["n_windows"])
    first = np.cumsum(rows["n_windows"]) - rows["n_windows"]
    key, doc_id, copy = (rows[c][row] for c in ("key", "doc_id", "copy"))
    place = rows["place"][row] + np.arange(len(row)) - first[row]
    # Equal windows beside each other, by doc_id.
    order = np.argsort(windows["hash"], kind="stable")
    hashes, by_key, by_doc = windows["hash"][order], key[order], doc_id[order]
    new = np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (by_key[1:] != by_key[:-1])])
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - 1
    kept_doc = by_doc[begin]
    n_docs = np.add.reduceat((new | np.concatenate([[True], by_doc[1:] != by_doc[:-1]])).astype(np.int64), begin)
    # The least (place, copy) in the least document, as one number.
    spot = (place << 32) + copy.astype(np.int64) + (1 << 31)
    spot = np.minimum.reduceat(np.where(by_doc == kept_doc[group], spot[order], np.iinfo(np.int64).max), begin)
    of = np.empty(len(order), np.int64)
    of[order] = group
    at = np.flatnonzero(n_docs[of] > 1)
    of, own = of[at], row[at]
    kept_doc, kept_place, kept_copy = kept_doc[of], spot[of] >> 32, (spot[of] & 0xFFFFFFFF) - (1 << 31)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) != 1) | (np.diff(own) != 0) | (np.diff(kept_doc) != 0) | (np.diff(kept_copy) != 0) | (np.diff(kept_place) != 1)
    begin = np.flatnonzero(new)
    steps = {c: np.cumsum(windows[c], dtype=np.int64) for c in ("start", "finish")}
    chars = {c: rows[c][own[begin]] + x[at[begin]] - x[first[own[begin]]] for c, x in steps.items()}
    found = {"doc_id": doc_id[at[begin]], "copy": copy[at[begin]], "place": place[at[begin]], "n_windows": np.diff(begin, append=len(at))}
    last = at[begin] + found["n_windows"] - 1
    found |= {"start": chars["start"], "finish": rows["finish"][own[begin]] + steps["finish"][last] - steps["finish"][first[own[begin]]]}
    found |= {"n_docs": np.maximum.reduceat(n_docs[of], begin) if len(begin) else begin}
    found |= {"kept_doc_id": kept_doc[begin], "kept_copy": kept_copy[begin], "kept_place": kept_place[begin]}
    kinds = {"long": pa.int64(), "int": pa.int32()}
    return pa.record_batch([pa.array(found[c], kinds[kind]) for c, kind in map(str.split, JUDGED.split(", "))], names(JUDGED))


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """JUDGED, from RUN sorted by key and doc_id; the last key of a batch waits for the next."""
    fixed = names(RUN)[:-1]
    held, n, limit = [], 0, ROWS

    def gathered() -> tuple[dict[str, np.ndarray], np.ndarray]:
        return {c: np.concatenate([rows[c] for rows, _ in held]) for c in (*fixed, "n_windows")}, np.concatenate([w for _, w in held])

    for batch in batches:
        if not batch.num_rows:
            continue
        packed = batch.column("windows").cast(pa.binary())
        _, offsets, data = packed.buffers()
        bounds = np.frombuffer(offsets, np.int32)[packed.offset : packed.offset + len(packed) + 1].astype(np.int64)
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in fixed} | {"n_windows": np.diff(bounds) // ENTRY.itemsize}
        held.append((rows, np.frombuffer(data, ENTRY, int(rows["n_windows"].sum()), int(bounds[0]))))
        n += batch.num_rows
        if n >= limit:
            rows, windows = gathered()
            cut = int(np.searchsorted(rows["key"], rows["key"][-1]))
            at = int(rows["n_windows"][:cut].sum())
            if cut:
                yield judged_runs({c: x[:cut] for c, x in rows.items()}, windows[:at])
            held, n = [({c: x[cut:] for c, x in rows.items()}, windows[at:])], n - cut
            limit = max(ROWS, 2 * n)
    if held:
        yield judged_runs(*gathered())


def judged_windows(found: DataFrame) -> DataFrame:
    """JUDGED, window by window, for RUN of single windows whose key is their hash: no task needs all rows of a key."""
    found = stored(found.drop("windows"))
    first = F.min(F.struct("doc_id", "place", "copy"))
    in_docs = found.groupBy("key", "doc_id").agg(F.min(F.struct("place", "copy")).alias("at")).select("key", "doc_id", "at.*")
    classes = in_docs.groupBy("key").agg(F.count(F.lit(1)).alias("n_docs"), first.alias("first")).where("n_docs > 1")
    # Stored, so that both sides of the join are plain and Spark can split a large class.
    classes = stored(classes.select("key", "n_docs", *(F.col(f"first.{c}").alias(f"kept_{c}") for c in ("doc_id", "copy", "place"))))
    return found.join(classes, "key").withColumn("n_windows", F.lit(1)).select(*names(JUDGED))


def needed_words(first: np.ndarray, after: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """Running count, by word, of the words that only runs that stay have: of some passage this is the place that is kept."""
    n = int(after.max(initial=0))

    def covered(at: np.ndarray) -> np.ndarray:
        steps = np.bincount(first[at], minlength=n + 1) - np.bincount(after[at], minlength=n + 1)
        return np.cumsum(steps)[:n] > 0

    return np.concatenate([[0], np.cumsum(covered(stays) & ~covered(~stays))])


def bridges(first: np.ndarray, after: np.ndarray, kept: np.ndarray, needed: np.ndarray) -> list[tuple[int, int]]:
    """Regions (first word, word after) that join runs of a text with equal ones of a kept text, from ``kept`` on, in the order of
    both: the largest ones in which the runs' shingles are at SIMILARITY and no word is needed."""
    found = []
    order = np.argsort(first, kind="stable")
    first, after, kept = first[order], after[order], kept[order]
    end = kept + after - first
    # Shingles of a run that the one before it has not; runs that go back in the kept text begin a new chain.
    shared = after - first - SHINGLE + 1
    again = np.maximum(after[:-1] - first[1:], end[:-1] - kept[1:]) - SHINGLE + 1
    shared[1:] -= np.clip(again, 0, shared[1:])
    total = np.concatenate([[0], np.cumsum(shared)])
    chains = np.concatenate([[0], np.flatnonzero((kept[1:] <= kept[:-1]) | (end[1:] <= end[:-1])) + 1, [len(first)]])
    for low, high in zip(chains[:-1].tolist(), chains[1:].tolist(), strict=True):
        for i in range(low, high - 1):
            both = total[i + 2 : high + 1] - total[i]
            sizes = after[i + 1 : high] - first[i] + end[i + 1 : high] - kept[i] - 2 * (SHINGLE - 1)
            free = needed[after[i + 1 : high]] == needed[first[i]]
            fit = np.flatnonzero((both >= SIMILARITY * (sizes - both)) & free)
            if len(fit):
                found.append((int(first[i]), int(after[i + 1 + fit[-1]])))
    return found


def spans_of(rows: dict[str, np.ndarray]) -> Iterator[tuple]:
    """The spans of one text, from its judged runs in order."""
    doc_id, copy, place, n_windows = rows["doc_id"][0], rows["copy"][0], rows["place"].astype(np.int64), rows["n_windows"]
    own = (rows["kept_doc_id"] == doc_id) & (rows["kept_copy"] == copy)
    stays = own & (place - rows["kept_place"] < LEAST_WORDS)
    until = place + n_windows - 1 + LEAST_WORDS
    needed = needed_words(place, until, stays)
    for removed in (False, True):
        at = np.flatnonzero(stays != removed)
        if not len(at):
            continue
        first, after, n = place[at], until[at], n_windows[at]
        kept, kept_copy, kept_place = (rows[c][at] for c in ("kept_doc_id", "kept_copy", "kept_place"))
        low = np.concatenate([[True], first[1:] > after[:-1]])
        if removed:
            new = np.ones(len(at), bool)
            new[1:] = (first[1:] != first[:-1] + n[:-1]) | (kept_place[1:] != kept_place[:-1] + n[:-1])
            new[1:] |= (kept[1:] != kept[:-1]) | (kept_copy[1:] != kept_copy[:-1])
            begin = np.flatnonzero(new)
            last = np.append(begin[1:], len(at)) - 1
            _, which = np.unique(np.stack([kept[begin], kept_copy[begin]]), axis=1, return_inverse=True)
            for group in np.flatnonzero(np.bincount(which.ravel()) > 1):
                b = begin[which.ravel() == group]
                e = last[which.ravel() == group]
                for x, y in bridges(first[b], after[e], kept_place[b], needed):
                    low &= (first <= x) | (first >= y)
        begin = np.flatnonzero(low)
        last = np.append(begin[1:], len(at)) - 1
        n_docs, least = np.maximum.reduceat(rows["n_docs"][at], begin), np.minimum.reduceat(kept, begin)
        start, finish = rows["start"][at][begin].astype(np.int64), rows["finish"][at][last]
        for x in zip(start.tolist(), (finish - start).tolist(), (after[last] - first[begin]).tolist(), n_docs.tolist(), least.tolist(), strict=True):
            yield int(doc_id), *x[:3], removed, *x[3:]


def joined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SPAN, from rows JUDGED sorted by doc_id, copy and place; the last text of a batch waits for the next."""
    columns = names(JUDGED)
    rest: list[dict[str, np.ndarray]] = []

    def text(parts: list[dict[str, np.ndarray]]) -> Iterator[tuple]:
        rows = {c: np.concatenate([p[c] for p in parts]) for c in columns}
        # Rows that repeat a doc_id and text.
        once = np.concatenate([[True], np.diff(rows["place"]) != 0])
        return spans_of({c: x[once] for c, x in rows.items()})

    for batch in batches:
        if not len(batch):
            continue
        rows = {c: batch[c].to_numpy() for c in columns}
        cuts = np.flatnonzero((np.diff(rows["doc_id"]) != 0) | (np.diff(rows["copy"]) != 0)) + 1
        bounds = [0, *cuts.tolist(), len(batch)]
        found = []
        for low, high in zip(bounds[:-1], bounds[1:], strict=True):
            part = {c: x[low:high] for c, x in rows.items()}
            if rest and (rest[0]["doc_id"][0], rest[0]["copy"][0]) != (part["doc_id"][0], part["copy"][0]):
                found += text(rest)
                rest = []
            rest.append(part)
        yield pd.DataFrame(found, columns=names(SPAN))
    if rest:
        yield pd.DataFrame(list(text(rest)), columns=names(SPAN))


def repeated_passages(documents: DataFrame) -> DataFrame:
    """One row per span of repeated words: doc_id, start, n_chars, n_words, removed, n_docs and kept_doc_id.

    n_docs: the most documents that have one of its windows. kept_doc_id: the least document in which one of them stays.
    """
    texts = documents.where("doc_id is not null and text is not null")
    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.hash("text").alias("copy"), "text")
    keys = texts.select("text").mapInPandas(key_rows, "key long, n_texts long, n_windows long").groupBy("key")
    keys = stored(keys.agg(F.sum("n_texts").alias("n_texts"), F.sum("n_windows").alias("n_windows")).where("n_texts > 1").drop("n_texts"))
    marks, shift = bit_map(keys.select("key"))
    # At most one for each MOST_OF_KEY windows.
    large = keys.where(F.col("n_windows") > MOST_OF_KEY).select("key").toPandas()["key"].to_numpy(np.int64).view(np.uint64)
    found = runs(texts, marks, shift, large, of_large=False)
    judged = found.repartition("key").sortWithinPartitions("key", "doc_id").mapInArrow(judge, JUDGED)
    if len(large):
        judged = judged.unionByName(judged_windows(runs(texts, marks, shift, large, of_large=True)))
    return judged.repartition("doc_id", "copy").sortWithinPartitions("doc_id", "copy", "place").mapInPandas(joined, SPAN)
