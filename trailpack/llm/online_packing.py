"""Bounded-space online packing of tokenised documents.

Each partition keeps a fixed number of open windows. What is left of a document after its full windows goes to the open window that it
fits most tightly; where it fits none and no more may be opened, its head fills the fullest window, which is emitted, and its rest
is placed again. So every window that is emitted is full, and a partition leaves at most ``open_windows`` of them behind. These
leftovers, with their ids, are merged in the same way, ``FAN`` partitions at a time, until one group is left. What that group cannot fill
is cut at powers of two, which need no padding: no sequence is padded at all.

Memory of a task: one batch of texts, the open windows, and ids of some megabytes; a group of the merge holds at most
``FAN * open_windows`` windows. A task that is run again gives the same sequences, and only whole stored tables are read on.

Defined results: a null text is empty, and an empty text is the end id alone. Very long texts are encoded in parts and cut like any
other. Repeated rows and null doc_ids are packed like others, each row for itself. Other columns are ignored. No documents, no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .tokens import encoder, tokenizer_path

END_ID = 0
LENGTH = 1024
#: Windows that a partition keeps open.
OPEN_WINDOWS = 16
#: Partitions whose leftovers are merged by one task.
FAN = 64
#: Bytes of ids in a batch of output.
BATCH_BYTES = 8_000_000

PIECES = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64())]
    + [("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64()), ("window", pa.int64())]
)
TYPES = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, part long, window long"
)
#: doc_id, start, ids, doc_tokens.
Piece = tuple[int | None, int, bytes, int]


def tokens_of(ids: bytes) -> int:
    return len(ids) // 4


class Windows:
    """The open windows of one partition. ``add`` returns the windows that it fills, as lists of pieces."""

    def __init__(self, length: int, most: int):
        self.length, self.most = length, most
        self.open: list[list[Piece]] = []
        self.room: list[int] = []

    def _put(self, at: int, piece: Piece) -> list[list[Piece]]:
        self.open[at].append(piece)
        self.room[at] -= tokens_of(piece[2])
        if self.room[at]:
            return []
        del self.room[at]
        return [self.open.pop(at)]

    def add(self, piece: Piece) -> list[list[Piece]]:
        doc, start, ids, total = piece
        n = tokens_of(ids)
        cut = lambda a, b: (doc, start + a, ids[4 * a : 4 * b], total)
        full = n // self.length
        out = [[cut(k * self.length, (k + 1) * self.length)] for k in range(full)]
        at = full * self.length
        while at < n:
            fits = [(room, i) for i, room in enumerate(self.room) if room >= n - at]
            if fits:
                return out + self._put(min(fits)[1], cut(at, n))
            if len(self.open) < self.most:
                self.open.append([])
                self.room.append(self.length)
                return out + self._put(len(self.open) - 1, cut(at, n))
            fullest = min((room, i) for i, room in enumerate(self.room))[1]
            end = at + self.room[fullest]
            out += self._put(fullest, cut(at, end))
            at = end
        return out


def unpadded(windows: list[list[Piece]], length: int) -> list[list[Piece]]:
    """The windows' pieces as full sequences and, for the rest, sequences at powers of two."""
    queue = [p for window in windows for p in window]
    left = sum(tokens_of(p[2]) for p in queue)
    out: list[list[Piece]] = []
    while left:
        size = length if left >= length else 1 << (left.bit_length() - 1)
        out.append([])
        left -= size
        while size:
            doc, start, ids, total = queue.pop(0)
            n = min(size, tokens_of(ids))
            out[-1].append((doc, start, ids[: 4 * n], total))
            if 4 * n < len(ids):
                queue.insert(0, (doc, start + n, ids[4 * n :], total))
            size -= n
    return out


class Rows:
    """Batches of output rows: filled windows under numbers of their own, open ones without a number."""

    def __init__(self, round_number: int, part: int):
        # A number has 5 bits for the round, 26 for the part of the round, 32 for the window.
        self.part, self.next = part, (round_number << 58) | (part << 32)
        self.columns: list[list] = [[] for _ in PIECES]
        self.bytes = 0

    def _add(self, pieces: list[Piece], sequence: int | None, window: int | None) -> None:
        offset = 0
        for doc, start, ids, total in pieces:
            n = tokens_of(ids)
            for column, value in zip(self.columns, (doc, start, n, ids, total, sequence, offset, self.part, window), strict=True):
                column.append(value)
            offset += n
            self.bytes += len(ids)

    def filled(self, windows: list[list[Piece]]) -> None:
        for pieces in windows:
            self._add(pieces, self.next, None)
            self.next += 1

    def open(self, windows: list[list[Piece]]) -> None:
        for number, pieces in enumerate(windows):
            self._add(pieces, None, number)

    def batch(self) -> pa.RecordBatch:
        made = pa.record_batch([pa.array(c, f.type) for c, f in zip(self.columns, PIECES, strict=True)], schema=PIECES)
        self.columns, self.bytes = [[] for _ in PIECES], 0
        return made


def packed_partitions(documents: DataFrame, length: int, open_windows: int, path: str) -> DataFrame:
    """Pieces of every partition's documents; those in windows still open have no sequence_id."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, end = encoder(path).encode, END_ID.to_bytes(4, "little")
        windows, rows = Windows(length, open_windows), Rows(0, TaskContext.get().partitionId())
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(text.as_py()) + end
                rows.filled(windows.add((doc_id.as_py(), 0, ids, tokens_of(ids))))
                if rows.bytes >= BATCH_BYTES:
                    yield rows.batch()
        rows.open(windows.open)
        yield rows.batch()

    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return texts.mapInArrow(pack, TYPES)


def merged(left: DataFrame, round_number: int, length: int, open_windows: int, last: bool) -> DataFrame:
    """Leftovers of ``FAN`` parts at a time, packed into fewer windows; in the last round, into sequences without padding."""

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("part", "ascending"), ("window", "ascending"), ("offset", "ascending")])
        pieces = zip(*(table.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)
        windows, rows = Windows(length, open_windows), Rows(round_number, table.column("part")[0].as_py() // FAN)
        for piece in pieces:
            rows.filled(windows.add(piece))
        if last:
            rows.filled(unpadded(windows.open, length))
        else:
            rows.open(windows.open)
        return pa.Table.from_batches([rows.batch()])

    return left.groupBy(F.floor(F.col("part") / FAN).alias("group")).applyInArrow(merge, TYPES)


def pack_online(documents: DataFrame, length: int = LENGTH, open_windows: int = OPEN_WINDOWS, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids, doc_tokens, sequence_id, offset: one row per piece, with its ids as little-endian 32-bit bytes."""
    made = stored(packed_partitions(documents, length, open_windows, path or tokenizer_path()))
    tables, round_number = [made], 0
    parts = (made.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        round_number += 1
        last = parts <= FAN
        made = stored(merged(made.where("sequence_id IS NULL"), round_number, length, open_windows, last))
        tables.append(made)
        parts = -(-parts // FAN)
        if last:
            break
    pieces = tables[0]
    for table in tables[1:]:
        pieces = pieces.unionByName(table)
    return pieces.where("sequence_id IS NOT NULL").drop("part", "window")


def packing_report(documents: DataFrame) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    pieces = pack_online(documents)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
