"""Hard negatives by a multiway hyperplane tree with ranges (geometric near-neighbour access tree).

An inner product is a distance once every vector is lengthened by one coordinate to the length of the longest: then
``distance(anchor, x)^2 = |anchor|^2 + longest^2 - 2 * score``, and a window of scores is an annulus about the anchor. A node of the tree
has up to ``ARITY`` split points; each row goes to the subtree of its nearest one. Every split point stores the least and
the greatest distance to the rows of each sibling subtree, taken over all rows. For an anchor, a sibling goes if its range about some
split point does not meet the distances that the triangle inequality allows for the annulus. What is left are leaves, whose
rows are scored exactly.

The split points are chosen from a sample of at most ``SAMPLE`` rows (the tree has ``MOST_LEAVES`` leaves at most, so it fits a task); the
ranges and the leaves hold every row, so nothing is missed: the search is exact. Leaves are stored in blocks of about ``BLOCK``
rows, dealt by a hash, so a vector that a third of all rows have is many blocks. Anchors are searched in chunks of neighbours. A chunk meets a
block where the tree leaves some of its anchors to it, and never as pairs of rows. Both searches (positives, then negatives in the
windows that the positives' scores give) first look into one block of the anchors' own leaf: the scores found there narrow the
annuli of the full search.

Defined results: rows with a null vec_id or label, or a null, empty or shorter vector, or one with a null or non-finite component, take no
part. Copies of a row (equal vec_id, label and vector) count once; other rows under one vec_id count each, and are never positives or
negatives of an anchor of that vec_id. Ties of score and vec_id go by label. Other columns are ignored. No rows give no rows. Inner
products must fit 63 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .vectors import all_finite, matrix, of_full_length, summed, whole_numbers

SCALE = 256
ARITY, LEAF_ROWS, MOST_LEAVES = 16, 512, 4096
#: Rows that the split points are chosen from, at most about so many.
SAMPLE = 16_384
#: Rows of a block, anchors of a chunk, and chunks that meet a block in one group.
BLOCK, CHUNK, SLICE = 1024, 128, 32
POSITIVES, NEGATIVES = 5, 10
#: The window of a negative's score, in hundredths of the positive's.
FROM, TO = 30, 90
#: Distances are compared with so much room for rounding, as a part of the greatest length.
SLACK = 1e-6


@dataclass
class Node:
    """Split points (with their added coordinate), where each leads (a node, or ~leaf), and ranges [split point, sibling]."""

    points: np.ndarray
    added: np.ndarray
    child: list[int]
    least: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))


@dataclass
class Tree:
    nodes: list[Node]
    leaves: int
    longest: float  # squared

    def added(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.longest - np.sum(x * x, axis=1), 0))

    def distances(self, node: Node, x: np.ndarray, added: np.ndarray) -> np.ndarray:
        products = x @ node.points.T + added[:, None] * node.added
        return np.sqrt(np.maximum(2 * self.longest - 2 * products, 0))

    def route(self, x: np.ndarray, ranges: np.ndarray | None = None) -> np.ndarray:
        """The leaf of each row. ``ranges`` (a row of least and one of negated greatest distances) is lowered by them."""
        leaf, added, starts = np.zeros(len(x), np.int64), self.added(x), self.starts()
        waiting = [(0, np.arange(len(x)))]
        while waiting:
            at, own = waiting.pop()
            if not len(own) or not self.nodes:
                continue
            node = self.nodes[at]
            far = self.distances(node, x[own], added[own])
            nearest = np.argmin(far, axis=1)
            k = len(node.child)
            for j, child in enumerate(node.child):
                mine = nearest == j
                if ranges is not None and mine.any():
                    cells = slice(starts[at] + j * k, starts[at] + (j + 1) * k)
                    ranges[0, cells] = np.minimum(ranges[0, cells], far[mine].min(axis=0))
                    ranges[1, cells] = np.minimum(ranges[1, cells], -far[mine].max(axis=0))
                if child < 0:
                    leaf[own[mine]] = ~child
                else:
                    waiting.append((child, own[mine]))
        return leaf

    def starts(self) -> list[int]:
        """Where each node's ranges begin in one long array."""
        return np.concatenate([[0], np.cumsum([len(n.child) ** 2 for n in self.nodes])]).astype(int).tolist()

    def with_ranges(self, ranges: np.ndarray) -> Tree:
        for node, start in zip(self.nodes, self.starts(), strict=False):
            k = len(node.child)
            node.least = ranges[0, start : start + k * k].reshape(k, k).T
            node.most = -ranges[1, start : start + k * k].reshape(k, k).T
        return self

    def open_leaves(self, x: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, rows of ``x``) where the leaf may hold a score in a window of the row; low and high: windows by row."""
        length = np.sum(x * x, axis=1)[:, None] + self.longest
        inner, outer = np.sqrt(np.maximum(length - 2 * high, 0)), np.sqrt(np.maximum(length - 2 * low, 0))
        alive = low <= high
        if not self.nodes:
            yield 0, np.flatnonzero(alive.any(axis=1))
            return
        slack = SLACK * np.sqrt(self.longest)
        waiting = [(0, np.flatnonzero(alive.any(axis=1)), alive)]
        while waiting:
            at, own, alive = waiting.pop()
            if not len(own):
                continue
            node = self.nodes[at]
            far = np.sqrt(np.maximum(length[own] - 2 * (x[own] @ node.points.T), 0))[:, None, :]  # anchors have no added part
            near_edge = np.maximum(inner[own][:, :, None] - far, far - outer[own][:, :, None]) - slack
            far_edge = far + outer[own][:, :, None] + slack
            for j, child in enumerate(node.child):
                meets = (node.least[:, j] <= far_edge) & (node.most[:, j] >= near_edge)
                left = alive[own] & meets.all(axis=2)
                mine = left.any(axis=1)
                if child < 0:
                    if mine.any():
                        yield ~child, own[mine]
                elif mine.any():
                    deeper = np.zeros_like(alive)
                    deeper[own] = left
                    waiting.append((child, own[mine], deeper))


def fit_tree(sample: np.ndarray, longest: float, leaves: int, seed: int = 5) -> Tree:
    """Split points by greedy choice of far ones among some random rows; leaves in depth-first order."""
    tree, rng = Tree([], 0, longest), np.random.default_rng(seed)
    added = tree.added(sample) if len(sample) else np.zeros(0)

    def split(own: np.ndarray, wanted: int) -> int:
        """A node's number, or ~leaf."""
        k = min(ARITY, wanted)
        points: list[int] = []
        if k >= 2:
            tried = rng.permutation(own)[: 4 * k]
            far = np.full(len(tried), np.inf)
            pick = 0
            while len(points) < k:
                points.append(tried[pick])
                gap = sample[tried] - sample[tried[pick]]
                far = np.minimum(far, np.sqrt(np.sum(gap * gap, axis=1) + (added[tried] - added[tried[pick]]) ** 2))
                pick = int(np.argmax(far))
                if far[pick] <= 0:
                    break
        if len(points) < 2:
            tree.leaves += 1
            return ~(tree.leaves - 1)
        at = len(tree.nodes)
        node = Node(sample[points], added[points], [])
        tree.nodes.append(node)
        nearest = np.argmin(tree.distances(node, sample[own], added[own]), axis=1)
        for j in range(len(points)):
            mine = own[nearest == j]
            node.child.append(split(mine, round(wanted * len(mine) / len(own))))
        return at

    if len(sample) == 0 or split(np.arange(len(sample)), leaves) == ~0:
        tree.leaves = 1
    return tree


def dealt(counts: dict[int, int], size: int, apart: bool) -> dict[int, tuple[int, int]]:
    """For each leaf, the first of its groups and how many it has, of about ``size`` rows each.

    ``apart``: no group holds rows of two leaves. Otherwise small neighbours share one.
    """
    out, first, held = {}, 0, 0
    for leaf in sorted(counts):
        n = counts[leaf]
        if held and (apart or held + n > size):
            first, held = first + 1, 0
        many = -(-n // size) if n > size else 1
        out[leaf] = (first, many)
        if many > 1:
            first, held = first + many, 0
        else:
            held += n
    return out


def grouped(rows: DataFrame, groups: dict[int, tuple[int, int]], name: str) -> DataFrame:
    """One row per group: ``name``, leaf and, as bytes, ids, labels and the matrix of its rows, in order of vec_id and label."""
    spark = rows.sparkSession
    places = spark.createDataFrame([(k, *v) for k, v in groups.items()], "leaf long, first long, many long")

    def block(table: pa.Table) -> pa.Table:
        table = table.sort_by([("vec_id", "ascending"), ("label", "ascending")]).combine_chunks()
        x = matrix(table.column("x").chunk(0))
        columns = [table.column(c).to_numpy().astype("<i8").tobytes() for c in ("vec_id", "label")]
        first = [pa.array([table.column(c)[0].as_py()], pa.int64()) for c in ("group", "leaf")]
        return pa.table([*first, *[pa.array([c], pa.binary()) for c in (*columns, x.astype("<i8").tobytes())]], [name, "leaf", "ids", "labels", "x"])

    # At most MOST_LEAVES places.
    found = rows.join(F.broadcast(places), "leaf").withColumn(
        "group", F.col("first") + F.pmod(F.xxhash64("vec_id", "label", "x"), F.col("many"))
    )
    return found.select("group", "leaf", "vec_id", "label", "x").groupBy("group").applyInArrow(
        block, f"{name} long, leaf long, ids binary, labels binary, x binary"
    )


def numbers(cell: pa.Scalar) -> np.ndarray:
    return np.frombuffer(cell.as_py(), "<i8")


def scores(anchors: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact."""
    bound = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * anchors.shape[1]
    if bound < 2.0**53:
        return (anchors.astype(float) @ rows.astype(float).T).astype(np.int64)
    return anchors @ rows.T


NONE, ALL = -(2**62), 2**62


class Search:
    """The blocks of all rows, the chunks of anchors, and the tree over both."""

    def __init__(self, rows: DataFrame, anchors: DataFrame, tree: Tree, counts: dict[int, int], asked: dict[int, int]):
        self.tree, self.places = tree, dealt(counts, BLOCK, apart=True)
        self.blocks = stored(grouped(rows, self.places, "block"))
        self.chunks = stored(grouped(anchors, dealt(asked, CHUNK, apart=False), "chunk"))

    def asks(self, found: DataFrame | None, narrowed: DataFrame | None) -> DataFrame:
        """The chunks with what is known of their anchors: positives found, and the scores that a probe has reached."""
        out = self.chunks
        for name, known in (("positives", found), ("reached", narrowed)):
            if known is None:
                out = out.withColumn(name, F.lit(None).cast("array<struct<at:bigint,slot:bigint,score:bigint,vec_id:bigint>>"))
                continue
            # A chunk has at most about CHUNK anchors with POSITIVES slots each.
            lists = known.groupBy("chunk").agg(F.collect_list(F.struct("at", "slot", "score", "vec_id")).alias(name))
            out = out.join(lists, "chunk", "left")
        return out

    def spread(self, asks: DataFrame, same: bool, probe: bool) -> DataFrame:
        """For each chunk and block that may hold something for it: the anchors concerned, with windows by slot."""
        tree, places, slots = self.tree, self.places, 1 if same else POSITIVES

        def windows(m: int, positives: list | None, reached: list | None):
            low, high = np.full((m, slots), NONE), np.full((m, slots), ALL if same else NONE - 1)
            known = np.zeros((2, m, slots), np.int64)
            for r in () if same else positives or ():
                low[r["at"], r["slot"]] = -(-FROM * r["score"] // 100)
                high[r["at"], r["slot"]] = TO * r["score"] // 100
                known[:, r["at"], r["slot"]] = r["vec_id"], r["score"]
            for r in reached or ():
                low[r["at"], r["slot"]] = max(low[r["at"], r["slot"]], r["score"])
            return low, high, known

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                    x = np.frombuffer(row["x"], "<i8").reshape(len(ids), -1)
                    low, high, known = windows(len(ids), row["positives"], row["reached"])
                    if probe:
                        leaf = tree.route(x.astype(float))
                        held = [(v, np.flatnonzero(leaf == v)) for v in np.unique(leaf).tolist()]
                    else:
                        held = tree.open_leaves(x.astype(float), low.astype(float), high.astype(float))
                    out: list[list] = [[] for _ in range(10)]
                    for leaf, own in held:
                        if leaf not in places:
                            continue
                        first, many = places[leaf]
                        part = [a[own].astype("<i8").tobytes() for a in (ids, labels, x, low, high, known[0], known[1])]
                        for block in range(first, first + (1 if probe else many)):
                            for column, value in zip(out, (block, row["chunk"], own.astype("<i8").tobytes(), *part), strict=True):
                                column.append(value)
                        if sum(map(len, out[5])) > 8_000_000:
                            yield packed(out)
                            out = [[] for _ in range(10)]
                    yield packed(out)

        names = ["block", "chunk", "at", "ids", "labels", "x", "low", "high", "positive_id", "positive_score"]

        def packed(out):
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 8]
            return pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

        return asks.mapInArrow(meet, ", ".join(f"{n} {'long' if n in ('block', 'chunk') else 'binary'}" for n in names))

    def visit(self, asked: DataFrame, same: bool, most: int) -> DataFrame:
        """The best ``most`` rows by anchor and slot among the blocks asked for: with the anchor's label, or with another."""
        asked = stored(asked.withColumn("slice", F.floor(F.col("chunk") / SLICE)))
        needed = asked.select(F.col("block").alias("held"), F.col("slice").alias("turn")).distinct()
        needed = needed.join(self.blocks, F.col("held") == F.col("block")).select("held", "turn", "ids", "labels", "x")
        slots = 1 if same else POSITIVES
        names = ["chunk", "at", "slot", "anchor_id", "positive_id", "positive_score", "score", "vec_id", "label"]

        def best(asks: pa.Table, blocks: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[] for _ in names]
            if blocks.num_rows and asks.num_rows:
                ids, labels = numbers(blocks.column("ids")[0]), numbers(blocks.column("labels")[0])
                x = numbers(blocks.column("x")[0]).reshape(len(ids), -1)
                for i in range(asks.num_rows):
                    chunk = asks.column("chunk")[i].as_py()
                    at, own, own_labels = (numbers(asks.column(c)[i]) for c in ("at", "ids", "labels"))
                    score = scores(numbers(asks.column("x")[i]).reshape(len(at), -1), x)
                    fits = ((labels[None, :] == own_labels[:, None]) == same) & (ids[None, :] != own[:, None])
                    low, high, pid, ps = (numbers(asks.column(c)[i]).reshape(len(at), slots) for c in ("low", "high", "positive_id", "positive_score"))
                    for slot in range(slots):
                        inside = fits & (score >= low[:, slot, None]) & (score <= high[:, slot, None])
                        for a in np.flatnonzero(inside.any(axis=1)).tolist():
                            found = np.flatnonzero(inside[a])
                            # Rows are in order of vec_id and label, which the stable sort keeps within ties.
                            found = found[np.argsort(-score[a, found], kind="stable")[:most]]
                            n = len(found)
                            same_for_all = (chunk, at[a], slot, own[a], pid[a, slot], ps[a, slot])
                            for column, value in zip(out, same_for_all, strict=False):
                                column.append(np.full(n, value, np.int64))
                            for column, values in zip(out[6:], (score[a, found], ids[found], labels[found]), strict=True):
                                column.append(values)
            return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out], names)

        found = asked.groupBy("block", "slice").cogroup(needed.groupBy("held", "turn")).applyInArrow(best, ", ".join(f"{n} long" for n in names))
        order = Window.partitionBy("chunk", "at", "slot").orderBy(F.desc("score"), "vec_id", "label")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    def best(self, same: bool, most: int, positives: DataFrame | None = None) -> DataFrame:
        """The exact best ``most`` rows per anchor and slot: a probe, and the search that its scores have narrowed."""
        probed = self.visit(self.spread(self.asks(positives, None), same, probe=True), same, most)
        narrowed = stored(probed.where(F.col("rank") == most).select("chunk", "at", "slot", "score", "vec_id"))
        return stored(self.visit(self.spread(self.asks(positives, narrowed), same, probe=False), same, most))


def hard_negatives(rows: DataFrame, anchors_of=None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows``: vec_id, label, x (array<long>, all of one length). ``anchors_of``: the condition for anchors.
    """
    types = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    rows = stored(rows.where("vec_id IS NOT NULL AND label IS NOT NULL").distinct())
    squares = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v * v)
    n, longest = rows.agg(F.count(F.lit(1)), F.max(squares)).first()
    if not n:
        return rows.sparkSession.createDataFrame([], types)
    # The hash of a row decides, so that the sample is the same on any partitioning.
    part = F.pmod(F.xxhash64("x", "vec_id"), F.lit(1_000_000)) < int(1_000_000 * min(1, SAMPLE / n)) + 1
    sample = rows.where(part).limit(2 * SAMPLE).select("x").orderBy("x").toArrow()
    points = matrix(sample.column(0).combine_chunks()).astype(float) if sample.num_rows else np.zeros((0, 1))
    tree = fit_tree(points, float(longest), max(1, min(MOST_LEAVES, n // LEAF_ROWS)))

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                leaf = pa.array(tree.route(matrix(batch.column(2)).astype(float)))
                yield pa.record_batch([*batch.columns, leaf], ["vec_id", "label", "x", "leaf"])

    def ranges(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        found = np.full((2, tree.starts()[-1]), np.inf)
        for batch in batches:
            if batch.num_rows:
                tree.route(matrix(batch.column(0)).astype(float), found)
        return found

    rows = stored(rows.select("vec_id", "label", "x").mapInArrow(placed, "vec_id long, label long, x array<long>, leaf long"))
    if tree.nodes:
        # A cell that no row reaches stays beyond all distances: its subtree is empty.
        tree = tree.with_ranges(summed(rows.select("x"), ranges, rows.rdd.getNumPartitions(), np.minimum).reshape(2, -1))
    anchors = rows.where(F.col("vec_id") % 100 == 0 if anchors_of is None else anchors_of)
    # At most MOST_LEAVES counts each.
    counts, asked = ({r["leaf"]: r["count"] for r in t.groupBy("leaf").count().collect()} for t in (rows, anchors))
    if not asked:
        return rows.sparkSession.createDataFrame([], types)
    search = Search(rows, anchors, tree, counts, asked)
    positives = search.best(True, POSITIVES).withColumn("slot", F.col("rank").cast("long") - 1)
    negatives = search.best(False, NEGATIVES, positives)
    return negatives.select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def mined(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Hard negatives of the anchors (vec_id divisible by 100), with the label of every seventh row moved on by one of ten."""
    rows = embeddings.where(all_finite(F.col(column)))
    label = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole_numbers(F.col(column), SCALE).alias("x"))
    return hard_negatives(of_full_length(rows.where("vec_id IS NOT NULL AND label IS NOT NULL")))
