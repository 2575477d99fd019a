"""Toxicity by the nearest labelled examples, found with a block-max inverted index.

1. At most ``EXAMPLES`` labelled documents (the first by a hash of their id) with ``POSTINGS`` distinct terms in all are the examples: all
   that is learned comes from them, so those two numbers bound the index, in the driver and in the tasks. A term is a word, or
   the first ``STEM`` letters of a longer one, as a 64-bit hash.
2. An example is a TF-IDF vector at length 1: each term weighs idf = ln(1 + examples / frequency). The ``TELLING_TERMS`` terms that tell
   the classes apart best weigh ``TELLING`` times that, and their counts matter: each of ``LEVELS`` that a count reaches is a term of its own.
3. The examples' vectors are inverted. Postings of rare and of telling terms are walked through and give every example the
   exact first part of its cosine. For the rest, the common terms, each block of ``BLOCK`` examples has the largest weight of each term:
   that bounds the second part. Blocks are opened in the order of their bounds, a few at a time, and the K-th best cosine
   found so far closes all blocks that cannot reach it. What comes out are the K nearest examples by exact cosine.
4. The vote is the cosine-weighted share of toxic examples among the K. Votes of the examples themselves (each
   left out of its own neighbours) calibrate it by a logistic fit; an example with no neighbour counts for the score of documents without any.

Only words enter a score. Whole texts are read, however long. Defined results: a null or empty text, or one without a term of the index,
has no neighbours and takes the share of toxic examples among those without neighbours. Rows that repeat a doc_id are scored each; as
an example it counts once, with the least of its texts. Copies of a text are one example, toxic if any is. Labels that
repeat a doc_id count as toxic if any of them is. Null labels are not used. Without labels of both classes the score is
the share of toxic labels, 0 without labels. A null doc_id is not held out. An empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Bounds on what is learned from: labelled rows, and distinct terms summed over them.
EXAMPLES, POSTINGS = 5000, 4_000_000
#: Telling terms, neighbours that vote, examples in a block.
TELLING_TERMS, K, BLOCK = 512, 15, 32
#: Weight of a term that tells the classes apart against that of another one.
TELLING = 8.0
STEM, LEVELS = 7, (2, 3, 4, 6, 8)
#: A term is common if so large a part of the examples have it; at most so many terms are.
COMMON_SHARE, COMMON_TERMS = 0.2, 1024
#: Blocks that are opened first; each further time twice as many.
OPENED_FIRST = 8
#: Tokens whose terms a task remembers; then it begins anew.
CACHED_TOKENS = 200_000
#: What a telling term needs: labelled documents that hold it, their share of one class, how many times the
#: share of the other class that is, and the chi-square of both.
LEAST_DOCUMENTS, LEAST_SHARE, LEAST_LIFT, LEAST_CHI = 3, 0.02, 8.0, 30.0
REJECT = 0.7
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def word_counts(text: str | None) -> Counter[str]:
    return Counter(WORD.findall((text or "").lower()))


def hashes_of(word: str) -> list[int]:
    """The word's terms: itself, and its beginning if it is longer."""
    import xxhash

    terms = [word, word[:STEM] + "~"] if len(word) > STEM else [word]
    return [xxhash.xxh64_intdigest(t.encode()) for t in terms]


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash, count) of each term of a text, by hash."""
    pairs = [(h, n) for word, n in word_counts(text).items() for h in hashes_of(word)]
    if not pairs:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, place = np.unique(np.array([h for h, _ in pairs], np.uint64), return_inverse=True)
    return hashes, np.bincount(place, [n for _, n in pairs]).astype(np.int64)


def labelled_examples(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """id, toxic, draw, hashes, counts of at most EXAMPLES labelled documents."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("id"))
    chosen = known.agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(EXAMPLES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [terms_of(t) for t in batch["text"]]
            made = batch[["id", "toxic", "draw"]].assign(hashes=[h.view(np.int64) for h, _ in found], counts=[c for _, c in found])
            yield made

    # At most EXAMPLES rows of two numbers are sent to all tasks.
    texts = documents.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")
    texts = texts.groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"), F.min("text").alias("text"))
    texts = texts.groupBy("text").agg(F.min("id").alias("id"), F.max("toxic").alias("toxic")).withColumn("draw", F.xxhash64("id"))
    return texts.mapInPandas(run, "id long, toxic int, draw long, hashes array<long>, counts array<long>")


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers of all ranges of n from first on."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())


class Index:
    """Block-max inverted index of the examples, with the calibration of its votes.

    Made from the examples' ids, labels and terms alone; what searching needs is derived from them where it is used.
    """

    def __init__(self, ids: np.ndarray, toxic: np.ndarray, first: np.ndarray, hashes: np.ndarray, counts: np.ndarray):
        """Example i has the terms ``hashes[first[i]:first[i + 1]]`` with their ``counts``."""
        self.given = ids, toxic, first, hashes, counts
        self.slope, self.shift, self.none = 1.0, 0.0, 0.0
        self.opened = self.searched = 0
        self._derive()

    def __reduce__(self):
        return _restored, (self.given, self.slope, self.shift, self.none)

    def _derive(self) -> None:
        ids, toxic, first, hashes, counts = self.given
        self.known: dict[str, tuple[int, ...]] = {}
        self.hashes, term = np.unique(hashes, return_inverse=True)
        n, example = len(ids), np.repeat(np.arange(len(ids)), np.diff(first))
        telling = self._telling(term, example, toxic, n)
        # Levels of the telling terms are further terms behind the others.
        self.level = {t: [len(self.hashes) + i * len(LEVELS) + j for j in range(len(LEVELS))] for i, t in enumerate(telling.tolist())}
        extra = [(example[at], np.array([self.level[t][j] for t in term[at].tolist()], np.int64))
                 for j, least in enumerate(LEVELS) for at in [np.flatnonzero(np.isin(term, telling) & (counts >= least))]]
        terms = len(self.hashes) + len(telling) * len(LEVELS)
        example = np.concatenate([example, *[e for e, _ in extra]])
        term = np.concatenate([term, *[t for _, t in extra]]).astype(np.int64)
        frequency = np.bincount(term, minlength=terms)
        self.idf = np.log1p(n / np.maximum(frequency, 1))
        special = np.zeros(terms, bool)
        special[telling] = special[len(self.hashes) :] = True
        self.idf[special] *= TELLING
        # The common terms, by frequency; a term's column among them, or -1.
        wide = np.flatnonzero((frequency >= max(COMMON_SHARE * n, 2)) & ~special)
        wide = wide[np.argsort(-frequency[wide], kind="stable")][:COMMON_TERMS]
        self.column = np.full(terms, -1)
        self.column[wide] = np.arange(len(wide))

        weight = self.idf[term]
        norm = np.sqrt(np.bincount(example, weight * weight, minlength=n))
        weight = weight / np.maximum(norm, 1e-12)[example]
        # Like examples side by side, so that a block's largest weights bound it well: by their heaviest common terms.
        dense = np.zeros((n, len(wide)))
        is_wide = self.column[term] >= 0
        dense[example[is_wide], self.column[term[is_wide]]] = weight[is_wide]
        order = self._alike(dense, ids)
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        self.ids, self.toxic = ids[order], toxic[order].astype(float)
        self.blocks = -(-n // BLOCK)
        padded = np.zeros((self.blocks * BLOCK, len(wide)))
        padded[:n] = dense[order]
        self.rows = padded.reshape(self.blocks, BLOCK, len(wide))
        self.most = self.rows.max(axis=1) if n else np.zeros((0, len(wide)))
        example, term, weight = place[example[~is_wide]], term[~is_wide], weight[~is_wide]
        by_term = np.argsort(term, kind="stable")
        self.example, self.weight = example[by_term].astype(np.int32), weight[by_term]
        self.start = np.searchsorted(term[by_term], np.arange(terms + 1))

    @staticmethod
    def _alike(dense: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """An order in which each example is followed by like ones: split again and again along the direction of largest spread."""
        parts, out = [np.argsort(ids, kind="stable")], []
        while parts:
            own = parts.pop()
            if len(own) <= BLOCK or not dense.shape[1]:
                out.append(own)
                continue
            c = dense[own] - dense[own].mean(axis=0)
            axis = c[int(np.argmax(np.sum(c * c, axis=1)))]
            for _ in range(5):  # power steps towards the largest spread
                axis = c.T @ (c @ axis)
                axis /= max(np.linalg.norm(axis), 1e-300)
            own = own[np.argsort(c @ axis, kind="stable")]
            half = -(-len(own) // (2 * BLOCK)) * BLOCK
            parts += [own[half:], own[:half]]
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    @staticmethod
    def _telling(term: np.ndarray, example: np.ndarray, toxic: np.ndarray, n: int) -> np.ndarray:
        """The terms that tell the classes apart best, by the chi-square of their presence against the label."""
        bads = float(toxic.sum())
        goods = n - bads
        if not bads or not goods:
            return np.zeros(0, np.int64)
        every = np.bincount(term).astype(float)
        bad = np.bincount(term, toxic[example].astype(float), minlength=len(every))
        good = every - bad
        chi = n * (bad * (goods - good) - good * (bads - bad)) ** 2 / (every * (n - every + 1e-9) * bads * goods)
        a, b = bad / bads, good / goods
        fit = (every >= LEAST_DOCUMENTS) & (chi >= LEAST_CHI) & (np.maximum(a, b) >= LEAST_SHARE) & (np.maximum(a, b) >= LEAST_LIFT * np.minimum(a, b))
        found = np.flatnonzero(fit)
        return np.sort(found[np.argsort(-chi[found], kind="stable")][:TELLING_TERMS])

    def _numbers(self, tokens: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """The numbers of the tokens' terms that are in the index; all new ones are looked up at once."""
        new = [t for t in tokens if t not in self.known]
        if new:
            if len(self.known) > CACHED_TOKENS:
                self.known.clear()
                new = list(tokens)
            hashes = [[h for word in WORD.findall(t) for h in hashes_of(word)] for t in new]
            own = np.array([h for hs in hashes for h in hs], np.uint64)
            at = np.minimum(np.searchsorted(self.hashes, own), max(len(self.hashes) - 1, 0))
            numbers = np.where(self.hashes[at] == own, at, -1).tolist() if len(self.hashes) else [-1] * len(own)
            place = 0
            for token, hs in zip(new, hashes, strict=True):
                self.known[token] = tuple(n for n in numbers[place : place + len(hs)] if n >= 0)
                place += len(hs)
        return self.known

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of a text at length 1, over the terms of the index."""
        # What stands between white space, counted; only tokens that are new are taken apart into words.
        counted = Counter((text or "").lower().split())
        known = self._numbers(counted)
        terms = {t for token in counted for t in known[token]}
        levels: list[int] = []
        if telling := terms & self.level.keys():
            counts = Counter()
            for token, n in counted.items():
                for t in known[token]:
                    if t in telling:
                        counts[t] += n
            levels = [level for t, n in counts.items() for level, least in zip(self.level[t], LEVELS, strict=True) if n >= least]
        at = np.array([*terms, *levels], np.int64)
        if not len(at):
            return at, np.zeros(0)
        weights = self.idf[at]
        return at, weights / np.linalg.norm(weights)

    def nearest(self, at: np.ndarray, weights: np.ndarray, k: int = K) -> list[tuple[float, int]]:
        """(cosine, example) of the k nearest with a cosine above 0; ties to the smaller id."""
        if not len(at) or not self.blocks:
            return []
        column = self.column[at]
        rare = column < 0
        first = self.start[at[rare]]
        n = self.start[at[rare] + 1] - first
        postings = ranges(first, n)
        part = np.bincount(self.example[postings], np.repeat(weights[rare], n) * self.weight[postings], minlength=self.blocks * BLOCK)
        part = part.reshape(self.blocks, BLOCK)
        common = np.zeros(self.most.shape[1])
        common[column[~rare]] = weights[~rare]
        bound = part.max(axis=1) + self.most @ common
        order = np.argsort(-bound, kind="stable")
        self.searched += 1
        found, numbers, at_block, step = np.zeros(0), np.zeros(0, np.int64), 0, OPENED_FIRST
        while at_block < len(order):
            least = np.partition(found, -k)[-k] if len(found) >= k else 0.0
            opened = order[at_block : at_block + step]
            # A hair of room, so that equal cosines that are summed in another order are seen.
            opened = opened[(bound[opened] >= least - 1e-9) & (bound[opened] > 0)]
            if not len(opened):
                break
            cosine = (part[opened] + self.rows[opened] @ common).ravel()
            number = (opened[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            good = (cosine > 0) & (cosine >= least - 1e-9) & (number < len(self.ids))
            found, numbers = np.concatenate([found, cosine[good]]), np.concatenate([numbers, number[good]])
            self.opened += len(opened)
            at_block += step
            step *= 2
        best = np.lexsort((self.ids[numbers], -np.round(found, 9)))[:k]
        return [(float(found[i]), int(numbers[i])) for i in best]

    @staticmethod
    def vote(toxic: np.ndarray, near: list[tuple[float, int]]) -> float:
        cosine = np.array([c for c, _ in near])
        return float(cosine @ toxic[[i for _, i in near]] / cosine.sum())

    def example_vectors(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(example, terms, weights) of the examples, as a text with their terms would have them."""
        ids, _, first, hashes, counts = self.given
        place = {int(i): at for at, i in enumerate(self.ids.tolist())}
        for i, example in enumerate(ids.tolist()):
            own = np.searchsorted(self.hashes, hashes[first[i] : first[i + 1]])
            n = counts[first[i] : first[i + 1]]
            levels = [level for t, c in zip(own.tolist(), n.tolist(), strict=True) if t in self.level for level, least in zip(self.level[t], LEVELS, strict=True) if c >= least]
            at = np.concatenate([own, np.array(levels, np.int64)]).astype(np.int64)
            weights = self.idf[at]
            yield place[example], at, weights / max(np.linalg.norm(weights), 1e-12)

    def calibrate(self) -> None:
        """A logistic fit from the examples' own votes to their labels."""
        votes, labels, lone = [], [], []
        for i, at, weights in self.example_vectors():
            near = [(c, e) for c, e in self.nearest(at, weights, K + 1) if e != i][:K]
            if near:
                votes.append(self.vote(self.toxic, near))
                labels.append(self.toxic[i])
            else:
                lone.append(self.toxic[i])
        base = float(self.toxic.mean()) if len(self.toxic) else 0.0
        self.none = (sum(lone) + base) / (len(lone) + 1)
        x, y = np.array(votes) - 0.5, np.array(labels, float)
        a, b = 4.0, 0.0
        for _ in range(50 if len(set(labels)) == 2 else 0):
            # Newton steps; a small pull towards the start keeps a perfect split finite.
            p = 1 / (1 + np.exp(-(a * x + b)))
            g = np.array([((p - y) * x).sum() + 0.01 * (a - 4), (p - y).sum() + 0.01 * b])
            w = p * (1 - p)
            h = np.array([[(w * x * x).sum() + 0.01, (w * x).sum()], [(w * x).sum(), w.sum() + 0.01]])
            step = np.clip(np.linalg.solve(h, g), -2, 2)
            a, b = max(a - step[0], 0.1), b - step[1]
        self.slope, self.shift = a, b

    def score(self, text: str | None) -> tuple[float, list[int], list[float]]:
        """The calibrated vote, and the neighbours' ids and cosines."""
        near = self.nearest(*self.vector(text))
        p = 1 / (1 + np.exp(-(self.slope * (self.vote(self.toxic, near) - 0.5) + self.shift))) if near else self.none
        return float(p), [int(self.ids[i]) for _, i in near], [round(c, 6) for c, _ in near]


def _restored(given, slope, shift, none) -> Index:
    index = Index(*given)
    index.slope, index.shift, index.none = slope, shift, none
    return index


def learn(documents: DataFrame, labels: DataFrame) -> Index:
    examples = stored(labelled_examples(documents, labels))
    # At most EXAMPLES rows of four numbers, and then no more than POSTINGS terms of the first of them.
    sizes = sorted((r["draw"], r["id"], r["n"], r["toxic"]) for r in examples.select("draw", "id", F.size("hashes").alias("n"), "toxic").collect())
    total = np.cumsum([n for _, _, n, _ in sizes])
    fitting = sizes[: int(np.searchsorted(total, POSTINGS, side="right"))]
    share = sum(t for *_, t in fitting) / max(len(fitting), 1)
    empty = np.zeros(0, np.int64)
    index = Index(empty, empty, np.zeros(1, np.int64), np.zeros(0, np.uint64), empty)
    index.none = share
    if not 0 < share < 1:
        return index
    draw, last = fitting[-1][:2]
    within = (F.col("draw") < draw) | ((F.col("draw") == draw) & (F.col("id") <= last))
    held = examples.where(within).select("id", "toxic", "hashes", "counts").orderBy("id").toArrow().combine_chunks()

    def flat(name: str) -> np.ndarray:
        chunks = held.column(name).chunks
        return np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in chunks]) if chunks else empty

    lengths = pa.compute.list_value_length(held.column("hashes")).to_numpy()
    first = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    ids, toxic = (held.column(c).to_numpy().astype(np.int64) for c in ("id", "toxic"))
    index = Index(ids, toxic, first, flat("hashes").astype(np.int64).view(np.uint64), flat("counts"))
    index.calibrate()
    return index


def scorer(documents: DataFrame, labels: DataFrame):
    """A column function of the text: struct of score, near_ids and near_cosines (the evidence), by all ``labels`` given."""
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents, labels))  # bounded by EXAMPLES and POSTINGS

    @F.pandas_udf("score double, near_ids array<bigint>, near_cosines array<double>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            found = [shared.value.score(t) for t in texts]
            yield pd.DataFrame(found, columns=["score", "near_ids", "near_cosines"])

    return score


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, near_ids, near_cosines. Labels of held-out rows are not learned from."""
    score = scorer(documents, labels.where(~held_out(F.col("doc_id"))))
    scored = documents.select("doc_id", score("text").alias("found")).select("doc_id", "found.*")
    predicted = F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, "near_ids", "near_cosines")


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents whose score is below REJECT, judged row by row where they lie."""
    score = scorer(documents, labels)
    return documents.where(score("text")["score"] < REJECT)
