"""Quality rules: text statistics, plain limits, and robust multivariate outliers per language and source.

Words are runs of characters other than ``[\\x20\\x09-\\x0D]``. A document that passes the plain limits is rejected if its
transformed statistics lie too far, by squared Mahalanobis distance, from the centre of its language and source. Centre and
scatter are the minimum-covariance-determinant estimate (MCD) of that group: from each of several starts (``STARTS``) every step takes the
``SHARE`` nearest documents of the group and estimates again from those, which lowers the determinant until it settles; after ``TRIED``
of ``STEPS`` steps the start of the least determinant goes on alone. Every step is one distributed sum over all documents, of all groups and starts at
once; a group never comes together in one task.

A group of any size is judged in the same way, by its own centre. Its scatter is drawn towards that of its language over all sources, as
if ``PRIOR`` more documents had been seen there: that decides in a group too small to know its own spread, and
fades in a large one. Nothing is measured against other languages.

Defined results: a null text has no words. Null languages and sources form groups of their own. Repeated rows count each. Scatter has
a floor per statistic (``FLOOR``), so that a group of equal documents rejects none of them. Whole texts are read, however long. An
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WINDOW = 8
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEATED = 20, 30

#: The transformed statistics with the least standard deviation that counts as spread.
FLOOR = {"log_words": 0.5, "word_length": 0.5, "symbols": 0.1, "dup_lines": 0.05, "repeated": 0.05}
NAMES = tuple(FLOOR)
SHARE, STEPS = 0.75, 10
#: Starts (by the medians' deviations, and by the floors), and the steps after which the better one of each group goes on.
STARTS, TRIED = ("deviations", "floors"), 2
#: Documents that the language's scatter counts for beside the group's own.
PRIOR = 50
#: A group's rows meet its estimate in so many parts, so that a large group is not one task's.
PARTS = 64
#: Squared distances above this are outliers: the 1 - 1e-6 quantile of chi-square with five degrees of freedom.
CUTOFF = 36.8
#: Makes the scatter of the nearest three quarters consistent for normal data: SHARE / P(chi2_7 <= the SHARE quantile of chi2_5).
CONSISTENCY = 0.75 / 0.5287

STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeat_words(words: list[bytes]) -> int:
    """Words in windows of WINDOW words that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.uint64, len(words))
    keys = np.zeros(n, np.uint64)
    for j in range(WINDOW):
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + n]
    order = np.argsort(keys, kind="stable")
    same = np.flatnonzero(keys[order[1:]] == keys[order[:-1]])
    if not len(same):
        return 0
    # Equal hashes are compared by their words.
    windows = np.lib.stride_tricks.sliding_window_view(ids, WINDOW)
    a, b = order[same], order[same + 1]
    equal = (windows[a] == windows[b]).all(axis=1)
    starts = np.zeros(len(words) + 1, np.int64)
    repeated = np.unique(np.concatenate([a[equal], b[equal]]))
    starts[repeated] += 1
    starts[np.minimum(repeated + WINDOW, len(words))] -= 1
    return int((np.cumsum(starts)[:-1] > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int]:
    data = (text or "").encode()
    words = data.split()  # of bytes: at ASCII white space, that is [\\x20\\x09-\\x0D]
    seen: set[bytes] = set()
    dup_lines = 0
    for line in data.split(b"\n"):
        if line in seen:
            dup_lines += bool(line.split())
        else:
            seen.add(line)
    chars = len((b"".join(words)).decode())
    return len(words), chars, len(data) - len(data.translate(None, SYMBOLS)), dup_lines, repeat_words(words)


def with_statistics(documents: DataFrame) -> DataFrame:
    """doc_id, lang, source and the STATS of every document."""
    names = [c.split()[0] for c in STATS.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = pd.DataFrame([statistics(t) for t in batch["text"]], columns=names, dtype="int64")
            yield pd.concat([batch[["row", "lang", "source"]].reset_index(drop=True), found], axis=1)

    # doc_id travels as text, so that null and large ids stay what they are.
    rows = documents.select(F.col("doc_id").cast("string").alias("row"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    made = rows.mapInPandas(run, f"row string, lang string, source string, {STATS}")
    return made.select(F.col("row").cast("long").alias("doc_id"), "lang", "source", *names)


def transformed() -> list[Column]:
    words, lines = F.greatest(F.col("n_words"), F.lit(1)), F.col("n_dup_lines")
    return [
        F.log1p("n_words").alias("log_words"),
        (F.col("word_chars") / words).alias("word_length"),
        F.log1p(F.lit(10) * F.col("n_symbols") / words).alias("symbols"),
        F.log1p(F.lit(10) * lines / words).alias("dup_lines"),
        (F.col("n_repeat_words") / words).alias("repeated"),
    ]


PAIRS = [(i, j) for i in range(len(NAMES)) for j in range(i, len(NAMES))]
ESTIMATE = "grp string, centre array<double>, inverse array<double>, scatter array<double>, determinant double"


def solved(scatter: np.ndarray) -> tuple[list[float], list[float], float]:
    """(flattened inverse, flattened scatter, log determinant), with spreads below the floor lifted to it; correlations stay."""
    floor = np.array([FLOOR[n] for n in NAMES]) ** 2
    scatter = scatter + np.diag(np.maximum(floor - np.diag(scatter), 0))
    values, axes = np.linalg.eigh(scatter)
    values = np.maximum(values, 1e-9 * max(values.max(), 1e-12))
    return ((axes / values) @ axes.T).ravel().tolist(), scatter.ravel().tolist(), float(np.log(values).sum())


def estimates(sums: DataFrame, scale: float) -> DataFrame:
    """ESTIMATE from each group's sums (grp, n, s_i, q_i_j)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                centre = np.array([r[f"s_{i}"] for i in range(len(NAMES))]) / r["n"]
                scatter = np.zeros((len(NAMES), len(NAMES)))
                for i, j in PAIRS:
                    scatter[i, j] = scatter[j, i] = scale * (r[f"q_{i}_{j}"] / r["n"] - centre[i] * centre[j])
                rows.append((r["grp"], centre.tolist(), *solved(scatter)))
            yield pd.DataFrame(rows, columns=["grp", "centre", "inverse", "scatter", "determinant"])

    return sums.mapInPandas(run, ESTIMATE)


def drawn_together(groups: DataFrame) -> DataFrame:
    """own_grp, centre, inverse: each group's scatter with that of its language, weighed by its documents and by PRIOR."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = len(NAMES)
        for batch in batches:
            rows = []
            for r in batch.to_dict("records"):
                own, wide = (np.array(r[c], float).reshape(p, p) for c in ("scatter", "lang_scatter"))
                rows.append((r["own_grp"], list(r["centre"]), solved((r["n"] * own + PRIOR * wide) / (r["n"] + PRIOR))[0]))
            yield pd.DataFrame(rows, columns=["own_grp", "centre", "inverse"])

    return groups.mapInPandas(run, "own_grp string, centre array<double>, inverse array<double>")


def distance() -> Column:
    """Squared Mahalanobis distance of the statistics from ``centre`` by ``inverse``."""
    p = len(NAMES)
    d = [F.col(n) - F.element_at("centre", i + 1) for i, n in enumerate(NAMES)]
    return reduce(lambda a, b: a + b, (d[i] * d[j] * F.element_at("inverse", i * p + j + 1) * (1 if i == j else 2) for i, j in PAIRS))


def moments(rows: DataFrame) -> DataFrame:
    sums = [F.sum(n).alias(f"s_{i}") for i, n in enumerate(NAMES)]
    products = [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"q_{i}_{j}") for i, j in PAIRS]
    return rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *sums, *products)


def in_parts(rows: DataFrame) -> DataFrame:
    """One row per group, once for each part."""
    return rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))


def mcd(rows: DataFrame) -> DataFrame:
    """ESTIMATE per group of ``rows`` (grp, part and the transformed statistics)."""
    median = lambda c: F.percentile_approx(c, 0.5, 1000)
    medians = rows.groupBy("grp").agg(F.array(*(median(n) for n in NAMES)).alias("centre"))
    away = rows.join(in_parts(medians), ["grp", "part"]).select("grp", "centre", *(F.abs(F.col(n) - F.element_at("centre", i + 1)).alias(n) for i, n in enumerate(NAMES)))
    p = len(NAMES)
    spread = away.groupBy("grp").agg(F.first("centre").alias("centre"), *(F.greatest(1.4826 * median(n), F.lit(FLOOR[n])).alias(f"d_{n}") for n in NAMES))
    widths = {"deviations": [F.col(f"d_{n}") for n in NAMES], "floors": [F.lit(FLOOR[n]) for n in NAMES]}

    def inverse(start: str) -> Column:
        return F.array(*(1 / F.pow(widths[start][i], F.lit(2)) if i == j else F.lit(0.0) for i in range(p) for j in range(p)))

    begun = F.explode(F.array(*(F.struct(F.lit(k).alias("start"), inverse(name).alias("inverse")) for k, name in enumerate(STARTS))))
    now = stored(spread.select("grp", "centre", begun.alias("b")).select("grp", "centre", "b.start", "b.inverse"))

    def step(now: DataFrame, keys: list[str]) -> DataFrame:
        """The estimates from the SHARE nearest rows by the estimates ``now``, which ``keys`` tell apart."""
        near = rows.join(in_parts(now), ["grp", "part"]).select(*keys, "part", *NAMES, distance().alias("d"))
        limit = near.groupBy(*keys).agg(F.percentile_approx("d", SHARE, 1000).alias("limit"))
        inner = near.join(in_parts(limit), [*keys, "part"]).where("d <= limit")
        # Each (group, start) is a group by itself.
        single = F.to_json(F.struct(*keys))
        made = estimates(moments(inner.withColumn("grp", single)), CONSISTENCY)
        key = F.from_json("grp", "grp string, start int")
        return made.select(*(key[k].alias(k) for k in keys), "centre", "inverse", "scatter", "determinant")

    for _ in range(TRIED):
        now = stored(step(now, ["grp", "start"]))
    best = now.groupBy("grp").agg(F.min_by(F.struct("centre", "inverse", "scatter", "determinant"), F.struct("determinant", "start")).alias("e"))
    now = stored(best.select("grp", "e.*"))
    for _ in range(STEPS - TRIED):
        now = stored(step(now, ["grp"]))
    return now


def judge_quality(documents: DataFrame) -> DataFrame:
    """doc_id, the STATS, base_failed, kept, and distance (squared; null if the plain limits reject)."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
    lang, source = (F.coalesce(c, F.lit("\u0002")) for c in ("lang", "source"))
    part = F.pmod(F.monotonically_increasing_id(), F.lit(PARTS)).cast("int")
    groups = F.concat(F.lit("\u0003"), lang).alias("lang_grp"), F.concat(lang, F.lit("\u0001"), source).alias("own_grp")
    rows = stored(with_statistics(documents).select("*", *transformed(), failed.alias("base_failed"), *groups, part.alias("part")))
    passed = rows.where("not base_failed")
    # Every document counts for its group and for its language.
    both = [passed.select(F.col(c).alias("grp"), "part", *NAMES) for c in ("own_grp", "lang_grp")]
    fits = mcd(stored(both[0].unionByName(both[1])))
    sizes = passed.groupBy("own_grp", "lang_grp").agg(F.count(F.lit(1)).alias("n"))
    own = sizes.join(fits.select(F.col("grp").alias("own_grp"), "centre", "scatter"), "own_grp")
    own = own.join(fits.select(F.col("grp").alias("lang_grp"), F.col("scatter").alias("lang_scatter")), "lang_grp")
    judged = rows.join(in_parts(stored(drawn_together(own))), ["own_grp", "part"], "left").withColumn("d", F.when(~F.col("base_failed"), distance()))
    names = [c.split()[0] for c in STATS.split(", ")]
    kept = ~F.col("base_failed") & (F.coalesce("d", F.lit(0.0)) <= CUTOFF)
    return judged.select("doc_id", *names, "base_failed", kept.alias("kept"), F.col("d").alias("distance"))
