"""Small documents with every awkward case: nulls, empty and very long texts, copies, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

# Columns that operators use inside themselves must not clash with a table's own.
SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, row string, key string, h1 long, bucket int, "
    "length long, score double, line string, component_id long, dropped string, n_words long, `a b` int"
)
EXTRA = ("r", "k", 1, 2, 3, 0.5, "l", 4, "d", 5, 6)


def text_of(rng: random.Random, n: int, words: int = 4000) -> str:
    parts = [f"w{rng.randrange(words)}" for _ in range(n)]
    return "\n".join(" ".join(parts[i : i + 12]) for i in range(0, n, 12))


LICENCE = "This Line Of Forty Or More Characters Is In Many Documents"


def rows(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    base = [text_of(rng, 60 + 10 * i) for i in range(12)]
    texts: list[str | None] = [None, "", " ", "\n", "\n\n  \t\r\n", "word", "é" * 50, "Two Words"]
    texts += base + base[:4] + base[:2]
    texts += [base[5] + " end", base[5].upper(), "  " + base[6] + "\t"]
    texts += [f"{b}\n \t{LICENCE if i % 2 else LICENCE.lower()}\x0b\n{LICENCE}" for i, b in enumerate(base[:7])]
    texts += [text_of(rng, 20_000), "x" * 100_000, "a b " * 10_000, "same same " * 40]
    made = [(i * 3, t, "en" if i % 3 else None, f"s{i % 2}" if i % 5 else None, len(t or "") or None) for i, t in enumerate(texts)]
    made += [made[9], made[9], (made[10][0], "another text under a known id", "en", "s1", 3)]
    made += [(None, base[0], "en", "s1", None), (None, "only here", None, None, None)]
    return [r + EXTRA for r in made]


def frame(spark, data: list[tuple] | None = None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()
