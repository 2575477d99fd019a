"""URL rules, and a character language-model ratio for the URLs that no rule fits.

Two interpolated Markov models of up to ``ORDER`` characters are counted from the URLs that rules allow and
from those that rules block. A URL's score is the mean, over its characters, of the difference between the two
log-probabilities. The threshold is set on labelled URLs that the models have not seen. DataFrame functions
only.

Defined results: a null url, or one without ``://``, has an empty host and path and is scored by its text (null:
the empty text). Repeated rows are judged each. Without labelled URLs all scores are 0 and all URLs pass.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored

# The rules of the contract, as (verdict, host, path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)

#: Characters in the longest n-gram; the pull of the shorter context; the share of labelled URLs that calibrates.
ORDER, PULL, FOLDS = 5, 2.0, 5
#: The threshold is a multiple of 1 / STEPS between -LIMIT / STEPS and LIMIT / STEPS.
STEPS, LIMIT = 50, 400
START, END = "\u0002", "\u0003"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule = verdict = None
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule = F.when(fits, F.lit(h + p)).otherwise(F.lit(None).cast("string") if rule is None else rule)
        verdict = F.when(fits, F.lit(says)).otherwise(F.lit(None).cast("string") if verdict is None else verdict)
    return rule, verdict


def grams(text: Column) -> Column:
    """For every character and the end mark: it and the ORDER - 1 characters before."""
    padded = F.concat(F.lit(START * (ORDER - 1)), text, F.lit(END))
    return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substr(padded, i, F.lit(ORDER)))


def gram_scores(counts: DataFrame) -> DataFrame:
    """(gram, ratio): log-probability of the gram's last character under the allow model less that under the block model.

    ``counts`` has each gram of the corpus once with how often both classes have it, 0 included. An order's
    estimate is (count + PULL * estimate of the next shorter order) / (context's count + PULL).
    """
    level = [None] * (ORDER + 1)
    level[ORDER] = counts.select("gram", "allow", "block")
    for j in range(ORDER - 1, 0, -1):
        level[j] = stored(level[j + 1].groupBy(F.right("gram", F.lit(j)).alias("gram")).agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")))
    shorter = None
    for j in range(1, ORDER + 1):
        grams_j = level[j].withColumn("context", F.left("gram", F.lit(j - 1)))
        contexts = grams_j.groupBy("context").agg(F.sum("allow").alias("all_allow"), F.sum("block").alias("all_block"))
        joined = grams_j.join(contexts, "context")
        if shorter is None:
            joined = joined.withColumns({"p_allow": F.lit(1e-3), "p_block": F.lit(1e-3)})
        else:
            joined = joined.withColumn("tail", F.right("gram", F.lit(j - 1))).join(shorter, "tail")
        estimate = lambda c: ((F.col(c) + PULL * F.col(f"p_{c}")) / (F.col(f"all_{c}") + PULL)).alias(f"p_{c}")
        shorter = stored(joined.select(F.col("gram").alias("tail"), estimate("allow"), estimate("block")))
    return shorter.select(F.col("tail").alias("gram"), (F.log("p_allow") - F.log("p_block")).alias("ratio"))


def threshold(scored: DataFrame) -> DataFrame:
    """One row: the score from which on to allow, by the best sum of both classes' hit rates.

    ``scored``: (verdict, score, rows). Scores are counted in 2 * LIMIT + 1 bins first; among equally good bins the
    middle one wins. Without rows of both classes: 0.
    """
    step = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), F.floor(F.col("score") * STEPS).cast("int")))
    bins = scored.groupBy(step.alias("bin")).agg(*(F.sum(F.when(F.col("verdict") == c, F.col("rows")).otherwise(0)).alias(c) for c in ("allow", "block")))
    # At most 2 * LIMIT + 1 rows from here on.
    table = bins.agg(F.sort_array(F.collect_list(F.struct("bin", "allow", "block"))).alias("t"))
    total = lambda c, t: F.aggregate(t, F.lit(0).cast("long"), lambda s, x: s + x[c])
    at = F.transform(
        F.sequence(F.lit(-LIMIT), F.lit(LIMIT)),
        lambda b: F.struct(
            (
                total("allow", F.filter("t", lambda x: x["bin"] >= b)) / total("allow", F.col("t"))
                + total("block", F.filter("t", lambda x: x["bin"] < b)) / total("block", F.col("t"))
            ).alias("hits"),
            b.alias("bin"),
        ),
    )
    best = F.filter("at", lambda x: x["hits"] >= F.array_max(F.transform("at", lambda y: y["hits"])) - 1e-9)
    both = (total("allow", F.col("t")) > 0) & (total("block", F.col("t")) > 0)
    return (
        table.select("t", F.when(both, at).alias("at"))
        .select(best.alias("best"))
        .select(F.coalesce(F.element_at("best", (F.size("best") / 2).cast("int") + 1)["bin"] / STEPS, F.lit(0.0)).alias("threshold"))
    )


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, and the model's ``score`` and ``threshold``."""
    host, path = host_and_path(F.col("url"))
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    at = F.instr("url", "://")
    text = F.coalesce(F.when(at > 0, F.substr("url", at + 3)).otherwise(F.col("url")), F.lit(""))
    read = pages.select("page_id", "url").withColumns({"host": host, "path": path, "text": text}).withColumn("ruled", ruled)
    # A text once, however many pages have it; a text that differs in its host's case only is one of its own.
    texts = stored(read.groupBy("text", "ruled").agg(F.count(F.lit(1)).alias("rows")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS))))
    learns = lambda c: F.sum(F.when((F.col("ruled") == c) & (F.col("fold") != 0), F.col("n")).otherwise(0)).alias(c)
    found = (
        texts.select("text", "ruled", "fold", "rows", F.explode(grams(F.col("text"))).alias("gram"))
        .groupBy("text", "ruled", "fold", "rows", "gram")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("n", F.col("times") * F.col("rows"))
    )
    found = stored(found)
    ratios = gram_scores(stored(found.groupBy("gram").agg(learns("allow"), learns("block"))))
    scores = (
        found.join(ratios, "gram")
        .groupBy("text", "ruled", "fold", "rows")
        .agg((F.sum(F.col("times") * F.col("ratio")) / F.sum("times")).alias("score"))
    )
    scores = stored(scores)
    cut = threshold(scores.where("fold = 0 and ruled is not null").select(F.col("ruled").alias("verdict"), "score", "rows"))
    judged = (
        read.join(scores.select("text", F.col("ruled").alias("ruled_"), "score"), ["text"])
        .where(F.col("ruled").eqNullSafe(F.col("ruled_")))
        .withColumns({"rule": rule, "threshold": cut.scalar()})
    )
    by_model = F.when(F.col("score") >= F.col("threshold"), "allow").otherwise("block")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "score", "threshold")
