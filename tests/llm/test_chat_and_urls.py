"""Conversation snapshots and URL verdicts."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest

from trailpack.llm import chat, url_filter

CHATS = "conv_id long, turn int, role string, text string, h1 string, place int, n_turns int, rendered string"


def render(turns) -> str:
    return "".join(f"<|im_start|>{r or ''}\n{t or ''}<|im_end|>\n" for r, t in turns)


def plain_chats(rows):
    order = lambda r: tuple((x is not None, x) for x in r)
    by_id = defaultdict(list)
    for conv_id, *turn in rows:
        by_id[conv_id].append(tuple(turn))
    convs = {c: [t[1:] for t in sorted(v, key=order)] for c, v in by_id.items()}
    for c, own in convs.items():
        equal = [d for d, other in convs.items() if other == own]
        known = [d for d in equal if d is not None]
        longer = any(len(o) > len(own) and o[: len(own)] == own for o in convs.values())
        if not longer and c == (min(known) if known else None):
            yield c, len(own), len(equal), render(own)


def chat_rows():
    rng = random.Random(3)
    logged = [[(rng.choice(["user", "assistant"]), f"turn {rng.randrange(3)}") for _ in range(rng.randrange(1, 6))] for _ in range(60)]
    rows = [(c, i, r, t) for c, own in enumerate(logged) for i, (r, t) in enumerate(own)]
    rows += [(100, 0, "user", None), (101, 0, "user", ""), (102, 0, None, "user"), (103, 0, "user", None), (103, 1, "bot", "x" * 100_000)]
    # Ties, repeated rows, null turns and ids.
    rows += [(110, 0, "b", "2"), (110, 0, "b", "1"), (110, 0, "a", "9"), (111, 0, "a", "9"), (111, 1, "b", "1")]
    rows += [(112, 0, "a", "r"), (112, 0, "a", "r"), (113, 0, "a", "r"), (114, None, "z", "z"), (114, 5, "a", "a")]
    rows += [(None, 0, "n", "n"), (None, 1, "n", "m"), (120, 0, "n", "n")]
    return rows


def test_chats(spark):
    rows = chat_rows()
    found = chat.format_chats(spark.createDataFrame([(*r, "h", 1, 2, "x") for r in rows], CHATS)).collect()
    assert Counter(map(tuple, found)) == Counter(plain_chats(rows))
    assert chat.format_chats(spark.createDataFrame([], CHATS)).collect() == []


def plain_verdict(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
    host, path = rest[:cut].lower(), rest[cut:]
    path = path[: min((path.find(c) for c in "?#" if c in path), default=len(path))]
    best = None
    for says, h, p in url_filter.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = h + p, says
    return host, path, *(best or (None, None))


URLS = [
    None, "", "nothing", "://", "http://", "http://a.com", "http://a.com/", "http://A.COM/x?y=/#z", "http://example.com/en/1",
    "http://example.com/english", "http://www.example.com/en/1", "http://x.www.example.com/en/", "http://m.example.com/en/",
    "http://notexample.com/en/", "http://b.net/es/", "http://b.net/fr/1#t", "http://b.net/de/", "ftp://b.net?x://y", "http://a.com:80/x",
    "http://c.org/a\nb", "http://" + "x" * 50_000 + ".org/", "http://é.org/ü", "a.com/x", "http://a.com/x", "http://a.com/x",
]


def pages_of(spark, urls):
    rows = [(i if i % 7 else None, u, "<p>", "t", "h", 0.5, "r") for i, u in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, text string, host string, score double, rule string")


def test_rules(spark):
    found = url_filter.judge_urls(pages_of(spark, URLS)).collect()
    wanted = [(i if i % 7 else None, *plain_verdict(u)) for i, u in enumerate(URLS)]
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in found) == Counter(w[:4] for w in wanted)
    ruled = {w[0]: w[4] for w in wanted if w[4] and w[0]}
    assert all(r.verdict == ruled[r.page_id] for r in found if r.page_id in ruled)
    assert all(r.verdict in ("allow", "block") for r in found)
    assert url_filter.judge_urls(pages_of(spark, [])).collect() == []


def test_without_labels_all_pass(spark):
    found = url_filter.judge_urls(pages_of(spark, ["http://a.org/x", "http://b.org/y", None])).collect()
    assert {r.verdict for r in found} == {"allow"}


def test_model_follows_the_language_of_each_side(spark):
    rng = random.Random(2)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(8))
    good, bad = "abcdefg", "uvwxyz"
    urls = [f"http://{word(good)}.com/{word(good)}" for _ in range(300)] + [f"http://{word(bad)}.net/es/{word(bad)}" for _ in range(300)]
    urls += [f"http://{word(good)}.org/{word(good)}" for _ in range(50)] + [f"http://{word(bad)}.org/{word(bad)}" for _ in range(50)]
    found = {r.host: r.verdict for r in url_filter.judge_urls(pages_of(spark, urls)).collect() if r.host.endswith(".org")}
    assert sum((v == "allow") == (h[0] in good) for h, v in found.items()) >= 0.97 * len(found)


@pytest.mark.parametrize("scores, wanted", [([("allow", 1.0), ("block", -1.0)], 0.0), ([("allow", 2.0), ("block", 1.0)], 1.52), ([("allow", 1.0)], 0.0), ([], 0.0)])
def test_threshold(spark, scores, wanted):
    table = spark.createDataFrame([(*s, 1) for s in scores], "verdict string, score double, rows long")
    assert url_filter.threshold(table).first().threshold == pytest.approx(wanted, abs=0.03)


def test_no_python_in_the_plans(spark):
    pages = pages_of(spark, URLS)
    table = spark.createDataFrame([(*r, "h", 1, 2, "x") for r in chat_rows()], CHATS)
    for df in (url_filter.judge_urls(pages), chat.format_chats(table)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
