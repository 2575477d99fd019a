"""Operators over documents against plain versions, on rows with every awkward case."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hard_cases import frame, rows, text_of, words
from hypothesis import given, settings
from hypothesis import strategies as st

from trailpack.llm import decontamination, line_dedup, near_copies, packing, quality, simhash, substring_dedup, tokens, toxicity

STRIP = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def bag(found) -> Counter:
    return Counter(map(tuple, found))


# Line de-duplication -----------------------------------------------------------------------------


def kept_lines(data, min_chars=40, min_docs=5):
    key = lambda line: line.strip(STRIP).translate(LOWER)
    holders = defaultdict(set)
    for doc_id, text, *_ in data:
        for line in (text or "").split("\n") if doc_id is not None else ():
            holders[key(line)].add(doc_id)
    for doc_id, text, *_ in data:
        lines = (text or "").split("\n")
        gone = [
            doc_id is not None and len(k := key(x)) >= min_chars and len(holders[k]) >= min_docs and doc_id < max(holders[k]) for x in lines
        ]
        yield doc_id, lines, [x for x, g in zip(lines, gone, strict=True) if not g]


def test_line_dedup(spark):
    found = line_dedup.line_report(frame(spark)).drop("kept_text").collect()
    wanted = [(d, len(a), len(a) - len(k), hashlib.sha256("\n".join(k).encode()).hexdigest()) for d, a, k in kept_lines(rows())]
    assert bag(found) == bag(wanted) and sum(w[2] for w in wanted) > 5


def test_line_dedup_over_many_shards_and_copies(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 3)
    monkeypatch.setattr(line_dedup, "PROBES", 7)
    data = rows()
    found = line_dedup.dedup_lines(frame(spark), min_chars=5, min_docs=2)
    assert found.columns == frame(spark).columns
    wanted = [(r[0], None if r[1] is None else "\n".join(k), *r[2:]) for r, (_, _, k) in zip(data, kept_lines(data, 5, 2), strict=True)]
    assert bag(found.collect()) == bag(wanted)


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(2)
    h1, h2 = (rng.integers(0, 2**63, 5000).astype(np.uint64) for _ in range(2))
    h1[:50] = h1[50:100]  # halves may be equal
    index = line_dedup.PerfectHash.of(h1, h2)
    assert sorted(index.index(h1, h2).tolist()) == list(range(5000))


# Packing -----------------------------------------------------------------------------------------


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    tokenizer.encode_special_tokens = True
    data = rows()
    found = packing.pack(frame(spark), length=64).collect()
    wanted = Counter()
    for doc_id, text, *_ in data:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        for k, (start, n) in enumerate(packing.cut(len(ids), 64)):
            wanted[doc_id, k, start, n, zlib.crc32(np.array(ids[start : start + n], "<u4").tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == wanted
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        assert at <= 64
    assert len(sequences) == best_fit_decreasing(Counter(r.length for r in found), 64)


def best_fit_decreasing(counts, length):
    room = []
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fits = [(r, i) for i, r in enumerate(room) if r >= size]
            if fits:
                room[min(fits)[1]] -= size
            else:
                room.append(length - size)
    return len(room)


def test_cut():
    assert packing.cut(1, 4) == [(0, 1)] and packing.cut(4, 4) == [(0, 4)] and packing.cut(8, 4) == [(0, 4), (4, 4)]
    assert packing.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("segment", [10**6, 40])
def test_ids_are_the_tokenizers(monkeypatch, segment):
    monkeypatch.setattr(tokens, "SEGMENT", segment)
    texts = [r[1] or "" for r in rows()[:30]]
    texts += ["  a  b\n\n c ", "x\ty \tz", "\na", "a\n", " a", "a ", "it's 12 don't  x", "a  b  c", "<|endoftext|> x"]
    texts += ["naïve café ½ ‘a’ – b… €", "日本 語", "a\u00a0b\u2003c", "\u0000x\u0085y", "Ωμέγα 12٣", "🙂 ok", "é" * 200 + " " * 200 + "x", "a\r\n\r\nb\x1c"]
    encoder = tokens.Encoder(packing.tokenizer_path())
    for text in texts:
        assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text[:50]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab'stÀ ı\n\t  1,—²é½_\u00a0\u1e9e"), max_size=40))
def test_ids_of_random_texts(text):
    encoder = tokens.encoder(packing.tokenizer_path())
    assert encoder.encode(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


# Quality rules -----------------------------------------------------------------------------------


def plain_statistics(text):
    data = text or ""
    own = data.encode().split()
    lines, dup = [], 0
    for line in data.split("\n"):
        dup += bool(line.encode().split()) and line in lines
        lines.append(line)
    windows = defaultdict(list)
    for i in range(len(own) - 7):
        windows[tuple(own[i : i + 8])].append(i)
    repeated = {j for at in windows.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    return len(own), sum(len(w.decode()) for w in own), sum(c in "#*$%&|<>" for c in data), dup, len(repeated)


def test_quality_statistics(spark):
    data = [r for r in rows() if r[1] is None or len(r[1]) < 50_000]
    data += [(1000 + i, t, "en", "s", 1, *rows()[0][5:]) for i, t in enumerate(["a\n#\n#\n \n \nb|c <*> &%$", "é à ü " * 30])]
    found = quality.judge_quality(frame(spark, data)).drop("kept", "distance").collect()
    wanted = []
    for doc_id, text, *_ in data:
        stats = plain_statistics(text)
        wanted.append((doc_id, *stats, stats[0] < 20 or 100 * stats[4] > 30 * stats[0]))
    assert bag(found) == bag(wanted)


def test_quality_outliers(spark):
    import random

    rng = random.Random(4)
    extra = rows()[0][5:]
    data = [(i, text_of(rng, rng.randrange(80, 400)), f"l{i % 2}", f"s{i % 3}", 1, *extra) for i in range(600)]
    odd = {i: " ".join(f"#{w}***$" for w in text_of(rng, 200).split()) for i in range(600, 620)}
    data += [(i, t, f"l{i % 2}", f"s{i % 3}", 1, *extra) for i, t in odd.items()]
    found = {r.doc_id: r for r in quality.judge_quality(frame(spark, data)).collect()}
    assert not any(found[i].kept for i in odd)
    assert sum(found[i].kept for i in range(600)) >= 597
    same = [(i, data[0][1], "l", "s", 1, *extra) for i in range(60)]
    assert all(r.kept for r in quality.judge_quality(frame(spark, same)).collect())


@pytest.mark.parametrize("n", [1, 3, 45, 60])
def test_a_small_source_unlike_the_others_is_judged_like_a_large_one(spark, n):
    """Long words in one source only: it is not measured against the others, whatever its size."""
    import random

    rng = random.Random(n)
    extra = rows()[0][5:]

    def text(letters):
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(letters)) for _ in range(rng.randrange(80, 300)))

    data = [(i, text(5), "en", f"s{i % 3}", 1, *extra) for i in range(300)]
    data += [(1000 + i, text(12), "en", "own", 1, *extra) for i in range(n)]
    found = {r.doc_id: r.kept for r in quality.judge_quality(frame(spark, data)).collect()}
    assert all(found[1000 + i] for i in range(n)) and sum(found[i] for i in range(300)) >= 298


def test_estimate_is_near_the_exact_least_determinant(spark):
    """Against all subsets of small groups: the nearest three quarters that have the least determinant."""
    from itertools import combinations

    rng = np.random.default_rng(3)
    p = len(quality.NAMES)
    data, made = [], {}
    for g in range(4):
        good = rng.normal(0, 1, (9, p)) * np.array([2, 1, 0.5, 0.3, 0.3]) + g
        bad = rng.normal(0, 0.2, (3, p)) + 15 + g
        made[f"g{g}"] = np.concatenate([good, bad])
        data += [(f"g{g}", i % quality.PARTS, *map(float, x)) for i, x in enumerate(made[f"g{g}"])]
    frame_of = spark.createDataFrame(data, "grp string, part int, " + ", ".join(f"{n} double" for n in quality.NAMES))
    found = {r.grp: r for r in quality.mcd(frame_of).collect()}
    for g, x in made.items():
        logdets = {c: np.linalg.slogdet(np.cov(x[list(c)].T, bias=True))[1] for c in combinations(range(12), 9)}
        best = min(logdets, key=logdets.get)
        assert best == tuple(range(9))
        assert np.allclose(found[g].centre, x[list(best)].mean(axis=0))


# SimHash -----------------------------------------------------------------------------------------


def plain_fingerprint(text):
    own = words(text)
    if not own:
        return 0
    k = min(3, len(own))
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + k]), 42) for i in range(len(own) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= 3 and root[i] != root[j]:
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return root


def test_simhash(spark):
    data = rows()
    prints = [plain_fingerprint(r[1]) for r in data]
    root = plain_components(prints)
    least = {}
    for r, (doc_id, *_) in zip(root, data, strict=True):
        least[r] = min((x for x in (least.get(r), doc_id) if x is not None), default=None)
    wanted = [(d[0], f"{p:016x}", least[r]) for d, p, r in zip(data, prints, root, strict=True)]
    assert bag(simhash.near_duplicates(frame(spark)).collect()) == bag(wanted)
    kept = simhash.one_of_each(frame(spark))
    assert kept.columns == frame(spark).columns
    stays = {d for d, _, c in wanted if d is not None and d == c}
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(stays)
    assert sum(r.doc_id is None for r in kept.collect()) == 2


def test_golay_keys_meet_at_three_bits_in_any_place():
    import random

    rng = random.Random(5)
    for _ in range(40):
        x = rng.getrandbits(64)
        near = [x] + [x ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 3))) for _ in range(20)]
        keys = [set() for _ in near]
        for key, at in simhash.keys(np.array(near, np.uint64)):
            for k, i in zip(key.tolist(), at.tolist(), strict=True):
                keys[i].add(k)
        assert all(keys[0] & k for k in keys)


def test_long_chains_are_one_component(spark):
    from trailpack.llm.common import components

    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001), (1001, 1001)], "a long, b long")
    found = {r.node: r.component for r in components(edges).collect()}
    assert found == {i: 0 for i in range(n + 1)} | {1000: 1000, 1001: 1000}


# Decontamination ---------------------------------------------------------------------------------


def shingles(text):
    own = words(text)
    k = min(5, len(own))
    return {tuple(own[i : i + k]) for i in range(len(own) - k + 1)} if own else set()


@pytest.mark.parametrize("block", [8_000_000, 2000])
def test_decontamination(spark, monkeypatch, block):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", block)
    data = rows()
    long = data[40][1].split() if data[40][1] else data[-8][1].split()
    items = [(1, None), (2, ""), (3, "two words"), (4, data[9][1][:200]), (4, data[9][1][:200]), (5, "w1 not there at all but long enough")]
    items += [(10 + i, " ".join(data[8 + i][1].split()[3 : 20 + 3 * i])) for i in range(8)]
    cut = data[12][1].split()[:60]
    items += [(30 + i, " ".join([*cut[: 60 - i], *["changed"] * i])) for i in range(0, 24, 2)]
    items += [(60, " ".join(long[:30]).upper()), (None, " ".join(data[13][1].split()[:15]))]
    table = spark.createDataFrame([(*x, 1) for x in items], "item_id long, text string, doc_id int")
    found = decontamination.find_contained(frame(spark), table).collect()
    wanted = []
    for doc_id, text, *_ in data:
        own = shingles(text)
        for item_id, item in items:
            q = shingles(item)
            if q and 5 * len(q & own) >= 4 * len(q):
                wanted.append((doc_id, item_id, len(q & own), len(q), len(q & own) / len(q)))
    assert bag(found) == bag(wanted) and 0.8 <= min(w[4] for w in wanted) < 1
    clean = decontamination.without_contained(frame(spark), table)
    assert clean.columns == frame(spark).columns
    hit = [any((q := shingles(i)) and 5 * len(q & shingles(r[1])) >= 4 * len(q) for _, i in items) for r in data]
    assert bag((r.doc_id, r.text) for r in clean.collect()) == bag((r[0], r[1]) for r, h in zip(data, hit, strict=True) if not h)


# Substring de-duplication ------------------------------------------------------------------------


def test_pasted_passages(spark):
    import random

    rng = random.Random(6)
    passages = [text_of(rng, n, 10**6).split() for n in (55, 80, 200)]
    extra = rows()[0][5:]
    data, holders = [], defaultdict(set)
    for i in range(120):
        own = text_of(rng, 150, 10**6).split()
        if i % 4 == 0:
            p = i // 4 % 3
            at = rng.randrange(150)
            own = own[:at] + [w.upper() if rng.random() < 0.3 else w for w in passages[p]] + own[at:]
            holders[p].add(i)
        sep = ["\n" if rng.random() < 0.1 else " " for _ in own]
        data.append((i, "".join(a + b for a, b in zip(own, sep, strict=True)), "en", "s", 1, *extra))
    texts = {r[0]: r[1] for r in data}
    found = substring_dedup.repeated_passages(frame(spark, data + data[:1])).collect()
    assert {r.doc_id for r in found} == set().union(*holders.values())
    first = {min(h) for h in holders.values()}
    assert {r.doc_id for r in found if not r.removed} == first
    for r in found:
        p = r.doc_id // 4 % 3
        assert r.kept_doc_id == min(holders[p]) and r.n_docs == len(holders[p])
        inside = texts[r.doc_id][r.start : r.start + r.n_chars].lower().split()
        assert len(inside) == r.n_words >= substring_dedup.LEAST_WORDS
        # A paragraph at the edge may be similar only, by a word of what surrounds the passage.
        assert sum(w in passages[p] for w in inside) >= len(inside) - 4


@pytest.mark.parametrize("n", [20, 25, 30, 40])
def test_short_equal_passages_are_reported_whole(spark, n):
    import random

    rng = random.Random(n)
    extra, data, at = rows()[0][5:], [], {}
    for i in range(0, 60, 2):
        passage = text_of(rng, n, 10**6).split()
        for d in (i, i + 1):
            own, at[d] = text_of(rng, 60, 10**6).split(), rng.randrange(61)
            data.append((d, " ".join(own[: at[d]] + passage + own[at[d] :]), "en", "s", 1, *extra))
    found = substring_dedup.repeated_passages(frame(spark, data)).collect()
    assert sorted((r.doc_id, r.removed, r.n_words, r.kept_doc_id) for r in found) == [(d, d % 2 == 1, n, d - d % 2) for d in range(60)]
    texts = {r[0]: r[1] for r in data}
    assert all(texts[r.doc_id][: r.start].split() == texts[r.doc_id].split()[: at[r.doc_id]] for r in found)


@pytest.mark.parametrize("middle", [True, False])
def test_passages_with_one_changed_word_are_found(spark, middle):
    import random

    rng = random.Random(51)
    extra, data, change = rows()[0][5:], [], {}
    for i in range(0, 120, 2):
        passage = text_of(rng, 51, 10**6).split()
        change[i + 1] = 25 if middle else rng.randrange(51)
        near = [*passage[: change[i + 1]], "changed", *passage[change[i + 1] + 1 :]]
        for d, own in ((i, passage), (i + 1, near)):
            data.append((d, " ".join([text_of(rng, 30, 10**6), *own, text_of(rng, 30, 10**6)]), "en", "s", 1, *extra))
    found = [r for r in substring_dedup.repeated_passages(frame(spark, data)).collect() if r.removed]
    assert all(r.kept_doc_id == r.doc_id - 1 for r in found) and {r.doc_id for r in found} == change.keys()
    for r in found:
        # Sides of the change of LEAST_WORDS words or more, and the changed word between two of them.
        sides = [n for n in (change[r.doc_id], 50 - change[r.doc_id]) if n >= substring_dedup.LEAST_WORDS]
        assert r.n_words == (51 if len(sides) == 2 else sides[0])


def left_and_linked(data, found):
    """Which word occurrences are left, and the classes of occurrences that equal windows link."""
    texts = {d: t.split(" ") for d, t in data}
    gone = {d: [False] * len(w) for d, w in texts.items()}
    for r in found:
        if r.removed:
            first = dict(data)[r.doc_id][: r.start].count(" ")
            for k in range(first, first + r.n_words):
                gone[r.doc_id][k] = True
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n, first_of = substring_dedup.LEAST_WORDS, {}
    for d, w in texts.items():
        for p in range(len(w) - n + 1):
            e, q = first_of.setdefault(tuple(w[p : p + n]), (d, p))
            for k in range(n):
                parent[root((d, p + k))] = root((e, q + k))
    classes = defaultdict(list)
    for d, w in texts.items():
        for k in range(len(w)):
            if (d, k) in parent:
                classes[root((d, k))].append(not gone[d][k])
    # A word that a near copy has for another one has no like.
    return gone, {root: left for root, left in classes.items() if len(left) > 1}


def test_a_passage_between_two_removed_ones_is_not_lost(spark):
    word = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    r1, r2, g = word("a", 100), word("b", 100), word("g", 24)
    data = [(0, " ".join(r1 + r2)), (1, " ".join(r1 + g + r2)), (2, " ".join(word("x", 30) + g + word("y", 30)))]
    found = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string")).collect()
    gone, classes = left_and_linked(data, found)
    assert all(any(left) for left in classes.values())
    assert sum(gone[1]) == 200 and sum(gone[2]) == 24 and not any(gone[0])


@pytest.mark.parametrize("seed", range(5))
def test_no_word_of_a_repeated_passage_is_lost(spark, seed):
    """Passages pasted whole, nested in one another, with changed, left out and inserted words."""
    import random

    rng = random.Random(seed)
    fresh = iter(range(10**6))
    word = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    pool = [word(rng.choice([20, 24, 40, 60, 120])) for _ in range(8)]
    pool += [pool[0] + pool[1], pool[2][:15] + pool[3] + pool[2][15:], pool[4] + word(5) + pool[5]]
    data = []
    for d in range(40):
        own = word(rng.randrange(0, 30))
        for _ in range(rng.randrange(1, 5)):
            passage = list(rng.choice(pool))
            for _ in range(rng.choice([0, 0, 1, 2, 4])):
                at = rng.randrange(len(passage))
                passage[at : at + rng.choice([0, 1])] = word(rng.choice([0, 1]))
            own += passage + word(rng.choice([0, 0, 3, 25]))
        data.append((d, " ".join(own)))
    found = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(3)).collect()
    _, classes = left_and_linked(data, found)
    assert len(classes) > 200 and all(any(left) for left in classes.values())


def pasted(seed, n=60):
    """(doc_id, text) of passages in random surroundings: in one text twice, in texts of one doc_id, in rows that come again, with
    words and gaps of over 255 characters and some outside ASCII."""
    import random

    rng = random.Random(seed)
    pool = [text_of(rng, k, 10**6).split() for k in (20, 21, 30, 45, 80, 300)]
    pool += [pool[3][:30] + ["ä" * 300, "x" * 700] + pool[4], ["same"] * 600, pool[0] + pool[2]]
    data = []
    for i in range(n):
        own = []
        for _ in range(rng.randrange(1, 5)):
            own += text_of(rng, rng.randrange(0, 30), 10**6).split() + rng.choice(pool)
        gap = " " * rng.choice([1, 1, 1, 300])
        data.append((i // 2 if i % 3 == 0 else i, "É " + gap.join(own) if i % 4 else " ".join(own).upper()))
    return data + data[:5] + [(None, data[0][1]), (7, None), (8, "")]


def plain_windows(data):
    """(doc_id, text, place) -> (n_docs, kept (doc_id, place)) of the windows in at least two documents."""
    n, holders = substring_dedup.LEAST_WORDS, defaultdict(set)
    for d, t in set(data):
        own = words(t) if d is not None and t else []
        for p in range(len(own) - n + 1):
            holders[tuple(own[p : p + n])].add((d, p, t))
    return {(d, t, p): (len({h[0] for h in own}), min(own)[:2]) for own in holders.values() if len({h[0] for h in own}) > 1 for d, p, t in own}


@pytest.mark.parametrize("of_key", [1, 40, 2_000_000])
def test_runs_say_of_each_window_what_all_windows_say(spark, monkeypatch, of_key):
    """Whether a key's runs are gathered by one task or its windows aggregated."""
    monkeypatch.setattr(substring_dedup, "MOST_OF_KEY", of_key)
    monkeypatch.setattr(substring_dedup, "ROWS", 7)
    seen = []
    monkeypatch.setattr(substring_dedup, "judged_windows", lambda found, real=substring_dedup.judged_windows: seen.append(1) or real(found))
    data = pasted(3)
    wanted = plain_windows(data)
    covered = defaultdict(set)
    for d, t, p in wanted:
        covered[d, t].update(range(p, p + substring_dedup.LEAST_WORDS))
    frame_ = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    found = substring_dedup.repeated_passages(frame_).collect()
    assert bool(seen) == (of_key < 2_000_000) and len(wanted) > 3000
    # Of texts that have their doc_id for themselves, the spans are the words of the repeated windows, where they are.
    texts = defaultdict(set)
    for d, t in data:
        texts[d].add(t)
    alone = {d: next(iter(own)) for d, own in texts.items() if len(own) == 1 and d is not None}
    for d, t in alone.items():
        at = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")]
        spans = [(r.start, r.start + r.n_chars, r.n_words) for r in found if r.doc_id == d]
        own = {k for k, (a, b) in enumerate(at) if any(x <= a and b <= y for x, y, _ in spans)}
        assert covered[d, t] <= own and bool(own) == bool(covered[d, t])
        assert all(sum(x <= a and b <= y for a, b in at) == k and x in dict(at) for x, y, k in spans)
    most = defaultdict(int)
    for (d, _, _), (n, _) in wanted.items():
        most[d] = max(most[d], n)
    assert {d: max(r.n_docs for r in found if r.doc_id == d) for d in most} == most
    kept = defaultdict(set)
    for (d, _, _), (_, (least, _)) in wanted.items():
        kept[d].add(least)
    assert all(r.kept_doc_id in kept[r.doc_id] for r in found)


def test_gathered_and_aggregated_keys_have_the_same_spans(spark, monkeypatch):
    frame_ = spark.createDataFrame(pasted(5), "doc_id long, text string").repartition(4)
    found = bag(substring_dedup.repeated_passages(frame_).collect())
    monkeypatch.setattr(substring_dedup, "MOST_OF_KEY", 60)
    monkeypatch.setattr(substring_dedup, "MOST_OF_RUN", 2)
    assert bag(substring_dedup.repeated_passages(frame_).collect()) == found and len(found) > 100


def test_runs_are_judged_alike_wherever_batches_end(monkeypatch):
    import pyarrow as pa

    hasher, texts, parts = decontamination.Hasher(), [], []
    for d, t in pasted(6):
        data = (t or "").encode().lower()
        own, starts, ends = hasher.words(data)
        keys, hashes = substring_dedup.window_keys(own)
        if d is not None and len(keys):
            texts.append((d, zlib.crc32(data) - 2**31))
            parts.append((keys, hashes, np.arange(len(keys)), starts[: len(keys)], ends[substring_dedup.LEAST_WORDS - 1 :]))
    found = pa.Table.from_batches(substring_dedup.run_batches(texts, parts, substring_dedup.MOST_OF_RUN)).sort_by([("key", "ascending"), ("doc_id", "ascending")])
    whole = pa.Table.from_batches(substring_dedup.judge(iter(found.combine_chunks().to_batches()))).to_pylist()
    monkeypatch.setattr(substring_dedup, "ROWS", 2)
    batches = list(substring_dedup.judge(iter(found.combine_chunks().to_batches(max_chunksize=3))))
    assert len(batches) > 100 and pa.Table.from_batches(batches).to_pylist() == whole and len(whole) > 300


def test_repeated_passages_store_less_than_the_texts(spark, tmp_path, monkeypatch):
    """No row of each window goes to disk: on 0.51 GB these took more than all the disk there was."""
    import itertools
    import random

    rng, number = random.Random(1), itertools.count()
    monkeypatch.setattr("trailpack.llm.common.scratch_dir", lambda spark: f"{tmp_path}/{next(number)}")
    pool = [text_of(rng, 400, 10**6) for _ in range(40)]
    data = [(i, f"{rng.choice(pool)} {text_of(rng, 20, 10**6)}") for i in range(800)]
    found = substring_dedup.repeated_passages(spark.createDataFrame(data, "doc_id long, text string").repartition(4)).collect()
    assert sum(r.removed for r in found) >= 760
    assert 0 < sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.2 * sum(len(t) for _, t in data)


def test_hard_documents_have_passages_where_they_repeat(spark):
    found = substring_dedup.repeated_passages(frame(spark)).collect()
    shared = {r.doc_id for r in found}
    # Copies of the long texts, and the texts that go on after one.
    copied = [r for r in rows() if r[0] is not None and r[1] and len(words(r[1])) >= 60 and sum(words(r[1])[:50] == words(o[1])[:50] and o[0] not in (r[0], None) for o in rows())]
    assert {r[0] for r in copied} <= shared and None not in shared


# Toxicity ----------------------------------------------------------------------------------------


def toxic_data(n=400):
    import random

    rng = random.Random(8)
    bad = ["idiot", "moron", "scum", "bösewicht"]
    data, labels = [], []
    extra = rows()[0][5:]
    for i in range(n):
        own = text_of(rng, rng.randrange(30, 120), 300).split()
        if i % 5 == 0:
            for _ in range(rng.randrange(2, 6)):
                own.insert(rng.randrange(len(own)), rng.choice(bad))
        data.append((i, " ".join(own), "en", "s", 1, *extra))
        labels.append((i, 1, int(i % 5 == 0)))
    return data, labels


def labels_of(spark, labels):
    return spark.createDataFrame([(*x, "t") for x in labels], "doc_id long, quality int, toxic int, text string")


def test_toxicity_held_out(spark):
    data, labels = toxic_data()
    found = toxicity.toxicity_report(frame(spark, data), labels_of(spark, labels)).collect()
    assert len(found) == len(data)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == (r.doc_id % 5 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in found)
    known = {r.doc_id for r in found if not r.held_out}
    assert all(set(r.near_ids) <= known for r in found)
    # Labels of held-out rows change nothing.
    wrong = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    again = toxicity.toxicity_report(frame(spark, data), labels_of(spark, wrong)).collect()
    assert bag((r.doc_id, r.score) for r in again) == bag((r.doc_id, r.score) for r in found)
    clean = toxicity.without_toxic(frame(spark, data), labels_of(spark, labels))
    assert clean.columns == frame(spark).columns and 310 <= clean.count() <= 325


def dense_vectors(index):
    dense = np.zeros((len(index.ids), len(index.idf)))
    for i, at, weights in index.example_vectors():
        dense[i, at] = weights
    return dense


def check_nearest(index, texts):
    dense = dense_vectors(index)
    for text in texts:
        at, weights = index.vector(text)
        if len(at):
            assert np.linalg.norm(weights) == pytest.approx(1)
            cosines = np.round(dense[:, at] @ weights, 9)
            best = [e for e in np.lexsort((index.ids, -cosines)) if cosines[e] > 0][: toxicity.K]
            found = index.nearest(at, weights)
            assert np.allclose([c for c, _ in found], cosines[best]) and [e for _, e in found] == best
        else:
            assert index.nearest(at, weights) == []


@pytest.mark.parametrize("share", [0.05, 0.2, 2.0])
def test_nearest_are_exact(spark, monkeypatch, share):
    """Against all cosines, with many, some and no common terms."""
    monkeypatch.setattr(toxicity, "COMMON_SHARE", share)
    data, labels = toxic_data()
    index = toxicity.learn(frame(spark, data), labels_of(spark, labels))
    check_nearest(index, [text for _, text, *_ in data] + [r[1] for r in rows()])


def test_few_blocks_are_opened():
    """On the driver's documents: exact neighbours from less than a third of the blocks."""
    import pyarrow.parquet as pq

    sf = "/root/testdata/sf0.1"
    documents = pq.read_table(f"{sf}/documents.parquet").to_pandas()
    known = documents.merge(pq.read_table(f"{sf}/labels.parquet").to_pandas(), on="doc_id")
    known = known[known["toxic"].notna()].drop_duplicates("text")
    terms = [toxicity.terms_of(t) for t in known["text"]]
    first = np.concatenate([[0], np.cumsum([len(h) for h, _ in terms])])
    index = toxicity.Index(
        known["doc_id"].to_numpy(), known["toxic"].to_numpy().astype(int), first, *(np.concatenate(x) for x in zip(*terms, strict=True))
    )
    texts = documents["text"].iloc[5000:5200].tolist()
    check_nearest(index, texts[:40])
    index.opened = index.searched = 0
    for text in texts:
        index.score(text)
    assert index.opened < index.searched * index.blocks / 3


def test_every_example_is_in_the_index(spark):
    import pickle

    data, labels = toxic_data()
    index = toxicity.learn(frame(spark, data), labels_of(spark, labels))
    assert set(index.ids.tolist()) == {d for d, *_ in labels}
    assert set(index.hashes.tolist()) == {h for _, text, *_ in data for h in toxicity.terms_of(text)[0].tolist()}
    assert all(index.score(text)[2][0] == 1 for _, text, *_ in data)
    again = pickle.loads(pickle.dumps(index))
    assert [again.score(text) for _, text, *_ in data[:50]] == [index.score(text) for _, text, *_ in data[:50]]


def test_examples_are_bounded_by_their_terms(spark, monkeypatch):
    data, labels = toxic_data()
    monkeypatch.setattr(toxicity, "POSTINGS", 300)
    index = toxicity.learn(frame(spark, data), labels_of(spark, labels))
    assert 30 < len(index.ids) < 250 and len(index.given[3]) <= 300


@pytest.mark.parametrize("labels", [[], [(0, 1, 0), (3, 1, 0)], [(None, 1, 1), (3, 1, None)], [(0, 0, 1), (0, 0, 0), (3, 1, 0), (27, 1, 1)]])
def test_toxicity_on_hard_rows(spark, labels):
    found = toxicity.toxicity_report(frame(spark), labels_of(spark, labels)).collect()
    assert bag((r.doc_id,) for r in found) == bag((r[0],) for r in rows())
    assert all(r.score is not None and 0 <= r.score <= 1 for r in found)


# Empty tables ------------------------------------------------------------------------------------


def test_empty_tables(spark):
    none = frame(spark, [])
    items = spark.createDataFrame([], "item_id long, text string")
    labels = labels_of(spark, [])
    for found in (
        line_dedup.line_report(none),
        line_dedup.dedup_lines(none),
        packing.pack(none),
        quality.judge_quality(none),
        simhash.near_duplicates(none),
        simhash.one_of_each(none),
        decontamination.find_contained(none, items),
        decontamination.without_contained(none, items),
        substring_dedup.repeated_passages(none),
        toxicity.toxicity_report(none, labels),
        toxicity.without_toxic(none, labels),
    ):
        assert found.collect() == []
    assert decontamination.without_contained(frame(spark), items).count() == len(rows())


# Near copies -------------------------------------------------------------------------------------


def changed(rng, words, share):
    """``words`` with some replaced, left out or put in, until their five-word shingles are just at ``share``."""
    own = list(words)
    before = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
    while True:
        tried = list(own)
        at = rng.randrange(len(tried))
        tried[at : at + rng.choice([0, 1, 1])] = [f"new{rng.random()}"] if rng.random() < 0.8 else []
        after = {tuple(tried[i : i + 5]) for i in range(len(tried) - 4)}
        if len(before & after) < share * len(before | after):
            return own
        own = tried


def test_near_copies(spark):
    """Pairs at a similarity of 0.8 and 0.9: nine in ten are found; what is below is left alone; one of each group stays."""
    import random

    rng = random.Random(5)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(20_000)]
    data, pairs = [], {}
    for k in range(240):
        own = [rng.choice(vocabulary) for _ in range(rng.choice([60, 200, 900]))]
        share = (0.8, 0.9, 0.5)[k % 3]
        other = changed(rng, own, 0.8 if share == 0.5 else share)
        if share == 0.5:
            other = [w if i % 12 else f"x{rng.random()}" for i, w in enumerate(own)]
        pairs[k] = share
        data += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other).upper())]
    data += [(1000, None), (1001, ""), (1002, " "), (None, data[0][1]), (1003, "one two"), (1004, "ONE  two")]
    extra = rows()[0][2:]
    kept = near_copies.without_near_copies(frame(spark, [(*d, *extra) for d in data]).repartition(5))
    assert kept.columns == frame(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    left = {i for i in ids if i is not None and i < 1000}
    assert {2 * k for k in pairs} <= left
    for share in (0.8, 0.9):
        own = [k for k in pairs if pairs[k] == share]
        assert sum(2 * k + 1 not in left for k in own) >= 0.9 * len(own), share
    assert all(2 * k + 1 in left for k in pairs if pairs[k] == 0.5)
    assert {1000, 1001, 1002, 1003} <= set(ids)
    assert 1004 not in ids and ids.count(None) == 1
    assert near_copies.without_near_copies(frame(spark, [])).collect() == []


def test_pair_keys_miss_no_five_bits():
    """Fingerprints at up to five differing bits share a key."""
    rng = np.random.default_rng(7)
    prints = rng.integers(0, 2**63, 300).astype(np.uint64)
    other = prints.copy()
    for i in range(len(other)):
        for bit in rng.choice(64, rng.integers(0, 6), replace=False):
            other[i] ^= np.uint64(1) << np.uint64(bit)
    sets = [[set() for _ in prints] for _ in range(2)]
    for k, own in enumerate((prints, other)):
        for key, at in near_copies.pair_keys(own, 0):
            for i, value in zip(at.tolist(), key.tolist(), strict=True):
                sets[k][i].add(value)
    shared = [bool(a & b) for a, b in zip(*sets, strict=True)]
    assert all(shared)
