"""Online packing, whitening and hard negatives against plain versions."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hard_cases import frame, rows

from trailpack.llm import hard_negatives, online_packing, vectors, whitening
from trailpack.llm.tokens import encoder, tokenizer_path

# Online packing ----------------------------------------------------------------------------------


def pieces_fill_sequences(found, length):
    """Every id of every document once, sequences gapless and without padding."""
    sequences = defaultdict(list)
    for r in found:
        assert r.length == len(r.ids) // 4 > 0
        sequences[r.sequence_id].append((r.offset, r.length))
    sizes = []
    for places in sequences.values():
        at = 0
        for offset, n in sorted(places):
            assert offset == at
            at += n
        sizes.append(at)
    short = [n for n in sizes if n != length]
    assert max(sizes, default=0) <= length
    assert all(n & (n - 1) == 0 for n in short) and len(set(short)) == len(short)
    return sizes


def whole_documents(found):
    """The documents' ids, from their pieces, as a bag."""
    by_doc = defaultdict(lambda: defaultdict(list))
    for r in found:
        by_doc[r.doc_id, r.doc_tokens][r.start].append(r.ids)
    return by_doc


@pytest.mark.parametrize(("fan", "parts", "open_windows"), [(64, 1, 16), (2, 9, 3), (3, 40, 1)])
def test_online_packing(spark, monkeypatch, fan, parts, open_windows):
    monkeypatch.setattr(online_packing, "FAN", fan)
    monkeypatch.setattr(online_packing, "BATCH_BYTES", 1000)
    encode = encoder(tokenizer_path()).encode
    data = rows()
    found = online_packing.pack_online(frame(spark).repartition(parts), length=64, open_windows=open_windows).collect()
    sizes = pieces_fill_sequences(found, 64)
    wanted = [(r[0], encode(r[1] or "") + b"\0\0\0\0") for r in data]
    assert sum(sizes) == sum(len(ids) // 4 for _, ids in wanted)
    single = [(d, ids) for d, ids in wanted if sum(d == e for e, _ in wanted) == 1]
    assert len(single) > 30
    by_doc = whole_documents(found)
    for doc_id, ids in single:
        own = by_doc[doc_id, len(ids) // 4]
        assert b"".join(own[start][0] for start in sorted(own)) == ids and all(len(x) == 1 for x in own.values())
    # Repeated rows and null ids: the same bytes in all.
    assert Counter(b"".join(r.ids for r in found)) == Counter(b"".join(ids for _, ids in wanted))


def test_windows_place_best_fit_and_emit_the_fullest():
    rng = random.Random(3)
    windows, model, emitted = online_packing.Windows(20, 4), [], 0
    for _ in range(2000):
        n = rng.choice([1, 2, 3, 7, 12, 19, 20, 41])
        out = windows.add((1, 0, b"abcd" * n, n))
        assert all(sum(len(p[2]) for p in w) == 80 for w in out)
        emitted += len(out)
        left = n % 20
        full = n // 20
        while left:
            fits = [r for r in model if r >= left]
            if fits:
                model.remove(min(fits))
                model.append(min(fits) - left)
                left = 0
            elif len(model) < 4:
                model.append(20 - left)
                left = 0
            else:
                left -= min(model)
                model.remove(min(model))
                full += 1
            full += model.count(0)
            model = [r for r in model if r]
        assert len(out) == full and sorted(windows.room) == sorted(model) and len(windows.open) <= 4


def test_unpadded():
    windows = [[(1, 0, b"abcd" * 5, 5)], [(2, 3, b"efgh" * 6, 9), (3, 0, b"ijkl" * 2, 2)]]
    made = online_packing.unpadded(windows, 8)
    assert [sum(len(p[2]) // 4 for p in w) for w in made] == [8, 4, 1]
    assert made[0] == [(1, 0, b"abcd" * 5, 5), (2, 3, b"efgh" * 3, 9)]


# Whitening ---------------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, x string, n long, s int, leaf string, `first` int"
EXTRA = ("x", 1, 2, "leaf", 3)
NAN, INF = float("nan"), float("inf")


def vector_rows(n=300, dimension=12, seed=4):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 0.3, (6, dimension))
    made = np.float32(centres[rng.integers(0, 6, n)] + rng.normal(0, 0.05, (n, dimension))).tolist()
    data = [(i, v, i % 10 if i % 11 else (i // 11) % 10) for i, v in enumerate(made)]
    data += [data[3], data[3], (100, made[100], 1), (100, made[7], 2), (900, made[50], 3), (901, made[50], 4), (1000, made[200], 3)]
    bad = [(950, None, 1), (951, [], 1), (952, [None] + made[0][1:], 1), (953, [NAN] + made[0][1:], 1), (954, [-INF] + made[0][1:], 1)]
    bad += [(955, made[0][:5], 1), (None, made[9], 1), (956, made[9], None)]
    return data, bad


def vector_frame(spark, data):
    return spark.createDataFrame([r + EXTRA for r in data], VECTORS)


def test_whitening(spark):
    data, bad = vector_rows()
    found = whitening.whiten(vector_frame(spark, data + bad).repartition(5)).collect()
    kept = data + bad[-2:]  # a null vec_id or label is no hindrance here
    x = np.array([[int(np.floor(1024 * np.float64(np.float32(c)))) + 100_000 for c in v] for _, v, _ in kept])
    n, sums = len(x), x.sum(axis=0)
    centred = (n * x - sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1][:8], axes[:, ::-1][:, :8]
    assert len(found) == 8 * n and {r.n for r in found} == {n} and len({r.identity_error for r in found}) == 1
    assert 0 <= found[0].identity_error < 1e-10
    by_row = defaultdict(list)
    for r in found:
        by_row[r.vec_id, r.deviation].append(r)
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(covariance), rel=1e-12)
    signs = {}
    for (vec_id, *_), own, c in zip(kept, x, centred, strict=True):
        got = by_row[vec_id, int(((n * own - sums) ** 2).sum())]
        assert Counter(r.component for r in got) == Counter(list(range(1, 9)) * (len(got) // 8))
        for r in got:
            plain = c @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1])
            signs.setdefault(r.component, np.sign(plain * r.whitened))
            assert r.whitened * signs[r.component] == pytest.approx(plain, abs=1e-9)


def test_whitening_without_variance(spark):
    data = [(i, [0.5, 0.25 * (i % 2), 0.25 * (i % 2)], 1) for i in range(6)]
    found = whitening.whiten(vector_frame(spark, data)).collect()
    assert len(found) == 18
    assert {(r.component, r.whitened is None) for r in found} == {(1, False), (2, True), (3, True)}
    assert {abs(round(r.whitened, 9)) for r in found if r.component == 1} == {1.0}
    assert found[0].identity_error < 1e-12
    same = whitening.whiten(vector_frame(spark, [(i, [0.5, 0.5], 1) for i in range(3)])).collect()
    assert [(r.whitened, r.explained, r.deviation) for r in same] == [(None, 0.0, 0)] * 6
    assert whitening.whiten(vector_frame(spark, [])).collect() == []
    assert whitening.whiten(vector_frame(spark, [(1, None, 1), (2, [], 2)])).collect() == []


def test_large_numbers_stay_exact():
    fit = whitening.Fit(10**9, (2**61, 5), True, np.zeros((2, 0)), np.zeros(0), 0.0)
    x = np.array([[2**40, 1], [2**31, 0]])
    exact = [[2**40 * 10**9 - 2**61, 10**9 - 5], [2**31 * 10**9 - 2**61, -5]]
    assert fit.deviations(x).tolist() == exact
    assert whitening.squares(fit.deviations(x)) == [None, None]
    assert whitening.squares(np.array([[3, 4], [2**31, 2**31]])) == [25, None]
    assert whitening.squares(np.array([[2**31, 2**30]])) == [2**62 + 2**60]


@pytest.mark.parametrize(("dimension", "spread"), [(40, 1.0), (150, 0.0), (3, 1.0), (1, 0.0)])
def test_jacobi_davidson_reaches_double_precision(dimension, spread):
    rng = np.random.default_rng(dimension)
    a = rng.normal(size=(2000, dimension)) * np.linspace(1, 1 + 5 * spread, dimension)
    v = a.T @ a
    passes = [0]

    def product(u):
        passes[0] += 1
        return v @ u

    values, axes = whitening.leading_pairs(product, dimension, 8)
    k = min(8, dimension)
    plain = np.linalg.eigvalsh(v)[::-1][:k]
    assert values == pytest.approx(plain, rel=1e-13) and passes[0] <= 200
    assert np.linalg.norm(v @ axes - axes * values, axis=0).max() <= 1e-12 * values[0]
    assert np.abs(axes.T @ axes - np.eye(k)).max() < 1e-13


def test_sums_of_many_tasks(spark):
    data = spark.range(1000).selectExpr("array(id, 2 * id) AS x").repartition(13)
    total = vectors.summed(data, lambda batches: sum((vectors.matrix(b.column(0)).sum(axis=0) for b in batches if b.num_rows), np.zeros(2)), 13, fan=3)
    assert total.tolist() == [499500.0, 999000.0]


# Hard negatives ----------------------------------------------------------------------------------


def plain_negatives(data):
    known = {(i, (lab + 1) % 10 if i % 7 == 0 else lab, tuple(int(np.floor(256 * np.float64(np.float32(c)))) for c in v)) for i, v, lab in data}
    known = sorted(known)
    out = Counter()
    for a, own, x in known:
        if a % 100:
            continue
        scored = sorted((-sum(p * q for p, q in zip(x, y, strict=True)), i, lab) for i, lab, y in known if i != a)
        for score, positive, _ in [s for s in scored if s[2] == own][:5]:
            fits = [s for s in scored if s[2] != own and 30 * -score <= 100 * -s[0] <= 90 * -score]
            for rank, (other, negative, _) in enumerate(fits[:10], 1):
                out[a, positive, rank, negative, -score, -other] += 1
    return out


@pytest.mark.parametrize("sizes", [(512, 1024, 128, 32), (10, 8, 2, 1)])
def test_hard_negatives(spark, monkeypatch, sizes):
    for name, size in zip(("LEAF_ROWS", "BLOCK", "CHUNK", "SLICE"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, size)
    data, bad = vector_rows(700)
    data += [(2000 + i, data[20][1], i % 10) for i in range(250)]  # one vector that many rows have
    found = hard_negatives.mined(vector_frame(spark, data + bad).repartition(5)).collect()
    assert Counter(map(tuple, found)) == plain_negatives(data) and len(found) > 200
    assert hard_negatives.mined(vector_frame(spark, bad)).collect() == []
    assert hard_negatives.mined(vector_frame(spark, data[1:40])).collect() == []  # no anchors


def test_tree_leaves_out_far_siblings():
    """On vectors in clear groups few leaves are opened, and none that holds a score in the window is left out."""
    rng = np.random.default_rng(6)
    centres = rng.normal(0, 100, (40, 16))
    x = np.floor(centres[rng.integers(0, 40, 4000)] + rng.normal(0, 5, (4000, 16)))
    longest = float(np.max(np.sum(x * x, axis=1)))
    tree = hard_negatives.fit_tree(x[:1000], longest, 100)
    ranges = np.full((2, tree.starts()[-1]), np.inf)
    leaf = tree.route(x, ranges)
    tree.with_ranges(ranges)
    score = x[:50] @ x.T
    high = np.sort(score, axis=1)[:, -2:-1]
    low = np.sort(score, axis=1)[:, -30:-29]
    opened = 0
    seen = {k: set(own.tolist()) for k, own in tree.open_leaves(x[:50], low, high)}
    for a in range(50):
        inside = (score[a] >= low[a]) & (score[a] <= high[a])
        assert all(a in seen.get(int(k), ()) for k in set(leaf[inside]))
        opened += sum(a in own for own in seen.values())
    assert tree.leaves >= 50 and opened <= 0.3 * 50 * tree.leaves
