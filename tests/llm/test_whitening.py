import math
import random

import numpy as np
import pytest

from visigraph.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, component int, x string"


def plain(rows, most=16):
    """{(vec_id, component): ...} by the definition, with whole matrices and numpy's own eigenvectors."""
    kept = [(i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in e]) for i, e in rows if e is not None and all(c is not None and math.isfinite(c) for c in e)]
    fit = sorted({tuple(x) for _, x in kept})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    y = np.array([[n * a - b for a, b in zip(x, s, strict=True)] for x in fit], float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:most], u[:, ::-1][:, :most]
    out = []
    for i, x in kept:
        far = [n * a - b for a, b in zip(x, s, strict=True)]
        w = (np.array(far, float) / n) @ u / np.sqrt(np.maximum(e, 1e-300))
        out += [(i, k + 1, n, sum(a * a for a in far), float(w[k]), float(e[k] / np.trace(v))) for k in range(len(e)) if e[k] > 1e-9 * e[0]]
    return sorted(out, key=str)


def compare(spark, rows):
    got = whitening.whiten(spark.createDataFrame([(i, e, 1, 7, "x") for i, e in rows], SCHEMA)).collect()
    want = plain(rows)
    got = sorted(got, key=lambda r: str(tuple(r)[:4]))
    want = sorted(want, key=lambda r: str(r[:4]))
    assert [tuple(r)[:4] for r in got] == [r[:4] for r in want]
    sign = {}
    for r, w in zip(got, want, strict=True):
        if abs(w[4]) > 1e-3:
            sign.setdefault(r.component, np.sign(r.whitened * w[4]))
        assert r.whitened == pytest.approx(sign.get(r.component, 1) * w[4], abs=1e-7)
        assert r.explained == pytest.approx(w[5], rel=1e-9)
        assert r.identity_error <= 1e-9
    return got


def vectors(n, d, seed=0):
    g = np.random.default_rng(seed)
    base = g.standard_normal((n, d)) * np.geomspace(4, 0.5, d) @ g.standard_normal((d, d))
    return [(i, [float(c) for c in x]) for i, x in enumerate(base)]


def test_equals_plain(spark):
    rows = vectors(300, 24)
    rows += [(1000 + i, e) for i, (_, e) in enumerate(rows[:40])] + [rows[0], (None, rows[1][1])]
    rows += [(5000, None), (5001, [None] * 24), (5002, [float("nan")] + [0.0] * 23), (5003, [0.0] * 23 + [float("inf")]), (5004, [1.0] * 24)]
    got = compare(spark, rows)
    assert {r.component for r in got} == set(range(1, 17)) and not {5000, 5001, 5002, 5003} & {r.vec_id for r in got}


def test_fewer_directions_than_components(spark):
    g = np.random.default_rng(3)
    low = g.integers(-40, 40, (60, 3)) @ g.integers(-3, 4, (3, 10)) / 64
    got = compare(spark, [(i, [float(c) for c in x]) for i, x in enumerate(low)])
    assert {r.component for r in got} == {1, 2, 3}


def test_nothing_to_whiten(spark):
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None, 1, 1, ""), (2, [], 1, 1, "")], SCHEMA)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], 1, 1, ""), (2, [1.0, 2.0], 1, 1, "")], SCHEMA)).collect() == []


def test_large_and_short_vectors(spark):
    rows = [(i, [float(a), float(b)]) for i, (a, b) in enumerate([(1e30, 1.0), (-1e30, 2.0), (5.0, -3.0)])] + [(9, [1.5])]
    got = whitening.whiten(spark.createDataFrame([(i, e, 1, 7, "x") for i, e in rows], SCHEMA)).collect()
    assert {r.vec_id for r in got} == {0, 1, 2, 9} and all(r.deviation is None for r in got if r.vec_id < 2)
    small = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0], 1, 1, ""), (2, [1.0], 1, 1, ""), (3, [0.0, 2.0], 1, 1, "")], SCHEMA)).collect()
    assert {(r.vec_id, r.n, r.deviation) for r in small} == {(1, 2, 64**2 + 128**2), (2, 2, 64**2 + 128**2), (3, 2, 64**2 + 128**2)}


@pytest.mark.parametrize("seed", range(12))
def test_spectrum(seed):
    """Close, repeated and zero eigenvalues, and entries of one size only."""
    g = np.random.default_rng(seed)
    d = int(g.integers(1, 40))
    q, _ = np.linalg.qr(g.standard_normal((d, d)))
    kinds = [g.random(d), np.repeat(g.random((d + 2) // 3), 3)[:d], np.where(g.random(d) < 0.5, 0, 1.0), 1 + 1e-13 * g.random(d), np.geomspace(1e6, 1e-3, d), 1 + 1e-6 * np.arange(d)]
    e = np.sort(kinds[seed % len(kinds)])[::-1]
    v = q * e @ q.T
    v = (v + v.T) / 2
    values, found = whitening.spectrum(v)
    true = np.linalg.eigvalsh(v)[::-1][: len(values)]
    scale = max(np.abs(true).max(), 1e-300)
    assert len(values) == min(16, int((e > 1e-12 * scale).sum())) or e.min() <= 1e-12 * scale
    assert np.abs(values - true).max() <= 1e-13 * d * scale
    assert np.abs(found.T @ found - np.eye(len(values))).max() < 1e-12
    assert np.abs(v @ found - found * values).max() <= 1e-12 * d * scale


def test_counts():
    g = random.Random(1)
    for _ in range(50):
        d = g.randrange(1, 15)
        a = np.array([[g.choice([0, 0, 1, -1, 2, g.gauss(0, 1)]) for _ in range(d)] for _ in range(d)], float)
        a = a + a.T
        e = np.linalg.eigvalsh(a)
        if np.abs(e).min() > 1e-9:
            assert whitening.positives(a) == int((e > 0).sum())
