"""Detectors and tests on whole series, against plain definitions."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tidemark.operators import detectors as D


def shocked(seed=1, n=600):
    x = np.sin(np.arange(n) / 5) + np.random.default_rng(seed).normal(0, 0.05, n)
    at = 2 * n // 3
    x[at : at + 16] += np.linspace(0, 3, 16) * (-1) ** np.arange(16)
    return x


@pytest.mark.parametrize("fn", [D.sub_lof_scores, D.sub_pca_scores, D.isolation_scores])
def test_subsequence_detectors_find_the_shock(fn):
    s = fn(shocked())
    assert len(s) == 600 and 400 <= int(np.argmax(s)) <= 431
    assert (fn(np.ones(100)) <= 1).all() and (fn(np.arange(5.0)) == 0).all()


def test_lof_is_the_textbook_one():
    x, m, k = shocked(2, 120), 8, 5
    w = D.windows(x, m)
    d = np.sqrt(((w[:, None] - w[None]) ** 2).sum(2))
    near = [[j for j in sorted(range(len(w)), key=lambda j: (d[i, j], j)) if abs(i - j) >= m][:k] for i in range(len(w))]
    lrd = [1 / np.mean([max(d[j, near[j][-1]], d[i, j]) for j in near[i]]) for i in range(len(w))]
    want = [np.mean([lrd[j] for j in near[i]]) / lrd[i] for i in range(len(w))]
    assert D.sub_lof_scores(x, m, k)[m - 1 :] == pytest.approx(want, rel=1e-6)


def test_pca_leaves_what_the_components_do_not_hold():
    x, m = shocked(3, 200), 8
    w = D.windows(x, m)
    c = w - w.mean(0)
    _, s, v = np.linalg.svd(c, full_matrices=False)
    k = int(np.searchsorted(np.cumsum(s**2), 0.9 * (s**2).sum())) + 1
    assert D.sub_pca_scores(x, m)[m - 1 :] == pytest.approx(np.linalg.norm(c - c @ v[:k].T @ v[:k], axis=1), abs=1e-6)


def test_granger_has_a_direction():
    rng = np.random.default_rng(4)
    a = rng.normal(0, 1, 500)
    b = np.r_[0, 0.9 * a[:-1]] + rng.normal(0, 0.1, 500)
    (fwd, f), (back, _) = D.granger(a, b), D.granger(b, a)
    assert fwd > 0.8 and back < 0.1 and f > 100
    assert D.granger(a * 1e-9, b * 1e-9)[0] == pytest.approx(fwd, abs=1e-6)
    assert D.granger(np.ones(50), b[:50]) == (0.0, 0.0) and D.granger(a[:5], b[:5]) == (0.0, 0.0)


def test_regimes():
    x = np.r_[np.zeros(60), np.full(60, 9.0)] + np.random.default_rng(5).normal(0, 0.5, 120)
    found = D.regimes(x)
    assert found[0][0] == 0 and found[-1][:2] == (60, 120) and all(a[1] == b[0] for a, b in zip(found[:-1], found[1:], strict=True))
    shifted, p, at = D.regime_shift(x)
    assert shifted and p > 0.99 and at == 60
    assert D.regime_shift(np.random.default_rng(6).normal(0, 1, 100))[0] is False


def test_stouffer():
    q = NormalDist()
    want = 1 - q.cdf((q.inv_cdf(0.99) + 2 * q.inv_cdf(0.9)) / math.sqrt(5))
    assert D.stouffer([0.01, 0.1, None, math.nan], [1, 2, 1, 1]) == pytest.approx(want, rel=1e-9)
    assert D.stouffer([]) == 1.0 and D.stouffer([1.0, 0.2]) == 1.0 and D.stouffer([0.0, 0.0]) == 1e-300


def test_block_p_is_the_share_of_runs_as_high():
    c = np.random.default_rng(7).normal(0, 1, 200)
    tops = [c[i : i + 8].max() for i in range(200)]
    assert D.block_p(c, 1.0, 13) == (1 + sum(t >= 1.0 for t in tops)) / 201
    assert D.block_p(np.array([]), 1.0, 3) == 1.0


def test_peaks_and_decomposition():
    t = np.arange(480)
    x = 0.02 * t + 5 * np.sin(2 * np.pi * t / 24) + np.random.default_rng(8).normal(0, 0.2, 480)
    assert D.peaks(x)[0][0] in (23, 24, 25) and D.peaks(np.ones(50)) == []
    trend, seasonal, rest = D.decompose(x, 24)
    assert trend + seasonal + rest == pytest.approx(x)
    assert np.std(rest) < 0.4 and abs(np.corrcoef(seasonal, np.sin(2 * np.pi * t / 24))[0, 1]) > 0.98
    short = D.decompose(x[:30], 24)
    assert (short[1] == 0).all()


def test_ring_moves_few_keys():
    keys = [f"k{i}" for i in range(2000)]
    three, four = D.ring(["a", "b", "c"]), D.ring(["a", "b", "c", "d"])
    assert len(three) == 384 and D.owner([], "k") is None
    moved = [k for k in keys if D.owner(three, k) != D.owner(four, k)]
    assert 0.1 < len(moved) / 2000 < 0.45 and {D.owner(four, k) for k in moved} == {"d"}
