"""Sequential and linear-algebra detectors over one ordered series, and tests between series; NumPy on whole series."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np

from tidemark.functions.expressions import MAD_SCALE
from tidemark.operators.kernels import change_points

_NORMAL = NormalDist()


def windows(x: np.ndarray, m: int) -> np.ndarray:
    """Subsequences of m points, each scaled to mean 0 and deviation 1; a flat one is all zeros."""
    w = np.lib.stride_tricks.sliding_window_view(np.asarray(x, float), m)
    mu, sd = w.mean(axis=1, keepdims=True), w.std(axis=1, keepdims=True)
    return np.where(sd > 1e-12, (w - mu) / np.where(sd > 1e-12, sd, 1), 0.0)


def spread(scores: np.ndarray, m: int, n: int) -> np.ndarray:
    """Each point's score: that of the subsequence which ends there; 0 before the first one ends."""
    return np.r_[np.zeros(min(n, m - 1)), scores][:n]


def _neighbours(w: np.ndarray, k: int, apart: int, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """(distances, indices) of the k nearest subsequences at least `apart` away, block of rows by block."""
    n, dist, idx = len(w), [], []
    sq = (w * w).sum(axis=1)
    for lo in range(0, n, block):
        rows = np.arange(lo, min(n, lo + block))
        d = np.maximum(0, sq[rows, None] + sq[None, :] - 2 * w[rows] @ w.T)
        d[np.abs(rows[:, None] - np.arange(n)[None, :]) < apart] = np.inf
        near = np.argsort(d, axis=1, kind="stable")[:, :k]
        dist.append(np.sqrt(np.take_along_axis(d, near, axis=1)))
        idx.append(near)
    return np.concatenate(dist), np.concatenate(idx)


def sub_lof_scores(x: np.ndarray, m: int = 16, k: int = 10) -> np.ndarray:
    """Local outlier factor of subsequences: the neighbours' mean reachability density over the own."""
    if len(x) < m + 2:
        return np.zeros(len(x))
    dist, idx = _neighbours(windows(x, m), k, m)
    ok = np.isfinite(dist)
    count = ok.sum(axis=1)
    far = np.where(count > 0, np.where(ok, dist, -np.inf).max(axis=1, initial=0.0), 0.0)
    mean = np.where(ok, np.maximum(far[idx], dist), 0.0).sum(axis=1) / np.maximum(1, count)
    dense = (count > 0) & (mean <= 1e-12)
    density = np.where(dense, 1e12, 1 / np.maximum(mean, 1e-12))
    out = np.where(ok, density[idx], 0.0).sum(axis=1) / np.maximum(1, count) / density
    return spread(np.where((count == 0) | dense | ~np.isfinite(out), 0.0, out), m, len(x))


def sub_pca_scores(x: np.ndarray, m: int = 16, share: float = 0.9) -> np.ndarray:
    """Distance of each subsequence from the plane of the principal components that hold `share` of the variance."""
    if len(x) < m + 2:
        return np.zeros(len(x))
    w = windows(x, m)
    c = w - w.mean(axis=0)
    values, vectors = np.linalg.eigh(c.T @ c / (len(c) - 1))
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    total = values.sum()
    k = int(np.searchsorted(np.cumsum(values), share * total)) + 1 if total > 0 else 1
    rest = c - c @ vectors[:, :k] @ vectors[:, :k].T
    return spread(np.sqrt((rest * rest).sum(axis=1)), m, len(x))


def isolation_scores(x: np.ndarray, m: int = 16, trees: int = 100, sample: int = 256, seed: int = 42) -> np.ndarray:
    """Isolation forest over subsequences: 2 to the minus mean depth over the expected one."""
    if len(x) < m + 2:
        return np.zeros(len(x))
    w, rng = windows(x, m), np.random.default_rng(seed)
    size = min(sample, len(w))
    expected = lambda n: 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n
    limit, depth = math.ceil(math.log2(max(2, size))), np.zeros(len(w))

    def grow(own: np.ndarray, all_: np.ndarray, level: int) -> None:
        if not len(all_):
            return
        columns = np.flatnonzero(np.ptp(w[own], axis=0) > 0) if len(own) > 1 and level < limit else []
        if not len(columns):
            depth[all_] += level + expected(len(own))
            return
        j = rng.choice(columns)
        cut = rng.uniform(w[own, j].min(), w[own, j].max())
        grow(own[w[own, j] < cut], all_[w[all_, j] < cut], level + 1)
        grow(own[w[own, j] >= cut], all_[w[all_, j] >= cut], level + 1)

    for _ in range(trees):
        grow(rng.choice(len(w), size, replace=False), np.arange(len(w)), 0)
    return spread(2.0 ** (-depth / trees / max(1e-12, expected(size))), m, len(x))


def causal_z(x: np.ndarray, window: int = 100) -> np.ndarray:
    """Distance of each value from the median of the `window` before it in scaled MADs: 0 with fewer than four, and
    infinite where those are all equal and the value differs."""
    x, out = np.asarray(x, float), np.zeros(len(x))
    for i in range(4, len(x)):
        past = x[max(0, i - window) : i]
        m = np.median(past)
        s = MAD_SCALE * np.median(np.abs(past - m))
        out[i] = (x[i] - m) / s if s > 0 else (0.0 if x[i] == m else math.copysign(math.inf, x[i] - m))
    return out


def granger(a: np.ndarray, b: np.ndarray, order: int = 2) -> tuple[float, float]:
    """(improvement, F): how much the past of a lowers the squared error of b beyond b's own past. (0, 0) where a series
    is constant or too short."""
    n = min(len(a), len(b))
    if order < 1 or n <= 3 * order + 1 or not (np.std(a[:n]) > 0 and np.std(b[:n]) > 0):
        return 0.0, 0.0
    a, b = ((np.asarray(s[:n], float) - np.mean(s[:n])) / np.std(s[:n]) for s in (a, b))
    past = lambda s: np.stack([s[order - k : n - k] for k in range(1, order + 1)], axis=1)
    y, own = b[order:], np.c_[np.ones(n - order), past(b)]

    def error(cols: np.ndarray) -> float:
        gram = cols.T @ cols
        beta = np.linalg.solve(gram + np.eye(len(gram)) * (1e-8 * np.trace(gram) / len(gram) + 1e-12), cols.T @ y)
        return float(((y - cols @ beta) ** 2).sum())

    short, full = error(own), error(np.c_[own, past(a)])
    if short <= 0:
        return 0.0, 0.0
    free = len(y) - 2 * order - 1
    f = (short - full) / order / (full / free) if free > 0 and full > 0 else 0.0
    return max(0.0, (short - full) / short), max(0.0, f)


def regimes(x: np.ndarray) -> list[tuple[int, int, float, float]]:
    """(start, stop, mean, deviation) of the stretches between change points; stop is exclusive."""
    ends = [0, *[k for k, _ in change_points(np.asarray(x, float))], len(x)]
    return [(lo, hi, float(np.mean(x[lo:hi])), float(np.std(x[lo:hi]))) for lo, hi in zip(ends[:-1], ends[1:], strict=True) if hi > lo]


def regime_shift(x: np.ndarray, least: float = 0.9) -> tuple[bool, float, int]:
    """(shifted, probability, start) of the last change of level, by Welch's statistic on the last two regimes."""
    found = regimes(x)
    if len(found) < 2:
        return False, 0.0, 0
    (a0, a1, am, asd), (b0, b1, bm, bsd) = found[-2:]
    error = math.sqrt(asd * asd / (a1 - a0) + bsd * bsd / (b1 - b0))
    p = 1 - 2 * (1 - _NORMAL.cdf(abs(bm - am) / error)) if error > 0 else float(am != bm)
    return p >= least, max(0.0, p), b0


def stouffer(ps: list[float | None], weights: list[float] | None = None) -> float:
    """Weighted sum of normal quantiles; what is no number has no say, nor has a weight that isn't positive."""
    got = [(min(1.0, max(1e-300, p)), w) for p, w in zip(ps, weights or [1.0] * len(ps), strict=True) if p is not None and p == p and w > 0]
    if not got:
        return 1.0
    # the quantile of 1 - p is minus that of p, which keeps its digits for small p; p = 1 ends the matter
    if any(p >= 1.0 for p, _ in got):
        return 1.0
    z = -sum(w * _NORMAL.inv_cdf(p) for p, w in got) / math.sqrt(sum(w * w for _, w in got))
    return min(1.0, max(1e-300, 0.5 * math.erfc(z / math.sqrt(2))))


def block_p(calibration: np.ndarray, peak: float, length: int, most: int = 64) -> float:
    """Split conformal p of a run's highest score against the highest of all calibration runs as long, lengths rounded
    down to a power of two of at most `most`."""
    size = 1
    while size * 2 <= min(max(1, length), most):
        size *= 2
    c = np.where(np.isfinite(calibration), calibration, -np.inf)
    if not len(c):
        return 1.0
    tops = np.lib.stride_tricks.sliding_window_view(np.r_[c, np.full(size - 1, -np.inf)], size).max(axis=1)
    tops = tops[np.isfinite(tops)]
    return float((1 + (tops >= peak).sum()) / (len(tops) + 1))


def peaks(x: np.ndarray, most: int = 6) -> list[tuple[int, float]]:
    """(lag, value) of the highest peaks of the autocorrelation of a detrended series, by value, ties to shorter lags."""
    n = len(x)
    if n < 8:
        return []
    t = np.arange(n) - (n - 1) / 2
    y = np.asarray(x, float) - np.mean(x)
    y = y - t * float(t @ y) / float(t @ t)
    f = np.fft.rfft(y, 2 * n)
    acf = np.fft.irfft(f * np.conj(f))[: n // 2 + 1]
    if acf[0] <= 0:
        return []
    acf = acf / acf[0]
    at = np.flatnonzero((acf[1:-1] > acf[:-2]) & (acf[1:-1] >= acf[2:]) & (acf[1:-1] > 0)) + 1
    return sorted(((int(k), float(acf[k])) for k in at), key=lambda p: (-p[1], p[0]))[:most]


def decompose(x: np.ndarray, period: int, rounds: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(trend, seasonal, remainder), which add up to x: seasonal from smoothed cycle subseries less its own low pass,
    trend by local linear regression with tricube weights, in turns."""
    x = np.asarray(x, float)
    n = len(x)
    if period < 2 or n < 2 * period:
        trend = _loess(x, max(7, n // 2 | 1))
        return trend, np.zeros(n), x - trend
    trend, seasonal = np.zeros(n), np.zeros(n)
    span = int(1.5 * period / (1 - 1.5 / 7)) | 1
    for _ in range(rounds):
        cycle = np.empty(n)
        for p in range(period):
            cycle[p::period] = _loess((x - trend)[p::period], 7)
        seasonal = cycle - _loess(_smooth(cycle, period), period | 1)
        trend = _loess(x - seasonal, span)
    return trend, seasonal, x - trend - seasonal


def _smooth(x: np.ndarray, size: int) -> np.ndarray:
    c = np.r_[0, np.cumsum(x)]
    i = np.arange(len(x))
    lo, hi = np.maximum(0, i - size // 2), np.minimum(len(x), i + (size + 1) // 2)
    return (c[hi] - c[lo]) / (hi - lo)


def _loess(y: np.ndarray, span: int) -> np.ndarray:
    n = len(y)
    q = min(span, n)
    lo = np.clip(np.arange(n) - q // 2, 0, n - q)
    at = lo[:, None] + np.arange(q)[None, :]
    d = at - np.arange(n)[:, None]
    reach = np.maximum(np.abs(d).max(axis=1, keepdims=True), 1) * max(1.0, span / n) + 1e-9
    w = (1 - np.minimum(1, np.abs(d) / reach) ** 3) ** 3
    v = y[at]
    s0, s1, s2 = w.sum(1), (w * d).sum(1), (w * d * d).sum(1)
    t0, t1 = (w * v).sum(1), (w * d * v).sum(1)
    det = s0 * s2 - s1 * s1
    return np.where(det > 1e-12, (s2 * t0 - s1 * t1) / np.where(det > 1e-12, det, 1), t0 / s0)


def ring(members: list[str], vnodes: int = 128) -> list[tuple[int, str]]:
    """A consistent hash ring: the sorted (crc32, member) of every member's virtual nodes."""
    import zlib

    return sorted((zlib.crc32(f"{m}#{i}".encode()), m) for m in set(members) for i in range(vnodes))


def owner(nodes: list[tuple[int, str]], key: str) -> str | None:
    """The member of the first virtual node at or after the key's hash, around the ring."""
    import bisect
    import zlib

    if not nodes:
        return None
    return nodes[bisect.bisect_left(nodes, (zlib.crc32(key.encode()), "")) % len(nodes)][1]
