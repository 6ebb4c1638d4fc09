"""Sequential models: NumPy kernels over one ordered series, run per key.

Each kernel takes a series' values in order and gives one score per value, from the past only unless it says
otherwise. per_series() runs one over every key in parallel; the streaming job keeps the same classes as state.
"""

from __future__ import annotations

import bisect
import math
import re
from collections import deque
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions.expressions import MAD_SCALE
from tidemark.functions import expressions as X

HISTORY, WARM_UP, RAMP, RUN, DRIFT = 1024, 20, 8, 12, 200


def per_series(df: DataFrame, by: list[str], order: str, value: str, fn: Callable[[np.ndarray], np.ndarray], out: str = "score") -> DataFrame:
    types = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*by, order, value]) + f", {out} double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")[[*by, order, value]]
        return pdf.assign(**{out: np.asarray(fn(pdf[value].to_numpy(float)), float)})

    return df.groupBy(*by).applyInPandas(run, schema)


def tail(z: float, side: str = "both") -> float:
    z = abs(z) if side == "both" else max(z, 0.0) if side == "high" else max(-z, 0.0)
    return min(1.0, (2 if side == "both" else 1) * 0.5 * math.erfc(z / math.sqrt(2)))


def severity_score(p: float) -> float:
    return 100.0 if p <= 0 else 0.0 if p >= 1 else min(100.0, max(0.0, -math.log10(p) / 12 * 100))


class TemporalModel:
    """Robust baseline of one series: observe(v) gives (p, score, typical, scale, kind) and then learns v, unless told
    not to; such a value is scored by itself alone."""

    def __init__(self, side: str = "both", warm_up: int = WARM_UP, keep: int = HISTORY) -> None:
        self.side, self.warm_up, self.history, self.recent, self.streak = side, warm_up, deque(maxlen=keep), deque(maxlen=RUN), 0

    def learn(self, v: float) -> None:
        if math.isfinite(v):
            self.history.append(v)

    def baseline(self) -> tuple[float, float]:
        x = np.array(self.history)
        n = len(x)
        centre = float(np.median(x))
        mad = MAD_SCALE * float(np.median(np.abs(x - centre)))
        if n >= 8 and (line := self._trend(x)) is not None:
            a, b = line
            resid = x - (a + b * np.arange(n))
            centre, mad = a + b * n, MAD_SCALE * float(np.median(np.abs(resid - np.median(resid))))
        if mad <= 0:
            whole = bool((x[:: max(1, n // 64)] == np.floor(x[:: max(1, n // 64)])).all())
            mad = max(1.0, math.sqrt(abs(centre))) if whole else max(0.02 * abs(centre), 1e-9)
        return centre, mad

    @staticmethod
    def _trend(x: np.ndarray) -> tuple[float, float] | None:
        """A line, where it explains half the variance and both halves rise (or fall) with it."""
        t = np.arange(len(x))
        b, a = np.polyfit(t, x, 1)
        total = ((x - x.mean()) ** 2).sum()
        if total <= 0 or 1 - ((x - a - b * t) ** 2).sum() / total < 0.5:
            return None
        if len(x) >= 16:
            h = len(x) // 2
            for part in (x[:h], x[h:]):
                s = np.polyfit(np.arange(len(part)), part, 1)[0]
                if s * b <= 0 or abs(s) < 0.3 * abs(b):
                    return None
        return float(a), float(b)

    def observe(self, v: float, learn: bool = True) -> tuple[float, float, float, float, str]:
        if not math.isfinite(v):
            return 1.0, 0.0, math.nan, math.nan, "point"
        n = len(self.history)
        if n < self.warm_up:
            if learn:
                self.history.append(v)
            return 1.0, 0.0, math.nan, math.nan, "point"
        typical, scale = self.baseline()
        z = (v - typical) / scale
        clamped = z if self.side == "both" else max(z, 0.0) if self.side == "high" else min(z, 0.0)
        p = tail(z, self.side)
        score, kind = severity_score(p) * min(1.0, (n - self.warm_up + 1) / (RAMP + 1)), "point"
        if not learn:
            return p, score, typical, scale, kind
        self.recent.append(clamped)
        if len(self.recent) == RUN:
            mb = tail(float(np.median(self.recent)) * math.sqrt(2 * RUN / math.pi), self.side)
            if severity_score(mb) > score:
                p, score, kind = mb, severity_score(mb), "multi_bucket"
        keep = self.history.maxlen
        self.history.append(v)
        self.streak = (self.streak + int(math.copysign(1, z)) if self.streak * z > 0 else int(math.copysign(1, z))) if abs(z) >= 2 else 0
        if abs(self.streak) >= DRIFT:  # what has lasted so long is the new normal
            self.history = deque(list(self.history)[-DRIFT:], maxlen=keep)
            self.recent.clear()
            self.streak = 0
        return p, score, typical, scale, kind


def temporal(x: np.ndarray) -> np.ndarray:
    m = TemporalModel()
    return np.array([m.observe(float(v))[1] for v in x])


def fit_gpd(excess: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto tail by profile likelihood over a grid, then golden section."""
    x = np.asarray(excess, float)
    mean, top = x.mean(), x.max()
    if mean <= 0 or top <= 0:
        return 0.0, max(float(mean), 1e-12)

    def loss(theta: float) -> float:
        if theta == 0:
            return math.log(mean) + 1
        y = 1 + theta * x
        if (y <= 0).any():
            return math.inf
        k = float(np.log(y).mean())  # below -0.5 the likelihood has no regular maximum and runs to the largest peak
        return math.log(k / theta) + k + 1 if k / theta > 0 and k > -0.5 else math.inf

    grid = np.concatenate([-np.geomspace(0.999, 1e-4, 40) / top, [0.0], np.geomspace(1e-4, 20, 60) / mean])
    costs = [loss(t) for t in grid]
    i = int(np.argmin(costs))
    lo, hi = grid[max(0, i - 1)], grid[min(len(grid) - 1, i + 1)]
    g = (math.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        if loss(a) < loss(b):
            hi = b
        else:
            lo = a
    theta = (lo + hi) / 2
    if loss(theta) > costs[i]:
        theta = float(grid[i])
    if abs(theta) < 1e-12:
        return 0.0, float(mean)
    k = float(np.log(1 + theta * x).mean())
    return k, k / theta


class Spot:
    """Peaks over threshold on a stream: p(v) of the upper tail; peaks refit it, alarms (p below q) are not learned."""

    def __init__(self, calibration: np.ndarray, q: float = 1e-3, level: float = 0.98) -> None:
        self.q, self.n = q, len(calibration)
        self.t = float(np.quantile(calibration, level))
        self.sorted = sorted(calibration.tolist())
        self.peaks = [v - self.t for v in self.sorted if v > self.t]
        self._fit()

    def _fit(self) -> None:
        self.shape, self.scale = fit_gpd(np.array(self.peaks)) if len(self.peaks) >= 10 else (0.0, max(float(np.mean(self.peaks)) if self.peaks else 0.0, 1e-12))

    def p(self, v: float) -> float:
        if v <= self.t:
            return (1 + self.n - bisect.bisect_left(self.sorted, v)) / (self.n + 1)
        y = (v - self.t) / self.scale
        s = math.exp(-y) if abs(self.shape) < 1e-9 else max(0.0, 1 + self.shape * y) ** (-1 / self.shape)
        return max(1e-300, min(1.0, len(self.peaks) / self.n * s))

    def step(self, v: float) -> float:
        p = self.p(v)
        if p >= self.q:
            self.n += 1
            bisect.insort(self.sorted, v)
            if v > self.t:
                self.peaks.append(v - self.t)
                self._fit()
        return p


def dspot_scores(x: np.ndarray, calibration: int = 300, depth: int = 24) -> np.ndarray:
    """-log10 of two-sided tail probabilities of values less the mean of the depth before; 0 while calibrating."""
    c = np.concatenate([[0.0], np.cumsum(np.nan_to_num(x))])
    i = np.arange(len(x))
    lo = np.maximum(0, i - depth)
    r = np.where(i > 0, x - (c[i] - c[lo]) / np.maximum(1, i - lo), 0.0)
    out = np.zeros(len(x))
    if len(x) <= calibration:
        return out
    up, down = Spot(r[:calibration]), Spot(-r[:calibration])
    for k in range(calibration, len(x)):
        out[k] = -math.log10(min(1.0, 2 * min(up.step(float(r[k])), down.step(-float(r[k])))))
    return out


def half_space_scores(x: np.ndarray, trees: int = 25, height: int = 8, window: int = 250, seed: int = 1) -> np.ndarray:
    """Half-space forest over (value, last value, difference); mass of the last full window, swapped when it fills."""
    rng = np.random.default_rng(seed)
    f = np.stack([x, np.r_[x[:1], x[:-1]], np.r_[0.0, np.diff(x)]], axis=1) if len(x) else np.zeros((0, 3))
    nodes = 2 ** (height + 1) - 1
    dim = rng.integers(0, 3, (trees, nodes))
    cut = np.empty((trees, nodes))
    lo, hi = np.zeros((trees, nodes, 3)), np.ones((trees, nodes, 3))
    s = rng.random((trees, 1, 3))
    width = 2 * np.maximum(s, 1 - s)
    lo[:, 0], hi[:, 0] = (s - width)[:, 0], (s + width)[:, 0]
    at = np.arange(trees)
    for k in range(nodes):
        d = dim[:, k]
        cut[:, k] = (lo[at, k, d] + hi[at, k, d]) / 2
        for side, child in enumerate((2 * k + 1, 2 * k + 2)):
            if child < nodes:
                lo[:, child], hi[:, child] = lo[:, k], hi[:, k]
                (hi if side == 0 else lo)[at, child, d] = cut[:, k]
    mass, fresh = np.zeros((trees, nodes)), np.zeros((trees, nodes))
    low, high, out = np.full(3, np.inf), np.full(3, -np.inf), np.zeros(len(x))
    for i, v in enumerate(f):
        low, high = np.minimum(low, v), np.maximum(high, v)
        u = np.where(high > low, (v - low) / np.where(high > low, high - low, 1), 0.5)
        node, total, open_ = np.zeros(trees, np.int64), np.zeros(trees), np.ones(trees, bool)
        for depth in range(height + 1):
            fresh[at, node] += 1
            m = mass[at, node]
            total = np.where(open_, m * 2.0**depth, total)
            open_ &= m > 0.1 * window
            if depth < height:
                node = 2 * node + 1 + (u[dim[at, node]] >= cut[at, node])
        if i >= window:
            out[i] = 1 - total.mean() / (window * (2.0 ** (height + 1) - 1))
        if (i + 1) % window == 0:
            mass, fresh = fresh, np.zeros_like(fresh)
    return out


#: Fixed value: longer series get no matrix profile.
MAX_POINTS = 100_000


def _profile(x: np.ndarray, m: int, left: bool) -> np.ndarray:
    """Smallest z-normalised distance of each subsequence to another, further than m // 4 away, or before it."""
    n = len(x) - m + 1
    if n < m + 1:
        return np.zeros(max(n, 0))
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    mu, sd = w.mean(axis=1), w.std(axis=1)
    flat = sd <= 1e-7 * max(1e-300, float(np.abs(x).max()))
    z = np.where(flat[:, None], 0.0, (w - mu[:, None]) / np.where(flat, 1, sd)[:, None])
    gap, out, i = max(1, m // 4), np.full(n, np.inf), np.arange(n)
    step = max(1, min(512, (1 << 26) // n))
    for lo in range(0, n, step):  # blocks of rows bound the memory
        hi = min(lo + step, n)
        to = hi if left else n
        d = 2 * m - 2 * z[lo:hi] @ z[:to].T
        a, b = i[lo:hi][:, None], i[None, :to]
        either = flat[lo:hi][:, None] | flat[None, :to]
        d = np.where(either, np.where(flat[lo:hi][:, None] & flat[None, :to], 0.0, float(m)), np.maximum(d, 0))
        d[(b > a - gap) & ((b < a + gap) if not left else True)] = np.inf
        out[lo:hi] = np.sqrt(d.min(axis=1))
    return np.where(np.isfinite(out), out, 0.0)


def _spread(p: np.ndarray, n: int, m: int) -> np.ndarray:
    """Each point takes the largest value of the subsequences that cover it."""
    out = np.zeros(n)
    for k in range(m):
        out[k : k + len(p)] = np.maximum(out[k : k + len(p)], p)
    return out


def matrix_profile_scores(x: np.ndarray, m: int = 8) -> np.ndarray:
    return _spread(_profile(x, m, False), len(x), m) if 2 * m <= len(x) <= MAX_POINTS else np.zeros(len(x))


def left_profile_scores(x: np.ndarray, m: int = 8) -> np.ndarray:
    return np.r_[np.zeros(m - 1), _profile(x, m, True)] if 2 * m <= len(x) else np.zeros(len(x))


def damp_scores(x: np.ndarray, m: int = 16, warm_up: int | None = None) -> np.ndarray:
    """Discords by DAMP, at the last point of each subsequence: its distance to the nearest earlier one, sought backwards
    in doubling stretches until one is nearer than the largest distance so far. 0 up to the warm-up (16 m)."""
    warm_up, out = max(2 * m, 16 * m if warm_up is None else warm_up), np.zeros(len(x))
    if len(x) < warm_up + m:
        return out
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    mu, sd = w.mean(axis=1), w.std(axis=1)
    flat = sd <= 1e-7 * max(1e-300, float(np.abs(x).max()))
    z = np.where(flat[:, None], 0.0, (w - mu[:, None]) / np.where(flat, 1, sd)[:, None])
    n_flat, gap, best = np.r_[0, np.cumsum(flat)], max(1, m // 4), 0.0

    def nearest(i: int, lo: int, hi: int) -> float:
        if flat[i] and n_flat[hi] > n_flat[lo]:
            return 0.0
        return math.sqrt(max(0.0, 2 * m - 2 * float((z[lo:hi] @ z[i]).max())))

    for i in range(warm_up, len(z)):
        hi, reach, d = i - gap, 2 * m, math.inf
        while hi > 0:
            lo = max(0, i - reach + 1)
            d = min(d, nearest(i, lo, hi))
            if d < best:
                break
            hi, reach = lo, 2 * reach
        out[i + m - 1] = d
        best = max(best, d)
    return out


def mass(query: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Distance profile of a query by one FFT product."""
    m, n = len(query), len(x)
    size = 1 << (n + m - 1).bit_length()
    dot = np.fft.irfft(np.fft.rfft(x, size) * np.fft.rfft(query[::-1], size), size)[m - 1 : n]
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    mu, sd = w.mean(axis=1), w.std(axis=1)
    d = 2 * m * (1 - (dot - m * mu * query.mean()) / np.maximum(m * sd * query.std(), 1e-300))
    return np.sqrt(np.maximum(d, 0))


def sub_knn_scores(x: np.ndarray, m: int = 16, k: int = 5) -> np.ndarray:
    if len(x) < 2 * m:
        return np.zeros(len(x))
    w = np.lib.stride_tricks.sliding_window_view(x, m)
    z = (w - w.mean(axis=1, keepdims=True)) / np.maximum(w.std(axis=1, keepdims=True), 1e-12)
    out, i = np.zeros(len(z)), np.arange(len(z))
    for lo in range(0, len(z), 512):
        d = np.maximum(0, 2 * m - 2 * z[lo : lo + 512] @ z.T)
        d[np.abs(i[None] - i[lo : lo + 512][:, None]) < m] = np.inf
        near = np.sort(d, axis=1)[:, :k]
        out[lo : lo + 512] = np.sqrt(np.where(np.isfinite(near), near, 0)).mean(axis=1)
    return _spread(out, len(x), m)


def holt_winters(x: np.ndarray, period: int, a: float, b: float, g: float) -> np.ndarray:
    """One-step forecasts of additive smoothing."""
    level, trend = float(x[:period].mean()), float((x[period : 2 * period].mean() - x[:period].mean()) / period)
    season, out = (x[:period] - level).tolist(), np.zeros(len(x))
    for i, v in enumerate(x.tolist()):
        s = season[i % period]
        out[i] = level + trend + s
        last, level = level, a * (v - s) + (1 - a) * (level + trend)
        trend = b * (level - last) + (1 - b) * trend
        season[i % period] = g * (v - level) + (1 - g) * s
    return out


def holt_winters_residuals(x: np.ndarray, period: int = 24) -> np.ndarray:
    if len(x) < 2 * period:
        return np.zeros(len(x))
    fits = [x - holt_winters(x, period, a, b, g) for a in (0.1, 0.3, 0.5, 0.7) for b in (0.05, 0.1, 0.3) for g in (0.1, 0.3, 0.5)]
    return min(fits, key=lambda r: float((r * r).sum()))


def change_points(x: np.ndarray, least: int = 5, threshold: float = 5.0) -> list[tuple[int, float]]:
    """Recursive binary segmentation; a split counts if it beats a line through its segment."""
    out, todo = [], [(0, len(x))]
    while todo:
        lo, hi = todo.pop()
        s, n = x[lo:hi], hi - lo
        if n < 2 * least:
            continue
        c, q = np.cumsum(s), np.cumsum(s * s)
        i = np.arange(least, n - least + 1)
        sse = (q[i - 1] - c[i - 1] ** 2 / i) + (q[-1] - q[i - 1]) - (c[-1] - c[i - 1]) ** 2 / (n - i)
        k, best = int(i[np.argmin(sse)]), float(max(sse.min(), 0.0))
        t = np.arange(n) - (n - 1) / 2
        line = float(((s - s.mean()) ** 2).sum() - (t @ s) ** 2 / (t @ t))
        score = (line - best) / (best / max(1, n - 2) + 1e-9)
        if score >= threshold:
            out.append((lo + k, score))
            todo += [(lo, lo + k), (lo + k, hi)]
    return sorted(out)


def change_point_scores(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k, s in change_points(x):
        out[min(k, len(x) - 1)] = s
    return out


def lord_decisions(x: np.ndarray, q: float = 0.05, warm_up: int = 50) -> np.ndarray:
    """1 where the LORD++ level rejects the empirical tail probability of a value."""
    gamma = lambda j: 1 / (2.2857 * j**1.6)
    past, rejected, out = [], [], np.zeros(len(x))
    for i, v in enumerate(x.tolist()):
        p = (1 + len(past) - bisect.bisect_left(past, v)) / (len(past) + 1) if len(past) >= warm_up else 1.0
        bisect.insort(past, v)
        t = i + 1
        level = gamma(t) * q / 2 + sum((q / 2 if k == 0 else q) * gamma(t - r) for k, r in enumerate(rejected))
        if p <= level:
            rejected.append(t)
            out[i] = 1.0
    return out


# ---- log templates ----------------------------------------------------------------------------------------------

MASKS = [re.compile(p, re.ASCII) for p in X.MASKS]
WILD, TREE_DEPTH, SIMILAR, MAX_CHILDREN = "<*>", 4, 0.4, 100


class Templates:
    """Templates of messages: by token count a shallow prefix tree, then the most similar cluster."""

    def __init__(self) -> None:
        self.tree: dict = {}

    def add(self, tokens: list[str]) -> list[str]:
        node = self.tree.setdefault(len(tokens), {})
        for t in tokens[:TREE_DEPTH]:
            t = WILD if any(c.isdigit() for c in t) else t
            if t not in node and len(node) >= MAX_CHILDREN:
                t = WILD
            node = node.setdefault(t, {})
        clusters = node.setdefault(None, [])
        best, share = None, -1.0
        for c in clusters:
            s = sum(a == b and a != WILD for a, b in zip(c, tokens, strict=True)) / max(1, len(tokens))
            if s > share:
                best, share = c, s
        if best is None or share < SIMILAR:
            clusters.append(best := list(tokens))
        else:
            best[:] = [a if a == b else WILD for a, b in zip(best, tokens, strict=True)]
        return best


def drain(df: DataFrame, key: str, message: str) -> DataFrame:
    """(key, template) with the templates as they stand after all messages. Trees are apart by token count."""
    from pyspark.sql import functions as F

    kind = dict(df.dtypes)[key]
    # the white space of str.split(), so that messages of one tree have one token count
    tokens = F.size(F.filter(F.split(F.coalesce(F.col(message), F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != ""))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, model, found = pdf.sort_values(key), Templates(), []
        for m in pdf[message].fillna(""):
            for pattern in MASKS:
                m = pattern.sub(WILD, m)
            found.append(model.add(m.split()))
        return pd.DataFrame({key: pdf[key], "template": [" ".join(t) for t in found]})

    return df.withColumn("tokens_", tokens).groupBy("tokens_").applyInPandas(run, f"`{key}` {kind}, template string")
