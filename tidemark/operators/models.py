"""Models of the job engine besides the plain baseline: seasonal, distribution and multivariate.

Each observes one bucket after another: observe() scores a value against the past and then learns it.
"""

from __future__ import annotations

import math
from collections import Counter, deque

import numpy as np

from tidemark.functions.expressions import MAD_SCALE
from tidemark.operators.kernels import HISTORY, WARM_UP, TemporalModel, severity_score

REFIT, LEAST_HISTORY, REDETECT, MOST_HISTORY, PHASE_WARM_UP, LEAST_GAIN = 200, 40, 300, 6000, 4, 0.1
MAX_LAG, LEAST_PEAK = 1440, 0.3


def chi2_sf(x: float, k: int) -> float:
    """Upper tail of chi square with k degrees of freedom, summed up from one or two degrees."""
    y = max(0.0, x) / 2
    a = (k % 2) / 2 or 1.0
    total = math.exp(-y) if a == 1.0 else math.erfc(math.sqrt(y))
    term = math.exp(-y) * y**a / math.gamma(a + 1)
    while a < k / 2:
        total, a = total + term, a + 1
        term *= y / a
    return min(1.0, total)


def periods(x: np.ndarray, most: int = 6) -> list[int]:
    """Lags of the strongest peaks of the autocorrelation of a detrended series that reach LEAST_PEAK."""
    x, n = np.asarray(x, float), len(x)
    if n < 8:
        return []
    t = np.arange(n) - (n - 1) / 2
    y = x - x.mean()
    y = y - t * (t @ y) / (t @ t)
    power = float(y @ y)
    if power <= 1e-12 * max(1.0, float(x @ x)):  # a line: what is left is rounding
        return []
    f = np.fft.rfft(y, 2 * n)
    acf = np.fft.irfft(f * np.conj(f))[: min(n // 2, MAX_LAG) + 1] / power
    mid = acf[2:-1]
    at = np.flatnonzero((mid >= LEAST_PEAK) & (mid > acf[1:-2]) & (mid >= acf[3:])) + 2
    return sorted(at.tolist(), key=lambda k: (-acf[k], k))[:most]


def _phase_means(x: np.ndarray, phase: np.ndarray, period: int) -> np.ndarray:
    n = np.bincount(phase, minlength=period)
    m = np.bincount(phase, x, minlength=period) / np.maximum(1, n)
    return m - m.mean()


def components(x: np.ndarray, at: np.ndarray, first: int, second: int = 0) -> tuple[float, np.ndarray, np.ndarray]:
    """(level, profile of the first period, profile of the second): means by phase, in turns where there are two."""
    level = float(x.mean())
    one, two = np.zeros(first), np.zeros(second)
    a, b = at % first, at % second if second else None
    for _ in range(4 if second else 1):
        one = _phase_means(x - level - (two[b] if second else 0.0), a, first)
        if second:
            two = _phase_means(x - level - one[a], b, second)
    return level, one, two


class SeasonalModel:
    """A baseline for each phase of the period found in the past; with a second period, one for what both leave over."""

    def __init__(self, side: str = "both") -> None:
        self.side, self.whole, self.since = side, TemporalModel(side), 0
        self.values: deque[float] = deque(maxlen=MOST_HISTORY)
        self.at: deque[int] = deque(maxlen=MOST_HISTORY)
        self.period = self.second = 0
        self.phases: list[TemporalModel] = []
        self.rest: TemporalModel | None = None
        self.profile = (0.0, np.zeros(1), np.zeros(1))

    def _find(self) -> None:
        self.since = 0
        x, at = np.array(self.values), np.array(self.at)
        usable = lambda lags: [p for p in lags if 2 <= p <= len(x) // 3]
        if not (found := usable(periods(x))):
            return
        first = found[0]
        left = lambda second: x - self._expected(at, components(x, at, first, second))
        alone = float(left(0).var())
        gains = [(1 - float(left(p).var()) / alone, -i, p) for i, p in enumerate(usable(periods(left(0)))) if p != first and alone > 0]
        gain, _, second = max(gains, default=(0.0, 0, 0))
        second = second if gain >= LEAST_GAIN else 0
        if (first, second) == (self.period, self.second):
            return
        self.period, self.second, self.phases, self.rest = first, second, [], None
        if second:
            self.profile, self.rest = components(x, at, first, second), TemporalModel(self.side)
            for v in x - self._expected(at, self.profile):
                self.rest.learn(float(v))
        else:
            self.phases = [TemporalModel(self.side, PHASE_WARM_UP) for _ in range(first)]
            for i, v in zip(at.tolist(), x.tolist(), strict=True):
                self.phases[i % first].learn(v)

    @staticmethod
    def _expected(at, profile):
        level, one, two = profile
        return level + one[at % len(one)] + (two[at % len(two)] if len(two) else 0.0)

    def observe(self, index: int, v: float, learn: bool = True) -> tuple[float, float, float, float, str]:
        if not math.isfinite(v):
            return 1.0, 0.0, math.nan, math.nan, "point"
        self.since += 1
        if len(self.values) >= LEAST_HISTORY and (not self.period or self.since >= REDETECT):
            self._find()
        if self.rest is not None:
            base = float(self._expected(index, self.profile))
            p, score, middle, scale, kind = self.rest.observe(v - base, learn)
            got = p, score, base + (0.0 if math.isnan(middle) else middle), scale, kind
        else:
            got = (self.phases[index % self.period] if self.phases else self.whole).observe(v, learn)
        if learn:
            self.values.append(v)
            self.at.append(index)
        return got


def _normal(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def poisson_cdf(k: float, mean: float) -> float:
    """Sum of the terms up to k; by the normal curve where that sum would be long."""
    if k < 0:
        return 0.0
    if mean > 500 or k > 1000:
        return _normal((k + 0.5 - mean) / math.sqrt(mean))
    return min(1.0, math.fsum(math.exp(i * math.log(mean) - mean - math.lgamma(i + 1)) for i in range(int(k) + 1)))


def cdf(family: str, a: float, b: float, x: float) -> float:
    if family == "lognormal":
        return _normal((math.log(x) - a) / b) if x > 0 else 0.0
    if family == "exponential":
        return -math.expm1(-a * x) if x > 0 else 0.0
    return poisson_cdf(math.floor(x), a) if family == "poisson" else _normal((x - a) / b)


def fit_family(values) -> tuple[str, float, float]:
    """(family, parameters) with the least AIC of normal, lognormal, exponential and, for counts, Poisson.

    Whole numbers are compared by the probability of the unit around each, so that all families are on one footing.
    """
    x = np.asarray(values, float)
    if len(x) < 4:
        return "normal", float(x.mean()), 1.0
    mean, whole = float(x.mean()), bool((x == np.trunc(x)).all())
    fits = [("normal", 2, mean, float(x.std()))]
    if (x > 0).all() and (s := float(np.log(x).std())) > 0:
        fits.append(("lognormal", 2, float(np.log(x).mean()), s))
    if (x >= 0).all() and mean > 0:
        fits.append(("exponential", 1, 1 / mean, 0.0))
        if whole:
            fits.append(("poisson", 1, mean, 0.0))
    times = Counter(x.tolist())

    def log_density(family: str, a: float, b: float, v: float) -> float:
        if family == "poisson":
            return v * math.log(a) - a - math.lgamma(v + 1)
        if whole:
            return math.log(max(1e-300, cdf(family, a, b, v + 0.5) - cdf(family, a, b, v - 0.5)))
        if family == "exponential":
            return math.log(a) - a * v
        u = math.log(v) if family == "lognormal" else v
        return -0.5 * math.log(2 * math.pi) - math.log(b) - 0.5 * ((u - a) / b) ** 2 - (u if family == "lognormal" else 0.0)

    def cost(fit) -> float:
        family, k, a, b = fit
        if family in ("normal", "lognormal") and b <= 0:
            return math.inf
        return 2 * k - 2 * math.fsum(n * log_density(family, a, b, v) for v, n in times.items())

    family, _, a, b = min(fits, key=cost)
    return family, a, b


def family_tail(family: str, a: float, b: float, x: float, side: str) -> float:
    """Probability of a value as extreme; an exponential one has its extreme above unless the side is low."""
    if (family in ("normal", "lognormal") and b <= 0) or (family == "exponential" and x < 0):
        return 1.0
    low = cdf(family, a, b, x)
    high = math.exp(-a * x) if family == "exponential" else 1 - low
    if family == "exponential" and side == "both":
        side = "high"
    return min(1.0, max(1e-300, high if side == "high" else low if side == "low" else 2 * min(low, high)))


class DistributionModel:
    """The family that fits the past best, fitted anew every REFIT values."""

    def __init__(self, side: str = "both") -> None:
        self.side, self.history, self.fit, self.since = side, deque(maxlen=HISTORY), None, 0

    def observe(self, v: float, learn: bool = True) -> tuple[float, float, float, float, str]:
        if not math.isfinite(v):
            return 1.0, 0.0, math.nan, math.nan, "point"
        got = 1.0, 0.0, math.nan, math.nan, "point"
        if len(self.history) >= WARM_UP:
            x = np.array(self.history)
            if self.fit is None or self.since >= REFIT:
                self.fit, self.since = fit_family(x), 0
            self.since += 1
            middle = float(np.median(x))
            scale = MAD_SCALE * float(np.median(np.abs(x - middle)))
            p = family_tail(*self.fit, v, self.side)
            got = p, severity_score(p), middle, scale if scale > 0 else float(x.std()), "point"
        if learn:
            self.history.append(v)
        return got


class MultivariateModel:
    """Distance of a vector from the past ones in the metric of their covariance, against a chi square tail."""

    def __init__(self, k: int) -> None:
        self.k, self.history = k, deque(maxlen=HISTORY)

    def observe(self, v: np.ndarray) -> tuple[float, float, float, np.ndarray]:
        """(p, score, distance, each component's share of it)."""
        got = 1.0, 0.0, 0.0, np.zeros(self.k)
        if not np.isfinite(v).all():
            return got
        if len(self.history) >= WARM_UP:
            past = np.array(self.history)
            c = np.atleast_2d(np.cov(past, rowvar=False))
            c = c + np.eye(self.k) * (1e-6 * np.trace(c) / self.k + 1e-9)
            d = v - past.mean(axis=0)
            parts = d * np.linalg.solve(c, d)
            square, positive = max(0.0, float(parts.sum())), np.maximum(0.0, parts)
            p = chi2_sf(square, self.k)
            share = positive / positive.sum() if positive.sum() > 0 else np.zeros(self.k)
            got = p, severity_score(p), math.sqrt(square), share
        self.history.append(v)
        return got


def radius95(k: int) -> float:
    """The distance that 95 % of vectors stay within, by the cube root of a chi square being nearly normal."""
    t = 2 / (9 * k)
    return math.sqrt(max(0.0, k * (1 - t + 1.645 * math.sqrt(t)) ** 3))


def seasonal_scores(x: np.ndarray) -> np.ndarray:
    m = SeasonalModel()
    return np.array([m.observe(i, float(v))[1] for i, v in enumerate(x)])


def distribution_scores(x: np.ndarray) -> np.ndarray:
    m = DistributionModel()
    return np.array([m.observe(float(v))[1] for v in x])
