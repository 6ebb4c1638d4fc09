"""Alarm policy over one ordered series: the guard, budgets, shapes, delivery, and the combined scan."""

from __future__ import annotations

import math
from collections import deque
from dataclasses import dataclass, replace

import numpy as np

from tidemark.functions.expressions import MAD_SCALE
from tidemark.operators.kernels import damp_scores, dspot_scores, half_space_scores


@dataclass(frozen=True)
class Guard:
    """k of the last n scores at or above the threshold fire, whatever the current one is; then nothing does for
    `refractory` steps. Scores in `suppress` (pairs of first and last index) count as below and never fire. With a
    cooldown, a score must reach that multiple of the threshold once something has fired."""

    threshold: float
    k: int = 1
    n: int = 1
    refractory: int = 0
    warm_up: int = 0
    cooldown: float = 0.0
    suppress: tuple[tuple[int, int], ...] = ()


#: The policies by name (k, n, refractory).
PRESETS = {"sensitive": (1, 1, 0), "balanced": (1, 1, 60), "precise": (2, 10, 0), "paranoid": (2, 10, 60)}


def apply_guard(scores: np.ndarray, g: Guard) -> np.ndarray:
    hushed = np.zeros(len(scores), bool)
    for first, last in g.suppress:
        hushed[max(0, first) : last + 1] = True
    over = (np.asarray(scores, float) >= g.threshold) & ~hushed  # a score that is no number isn't
    hits = np.cumsum(np.r_[0, over])
    at = np.arange(len(over))
    due = (hits[at + 1] - hits[np.maximum(0, at + 1 - g.n)] >= g.k) & ~hushed & (at >= max(g.warm_up, g.k - 1))
    out, free, fired = np.zeros(len(over), bool), 0, False
    for i in np.flatnonzero(due).tolist():
        if i >= free and not (g.cooldown > 0 and fired and scores[i] < g.cooldown * g.threshold):
            out[i], free, fired = True, i + 1 + g.refractory, True
    return out


def solve_threshold(scores: np.ndarray, rate: float, g: Guard) -> float:
    """The lowest score as threshold with which the guard gives at most round(rate * n) alarms."""
    allowed, levels = round(rate * len(scores)), np.unique(scores)
    lo, hi = 0, len(levels)
    while lo < hi:
        mid = (lo + hi) // 2
        alarms = apply_guard(scores, replace(g, threshold=float(levels[mid]))).sum()
        lo, hi = (lo, mid) if alarms <= allowed else (mid + 1, hi)
    return float(levels[lo]) if lo < len(levels) else math.inf


def effect(x: np.ndarray, at: int, window: int = 200) -> float:
    """Distance of a value from the median before it, in scaled MADs."""
    past = x[max(0, at - window) : at]
    if len(past) < 4:
        return 0.0
    m = float(np.median(past))
    s = MAD_SCALE * float(np.median(np.abs(past - m)))
    return abs(float(x[at]) - m) / s if s > 0 else (0.0 if x[at] == m else math.inf)


def shape(x: np.ndarray, start: int, stop: int, around: int = 0) -> str:
    """What kind of change [start, stop] is, from medians, spread and slope before, during and after.

    The context on either side is `around` points, by default four times the change's length and 30 at least; fewer
    than four before it give "unknown", fewer than four after it count as more of the same.
    """
    if not 0 <= start <= stop < len(x):
        return "unknown"
    length = stop - start + 1
    around = around if around >= 4 else max(30, 4 * length)
    before, during, after = x[max(0, start - around) : start], x[start : stop + 1], x[stop + 1 : stop + 1 + around]
    if len(before) < 4:
        return "unknown"
    spread = lambda p: MAD_SCALE * float(np.median(np.abs(p - np.median(p))))
    slope = lambda p: float(np.polyfit(np.arange(len(p)), p, 1)[0]) if len(p) > 1 else 0.0
    m0, m1, s = float(np.median(before)), float(np.median(during)), spread(before)
    m2 = float(np.median(after)) if len(after) >= 4 else m1
    if s > 0 and length >= 10 and (during == during[0]).all() and abs(during[0] - m0) > 3 * s:
        return "gap"
    s = s if s > 0 else abs(m0) * 1e-6 or 1e-9
    if abs(m1 - m0) < 3 * s:
        if spread(during) >= 2 * s:
            return "variance"
        return "trend_break" if abs(slope(after) - slope(before)) * len(after) > 3 * s else "unknown"
    up = m1 > m0
    if abs(m2 - m0) >= 0.5 * abs(m1 - m0):
        return "level_up" if up else "level_down"
    return "spike" if up else "dip"


def deliver(alerts: list[tuple[float, str]], every: float = 1800, most: int = 5, within: float = 7200) -> list[bool]:
    """Which alerts (time, key) in order are sent: none within `every` of the last of its key, and none once more
    than `most` of its key have come within the given span."""
    last: dict[str, float] = {}
    times: dict[str, deque] = {}
    out = []
    for t, key in alerts:
        if key in last and t - last[key] < every:
            out.append(False)
            continue
        last[key] = t
        seen = times.setdefault(key, deque())
        seen.append(t)
        while seen and t - seen[0] > within:
            seen.popleft()
        out.append(len(seen) <= most)
    return out


def cauchy_p(ps: np.ndarray) -> np.ndarray:
    """Cauchy combination over rows."""
    p = np.clip(ps, 1e-300, 1.0)
    t = np.where(p < 1e-15, 1 / (p * math.pi), np.tan((0.5 - p) * math.pi)).mean(axis=0)
    return np.clip(np.where(t > 1e15, 1 / (np.maximum(t, 1) * math.pi), 0.5 - np.arctan(t) / math.pi), 0, 1)


def tail_ranks(s: np.ndarray, warm_up: int) -> np.ndarray:
    """(1 + earlier scores as large) / (n + 1); 1 while warming up."""
    import bisect

    past, out = [], np.ones(len(s))
    for i, v in enumerate(s.tolist()):
        if i >= warm_up:
            out[i] = (1 + len(past) - bisect.bisect_left(past, v)) / (len(past) + 1)
        bisect.insort(past, v)
    return out


def scan(x: np.ndarray, rate: float = 1 / 2000, least_effect: float = 3.0, gap: int = 10, policy: str = "balanced") -> list[tuple[int, int, float, float, str]]:
    """Alarms (start, stop, peak score, effect, shape) of a series: extreme values, discords and half-space mass
    combined, a threshold by alarm budget, the guard, the effect gate, and regions with gaps bridged."""
    if len(x) < 400:
        return []
    warm = max(200, len(x) // 4)
    # a detector that gave no score at all did not run and has no say
    ranks = [tail_ranks(s, warm) for s in (damp_scores(x), half_space_scores(x)) if s.any()]
    ps = np.stack([10.0 ** -dspot_scores(x, warm), *ranks])
    score = -np.log10(cauchy_p(np.maximum(ps, 1 / (10 * len(x)))))
    k, n, refractory = PRESETS[policy]
    g = Guard(0, k, n, refractory, warm)
    g = Guard(solve_threshold(score, rate, g), k, n, refractory, warm)
    hits = [int(i) for i in np.flatnonzero(apply_guard(score, g)) if effect(x, int(i)) >= least_effect]
    out: list[tuple[int, int, float, float, str]] = []
    for i in hits:
        stop = i
        while stop + 1 < len(x) and score[stop + 1 : stop + 1 + gap].max(initial=0) >= g.threshold:
            stop += 1
        if not out or i > out[-1][1]:
            out.append((i, stop, float(score[i : stop + 1].max()), effect(x, i), shape(x, i, stop)))
    return out
