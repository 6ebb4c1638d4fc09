"""Alarm policy: guard, budget, shapes, delivery and the combined scan."""

import numpy as np

from tidemark.operators import policy as A


def test_guard_and_budget():
    s = np.array([0, 5, 0, 5, 5, 0, 0, 5, 5, 5], float)
    assert A.apply_guard(s, A.Guard(4, 2, 3)).tolist() == [False, False, False, True, True, True, False, False, True, True]  # the sixth: two hits are still in the ring
    assert A.apply_guard(s, A.Guard(4, refractory=3)).sum() == 2
    assert A.apply_guard(np.array([9.0] * 6), A.Guard(4, suppress=((1, 3),))).tolist() == [True, False, False, False, True, True]
    assert A.apply_guard(np.array([9.0, 9, 19, np.nan, 30]), A.Guard(4, cooldown=4.0)).tolist() == [True, False, True, False, True]
    t = A.solve_threshold(np.arange(1000.0), 0.01, A.Guard(0))
    assert t == 990 and A.apply_guard(np.arange(1000.0), A.Guard(t)).sum() == 10


def test_shapes():
    x = np.random.default_rng(1).normal(0, 1, 300)
    up, spike, dip = x.copy(), x.copy(), x.copy()
    up[150:] += 20
    spike[150:160] += 20
    dip[150:160] -= 20
    assert A.shape(up, 150, 160) == "level_up" and A.shape(spike, 150, 159) == "spike" and A.shape(dip, 150, 159) == "dip"
    assert A.shape(x, 2, 5) == "unknown"
    gap, loud = x.copy(), x.copy()
    gap[150:170] = -60.0
    loud[150:190] *= 8
    assert A.shape(gap, 150, 169) == "gap" and A.shape(loud, 150, 189) == "variance"


def test_delivery():
    got = A.deliver([(0, "a"), (10, "a"), (10, "b"), (1800, "a"), (3600, "a"), (5400, "a")], most=3)
    assert got == [True, False, True, True, True, False]


def test_scan_finds_a_shift_and_says_what_it_is():
    x = np.random.default_rng(2).normal(100, 1, 3000)
    assert len(A.scan(x)) <= 3
    x[2200:2230] += 50
    alarms = A.scan(x)
    (hit,) = [a for a in alarms if 2190 <= a[0] <= 2232]
    assert hit[3] >= 3 and hit[4] in ("spike", "unknown", "level_up", "level_down", "variance")


def test_scan_of_a_long_series():
    x = np.random.default_rng(3).normal(100, 1, 100_200)
    x[90_000:90_030] += 50
    assert any(89_990 <= a[0] <= 90_032 and a[2] > 2 for a in A.scan(x))
