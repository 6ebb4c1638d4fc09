"""Sequential kernels: known cases, brute force, causality, calibration, and the golden spikes."""

import math
import random

import numpy as np
import pytest

from tidemark.operators import kernels as N
from tidemark.operators import population as P


def noise(n, seed=1):
    return np.random.default_rng(seed).normal(100, 15, n)


def test_golden_spikes():
    i = np.arange(240)
    x = 100 + 6 * np.sin(0.9 * i) + 3 * np.sin(0.37 * i)
    x[[80, 140, 200]] *= 4
    model = N.TemporalModel("high")
    hits = [k for k, v in enumerate(x) if model.observe(float(v))[1] >= 50]
    assert hits == [80, 140, 200]


def test_few_false_alarms_on_noise():
    assert (N.temporal(noise(3000)) >= 50).mean() < 0.005


def test_not_finite_values_are_ignored():
    m = N.TemporalModel()
    for v in noise(50):
        m.observe(float(v))
    before = list(m.history)
    assert m.observe(math.nan)[:2] == (1.0, 0.0) and m.observe(math.inf)[:2] == (1.0, 0.0)
    assert list(m.history) == before


def test_drift_becomes_normal():
    x = np.r_[noise(300), noise(600, 2) + 200]
    s = N.temporal(x)
    assert s[305] > 20 and s[-50:].max() < 50


@pytest.mark.parametrize("fn", [N.temporal, N.dspot_scores, N.half_space_scores, N.left_profile_scores])
def test_scores_do_not_depend_on_the_future(fn):
    x = noise(700)
    y = x.copy()
    y[600:] += 500
    assert np.allclose(fn(x)[:600], fn(y)[:600])


def test_profiles_match_brute_force():
    x = noise(120, 3)
    m = 8
    z = [(x[i : i + m] - x[i : i + m].mean()) / x[i : i + m].std() for i in range(len(x) - m + 1)]
    d = np.array([[np.linalg.norm(a - b) for b in z] for a in z])
    gap = m // 4
    i = np.arange(len(z))
    want = np.where(np.abs(i[:, None] - i) < gap, np.inf, d)
    assert np.allclose(N._profile(x, m, False), want.min(axis=1), atol=1e-5)
    left = np.where(i[None] > i[:, None] - gap, np.inf, d).min(axis=1)
    assert np.allclose(N._profile(x, m, True), np.where(np.isfinite(left), left, 0), atol=1e-5)
    assert np.allclose(N.mass(x[30:38], x), d[30], atol=1e-5)


def test_damp_is_the_left_profile_where_it_matters(monkeypatch):
    x = np.sin(np.arange(1500) / 5) * 10 + np.random.default_rng(4).normal(0, 0.5, 1500)
    x[700:760], x[1000:1016] = 3.0, x[1000:1016][::-1] * 2
    got, m = N.damp_scores(x), 16
    z = N._profile(x, m, True)
    want = np.r_[np.zeros(m - 1), z]
    best = np.maximum.accumulate(got)
    assert (got[:271] == 0).all() and (got[271:] >= want[271:] - 1e-6).all()
    record = np.flatnonzero(np.r_[False, got[1:] > best[:-1]])
    flat = np.array([np.ptp(x[i - m + 1 : i + 1]) == 0 for i in record])  # _profile puts those at sqrt(m)
    assert len(record) > 2 and np.allclose(got[record][~flat], want[record][~flat], atol=1e-5)
    monkeypatch.setattr(N, "MAX_POINTS", 100)
    assert not N.matrix_profile_scores(x).any() and N.left_profile_scores(x).any()


def test_detectors_find_a_planted_anomaly():
    x = np.sin(np.arange(1200) / 5) * 10 + np.random.default_rng(4).normal(0, 0.5, 1200)
    x[900:908] += 40
    for fn in (N.half_space_scores, N.matrix_profile_scores, N.temporal):
        s = fn(x)
        assert 880 <= int(np.argmax(s[400:])) + 400 <= 925, fn.__name__

    y = noise(1200, 9)  # a tail fit needs a noisy series: a pure cycle is bounded, and the first value past its bound is extreme
    y[900] += 150
    assert int(np.argmax(N.dspot_scores(y))) == 900


def test_tail_fit_recovers_an_exponential():
    shape, scale = N.fit_gpd(np.random.default_rng(5).exponential(3, 4000))
    assert abs(shape) < 0.08 and abs(scale - 3) < 0.3


def test_change_points():
    x = np.r_[np.zeros(60), np.ones(60) * 10, np.ones(60) * 3] + np.random.default_rng(6).normal(0, 0.3, 180)
    assert [k for k, _ in N.change_points(x)] == [60, 120]


def test_templates():
    t = N.Templates()
    for u in ("ann", "bob", "cid"):
        got = t.add(["login", "by", u, "from", "host"])
    assert got == ["login", "by", "<*>", "from", "host"] or len(t.tree[5]["login"]["by"]) == 3


def test_templates_read_every_line(spark):
    from tidemark.plans import catalog

    texts = ["first line\n second one ends here\n", "first line\n\nsecond one ends there", "\u00a0one\u2003two\x1fthree ", "one two three", "", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "key int, message string")
    got = {r["key"]: r["template"] for r in N.drain(rows, "key", "message").collect()}
    assert got == {0: "first line second one ends <*>", 1: "first line second one ends <*>", 2: "one two three", 3: "one two three", 4: "", 5: ""}

    sf = "/root/testdata/sf0.001"
    turns = spark.read.parquet(f"{sf}/conversations.parquet").select("text").toPandas()["text"]
    have = catalog.QUERIES["drain_templates"](spark, sf).toPandas()
    assert have["n"].sum() == len(turns)
    assert (have["template"].str.split().str.len() * have["n"]).sum() == turns.str.split().str.len().sum()


def test_population_pools_all_earlier_buckets(spark):
    from tidemark.operators import baseline as B

    rng = np.random.default_rng(10)
    rows = [(s, d, u, float(rng.normal(10 * (d < 60) + 5 * (s == "b"), 3))) for s in "ab" for d in range(150) for u in range(3)] + [("a", 40, 9, None)]
    got = B.population_zscore(spark.createDataFrame(rows, "s string, bucket long, user int, v double"), ["s"], "v").collect()
    assert len(got) == len(rows)
    for r in got:
        past = np.array([v for s, d, _, v in rows if s == r["s"] and d < r["bucket"] and v is not None])
        assert r["n_past"] == len(past)
        if len(past) >= 20:
            m = np.median(past)
            assert r["typical"] == pytest.approx(m) and r["scale"] == pytest.approx(1.4826 * np.median(abs(past - m)), rel=1e-6)


def test_outliers_stand_out():
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal((50, 60, 10), 3, (200, 3)), np.array([[90, 60, 10], [50, 99, 10], [50, 60, 60], [5, 5, 5], [80, 80, 50]])]
    s, influence = P.ensemble(x)
    assert set(np.argsort(s)[-5:]) == {200, 201, 202, 203, 204}
    assert np.median(s[:200]) <= 0.15 and np.allclose(influence.sum(axis=1), 1)


def test_online_discovery_control():
    rng = random.Random(8)
    x = np.array([rng.gauss(0, 1) for _ in range(600)])
    assert N.lord_decisions(x).sum() <= 3
