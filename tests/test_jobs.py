"""Jobs and their models: planted anomalies, literal values, and brute force over plain rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import jobs as J
from tidemark.operators import models as M
from tidemark.operators.kernels import TemporalModel
from tidemark.operators.rules import Calendar, Rule

HOUR = 3600
D = J.Detector


def test_chi_square_tail():
    for k, x in ((1, 3.841459), (2, 5.991465), (3, 7.814728), (4, 9.487729), (7, 14.06714)):
        assert M.chi2_sf(x, k) == pytest.approx(0.05, rel=1e-5)
    assert M.chi2_sf(0, 3) == 1


def test_periods():
    t = np.arange(300)
    assert M.periods(np.sin(2 * np.pi * t / 24) + 0.01 * t)[0] == 24
    assert M.periods(t * 2.0) == [] and M.periods(np.ones(50)) == [] and M.periods(np.arange(5)) == []


def test_seasonal_model_sees_what_is_out_of_phase():
    rng = np.random.default_rng(1)
    x = 100 + 40 * np.sin(2 * np.pi * np.arange(480) / 24) + rng.normal(0, 1, 480)
    x[450] = 140  # a value of the day's peak at its trough
    m = M.SeasonalModel()
    got = [m.observe(i, float(v)) for i, v in enumerate(x)]
    assert m.period == 24
    assert got[450][1] > 50 and abs(got[450][2] - 60) < 4
    assert got[450][1] == max(s[1] for s in got)
    begun = next(i for i, s in enumerate(got) if i >= 40 and abs(s[2] - x[i]) < 10 and not math.isnan(s[2]))
    assert begun < 120  # the period is found early, and each phase is then a baseline of its own
    for i in range(300, 450):
        past = x[i % 24 : i : 24]
        assert got[i][2] == pytest.approx(np.median(past)) and got[i][3] == pytest.approx(1.4826 * np.median(np.abs(past - np.median(past))))
    assert m.observe(480, math.nan)[1] == 0


def test_second_period_is_taken_out():
    rng = np.random.default_rng(2)
    t = np.arange(900)
    x = 50 + 20 * np.sin(2 * np.pi * t / 12) + 12 * np.sin(2 * np.pi * t / 70) + rng.normal(0, 0.5, 900)
    level, one, two = M.components(x, t, 12, 70)
    assert np.std(x - level - one[t % 12] - two[t % 70]) < 1
    m = M.SeasonalModel()
    for i, v in enumerate(x):
        m.observe(i, float(v))
    assert m.period and m.second and m.rest is not None


def test_families():
    rng = np.random.default_rng(3)
    assert M.fit_family(rng.poisson(4, 1000))[0] == "poisson"
    assert M.fit_family(rng.exponential(3, 1000))[0] == "exponential"
    assert M.fit_family(rng.lognormal(1, 0.5, 1000))[0] == "lognormal"
    assert M.fit_family(rng.normal(0, 1, 1000))[0] == "normal"
    assert M.poisson_cdf(2, 3.0) == pytest.approx(math.exp(-3) * (1 + 3 + 4.5))
    assert M.family_tail("exponential", 0.5, 0, 4, "both") == pytest.approx(math.exp(-2))
    assert M.family_tail("normal", 0, 1, 1.959964, "both") == pytest.approx(0.05, rel=1e-5)
    assert M.family_tail("normal", 0, 0, 3, "both") == 1 and M.family_tail("exponential", 1, 0, -1, "low") == 1


def test_distribution_model_warms_up_and_scores():
    m = M.DistributionModel("high")
    rng = np.random.default_rng(4)
    assert all(m.observe(float(v))[1] == 0 for v in rng.poisson(4, 20))
    for v in rng.poisson(4, 100):
        m.observe(float(v))
    assert m.observe(30.0)[1] > 60 and m.observe(0.0)[1] < 10


def test_multivariate_model_against_plain_algebra():
    rng = np.random.default_rng(5)
    past, v = rng.normal(size=(40, 3)), np.array([3.0, 0.0, -1.0])
    m = M.MultivariateModel(3)
    for row in past:
        m.observe(row)
    p, score, distance, share = m.observe(v)
    c = np.cov(past.T)
    c += np.eye(3) * (1e-6 * np.trace(c) / 3 + 1e-9)
    d = v - past.mean(0)
    assert distance == pytest.approx(math.sqrt(d @ np.linalg.inv(c) @ d))
    assert p == pytest.approx(M.chi2_sf(distance**2, 3)) and share.sum() == pytest.approx(1) and share[0] > 0.5
    assert m.observe(np.array([np.nan, 0, 0]))[:2] == (1.0, 0.0) and len(m.history) == 41
    assert M.radius95(2) == pytest.approx(math.sqrt(5.99), abs=0.02)


def test_skipped_values_are_scored_and_not_learned():
    m = TemporalModel()
    for i in range(40):
        m.observe(float(i % 5))
    before = list(m.history)
    assert m.observe(1000.0, learn=False)[1] > 50
    assert list(m.history) == before


@pytest.mark.parametrize(
    ("job", "says"),
    [
        (J.Job("", 60, (D("count"),)), "name"),
        (J.Job("j", 0, (D("count"),)), "bucket_span"),
        (J.Job("j", 60, ()), "detector"),
        (J.Job("j", 60, (D(),)), "function"),
        (J.Job("j", 60, (D("mean"),)), "field"),
        (J.Job("j", 60, (D("rare"),)), "by_field"),
        (J.Job("j", 60, (D("ratio", "a"),)), "denom_field"),
        (J.Job("j", 60, (D("nonsense", "a"),)), "unknown"),
    ],
)
def test_jobs_are_validated(job, says):
    with pytest.raises(ValueError, match=says):
        job.validate()


def test_names_and_parsing():
    assert [d.id for d in (D("mean", "x"), D("count"), D("mean", "x", over_field="h"), D("rare", by_field="f"), D("ratio", "a", denom_field="b"), D(fields=("a", "b")), D("lat_long", by_field="u"), D("time_of_day"))] == ["mean(x)", "count", "mean(x) over h", "rare(f)", "ratio(a/b)", "multivariate(a,b)", "lat_long by u", "time_of_day"]
    assert J.seconds("1h30m") == 5400 and J.seconds("250ms") == 0.25 and J.seconds(7) == 7
    with pytest.raises(ValueError):
        J.seconds("five")
    job = J.parse('{"name": "a", "bucket_span": "5m", "influencers": ["h"], "detectors": [{"function": "mean", "field": "x", "rules": [{"actual_below": 3, "hours": [1, 2]}]}]}')
    assert job.span_s == 300 and job.detectors[0].rules == (Rule(actual_below=3, hours=(1, 2)),) and job.influencers == ("h",)


@pytest.fixture(scope="module")
def frame(spark):
    """Two hosts, sixty hours, five points an hour; host b leaps in hour 50, by points of zone z2 for the most part."""
    rows = []
    for h in range(60):
        for i in range(5):
            rows.append((h * HOUR + i * 600, 10.0 + (h * 7 + i) % 5, "a", "z1", 1.0))
            leap = h == 50
            rows.append((h * HOUR + i * 600, 500.0 if leap else 20.0 + (h * 3 + i) % 4, "b", "z2" if leap and i else "z1", 2.0))
    df = spark.createDataFrame(rows, "s long, value double, host string, zone string, w double")
    return df.withColumn("time", F.timestamp_seconds("s")).drop("s")


def test_a_record_has_all_its_parts(frame):
    got = J.analyze(frame, J.Job("j", HOUR, (D("mean", "value", by_field="host"),), influencers=("zone",), threshold=50.0)).collect()
    r = next(r for r in got if r.bucket == 50 * HOUR and r.series == "host=b")
    assert (r.detector, r.direction, r.kind) == ("mean(value)", "up", "point") and r.actual == 500 and 20 < r.typical < 25
    assert r.lower < r.typical < r.upper and r.p < 1e-6 and r.score > 50
    assert [tuple(i) for i in r.influencers] == [("zone", "z2", 0.8)]
    assert not any(r.series == "host=a" for r in got)


def test_records_equal_a_plain_loop(frame):
    got = {(r.series, r.bucket): r.score for r in J.analyze(frame, J.Job("j", HOUR, (D("mean", "value", by_field="host"),), threshold=0.001)).collect()}
    want, sums = {}, {}
    for r in frame.collect():
        b = int(r.time.timestamp()) // HOUR * HOUR
        s = sums.setdefault((r.host, b), [0.0, 0])
        s[0], s[1] = s[0] + r.value, s[1] + 1
    for host in "ab":
        m = TemporalModel()
        for (h, b), (total, n) in sorted(sums.items(), key=lambda x: x[0][1]):
            if h == host and (score := m.observe(total / n)[1]) >= 0.001:
                want[f"host={host}", b] = score
    assert got.keys() == want.keys() and len(want) > 3
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_calendars_rules_and_learning(frame):
    job = lambda rules=(), calendars=(): J.Job("j", HOUR, (D("mean", "value", by_field="host", rules=rules),), threshold=50.0, calendars=calendars)
    leaps = lambda j: J.analyze(frame, j).filter(f"bucket = {50 * HOUR}").count()
    assert leaps(job()) == 1
    assert leaps(job(calendars=(Calendar(50 * HOUR, 51 * HOUR),))) == 0
    assert leaps(job(rules=(Rule(actual_above=400.0),))) == 0
    assert leaps(job(rules=(Rule(actual_above=400.0, skip_model_update=True),))) == 1


def test_every_function_runs(frame):
    plain = [D(f, "value", by_field="host") for f in J.PLAIN]
    special = [D("rate"), D("ratio", "value", denom_field="w"), D("info_content", by_field="zone"), D("time_of_day"), D("time_of_week"), D("rare", by_field="zone"), D("freq_rare", by_field="zone"), D("mean", "value", over_field="host"), D(fields=("value", "w")), D("lat_long"), D("sum", "value", model="seasonal"), D("sum", "value", model="distribution")]
    job = J.Job("j", HOUR, (*plain, *special), threshold=30.0, influencers=("host",))
    rows = J.analyze(frame.withColumns({"lat": F.col("w") * 10, "lon": F.when(F.col("value") > 400, 90.0).otherwise(5.0)}), job)
    found = {r.detector for r in rows.filter(f"bucket = {50 * HOUR}").collect()}
    assert {"mean(value)", "max(value)", "sum(value)", "ratio(value/w)", "freq_rare(zone)", "mean(value) over host", "multivariate(value,w)", "lat_long"} <= found
    # one zone an hour until then: the entropy of 0 has the scale of a count, 1
    bits = J.analyze(frame, J.Job("j", HOUR, (D("info_content", by_field="zone"),), threshold=1.0)).collect()
    assert [(r.bucket, r.typical) for r in bits] == [(50 * HOUR, 0.0)] and bits[0].actual == pytest.approx(0.9709506)
    assert bits[0].p == pytest.approx(math.erfc(0.9709506 / math.sqrt(2)), abs=1e-6)
    assert J.analyze(frame.limit(0), J.Job("j", HOUR, (D("mean", "value"),))).count() == 0
    assert J.bucket_results(rows).filter(f"bucket = {50 * HOUR}").head().score >= 50
