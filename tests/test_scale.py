"""Steps that must hold on larger tables and odd inputs, against plain definitions."""

import math
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import incidents as I
from tidemark.operators import jobs as J
from tidemark.operators import multiple as M
from tidemark.operators import neighbours as V
from tidemark.operators import population as P
from tidemark.operators import relations as L
from tidemark.plans import catalog


def test_benjamini_yekutieli_takes_one_harmonic_number_a_family(spark):
    rng = np.random.default_rng(1)
    p = np.round(np.r_[rng.uniform(0, 2e-5, 500), rng.uniform(0, 1, 150_000)], 7)
    rows = spark.createDataFrame([(int(i), "a", float(v)) for i, v in enumerate(p)] + [(-1, None, 1e-9), (-2, None, None)], "id long, family string, p double")
    began = time.time()
    got = {r["id"] for r in M.step_up(rows, ["family"], "p", 0.05, dependent=True).filter("rejected").collect()}
    assert time.time() - began < 60
    m = len(p)
    rank = np.searchsorted(np.sort(p), p, "right")
    ok = p <= rank * 0.05 / (m * (1 / np.arange(1, m + 1)).sum())
    assert got == {int(i) for i in np.flatnonzero(p <= p[ok].max())} | {-1}
    small = spark.range(1, 500).select(F.col("id"), M.harmonic_number(F.col("id")).alias("h")).collect()
    assert [r["h"] for r in small] == pytest.approx([sum(1 / i for i in range(1, r["id"] + 1)) for r in small], rel=1e-14)


def test_near_score_has_no_precision_without_flags(spark):
    some, none = spark.range(3).withColumnRenamed("id", "idx"), spark.range(0).withColumnRenamed("id", "idx")
    r = L.near_score(none, some, "idx", 1, 1).first()
    assert (r["tp"], r["fp"], r["fn"], r["recall"], r["f1"]) == (0, 0, 3, 0, 0) and math.isnan(r["precision"])
    r = L.near_score(some, none, "idx", 1, 1).first()
    assert (r["tp"], r["fp"], r["fn"], r["precision"], r["f1"]) == (0, 3, 0, 0, 0) and math.isnan(r["recall"])
    assert all(math.isnan(L.near_score(none, none, "idx", 1, 1).first()[c]) for c in ("precision", "recall", "f1"))


def test_event_score_without_alarms_or_labels(spark):
    rows = spark.createDataFrame([("a", 1, False, True), ("a", 2, False, False)], "key string, idx long, alarm boolean, label boolean")
    r = L.event_score(rows, "key", "idx", "alarm", "label").first()
    assert (r["series"], r["events"], r["events_hit"], r["event_recall"], r["regions"], r["false_regions"]) == (1, 1, 0, 0, 0, 0)
    assert [r[c] for c in ("alarms", "false_alarms", "alarm_precision", "alarms_per_series")] == [None] * 4 and math.isnan(r["region_precision"])
    r = L.event_score(rows.withColumn("label", F.lit(False)), "key", "idx", "alarm", "label").first()
    assert (r["series"], r["events"], r["alarms_per_series"]) == (0, 0, None) and math.isnan(r["event_recall"])


def test_range_f1_query_leaves_out_series_without_alarms(spark, tmp_path):
    """Series a is labelled (hours 9 to 12) and fires, b is labelled and never fires: its SQL joins both sides."""
    rows = [(i, f"2024-01-01 {h:02}:00:00", 1, t, 100.0 if t == "a" and h < 11 else 1.0, "{}") for i, (t, h) in enumerate((t, h) for t in "ab" for h in range(8, 14))]
    events = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    events.withColumn("ts", F.to_timestamp_ntz("ts")).write.parquet(f"{tmp_path}/events.parquet")
    got = catalog.QUERIES["range_f1"](spark, str(tmp_path)).collect()
    want = duckdb.sql(f"WITH events AS (SELECT * FROM read_parquet('{tmp_path}/events.parquet/*.parquet')) {catalog.SQL['range_f1']}").fetchall()
    assert [tuple(r) for r in got] == want and [r["event_type"] for r in got] == ["a"]


def test_chain_links_hold_the_same_components_together(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(t), str(j), e) for i, t, j, e in zip(rng.permutation(400), np.round(np.sort(rng.uniform(0, 4e5, 400)), 0), rng.integers(0, 3, 400), [None if x == 0 else f"u{x}" for x in rng.integers(0, 12, 400)], strict=True)]
    s = spark.createDataFrame(rows, "id long, ts double, job string, entity string")
    links = I.chain_links(s, 2400).collect()
    assert len(links) <= 4 * len(rows)
    up = {r[0]: {r[0]} for r in rows}
    for a in rows:
        for b in rows:
            d = abs(a[1] - b[1])
            if a[0] < b[0] and ((d <= 2400 and a[3] is not None and a[3] == b[3]) or (d <= 1200 and a[2] != b[2])) and up[a[0]] is not up[b[0]]:
                up[a[0]] |= up[b[0]]
                for x in up[b[0]]:
                    up[x] = up[a[0]]
    got = {r["id"]: r["component"] for r in I.label_components(s, spark.createDataFrame(links)).collect()}
    assert got == {x: min(up[x]) for x in up} and 5 < len(set(got.values())) < 300


def test_components_of_a_long_path(spark):
    path = spark.range(3000).select(F.col("id"), (F.col("id") + 1).alias("b")).filter("b < 3000")
    assert I.label_components(spark.range(3000), path.withColumnRenamed("id", "a")).filter("component = 0").count() == 3000


@pytest.mark.parametrize("groups", [None, "g"])
def test_nearest_over_many_leaves_is_exact(spark, monkeypatch, groups):
    monkeypatch.setattr(V, "LEAF", 16)
    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, (300, 2)), rng.integers(0, 4, (200, 2)), np.tile([[7.0, 7.0]], (40, 1))]
    g = rng.integers(0, 3, len(x)) if groups else np.zeros(len(x), int)
    keys = rng.permutation(len(x))
    df = spark.createDataFrame([(int(i), int(h), float(a), float(b)) for i, h, (a, b) in zip(keys, g, x, strict=True)], "id long, g int, a double, b double")
    got = {r["key"]: [(n["distance"], n["neighbour"]) for n in r["near"]] for r in V.nearest(df, "id", ["a", "b"], 5, groups).collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {int(keys[i]): sorted((d[i, j], int(keys[j])) for j in range(len(x)) if j != i and g[i] == g[j])[:5] for i in range(len(x))}
    assert got == want


def plain_outliers(x, k):
    scale = lambda v: s if (s := 1.4826 * np.median(abs(v - np.median(v)))) > 0 else np.std(v, ddof=1)
    z = np.column_stack([(c - np.median(c)) / (scale(c) or 1) for c in x.T])
    d = np.sqrt(((z[:, None] - z[None]) ** 2).sum(2))
    near = [sorted((j for j in range(len(z)) if j != i), key=lambda j: (d[i, j], j))[:k] for i in range(len(z))]
    total = [sum(max(d[j, near[j][-1]], d[i, j]) for j in near[i]) for i in range(len(z))]
    lrd = [len(n) / t if t > 0 else math.inf for n, t in zip(near, total, strict=True)]
    lof = [1.0 if math.isinf(lrd[i]) else sum(lrd[j] for j in near[i] if lrd[j] < math.inf) / (len(near[i]) * lrd[i]) for i in range(len(z))]
    inner = [np.mean([d[a, b] for a in n for b in n if a != b]) for n in near]
    ldof = [np.mean(d[i, near[i]]) / inner[i] if inner[i] > 0 else 1.0 for i in range(len(z))]
    score = 0
    for raw in ([np.mean(d[i, near[i]]) for i in range(len(z))], [d[i, near[i][-1]] for i in range(len(z))], lof, ldof):
        v = np.log(np.maximum(raw, 1e-12))
        score = score + (1 / (1 + np.exp(3 - (v - np.median(v)) / scale(v))) if scale(v) > 0 else 0)
    return score / 4


def test_outliers_of_groups_of_any_size(spark):
    """Equal rows, groups apart, a group of two, a missing feature; the same keys in both groups."""
    rng = np.random.default_rng(6)
    one, two = np.r_[rng.normal(0, 1, (60, 2)), np.tile([[3.0, 3.0]], (9, 1))], rng.normal(50, 9, (40, 2))
    rows = [(h, i, float(a), float(b)) for h, x in (("p", one), ("q", two)) for i, (a, b) in enumerate(x)] + [("r", 1, 1.0, 2.0), ("r", 2, 5.0, 2.0), ("q", 99, None, 1.0)]
    got = {(r["h"], r["id"]): r for r in P.outliers(spark.createDataFrame(rows, "h string, id long, a double, b double"), ["h"], "id", ["a", "b"]).collect()}
    for h, x in (("p", one), ("q", two)):
        assert [got[h, i]["score"] for i in range(len(x))] == pytest.approx(plain_outliers(x, 5), abs=1e-9)
    assert got["r", 1]["score"] == 0 and got["q", 99]["score"] is None and sum(got["q", 3]["influence"]) == pytest.approx(1)
    assert len(got) == len(rows)


def test_influencers_do_not_sort_points(spark):
    """Without size estimates the points of a job were shuffled whole and sorted by bucket."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = spark.range(10).select(F.timestamp_seconds("id").alias("time"), F.lit(1.0).alias("value"), F.lit("u").alias("user"))
        d = J.Detector("count")
        got = J._influencers(p, spark.range(1).select(F.lit(0).cast("long").alias("bucket"), F.lit("").alias("series")), d, J.Job("j", 60, (d,), influencers=("user",)))
        plan = got._jdf.queryExecution().toString()
        assert "strategy=broadcast" in plan
        assert [tuple(i) for i in got.first()["influencers"]] == [("user", "u", 1.0)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
