"""More registered queries: correlation, delivery, scoring against labels, conformal and subsequence detectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import detectors as D
from tidemark.operators import relations as L
from tidemark.plans.catalog import DAY, HOUR, HRS, PTS, SQL, _idx, _kernel, hourly, points, query, r6, read

IDX = f"SELECT event_type, CAST(bucket / 3600 AS BIGINT) AS idx, v FROM ({HRS})"
#: Alarms and labels of the evaluation queries: high hourly means, and the hours of a purchase above 150.
LAB = f"SELECT i.event_type, i.idx, i.v, i.v > 60 AS alarm, coalesce(m.most, 0) > 150 AS label FROM ({IDX}) i LEFT JOIN (SELECT event_type, CAST(bucket / 3600 AS BIGINT) AS idx, max(value) AS most FROM ({PTS}) GROUP BY ALL) m USING (event_type, idx)"


def _labelled(spark, sf):
    hour = (F.floor(F.unix_micros("time") / 1e6 / HOUR)).cast("long").alias("idx")
    most = points(spark, sf).groupBy("event_type", hour).agg(F.max("value").alias("most"))
    return _idx(spark, sf).join(most, ["event_type", "idx"], "left").select("event_type", "idx", "v", (F.col("v") > 60).alias("alarm"), (F.coalesce("most", F.lit(0.0)) > 150).alias("label"))


@query(f"SELECT CAST(floor(epoch(time) / 86400) AS BIGINT) AS day, is_change, count(*) AS n, count(usr) AS with_user FROM (SELECT time, usr, false AS is_change FROM ({PTS}) WHERE event_type = 'error' UNION ALL SELECT o_orderdate, NULL, true FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY ALL")
def timeline_union(spark, sf):
    symptoms = points(spark, sf).filter("event_type = 'error'").select("time", "user")
    changes = read(spark, sf, "orders").filter("o_orderpriority like '1%'").select(F.col("o_orderdate").cast("timestamp").alias("time"))
    day = F.floor(F.unix_micros("time") / 1e6 / DAY).cast("long").alias("day")
    return L.timeline(symptoms, changes).groupBy(day, "is_change").agg(F.count("*").alias("n"), F.count("user").alias("with_user"))


@query(f"WITH s AS (SELECT event_id, CAST(k AS INTEGER) % 3 AS tag FROM ({PTS}) WHERE event_type = 'error' AND k IS NOT NULL), t AS (SELECT count(*) AS t FROM s) SELECT tag, count(*) AS n FROM s, t GROUP BY tag, t HAVING t >= 4 AND count(*) > floor(0.33 * t)")
def coarse_entities(spark, sf):
    s = points(spark, sf).filter("event_type = 'error' and k is not null").select("event_id", (F.col("k").cast("int") % 3).alias("tag"))
    return L.coarse_entities(s, "event_id", "tag", share=0.33)


_DAYS = f"SELECT DISTINCT CAST(floor(epoch(time) / 86400) AS BIGINT) AS d, usr FROM ({PTS}) WHERE value > 100"
_OVER = f"WITH e AS ({_DAYS}), n AS (SELECT d, count(*) AS n FROM e GROUP BY d) SELECT a.d AS fresh, b.d AS known, count(*) / least(x.n, y.n) AS overlap FROM e a JOIN e b ON a.usr = b.usr AND a.d > b.d JOIN n x ON x.d = a.d JOIN n y ON y.d = b.d GROUP BY a.d, b.d, x.n, y.n"


def _overlaps(spark, sf):
    e = points(spark, sf).filter("value > 100").select(F.floor(F.unix_micros("time") / 1e6 / DAY).cast("long").alias("d"), "user")
    return L.overlap(e.withColumnRenamed("d", "fresh"), e.withColumnRenamed("d", "known"), "fresh", "known", "user").filter("fresh > known")


@query(f"SELECT fresh, known, round(overlap, 6) AS overlap FROM ({_OVER})")
def entity_overlap(spark, sf):
    return _overlaps(spark, sf).withColumn("overlap", r6("overlap"))


@query(f"SELECT fresh, known, round(overlap, 6) AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY fresh ORDER BY overlap DESC, known) AS x, row_number() OVER (PARTITION BY known ORDER BY overlap DESC, fresh) AS y FROM ({_OVER}) WHERE overlap >= 0.02) WHERE x = 1 AND y = 1")
def incident_best_match(spark, sf):
    return L.best_matches(_overlaps(spark, sf), "fresh", "known", "overlap", 0.02).withColumn("overlap", r6("overlap"))


@query(f"SELECT event_type, count(*) AS n, max(value) AS score, CAST(floor(epoch(min(time))) AS BIGINT) AS first, CAST(floor(epoch(max(time))) AS BIGINT) AS last, string_agg(CASE WHEN t <= 5 THEN txt END, '; ' ORDER BY t) AS texts FROM (SELECT *, 'user ' || usr AS txt, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, 'user ' || usr DESC) AS t FROM ({PTS}) WHERE value > 120) GROUP BY event_type")
def alert_digest(spark, sf):
    a = points(spark, sf).filter("value > 120").withColumn("text", F.concat(F.lit("user "), "user"))
    return L.digest(a, "event_type", "value", "time", "text").withColumn("first", F.unix_seconds("first")).withColumn("last", F.unix_seconds("last"))


@query(f"""WITH f AS (SELECT DISTINCT idx FROM ({LAB}) WHERE v > 75), l AS (SELECT DISTINCT idx FROM ({LAB}) WHERE label),
c AS (SELECT (SELECT count(*) FROM l WHERE EXISTS (SELECT 1 FROM f WHERE f.idx BETWEEN l.idx - 1 AND l.idx + 1)) AS tp, (SELECT count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.idx BETWEEN l.idx - 1 AND l.idx + 1)) AS fn, (SELECT count(*) FROM f WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.idx BETWEEN f.idx - 1 AND f.idx + 1)) AS fp)
SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c""")
def bucket_f1_tolerance(spark, sf):
    rows = _labelled(spark, sf)
    got = L.near_score(rows.filter("v > 75").select("idx"), rows.filter("label").select("idx"), "idx", 1, 1)
    return got.select("tp", "fp", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"), r6("f1").alias("f1"))


@query(f"""WITH s AS (SELECT event_type, v, count(*) FILTER (WHERE label) AS pos, count(*) AS n FROM (SELECT event_type, round(v, 3) AS v, label FROM ({LAB})) GROUP BY ALL),
a AS (SELECT event_type, v, sum(pos) OVER d AS tp, sum(n) OVER d AS fl, sum(pos) OVER (PARTITION BY event_type) AS al, row_number() OVER (PARTITION BY event_type ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS m FROM s WINDOW d AS (PARTITION BY event_type ORDER BY v DESC)),
p AS (SELECT DISTINCT event_type, CAST(floor(j * (m - 1) / 63) AS BIGINT) AS i FROM (SELECT DISTINCT event_type, m FROM a), range(64) r(j) WHERE m > 64),
f AS (SELECT event_type, v, CASE WHEN tp > 0 THEN 2 * tp / (fl + al) ELSE 0 END AS f1 FROM a WHERE m <= 64 OR (event_type, i) IN (SELECT event_type, i FROM p))
SELECT event_type, v AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY f1 DESC, v) AS t FROM f) WHERE t = 1""")
def best_threshold(spark, sf):
    rows = _labelled(spark, sf).withColumn("v", F.round("v", 3))
    return L.best_threshold(rows, "event_type", "v", "label", 64).withColumn("f1", r6("f1"))


@query(f"""WITH r AS (SELECT *, max(CAST(label AS INTEGER)) OVER (PARTITION BY event_type) AS has, label AND NOT coalesce(lag(label) OVER o, false) AS le, alarm AND NOT coalesce(lag(alarm) OVER o, false) AS ae FROM ({LAB}) WINDOW o AS (PARTITION BY event_type ORDER BY idx)),
x AS (SELECT *, sum(CAST(le AS INTEGER)) OVER o AS e, sum(CAST(ae AS INTEGER)) OVER o AS g FROM r WHERE has = 1 WINDOW o AS (PARTITION BY event_type ORDER BY idx)),
ev AS (SELECT count(*) AS events, count(*) FILTER (WHERE hit) AS events_hit FROM (SELECT bool_or(alarm) AS hit FROM x WHERE label GROUP BY event_type, e)),
rg AS (SELECT count(*) AS regions, count(*) FILTER (WHERE NOT real) AS false_regions, CAST(sum(n) AS BIGINT) AS alarms, CAST(sum(f) AS BIGINT) AS false_alarms FROM (SELECT bool_or(label) AS real, count(*) AS n, count(*) FILTER (WHERE NOT label) AS f FROM x WHERE alarm GROUP BY event_type, g))
SELECT (SELECT count(DISTINCT event_type) FROM x) AS series, *, round(events_hit / events, 6) AS event_recall, round((alarms - false_alarms) / alarms, 6) AS alarm_precision, round((regions - false_regions) / regions, 6) AS region_precision, round(alarms / (SELECT count(DISTINCT event_type) FROM x), 6) AS alarms_per_series FROM ev, rg""")
def event_operating_point(spark, sf):
    got = L.event_score(_labelled(spark, sf), "event_type", "idx", "alarm", "label")
    for c in ("event_recall", "alarm_precision", "region_precision", "alarms_per_series"):
        got = got.withColumn(c, r6(c))
    return got


_WIN = f"SELECT event_type, idx // 48 AS w, min(idx) * 3600.0 AS a, max(idx) * 3600.0 + 1800 AS b FROM ({LAB}) WHERE label AND idx % 48 < 12 GROUP BY ALL"


@query(f"""WITH w AS ({_WIN}), d AS (SELECT event_type, idx * 3600.0 AS t FROM ({LAB}) WHERE v > 70),
m AS (SELECT d.event_type, d.t, w.a, w.b FROM d ASOF LEFT JOIN w ON d.event_type = w.event_type AND d.t >= w.a),
g AS (SELECT count(*) AS tp, coalesce(sum(2 / (1 + exp(5 * least(0.0, greatest(-1.0, (t - b) / (b - a))))) - 1), 0) AS gain FROM (SELECT event_type, a, b, min(t) AS t FROM m WHERE t <= b GROUP BY ALL)),
l AS (SELECT count(*) AS fp, coalesce(sum(CASE WHEN b IS NULL OR (t - b) / (b - a) > 3 THEN -1 ELSE 2 / (1 + exp(5 * (t - b) / (b - a))) - 1 END), 0) AS loss FROM m WHERE b IS NULL OR t > b),
n AS (SELECT count(*) AS n FROM w), p(profile, ptp, pfp, pfn) AS (VALUES ('standard', 1.0, 0.11, 1.0), ('reward_low_FP', 1.0, 0.22, 1.0), ('reward_low_FN', 1.0, 0.11, 2.0)),
r AS (SELECT profile, tp, fp, n - tp AS fn, ptp * gain + pfp * loss - pfn * (n - tp) AS raw, -pfn * n AS nul, ptp * n * (2 / (1 + exp(-5)) - 1) AS best FROM p, g, l, n)
SELECT profile, tp, fp, fn, round(raw, 5) AS raw, round(least(100.0, greatest(0.0, 100 * (raw - nul) / (best - nul))), 5) AS normalized FROM r""")
def benchmark_profiles(spark, sf):
    rows = _labelled(spark, sf)
    w = rows.filter("label and idx % 48 < 12").groupBy("event_type", F.expr("idx div 48")).agg((F.min("idx") * 3600.0).alias("start"), (F.max("idx") * 3600.0 + 1800).alias("stop"))
    d = rows.filter("v > 70").select("event_type", (F.col("idx") * 3600.0).alias("time"))
    got = L.benchmark_score(d, w, "event_type")
    return got.select("profile", "tp", "fp", "fn", F.round("raw", 5).alias("raw"), F.round("normalized", 5).alias("normalized"))


@query(f"SELECT event_type, idx, round(max(v) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING), 6) AS top FROM ({IDX})")
def sliding_max(spark, sf):
    return _idx(spark, sf).select("event_type", "idx", r6(L.sliding_max("v", 8, "idx", ["event_type"])).alias("top"))


_P = f"SELECT event_type, idx, 1 / (1 + v) AS p FROM ({IDX})"


@query(f"SELECT event_type, idx, round(1 - pow(1 - min(p) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 4), 6) AS p FROM ({_P})")
def corroborated_causal(spark, sf):
    rows = _idx(spark, sf).select("event_type", "idx", (1 / (1 + F.col("v"))).alias("p"))
    return rows.select("event_type", "idx", r6(L.corroborated("p", 3, "idx", ["event_type"], causal=True)).alias("p"))


@query(f"SELECT event_type, idx, CASE WHEN t <= 100 THEN 1.0 ELSE round((1 + len(list_filter(base, lambda x: x >= v))) / (len(base) + 1), 6) END AS p FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY idx) AS t FROM ({IDX})) JOIN (SELECT event_type, list(v) AS base FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY idx) AS t FROM ({IDX})) WHERE t <= 100 GROUP BY event_type) USING (event_type)")
def streaming_conformal(spark, sf):
    return L.streaming_conformal(_idx(spark, sf), "event_type", "idx", "v", 100).select("event_type", "idx", r6("p").alias("p"))


@query("""WITH m AS (SELECT o_orderpriority AS g, count(*) AS n, avg(o_totalprice) AS mu, var_pop(o_totalprice) AS s, avg(ln(o_totalprice)) AS lm, var_pop(ln(o_totalprice)) AS ls FROM orders GROUP BY ALL)
SELECT g, family, round(aic, 2) AS aic FROM (
SELECT g, 'normal' AS family, 4 + n * (ln(2 * pi() * s) + 1) AS aic FROM m UNION ALL
SELECT g, 'lognormal', 4 + n * (ln(2 * pi() * ls) + 1) + 2 * n * lm FROM m UNION ALL
SELECT g, 'exponential', 2 + 2 * n * ln(mu) + 2 * n FROM m)""")
def distribution_aic(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_totalprice").alias("v"))
    return L.fit_distribution(rows, "g", "v").select("g", "family", F.round("aic", 2).alias("aic"))


_TRI = f"SELECT event_id, 1 / (1 + value) AS a, 1 / (1 + k) AS b, (event_id % 97 + 1) / 98 AS c FROM ({PTS}) WHERE k IS NOT NULL"


@query(f"SELECT event_id, round(3 * x * x * (1 - x) + x * x * x, 6) AS p, (CAST(a < 0.05 AS INTEGER) + CAST(b < 0.05 AS INTEGER) + CAST(c < 0.05 AS INTEGER)) >= 2 AS voted FROM (SELECT *, list_sort([a, b, c])[2] AS x FROM ({_TRI}))")
def majority_vote(spark, sf):
    e = points(spark, sf).filter("k is not null").select("event_id", (1 / (1 + F.col("value"))).alias("a"), (1 / (1 + F.col("k"))).alias("b"), ((F.col("event_id") % 97 + 1) / 98).alias("c"))
    return e.select("event_id", r6(X.majority("a", "b", "c")).alias("p"), X.vote(2, 0.05, "a", "b", "c").alias("voted"))


SQL["causal_robust_z"] = f"""SELECT event_type, idx, v, CASE WHEN coalesce(len(past), 0) < 4 THEN 0.0 ELSE round((v - m) / (1.4826 * list_median(list_transform(past, lambda x: abs(x - m)))), 6) END AS score
FROM (SELECT *, list_median(past) AS m FROM (SELECT *, list(v) OVER (PARTITION BY event_type ORDER BY idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING) AS past FROM ({IDX})))"""


def _rounded(fn, digits: int = 6):
    return lambda x: fn(x).round(digits)


_kernel("causal_robust_z", _rounded(D.causal_z), "Distance from the median of the hundred values before, in scaled MADs.")
_kernel("sub_lof", D.sub_lof_scores, "Local outlier factor of subsequences.")
_kernel("sub_pca", D.sub_pca_scores, "Reconstruction error of subsequences.")
_kernel("sub_isolation_forest", D.isolation_scores, "Isolation forest over subsequences.")
_kernel("stl_remainder", lambda x: D.decompose(x, 24)[2], "Remainder of a seasonal decomposition with a period of a day.")


def _each(spark, sf, run, schema):
    """run(key, ordered values) -> rows, for every series."""
    import pandas as pd

    names = [c.split()[0] for c in schema.split(", ")]

    def apply(pdf):
        pdf = pdf.sort_values("idx")
        key = pdf["event_type"].iloc[0]
        return pd.DataFrame([(key, *row) for row in run(pdf["v"].to_numpy(float))], columns=names)

    return _idx(spark, sf).groupBy("event_type").applyInPandas(apply, schema)


@query()
def series_regimes(spark, sf):
    """Stretches between change points, and whether the last change shifted the level."""
    return _each(spark, sf, lambda x: [(*r, D.regime_shift(x)[0]) for r in D.regimes(x)], "event_type string, start long, stop long, mean double, deviation double, shifted boolean")


@query()
def seasonality_peaks(spark, sf):
    """The six highest peaks of each series' autocorrelation."""
    return _each(spark, sf, lambda x: D.peaks(x), "event_type string, lag long, value double")


@query()
def granger_pairs(spark, sf):
    """Of every ordered pair of event types, how far the past of one improves on the other's own: rows come aligned by
    hour with a column for each type, and each pair is a task."""
    import pandas as pd

    rows = hourly(spark, sf).select("bucket", "event_type", "v")
    types = rows.select("event_type").distinct()
    pairs = types.crossJoin(types.withColumnRenamed("event_type", "effect")).filter("event_type <> effect")  # a handful of names
    a = rows.join(F.broadcast(pairs), "event_type").withColumnRenamed("v", "a")
    b = rows.select("bucket", F.col("event_type").alias("effect"), F.col("v").alias("b"))
    both = a.join(b, ["bucket", "effect"])

    def run(pdf):
        pdf = pdf.sort_values("bucket")
        better, f = D.granger(pdf["a"].to_numpy(float), pdf["b"].to_numpy(float))
        return pd.DataFrame([(pdf["event_type"].iloc[0], pdf["effect"].iloc[0], better, f)], columns=["cause", "effect", "improvement", "f"])

    return both.groupBy("event_type", "effect").applyInPandas(run, "cause string, effect string, improvement double, f double")

