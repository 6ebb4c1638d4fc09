"""Registered queries of the job engine: whole jobs, and the models that only jobs use."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import jobs as J
from tidemark.operators import models as M
from tidemark.plans.catalog import HOUR, PTS, _kernel, points, query

_ROUNDED = ("actual", "typical", "lower", "upper", "score")


def _job(spark, sf, *detectors: J.Detector, **more):
    got = J.analyze(points(spark, sf), J.Job("events", HOUR, detectors, **more))
    return got.withColumns({c: F.round(c, 4) for c in _ROUNDED})


@query()
def job_records(spark, sf):
    """A job of plain, seasonal, distribution, rate, distinct and median detectors with influencers."""
    D = J.Detector
    own = D("mean", "value", by_field="event_type"), D("count", by_field="event_type"), D("count"), D("sum", "value", model="seasonal"), D("count", model="distribution", side="high"), D("distinct_count", "user"), D("median", "value", by_field="event_type", side="low"), D("rate")
    return _job(spark, sf, *own, influencers=("user", "event_type"), threshold=5.0)


@query()
def job_special_detectors(spark, sf):
    """Ratio, entropy, time of day and week, rare and population detectors in one job."""
    D = J.Detector
    own = D("ratio", "value", denom_field="k"), D("info_content", by_field="event_type"), D("time_of_day"), D("time_of_week"), D("freq_rare", by_field="user"), D("mean", "value", over_field="event_type")
    return _job(spark, sf, *own, threshold=1.0)


_FRAME = "OVER (PARTITION BY event_type ORDER BY bucket ROWS BETWEEN 1024 PRECEDING AND 1 PRECEDING)"
_MOMENTS = f"""SELECT bucket, event_type, a, b, count(*) {_FRAME} AS n, avg(a) {_FRAME} AS ma, avg(b) {_FRAME} AS mb, var_samp(a) {_FRAME} AS va, var_samp(b) {_FRAME} AS vb, covar_samp(a, b) {_FRAME} AS cab
FROM (SELECT bucket, event_type, avg(value) AS a, avg(k) AS b FROM ({PTS}) GROUP BY ALL HAVING avg(value) IS NOT NULL AND avg(k) IS NOT NULL)"""


@query(f"""WITH m AS ({_MOMENTS}), r AS (SELECT *, 1e-6 * (va + vb) / 2 + 1e-9 AS e FROM m WHERE n >= 20),
q AS (SELECT *, greatest(0.0, ((a - ma) * (a - ma) * (vb + e) - 2 * (a - ma) * (b - mb) * cab + (b - mb) * (b - mb) * (va + e)) / ((va + e) * (vb + e) - cab * cab)) AS s FROM r)
SELECT bucket, 'event_type=' || event_type AS series, round(sqrt(s), 4) AS distance, round(least(100.0, s / 2 / ln(10) / 12 * 100), 4) AS score FROM q WHERE s / 2 / ln(10) / 12 * 100 >= 10""")
def job_multivariate(spark, sf):
    """Joint deviations of the hourly means of two measures."""
    return _job(spark, sf, J.Detector(fields=("value", "k"), by_field="event_type")).select("bucket", "series", F.col("actual").alias("distance"), "score")


_kernel("seasonal_model", M.seasonal_scores, "A baseline for each phase of the period that the past shows.")
_kernel("distribution_model", M.distribution_scores, "Tail of the family that fits the past best.")
