"""Jobs: what to watch, and the records of a batch run.

analyze(df, job) takes points (time, value, and a column per measure and dimension). Every detector is one plan:
buckets are aggregated in the JVM, so raw rows shuffle as partial aggregates only, and a series' buckets meet its model
in one task. A detector's records carry actual, typical, bounds, p, score, kind, direction and influencers.
"""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass, field, fields
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import expressions as X
from tidemark.operators import baseline as B
from tidemark.operators import buckets as K
from tidemark.operators import models as M
from tidemark.operators import rules as R
from tidemark.operators.kernels import HISTORY, TemporalModel

PLAIN = ("count", "distinct_count", "non_zero_count", "sum", "non_null_sum", "mean", "metric", "min", "max", "median", "varp", "rate")
FIELDLESS = ("count", "rate", "rare", "freq_rare", "info_content", "time_of_day", "time_of_week", "lat_long")
FUNCTIONS = (*PLAIN, "ratio", "rare", "freq_rare", "info_content", "time_of_day", "time_of_week", "lat_long")
MODELS = ("", "seasonal", "distribution")
RECORD = "bucket long, detector string, series string, actual double, typical double, lower double, upper double, p double, score double, kind string, direction string, influencers array<struct<field:string,value:string,share:double>>"
_MODEL = "bucket long, actual double, typical double, lower double, upper double, p double, score double, kind string"
_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


@dataclass(frozen=True)
class Detector:
    function: str = ""
    field: str = ""
    by_field: str = ""
    partition_field: str = ""
    over_field: str = ""
    denom_field: str = ""
    fields: tuple[str, ...] = ()
    side: str = "both"
    model: str = ""
    rules: tuple[R.Rule, ...] = ()

    @property
    def id(self) -> str:
        """Names what is computed, not how it is split."""
        f = self.function
        if len(self.fields) >= 2:
            return f"multivariate({','.join(self.fields)})"
        if f in ("rare", "freq_rare", "info_content"):
            return f"{f}({self.by_field})"
        if f == "ratio":
            return f"ratio({self.field}/{self.denom_field})"
        if f == "lat_long":
            return f + (f" over {self.over_field}" if self.over_field else f" by {self.by_field}" if self.by_field else "")
        if f.startswith("time_of_"):
            return f
        return f + (f"({self.field})" if self.field else "") + (f" over {self.over_field}" if self.over_field else "")

    @property
    def split(self) -> list[str]:
        return [c for c in (self.partition_field, self.by_field) if c]

    def problem(self) -> str | None:
        if len(self.fields) >= 2:
            return None
        if not self.function:
            return "function is required"
        if self.function not in FUNCTIONS:
            return f"unknown function {self.function!r}"
        if self.function == "ratio" and not (self.field and self.denom_field):
            return "field and denom_field are required"
        if self.function not in FIELDLESS and not self.field:
            return "field is required"
        if self.function in ("rare", "freq_rare", "info_content") and not self.by_field:
            return "by_field is required"
        if self.side not in ("both", "high", "low") or self.model not in MODELS:
            return "unknown side or model"
        return None


@dataclass(frozen=True)
class Job:
    name: str
    span_s: int
    detectors: tuple[Detector, ...]
    influencers: tuple[str, ...] = ()
    threshold: float = 10.0
    calendars: tuple[R.Calendar, ...] = field(default=())

    def validate(self) -> Job:
        if not self.name:
            raise ValueError("job: name is required")
        if self.span_s <= 0:
            raise ValueError(f"job {self.name}: bucket_span must be positive")
        if not self.detectors:
            raise ValueError(f"job {self.name}: at least one detector is required")
        for i, d in enumerate(self.detectors):
            if problem := d.problem():
                raise ValueError(f"job {self.name}: detector {i} ({d.function}): {problem}")
        return self


def seconds(text: str | float) -> float:
    """A duration such as 1h30m, or a number of seconds."""
    if not isinstance(text, str):
        return float(text)
    parts = re.findall(r"([0-9]*\.?[0-9]+)(ns|us|µs|ms|s|m|h)", text)
    if "".join(a + b for a, b in parts) != text.lstrip("+-") or not parts:
        raise ValueError(f"not a duration: {text!r}")
    return (-1 if text.startswith("-") else 1) * sum(float(a) * _UNITS[b] for a, b in parts)


def parse(text: str) -> Job:
    """A job from JSON; durations are texts, names are those of Job and Detector, bucket_span stands for span_s."""
    raw = json.loads(text)
    own = {f.name for f in fields(Detector)}
    made = []
    for d in raw.get("detectors", []):
        rules = tuple(R.Rule(**{k: tuple(v) if isinstance(v, list) else v for k, v in r.items()}) for r in d.get("rules", []))
        made.append(Detector(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items() if k in own and k != "rules"}, rules=rules))
    calendars = tuple(R.Calendar(**c) for c in raw.get("calendars", []))
    return Job(raw.get("name", ""), int(seconds(raw.get("bucket_span", 0))), tuple(made), tuple(raw.get("influencers", [])), float(raw.get("threshold", 10.0)), calendars).validate()


def series_of(split: list[str]) -> Column:
    """field=value of the split, joined by semicolons; a missing value is the empty text, and a series like any other."""
    return F.concat_ws(";", *[F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in split]) if split else F.lit("")


def _learns(d: Detector):
    """Whether a value is to be learned, by the rules that stop learning; one without bounds stops it always."""
    stops = [(r.actual_below, r.actual_above) for r in d.rules if r.skip_model_update]
    return lambda v: not any((lo is None and hi is None) or (lo is not None and v < lo) or (hi is not None and v > hi) for lo, hi in stops)


def _model(d: Detector, side: str, warm_up: int, keep: int):
    if d.model == "seasonal":
        return M.SeasonalModel(side).observe
    m = M.DistributionModel(side) if d.model == "distribution" else TemporalModel(side, warm_up, keep)
    return lambda i, v, learn: m.observe(v, learn)


def _scored(rows: DataFrame, group: list[str], value: str, d: Detector, job: Job, side: str | None = None, warm_up: int = 20, keep: int = HISTORY) -> DataFrame:
    """The model of each group over its buckets; rows below the job's threshold are left out."""
    learns, span, least, side = _learns(d), job.span_s, job.threshold, side or d.side

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, observe, out = pdf.sort_values("bucket"), _model(d, side, warm_up, keep), []
        key = [pdf[c].iloc[0] for c in group]
        for b, v in zip(pdf["bucket"].tolist(), pdf[value].astype(float).tolist(), strict=True):
            p, score, typical, scale, kind = observe(b // span, v, learns(v))
            if score >= least and not math.isnan(typical):
                out.append((*key, b, v, typical, typical - 1.96 * scale, typical + 1.96 * scale, p, score, kind))
        return pd.DataFrame(out, columns=[*group, *(c.split()[0] for c in _MODEL.split(", "))])

    kind = dict(rows.dtypes)
    schema = "".join(f"`{c}` {kind[c]}, " for c in group) + _MODEL
    return rows.filter(F.col(value).isNotNull()).select(*group, "bucket", value).groupBy(*group).applyInPandas(run, schema)


def _measure(name: str) -> Column:
    """A measure falls back to the value of the point."""
    return F.coalesce(F.col(name).cast("double"), F.col("value")) if name and name != "value" else F.col("value")


def _vectors(df: DataFrame, d: Detector, job: Job) -> DataFrame:
    means = df.withColumn("bucket", X.bucket_of("time", job.span_s)).withColumn("series", series_of(d.split)).groupBy("series", "bucket")
    rows = means.agg(*[F.avg(c).alias(f"m{i}_") for i, c in enumerate(d.fields)])
    cols, names, least = [f"m{i}_" for i in range(len(d.fields))], d.fields, job.threshold

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, m, out = pdf.sort_values("bucket"), M.MultivariateModel(len(names)), []
        for b, v in zip(pdf["bucket"].tolist(), pdf[cols].to_numpy(float), strict=True):
            p, score, distance, share = m.observe(v)
            if score >= least:
                told = [{"field": n, "value": "", "share": float(s)} for n, s in sorted(zip(names, share, strict=True), key=lambda x: -x[1]) if s >= 0.1]
                out.append((pdf["series"].iloc[0], b, distance, math.sqrt(len(names)), 0.0, M.radius95(len(names)), p, score, "multivariate", told))
        return pd.DataFrame(out, columns=["series", *(c.split()[0] for c in _MODEL.split(", ")), "influencers"])

    schema = f"series string, {_MODEL}, influencers array<struct<field:string,value:string,share:double>>"
    return rows.dropna(subset=cols).groupBy("series").applyInPandas(run, schema)


def _population(df: DataFrame, d: Detector, job: Job) -> DataFrame:
    """Each entity of the over field against the pool of all entities' earlier buckets of its split."""
    own = df.filter(F.coalesce(F.col(d.over_field).cast("string"), F.lit("")) != "").withColumn("m_", _measure(d.field))
    keyed = own.withColumn("bucket", X.bucket_of("time", job.span_s)).withColumn("split_", series_of(d.split))
    agg = K.aggregate_expr("row_rate" if d.function == "rate" and not d.field else d.function, "m_", job.span_s)
    z = B.population_zscore(keyed.groupBy("bucket", "split_", d.over_field).agg(agg.cast("double").alias("v")), ["split_"], "v")
    z = z.filter("z is not null").withColumn("p", X.z_probability("z", d.side)).withColumn("score", X.score_from_p("p")).filter(F.col("score") >= job.threshold)
    entity = F.concat(F.when(F.col("split_") != "", F.concat("split_", F.lit(";"))).otherwise(""), F.lit(f"{d.over_field}="), F.col(d.over_field).cast("string")) if d.split else F.col(d.over_field).cast("string")
    half = 1.96 * F.col("scale")
    told = F.array(F.struct(F.lit(d.over_field).alias("field"), F.col(d.over_field).cast("string").alias("value"), F.lit(1.0).alias("share")))
    return z.select(entity.alias("series"), "bucket", F.col("v").alias("actual"), "typical", (F.col("typical") - half).alias("lower"), (F.col("typical") + half).alias("upper"), "p", "score", F.lit("population").alias("kind"), told.alias("influencers"))


def _rare(df: DataFrame, d: Detector, job: Job) -> DataFrame:
    rows = B.rare(df.withColumn("bucket", X.bucket_of("time", job.span_s)), d.by_field, frequent=d.function == "freq_rare").filter(F.col("score") >= job.threshold)
    value = F.col(d.by_field).cast("string")
    told = F.array(F.struct(F.lit(d.by_field).alias("field"), value.alias("value"), F.lit(1.0).alias("share")))
    zero = F.lit(0.0)
    return rows.select(value.alias("series"), "bucket", F.col("n").cast("double").alias("actual"), zero.alias("typical"), zero.alias("lower"), zero.alias("upper"), "p", "score", F.lit(d.function).alias("kind"), told.alias("influencers"))


def _bucketed(df: DataFrame, d: Detector, job: Job) -> DataFrame:
    """Plain aggregates, ratios, entropies and distances by series, and the model over them."""
    span, split, f = job.span_s, d.split, d.function
    if f in ("time_of_day", "time_of_week"):
        n = K.slot_counts(df, span, weekly=f == "time_of_week")
        return _scored(n, ["slot"], "n", d, job, "high", 3, 512).withColumn("series", F.lit(""))
    if f == "ratio":
        rows, value = K.ratio(df, span, split, F.col(d.field), F.col(d.denom_field)), "ratio"
    elif f == "info_content":
        split = [d.partition_field] if d.partition_field else []
        rows, value = K.entropy(df, span, d.by_field, split), "entropy"
    elif f == "lat_long":
        split = [*split, d.over_field] if d.over_field else split
        rows, value = B.centroid_distance(K.spherical_mean(df.filter("lat is not null and lon is not null"), span, "lat", "lon", split), split), "km"
        return _scored(rows.withColumn("series", series_of(split)), ["series"], value, d, job, "high")
    else:
        fn = "row_rate" if f == "rate" and not d.field else f
        as_text = f == "distinct_count" and d.field
        keyed = df.withColumn("m_", F.coalesce(F.col(d.field).cast("string"), F.col("value").cast("string")) if as_text else _measure(d.field))
        rows, value = K.aggregate(keyed, span, split, (fn, "m_", "v")).withColumn("v", F.col("v").cast("double")), "v"
        if fn in ("count", "distinct_count", "row_rate") and not split:
            rows = K.gap_fill(rows, span, "v")
        elif fn in ("count", "distinct_count"):
            rows = K.zero_fill(rows.withColumns({c: F.coalesce(F.col(c).cast("string"), F.lit("")) for c in split}), split, "v")
    return _scored(rows.withColumn("series", series_of(split)), ["series"], value, d, job)


def _influencers(df: DataFrame, records: DataFrame, d: Detector, job: Job) -> DataFrame:
    """records with each influencer's most frequent value among the points of their bucket and series.

    Only the points of buckets that have a record are counted. The records' buckets go to the points, which so are
    neither shuffled nor sorted by bucket: they are few, as each is a bucket of points that stands out.
    """
    if not job.influencers or "influencers" in records.columns:
        return records if "influencers" in records.columns else records.withColumn("influencers", F.array().cast("array<struct<field:string,value:string,share:double>>"))
    keyed = df.withColumn("bucket", X.bucket_of("time", job.span_s)).withColumn("series", series_of(d.split) if not d.function.startswith("time_of_") else F.lit(""))
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in job.influencers])).alias("i")
    told = keyed.join(F.broadcast(records.select("bucket", "series").distinct()), ["bucket", "series"], "left_semi").select("bucket", "series", pairs).select("bucket", "series", "i.*").filter("value <> ''")
    n = told.groupBy("bucket", "series", "field", "value").agg(F.count("*").alias("n"))
    # the most frequent value, ties to the one that sorts first: the least of (-n, value)
    top = n.groupBy("bucket", "series", "field").agg(F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("t"), F.sum("n").alias("all"))
    one = F.struct("field", F.col("t.value").alias("value"), (-F.col("t.n") / F.col("all")).alias("share"))
    lists = top.groupBy("bucket", "series").agg(F.sort_array(F.collect_list(one)).alias("influencers"))  # one for each influencer of the job
    return records.join(lists, ["bucket", "series"], "left").withColumn("influencers", F.coalesce("influencers", F.array().cast("array<struct<field:string,value:string,share:double>>")))


def detect(df: DataFrame, d: Detector, job: Job) -> DataFrame:
    """The records of one detector."""
    if len(d.fields) >= 2:
        rows = _vectors(df, d, job)
    elif d.function in ("rare", "freq_rare"):
        rows = _rare(df, d, job)
    elif d.over_field and d.function in PLAIN:
        rows = _population(df, d, job)
    else:
        rows = _bucketed(df, d, job)
    rows = _influencers(df, rows, d, job)
    rows = rows.withColumn("detector", F.lit(d.id)).withColumn("direction", F.when(F.col("actual") >= F.col("typical"), "up").otherwise("down"))
    return R.suppress(rows, list(d.rules)).select(*(c.split()[0] for c in re.sub("<.*>", "", RECORD).split(", ")))


def analyze(df: DataFrame, job: Job) -> DataFrame:
    """Records of all detectors of a job over points; an empty table gives none.

    Buckets that a calendar covers are left out before anything learns from them. Null dimensions are the empty text,
    null measures the point's value. A rule with skip_model_update keeps values from being learned; the others
    suppress records.
    """
    job.validate()
    if job.calendars:
        df = df.filter(~R.covered(F.timestamp_seconds(X.bucket_of("time", job.span_s)), list(job.calendars)))
    return reduce(DataFrame.unionByName, [detect(df, d, job) for d in job.detectors])


def bucket_results(records: DataFrame) -> DataFrame:
    """(bucket, score, records): a bucket's score is that of its strongest record."""
    return records.groupBy("bucket").agg(F.max("score").alias("score"), F.count("*").alias("records"))
