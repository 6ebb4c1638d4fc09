"""Time buckets: aggregation per series, gap and zero filling, entropy, dominant values, staleness.

Everything here is a grouped aggregation with map-side combine, or a join with a small spine; a bucket is named by
its start in epoch seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import bucket_of

MAX_GAP_BUCKETS = 1_000_000


def aggregate_expr(fn: str, field: str = "value", span_s: int = 1, summary: str | None = None) -> Column:
    """The aggregation a detector function stands for. Missing measures are null and skipped."""
    c = F.col(field)
    if fn == "count":
        return (F.sum(F.coalesce(F.col(summary), F.lit(0.0))) if summary else F.count("*")).cast("double")
    table = {
        "distinct_count": lambda: F.count_distinct(c).cast("double"),
        "non_zero_count": lambda: F.count_if(c != 0).cast("double"),
        "sum": lambda: F.sum(c),
        "non_null_sum": lambda: F.sum(c),
        "mean": lambda: F.avg(c),
        "metric": lambda: F.avg(c),
        "min": lambda: F.min(c),
        "max": lambda: F.max(c),
        "median": lambda: F.percentile(c, F.lit(0.5)),
        "varp": lambda: F.var_pop(c),
        "rate": lambda: F.sum(c) / span_s,
        "row_rate": lambda: F.count("*") / span_s,
    }
    return table[fn]()


def aggregate(df: DataFrame, span_s: int, by: list[str], *fns: tuple[str, str, str], time: str = "time") -> DataFrame:
    """(bucket, *by, one column per (function, field, name))."""
    keyed = df.withColumn("bucket", bucket_of(time, span_s))
    return keyed.groupBy("bucket", *by).agg(*(aggregate_expr(fn, field, span_s).alias(name) for fn, field, name in fns))


def ratio(df: DataFrame, span_s: int, by: list[str], numerator: Column, denominator: Column, time: str = "time") -> DataFrame:
    """Sum over sum per bucket; missing measures add nothing, a zero denominator gives no row."""
    keyed = df.withColumn("bucket", bucket_of(time, span_s))
    sums = keyed.groupBy("bucket", *by).agg(F.sum(F.coalesce(numerator, F.lit(0.0))).alias("num"), F.sum(F.coalesce(denominator, F.lit(0.0))).alias("den"))
    return sums.filter("den <> 0").withColumn("ratio", F.col("num") / F.col("den"))


def entropy(df: DataFrame, span_s: int, field: str, by: list[str] | None = None, time: str = "time") -> DataFrame:
    """Shannon entropy in bits of a dimension's values per bucket; the empty value is left out."""
    by = by or []
    keyed = df.filter((F.col(field).isNotNull()) & (F.col(field) != "")).withColumn("bucket", bucket_of(time, span_s))
    n = keyed.groupBy("bucket", *by, field).agg(F.count("*").alias("n"))
    # -sum(p log2 p) from sums that need one pass: log2(total) - sum(n log2 n) / total
    return n.groupBy("bucket", *by).agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("entropy"))


def dominant(df: DataFrame, span_s: int, field: str, by: list[str] | None = None, time: str = "time") -> DataFrame:
    """Most frequent value of a dimension per bucket and its share; ties go to the value that sorts first."""
    by = by or []
    n = df.withColumn("bucket", bucket_of(time, span_s)).groupBy("bucket", *by, field).agg(F.count("*").alias("n"))
    w = Window.partitionBy("bucket", *by).orderBy(F.desc("n"), field)
    total = F.sum("n").over(Window.partitionBy("bucket", *by))
    return n.withColumn("share", F.col("n") / total).withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn", "n")


def gap_fill(buckets: DataFrame, span_s: int, value: str) -> DataFrame:
    """An unsplit count with zeros in the silent buckets between its first and last; beyond a million none are filled."""
    ends = buckets.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi")).filter((F.col("hi") - F.col("lo")) / span_s < MAX_GAP_BUCKETS)
    spine = ends.select(F.explode(F.sequence("lo", "hi", F.lit(span_s))).alias("bucket"))
    return spine.unionByName(buckets.select("bucket")).distinct().join(buckets, "bucket", "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def zero_fill(buckets: DataFrame, by: list[str], value: str) -> DataFrame:
    """A split count: every series gets 0 in the buckets it misses, from its own first bucket on."""
    first = buckets.groupBy(*by).agg(F.min("bucket").alias("first"))
    spine = buckets.select("bucket").distinct()
    # the spine is one row per bucket of the whole span; series meet it by a range condition on their first bucket
    every = first.join(F.broadcast(spine), F.col("bucket") >= F.col("first")).drop("first")
    return every.join(buckets, ["bucket", *by], "left").withColumn(value, F.coalesce(value, F.lit(0.0)))


def stale(df: DataFrame, by: list[str], max_age_s: float, time: str = "time") -> DataFrame:
    """Series whose last point is more than max_age_s older than the newest point of all."""
    last = df.groupBy(*by).agg(F.max(F.unix_micros(time)).alias("last"))
    age = (F.max("last").over(Window.partitionBy()) - F.col("last")) / 1e6
    return last.withColumn("age_s", age).filter(F.col("age_s") > max_age_s).drop("last")


def slot_counts(df: DataFrame, span_s: int, weekly: bool = False, time: str = "time") -> DataFrame:
    """Rows per bucket with the bucket's slot: the UTC hour, or the weekday (Sunday is 0) times 24 plus the hour."""
    n = df.withColumn("bucket", bucket_of(time, span_s)).groupBy("bucket").agg(F.count("*").cast("double").alias("n"))
    at = F.timestamp_seconds("bucket")
    slot = (F.dayofweek(at) - 1) * 24 + F.hour(at) if weekly else F.hour(at)
    return n.withColumn("slot", slot.cast("int"))


def spherical_mean(df: DataFrame, span_s: int, lat: str, lon: str, by: list[str], time: str = "time") -> DataFrame:
    """Mean position on the sphere per bucket and series."""
    a, b = F.radians(lat), F.radians(lon)
    keyed = df.withColumn("bucket", bucket_of(time, span_s)).groupBy("bucket", *by)
    xyz = keyed.agg(F.avg(F.cos(a) * F.cos(b)).alias("x"), F.avg(F.cos(a) * F.sin(b)).alias("y"), F.avg(F.sin(a)).alias("z"))
    return xyz.select("bucket", *by, "x", "y", "z", F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("lat"), F.degrees(F.atan2("y", "x")).alias("lon"))


def influencer_rank(records: DataFrame, field: str, value: str, score: str, share: str) -> DataFrame:
    """Per (field, value): records, highest score, and the sum of score times share (a share of 0 or less counts as 1)."""
    weight = F.when(F.col(share) > 0, F.col(share)).otherwise(1.0)
    g = records.groupBy(field, value).agg(F.count("*").alias("records"), F.max(score).alias("max_score"), F.sum(F.col(score) * weight).alias("total"))
    w = Window.orderBy(F.desc("total"), F.desc("max_score"), field, value)
    return g.withColumn("rank", F.row_number().over(w))
