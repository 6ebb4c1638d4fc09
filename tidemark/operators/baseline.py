"""Baselines as window expressions: robust z scores, seasonal phases, populations, rarity, rolling statistics.

The frames end before the current row, so a score never depends on what comes later. Series are the partitions; a
series' history is bounded by its frame, and sorting spills.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import MAD_SCALE, array_mad, array_median, haversine_km

HISTORY, WARM_UP = 1024, 20


def robust_scale(centre: Column, mad: Column, integers: Column) -> Column:
    """1.4826 MAD; where that is 0, a floor: for integer series max(1, sqrt|centre|), else 2 % of |centre|."""
    floor = F.when(integers, F.greatest(F.lit(1.0), F.sqrt(F.abs(centre)))).otherwise(F.greatest(0.02 * F.abs(centre), F.lit(1e-9)))
    return F.when(mad > 0, MAD_SCALE * mad).otherwise(floor)


def zscore(df: DataFrame, by: list[str], value: str, order: str = "bucket", window: int = HISTORY, warm_up: int = WARM_UP, side: str = "both") -> DataFrame:
    """typical, scale and z of each value against the median and MAD of up to `window` values before it.

    Rows with fewer than warm_up values before them have no z. A one-sided z ignores deviations to the other side.
    """
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-window, -1)
    rows = df.withColumn("past", F.collect_list(value).over(w)).withColumn("n_past", F.size("past"))
    rows = rows.withColumn("typical", F.when(F.col("n_past") >= warm_up, array_median(F.col("past"))))
    rows = rows.withColumn("mad", array_mad(F.col("past"), F.col("typical")))
    integers = F.forall("past", lambda x: x == F.floor(x))
    rows = rows.withColumn("scale", robust_scale(F.col("typical"), F.col("mad"), integers))
    z = (F.col(value) - F.col("typical")) / F.col("scale")
    z = z if side == "both" else F.greatest(z, F.lit(0.0)) if side == "high" else F.least(z, F.lit(0.0))
    return rows.withColumn("z", z).drop("past", "mad")


def bounds(df: DataFrame) -> DataFrame:
    return df.withColumn("lower", F.col("typical") - 1.96 * F.col("scale")).withColumn("upper", F.col("typical") + 1.96 * F.col("scale"))


def multi_bucket(df: DataFrame, by: list[str], z: str = "z", order: str = "bucket", n: int = 12) -> DataFrame:
    """Median of the last n z scores, scaled to unit variance: slow shifts that no single bucket shows."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    rows = df.filter(F.col(z).isNotNull()).withColumn("run", F.collect_list(z).over(w))
    return rows.withColumn("mb_z", F.when(F.size("run") == n, array_median(F.col("run")) * math.sqrt(2 * n / math.pi))).drop("run")


def seasonal_zscore(df: DataFrame, by: list[str], value: str, period: int, span_s: int, order: str = "bucket", warm_up: int = 4) -> DataFrame:
    """As zscore, each phase of a fixed period against its own past."""
    phase = F.pmod(F.floor(F.col(order) / span_s), F.lit(period)).cast("int")
    return zscore(df.withColumn("phase", phase), [*by, "phase"], value, order, warm_up=warm_up)


def population_zscore(df: DataFrame, split: list[str], value: str, order: str = "bucket", warm_up: int = WARM_UP) -> DataFrame:
    """Each entity's value against the pool of all entities' values in all earlier buckets of the same split.

    The pool of a bucket is summed up once and joined to the bucket's rows, not to every entity by itself. It grows
    from bucket to bucket in one sorted array, so a split's values are held once; null and NaN don't count.
    """

    def pools(pdf):
        out, past, whole = [], np.zeros(0), True
        for bucket, v in pdf.groupby(order, sort=True)[value]:
            typical = mad = None
            if len(past) >= warm_up:
                typical = float(past[(len(past) - 1) // 2] + past[len(past) // 2]) / 2
                off = np.abs(past - typical)
                off.partition([(len(past) - 1) // 2, len(past) // 2])
                mad = float(off[(len(past) - 1) // 2] + off[len(past) // 2]) / 2
            out.append((*(pdf[c].iloc[0] for c in split), bucket, len(past), typical, mad, whole))
            new = v.dropna().to_numpy(float)
            past, whole = np.sort(np.concatenate([past, new]), kind="stable"), whole and bool((new == np.floor(new)).all())
        return pd.DataFrame(out, columns=[*split, order, "n_past", "typical", "mad", "integers"])

    kind = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kind[c]}" for c in [*split, order]) + ", n_past int, typical double, mad double, integers boolean"
    pool = df.select(*split, order, F.col(value).cast("double").alias(value)).groupBy(*split).applyInPandas(pools, schema)
    pool = pool.withColumn("scale", robust_scale(F.col("typical"), F.col("mad"), F.col("integers")))
    rows = df.join(pool.select(*split, order, "n_past", "typical", "scale"), [*split, order])
    return rows.withColumn("z", (F.col(value) - F.col("typical")) / F.col("scale"))


def rare(df: DataFrame, field: str, order: str = "bucket", warm_up: int = 20, most: int = 2, frequent: bool = False) -> DataFrame:
    """Values seen in at most `most` buckets so far, from the warm-up on: f = buckets with it / buckets so far.

    score = min(100, 50 - 15 log10 f), plus 10 log2(n + 1) of the bucket's rows where `frequent`.
    """
    n = df.filter(F.col(field).isNotNull() & (F.col(field).cast("string") != "")).groupBy(order, field).agg(F.count("*").alias("n"))
    turns = df.select(order).distinct().withColumn("turn", F.row_number().over(Window.orderBy(order)))
    rows = n.join(F.broadcast(turns), order).withColumn("seen", F.row_number().over(Window.partitionBy(field).orderBy(order)))
    rows = rows.filter((F.col("turn") > warm_up) & (F.col("seen") <= most)).withColumn("p", F.col("seen") / F.col("turn"))
    score = 50 - 15 * F.log10("p") + (10 * F.log2(F.col("n") + 1) if frequent else 0)
    return rows.withColumn("score", F.least(F.lit(100.0), score))


def centroid_distance(df: DataFrame, by: list[str], order: str = "bucket") -> DataFrame:
    """Kilometres from the mean of all earlier positions. df: x, y, z (unit vector means), lat, lon."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = df.withColumns({f"c{a}": F.avg(a).over(w) for a in "xyz"})
    lat = F.degrees(F.atan2("cz", F.sqrt(F.col("cx") ** 2 + F.col("cy") ** 2)))
    lon = F.degrees(F.atan2("cy", "cx"))
    return rows.withColumn("km", F.when(F.col("cx").isNotNull(), haversine_km("lat", "lon", lat, lon))).drop("cx", "cy", "cz")


def moving_average(df: DataFrame, by: list[str], value: str, order: str, half: int) -> DataFrame:
    return df.withColumn("ma", F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)))


def mean_residual(df: DataFrame, by: list[str], value: str, order: str, depth: int) -> DataFrame:
    """Value less the mean of up to `depth` values before it; the first is 0."""
    mean = F.avg(value).over(Window.partitionBy(*by).orderBy(order).rowsBetween(-depth, -1))
    return df.withColumn("residual", F.coalesce(F.col(value) - mean, F.lit(0.0)))


def deseasonalise(df: DataFrame, by: list[str], value: str, order: str, index: str, period: int, keep: int = 8, least: int = 2) -> DataFrame:
    """Value less the median of the last `keep` values of its phase; 0 until there are `least`."""
    rows = df.withColumn("phase", F.pmod(F.col(index), F.lit(period)).cast("int"))
    w = Window.partitionBy(*by, "phase").orderBy(order).rowsBetween(-keep, -1)
    rows = rows.withColumn("past", F.collect_list(value).over(w))
    return rows.withColumn("residual", F.when(F.size("past") >= least, F.col(value) - array_median(F.col("past"))).otherwise(0.0)).drop("past")


def persistence(df: DataFrame, by: list[str], flag: Column, order: str, k: int, n: int) -> DataFrame:
    """True where k of the last n flags are."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(n - 1), 0)
    return df.withColumn("fires", F.sum(flag.cast("int")).over(w) >= k)


def candidates(df: DataFrame, by: list[str], flag: Column, score: str, order: str, gap: int) -> DataFrame:
    """Regions of flagged rows (order is an index); flags at most `gap` apart are one region."""
    w = Window.partitionBy(*by).orderBy(order)
    hits = df.filter(flag).withColumn("new", F.coalesce((F.col(order) - F.lag(order).over(w) > gap).cast("int"), F.lit(1)))
    hits = hits.withColumn("region", F.sum("new").over(w))
    return hits.groupBy(*by, "region").agg(F.min(order).alias("start"), F.max(order).alias("stop"), F.max(score).alias("peak"), F.count("*").alias("hits"))


def renormalise(records: DataFrame, by: list[str], p: str, score: str) -> DataFrame:
    """Scores against the most severe record of the same detector and series (12 decades at least)."""
    severity = F.when(F.col(p) < 1e-12, 12.0).otherwise(-F.log10(p))
    anchor = F.greatest(F.lit(12.0), F.max(severity).over(Window.partitionBy(*by)))
    return records.withColumn("initial_score", F.col(score)).withColumn(score, F.greatest(F.lit(0.0), F.least(F.lit(100.0), severity / anchor * 100)))


def empirical_tail(df: DataFrame, by: list[str], value: str, order: str, window: int, warm_up: int) -> DataFrame:
    """(1 + values before that are as large) / (n + 1) over up to `window` values before."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-window, -1)
    rows = df.withColumn("past", F.collect_list(value).over(w)).withColumn("n_past", F.size("past"))
    p = (1 + F.size(F.filter("past", lambda x: x >= F.col(value)))) / (F.col("n_past") + 1)
    return rows.withColumn("p", F.when(F.col("n_past") >= warm_up, p).otherwise(1.0)).drop("past")
