"""Detection quality: confusion, segments, point adjustment, precision-recall area, range scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def segments(df: DataFrame, by: list[str], flag: str, order: str) -> DataFrame:
    """Rows where flag holds, with a segment number: islands of consecutive index values."""
    w = Window.partitionBy(*by).orderBy(order)
    return df.filter(flag).withColumn("segment", F.col(order) - F.row_number().over(w))


def confusion(df: DataFrame, by: list[str], label: str, fired: str) -> DataFrame:
    c = lambda a, b: F.count_if((F.col(label) == a) & (F.col(fired) == b))
    g = df.groupBy(*by).agg(c(True, True).alias("tp"), c(False, True).alias("fp"), c(True, False).alias("fn"), c(False, False).alias("tn"))
    return with_f1(g)


def with_f1(g: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = div(F.col("tp"), F.col("tp") + F.col("fp")), div(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumn("precision", p).withColumn("recall", r).withColumn("f1", div(2 * p * r, p + r))


def point_adjust(df: DataFrame, by: list[str], label: str, fired: str, order: str, k: float = 0.0) -> DataFrame:
    """Of each labelled segment all points count as fired once more than a share k of them (one at least) did."""
    labelled = segments(df, by, label, order)
    whole = Window.partitionBy(*by, "segment")
    hit = (F.sum(F.col(fired).cast("int")).over(whole) > 0) & (F.avg(F.col(fired).cast("int")).over(whole) >= k)
    labelled = labelled.withColumn("adjusted", F.col(fired) | hit).drop("segment")
    return labelled.unionByName(df.filter(~F.col(label)).withColumn("adjusted", F.col(fired)))


def auc_pr(df: DataFrame, by: list[str], label: str, score: str) -> DataFrame:
    """Area under the precision-recall steps; equal scores are one step."""
    g = df.groupBy(*by, score).agg(F.count_if(F.col(label)).alias("pos"), F.count("*").alias("n"))
    w = Window.partitionBy(*by).orderBy(F.desc(score))
    g = g.withColumn("tp", F.sum("pos").over(w)).withColumn("seen", F.sum("n").over(w)).withColumn("all", F.sum("pos").over(Window.partitionBy(*by)))
    return g.groupBy(*by).agg(F.sum(F.when(F.col("all") > 0, F.col("pos") / F.col("all") * F.col("tp") / F.col("seen")).otherwise(0.0)).alias("auc_pr"))


def range_overlap(real: DataFrame, found: DataFrame, by: list[str]) -> DataFrame:
    """Per real region: share of it covered by found regions (both start, stop inclusive), and how many overlap it."""
    f = found.select(*by, F.col("start").alias("f0"), F.col("stop").alias("f1"))
    j = real.join(f.withColumnsRenamed({c: f"{c}_" for c in by}), [F.col(c) == F.col(f"{c}_") for c in by] + [F.col("f0") <= F.col("stop"), F.col("f1") >= F.col("start")], "left")
    size = F.least("stop", "f1") - F.greatest("start", "f0") + 1
    g = j.groupBy(*by, "start", "stop").agg(F.coalesce(F.sum(size), F.lit(0)).alias("covered"), F.count("f0").alias("overlaps"))
    return g.withColumn("coverage", F.col("covered") / (F.col("stop") - F.col("start") + 1))


def range_f1(real: DataFrame, found: DataFrame, by: list[str], alpha: float = 0.5, how: str = "full") -> DataFrame:
    """Range recall (existence and coverage, flat bias, 1 / overlaps where several) and range precision, per key.

    A key with regions on one side alone has 0 for what it lacks; how="inner" leaves it out.
    """
    part = lambda d, a: d.groupBy(*by).agg(F.avg(a * (F.col("overlaps") > 0).cast("int") + (1 - a) * F.col("coverage") / F.greatest(F.lit(1), "overlaps")).alias("v"))
    r = part(range_overlap(real, found, by), alpha).withColumnRenamed("v", "recall")
    p = part(range_overlap(found, real, by), 0.0).withColumnRenamed("v", "precision")
    j = r.join(p, by, how).na.fill(0.0, ["recall", "precision"])
    return j.withColumn("f1", F.when(F.col("recall") + F.col("precision") > 0, 2 * F.col("recall") * F.col("precision") / (F.col("recall") + F.col("precision"))).otherwise(0.0))


def label_points(points: DataFrame, windows: DataFrame, time: str = "time") -> DataFrame:
    """points with label: inside any window of their key (ends included). Windows are joined by their key."""
    w = windows.select(F.col("key").alias("key_"), F.col("start").alias("start_"), F.col("stop").alias("stop_"))
    inside = points.join(w, (F.col("key") == F.col("key_")) & F.col(time).between(F.col("start_"), F.col("stop_")), "left_semi").withColumn("label", F.lit(True))
    outside = points.join(w, (F.col("key") == F.col("key_")) & F.col(time).between(F.col("start_"), F.col("stop_")), "left_anti").withColumn("label", F.lit(False))
    return inside.unionByName(outside)
