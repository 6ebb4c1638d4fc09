"""Series models that aggregates and windows can express: correlation by lag, lines, one split, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def acf(df: DataFrame, value: str, order: str, max_lag: int) -> DataFrame:
    """Autocorrelation of one series by lag, around its mean. Lags are an equi-join on the shifted index."""
    m = df.agg(F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("s"))
    a = df.select(F.col(order).alias("i"), F.col(value).alias("x"), F.explode(F.sequence(F.lit(1), F.lit(max_lag))).alias("lag"))
    b = df.select((F.col(order)).alias("j"), F.col(value).alias("y"))
    j = a.join(b, F.col("i") + F.col("lag") == F.col("j")).crossJoin(F.broadcast(m))
    return j.groupBy("lag").agg((F.sum((F.col("x") - F.col("m")) * (F.col("y") - F.col("m"))) / F.max("s")).alias("acf"))


def cross_correlation(df: DataFrame, a: str, b: str, order: str, max_lag: int) -> DataFrame:
    """Pearson correlation of a with b shifted by each lag; positive lags mean that a leads."""
    x = df.filter(F.col(a).isNotNull()).select(F.col(order).alias("i"), F.col(a).alias("x"), F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag"))
    y = df.filter(F.col(b).isNotNull()).select(F.col(order).alias("j"), F.col(b).alias("y"))
    return x.join(y, F.col("i") + F.col("lag") == F.col("j")).groupBy("lag").agg(F.corr("x", "y").alias("r"))


def lead_lag(df: DataFrame, a: str, b: str, order: str, max_lag: int) -> DataFrame:
    return cross_correlation(df, a, b, order, max_lag).orderBy(F.desc(F.abs(F.round("r", 9))), "lag").limit(1)


def linear_forecast(df: DataFrame, by: list[str], value: str, order: str, horizon: int) -> DataFrame:
    fit = df.groupBy(*by).agg(F.regr_slope(value, order).alias("slope"), F.regr_intercept(value, order).alias("intercept"), F.max(order).alias("last"))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return steps.withColumn("forecast", F.col("intercept") + F.col("slope") * (F.col("last") + F.col("step"))).drop("slope", "intercept", "last")


def best_split(df: DataFrame, value: str, order: str, least: int = 5) -> DataFrame:
    """The split of one series into two levels with the smallest squared error, scored against a line."""
    w = Window.orderBy(order)
    d = df.select(F.row_number().over(w).cast("long").alias("i"), F.col(value).alias("v"))
    run = Window.orderBy("i")
    c = d.withColumn("ls", F.sum("v").over(run)).withColumn("lq", F.sum(F.col("v") * F.col("v")).over(run))
    t = d.agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"), F.regr_sxx("v", "i").alias("sxx"), F.regr_sxy("v", "i").alias("sxy"), F.regr_syy("v", "i").alias("syy"))
    x = c.crossJoin(F.broadcast(t)).filter((F.col("i") >= least) & (F.col("n") - F.col("i") >= least))
    right = (F.col("q") - F.col("lq")) - (F.col("s") - F.col("ls")) ** 2 / (F.col("n") - F.col("i"))
    x = x.withColumn("sse", F.col("lq") - F.col("ls") ** 2 / F.col("i") + right).withColumn("line", F.col("syy") - F.col("sxy") ** 2 / F.col("sxx"))
    best = x.orderBy("sse", "i").limit(1)
    return best.select(F.col("i").alias("split"), ((F.col("line") - F.col("sse")) / (F.col("sse") / (F.col("n") - 2) + 1e-9)).alias("score"))


def features(df: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    return df.groupBy(*by).agg(F.count("*").alias("length"), F.regr_slope(value, order).alias("trend"), F.stddev_pop(value).alias("noise"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"))


def suggest_span(df: DataFrame, by: list[str], spans: list[int], time: str = "time") -> DataFrame:
    """The largest of the given spans that a series' median distance between points reaches, else the smallest."""
    gap = (F.unix_micros(time) - F.lag(F.unix_micros(time)).over(Window.partitionBy(*by).orderBy(time))) / 1e6
    d = df.withColumn("gap", gap).filter("gap > 0").groupBy(*by).agg(F.expr("percentile_disc(0.5) within group (order by gap)").alias("d"))
    pick = F.lit(spans[0])
    for s in spans[1:]:
        pick = F.when(F.col("d") >= s, F.lit(s)).otherwise(pick)
    return d.select(*by, pick.cast("long").alias("span_s"))
