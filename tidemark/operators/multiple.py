"""Many tests at once: false-discovery control and conformal p-values, as ranks and range frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import clean_p

#: Slices of an octave of p-values.
SLICES = 4096


EULER = 0.57721566490153286


def harmonic_number(m: Column) -> Column:
    """1 + 1/2 + ... + 1/m: the sum itself for small m, else its asymptotic series, which is exact to a double."""
    m = m.cast("double")
    small = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(200.0)).cast("int")), F.lit(0.0), lambda acc, i: acc + 1.0 / i)
    return F.when(m <= 200, small).otherwise(F.log(m) + EULER + 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * m * m * m * m))


def step_up(df: DataFrame, by: list[str], p: str, q: float, dependent: bool = False, pi0: str | None = None) -> DataFrame:
    """Benjamini-Hochberg (Benjamini-Yekutieli if dependent; a column with Storey's pi0 makes it adaptive).

    Adds rejected: all p-values up to the largest one below its step. The largest rank among ties counts.

    Ranks are running counts of distinct p-values, first over slices of their logarithm and then within each slice, so no
    task sorts a whole family; the rows themselves meet one number for each family.
    """
    rows = df.withColumn("p_", clean_p(p))
    n = rows.groupBy(*by, "p_").agg(F.count("*").alias("n_"), F.max(pi0 if pi0 else F.lit(1.0)).alias("pi0_")).withColumn("slice_", F.floor(F.log2("p_") * SLICES))
    slices, key = n.groupBy(*by, "slice_").agg(F.sum("n_").alias("in_")), [*by, "slice_"]
    whole = Window.partitionBy(*by)
    slices = slices.withColumn("m_", F.sum("in_").over(whole)).withColumn("before_", F.sum("in_").over(whole.orderBy("slice_")) - F.col("in_")).drop("in_")
    met = n.join(renamed(slices, key), same(key), "inner").withColumn("rank_", F.col("before_") + F.sum("n_").over(Window.partitionBy(*key).orderBy("p_")))
    level = F.col("rank_") * q / (F.col("m_") * (harmonic_number(F.col("m_")) if dependent else F.lit(1.0)) * F.col("pi0_"))
    cuts = met.filter(F.col("p_") <= level).groupBy(*by).agg(F.max("p_").alias("cut_"))
    out = rows.join(renamed(cuts, by), same(by), "left").withColumn("rejected", F.coalesce(F.col("p_") <= F.col("cut_"), F.lit(False)))
    return out.drop("p_", "cut_", *(f"{x}_k" for x in by))


def renamed(df: DataFrame, key: list[str]) -> DataFrame:
    return df.withColumnsRenamed({c: f"{c}_k" for c in key})


def same(key: list[str]) -> Column:
    """Equal keys, null like any other; true where there is no key."""
    return reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"{c}_k")) for c in key], F.lit(True))


def storey_pi0(df: DataFrame, by: list[str], p: str, cut: float = 0.5) -> DataFrame:
    """The share of true nulls from the p-values above the cut; between 1/m and 1."""
    g = df.groupBy(*by).agg(F.count("*").alias("m"), F.count_if(clean_p(p) > cut).alias("above"))
    pi0 = F.greatest(1 / F.col("m"), F.least(F.lit(1.0), (F.col("above") + 1) / (F.col("m") * (1 - cut))))
    return g.withColumn("pi0", pi0).drop("m", "above")


def conformal_p(scores: DataFrame, calibration: DataFrame, by: list[str], score: str) -> DataFrame:
    """(1 + calibration scores as large) / (n + 1), by one sort of both sides instead of a range join."""
    both = scores.withColumn("cal_", F.lit(0)).unionByName(calibration.select(*by, score).withColumn("cal_", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy(F.desc(score)).rangeBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by)
    both = both.withColumn("ge_", F.sum("cal_").over(w)).withColumn("n_", F.sum("cal_").over(whole))
    return both.filter("cal_ = 0").withColumn("p", (1 + F.col("ge_")) / (F.col("n_") + 1)).drop("cal_", "ge_", "n_")
