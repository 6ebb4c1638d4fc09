"""Peers and outliers: cross-section scores, and nearest-neighbour ensembles over feature tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expressions import MAD_SCALE, array_mad, array_median
from tidemark.operators import neighbours as V
from tidemark.operators.multiple import same


def cross_median(df: DataFrame, value: str, order: str = "bucket") -> DataFrame:
    return df.groupBy(order).agg(F.percentile(value, F.lit(0.5)).alias("median"))


def deviation(df: DataFrame, value: str, order: str = "bucket") -> DataFrame:
    """Robust |z| of each series within the cross-section of its moment."""
    g = df.groupBy(order).agg(F.collect_list(value).alias("all")).withColumn("centre", array_median(F.col("all")))
    g = g.withColumn("scale", MAD_SCALE * array_mad(F.col("all"), F.col("centre"))).drop("all")
    return df.join(g, order).withColumn("deviation", F.when(F.col("scale") > 0, F.abs(F.col(value) - F.col("centre")) / F.col("scale")).otherwise(0.0))


def relative(df: DataFrame, value: str, order: str = "bucket") -> DataFrame:
    """Each series over the cross-section's median, or less it where that is 0."""
    m = F.col("median")
    return df.join(cross_median(df, value, order), order).withColumn("relative", F.when(F.abs(m) <= 1e-12, F.col(value) - m).otherwise(F.col(value) / m))


def nearest(df: DataFrame, key: str, features: list[str], k: int) -> DataFrame:
    """(key, rank, neighbour, distance) in the features' own units, ties to the smaller neighbour; for tables of any size."""
    rows = V.nearest(df, key, features, k).select("key", F.posexplode("near").alias("i", "n"))
    return rows.select("key", (F.col("i") + 1).alias("rank"), "n.neighbour", "n.distance")


def standardise(x: np.ndarray) -> np.ndarray:
    """By median and scaled MAD, else mean and deviation, else by 1."""
    m = np.median(x, axis=0)
    s = MAD_SCALE * np.median(np.abs(x - m), axis=0)
    sd = x.std(axis=0)
    flat = s <= 0
    m = np.where(flat, x.mean(axis=0), m)
    s = np.where(flat, np.where(sd > 0, sd, 1.0), s)
    return (x - m) / s


def neighbours(z: np.ndarray, k: int, block: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Distances and places of the k nearest other rows, blocks of rows at a time."""
    n = len(z)
    k = min(k, n - 1)
    dist, at = np.empty((n, k)), np.empty((n, k), np.int64)
    sq = (z * z).sum(axis=1)
    for lo in range(0, n, block):
        part = z[lo : lo + block]
        d = np.maximum(0, sq[lo : lo + block, None] - 2 * part @ z.T + sq[None])
        d[np.arange(len(part)), np.arange(lo, lo + len(part))] = np.inf
        # exact distances for the few that matter
        near = np.argpartition(d, min(n - 1, k + 8), axis=1)[:, : min(n, k + 8) if n > k + 8 else n]
        exact = np.sqrt(((part[:, None, :] - z[near]) ** 2).sum(axis=2))
        exact[near == np.arange(lo, lo + len(part))[:, None]] = np.inf
        order = np.lexsort((near, exact), axis=1)[:, :k]
        dist[lo : lo + block] = np.take_along_axis(exact, order, axis=1)
        at[lo : lo + block] = np.take_along_axis(near, order, axis=1)
    return dist, at


def lof(dist: np.ndarray, at: np.ndarray) -> np.ndarray:
    reach = np.maximum(dist, dist[:, -1][at])
    density = 1 / np.maximum(reach.mean(axis=1), 1e-12)
    return density[at].mean(axis=1) / density


def ldof(z: np.ndarray, dist: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Mean distance to the neighbours over the mean distance among them."""
    k = at.shape[1]
    if k < 2:
        return np.ones(len(z))
    p = z[at]
    d = np.sqrt(((p[:, :, None, :] - p[:, None, :, :]) ** 2).sum(axis=3))
    inner = d.sum(axis=(1, 2)) / (k * (k - 1))
    return dist.mean(axis=1) / np.maximum(inner, 1e-12)


def squash(raw: np.ndarray) -> np.ndarray:
    """Logarithm, robust z, and a sigmoid around three deviations."""
    x = np.log(np.maximum(raw, 1e-12))
    m = np.median(x)
    s = MAD_SCALE * np.median(np.abs(x - m))
    s = s if s > 0 else (x.std() or 1.0)
    return 1 / (1 + np.exp(-np.clip((x - m) / s - 3, -500, 500)))


def ensemble(x: np.ndarray, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Outlier scores of 0 to 1, and each feature's share of the squared distance to the neighbours. 3 to 50 000 rows."""
    if not 3 <= len(x) <= 50_000:
        raise ValueError("3 to 50000 rows")
    z = standardise(np.asarray(x, float))
    dist, at = neighbours(z, k)
    parts = [dist.mean(axis=1), dist[:, -1], lof(dist, at), ldof(z, dist, at)]
    gap = ((z[:, None, :] - z[at]) ** 2).sum(axis=1)
    total = gap.sum(axis=1, keepdims=True)
    return np.mean([squash(p) for p in parts], axis=0), np.where(total > 0, gap / np.where(total > 0, total, 1), 1 / z.shape[1])


METHODS = ("knn", "kth_nn", "lof", "ldof")


def _scales(df: DataFrame, cols: list[str]) -> DataFrame:
    """(g, m_c, s_c): median and scaled MAD of each column by group, else the sample deviation, else 0."""
    m = df.groupBy("g").agg(*(F.percentile(c, F.lit(0.5)).alias(f"m_{c}") for c in cols))
    mads = df.join(m, "g").groupBy("g").agg(*(F.percentile(F.abs(F.col(c) - F.col(f"m_{c}")), F.lit(0.5)).alias(f"a_{c}") for c in cols), *(F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"d_{c}") for c in cols))
    s = lambda c: F.when(F.col(f"a_{c}") > 0, MAD_SCALE * F.col(f"a_{c}")).otherwise(F.col(f"d_{c}"))
    return m.join(mads, "g").select("g", *(F.col(f"m_{c}") for c in cols), *(s(c).alias(f"s_{c}") for c in cols))


def outliers(df: DataFrame, by: list[str], key: str, features: list[str], k: int = 5) -> DataFrame:
    """(*by, key, score, influence array) within each group, for groups of any size; keys are unique in a group.

    Features are standardised by group; the score is the mean of the squashed kNN and kth distances, LOF and LDOF. The
    influence is each feature's share of the squared distance to the neighbours, null where that is 0. Groups of fewer
    than three rows score 0; rows that lack a feature have no score.
    """
    groups = df.select(*by).distinct().withColumn("g", (F.row_number().over(Window.orderBy(*by)) - 1).cast("double"))
    names = [f"f{i}_" for i in range(len(features))]
    rows = df.select(*by, F.col(key).alias("key"), *(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(n) for c, n in zip(features, names, strict=True)))
    rows = V.keep(rows.join(groups.withColumnsRenamed({c: f"{c}_k" for c in by}), same(by)).drop(*(f"{c}_k" for c in by)))
    whole = rows.dropna(subset=names)
    sizes = whole.groupBy("g").agg(F.count("*").alias("n")).filter("n >= 3")
    z = whole.join(sizes, "g").join(_scales(whole, names), "g")
    z = z.select("g", "key", *((F.col(n) - F.col(f"m_{n}")).__truediv__(F.when(F.col(f"s_{n}") > 0, F.col(f"s_{n}")).otherwise(1.0)).alias(n) for n in names))
    near = V.keep(V.nearest(z, "key", names, k, "g"))

    add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    apart = lambda u, v: F.sqrt(add(F.zip_with(u, v, lambda p, q: (p - q) * (p - q))))
    size = F.size("near")
    inner = add(F.flatten(F.transform("near", lambda a: F.transform("near", lambda b: apart(a["y"], b["y"]))))) / (size * (size - 1))
    links = near.select("g", "key", F.explode("near").alias("n")).select("g", "key", F.col("n.neighbour").alias("nb"), "n.distance")
    reach = near.select("g", F.col("key").alias("nb"), F.element_at("near", -1)["distance"].alias("kd"))
    dense = links.join(reach, ["g", "nb"]).groupBy("g", "key").agg(F.count("*").alias("c"), F.sum(F.greatest("kd", "distance")).alias("sum"))
    dense = dense.select("g", "key", "c", F.when(F.col("sum") > 0, F.col("c") / F.col("sum")).alias("lrd"))  # null: infinite
    around = links.join(dense.select("g", F.col("key").alias("nb"), F.col("lrd").alias("other")), ["g", "nb"]).groupBy("g", "key").agg(F.coalesce(F.sum("other"), F.lit(0.0)).alias("around"))
    lof_ = dense.join(around, ["g", "key"]).select("g", "key", F.coalesce(F.col("around") / (F.col("c") * F.col("lrd")), F.lit(1.0)).alias("lof"))
    mean = add(F.transform("near", lambda a: a["distance"])) / size
    off = lambda i: F.transform("near", lambda a: (F.col("x")[i] - a["y"][i]) * (F.col("x")[i] - a["y"][i]))
    gap = F.array(*(add(off(i)) for i in range(len(names))))
    raw = near.select("g", "key", mean.alias("knn"), F.element_at("near", -1)["distance"].alias("kth_nn"), F.when((size >= 2), F.when(inner > 0, mean / F.when(inner > 0, inner))).alias("ldof"), gap.alias("gap"))
    raw = raw.join(lof_, ["g", "key"]).withColumn("ldof", F.coalesce("ldof", F.lit(1.0)))
    raw = V.keep(raw.select("g", "key", "gap", *(F.log(F.greatest(F.col(c), F.lit(1e-12))).alias(c) for c in METHODS)))
    part = lambda c: F.when(F.col(f"s_{c}") > 0, 1 / (1 + F.exp(3 - (F.col(c) - F.col(f"m_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}"))))).otherwise(0.0)
    total = add(F.col("gap"))
    scored = raw.join(_scales(raw, list(METHODS)), "g").select("g", "key", (sum((part(c) for c in METHODS), F.lit(0.0)) / len(METHODS)).alias("score"), F.when(total > 0, F.transform("gap", lambda v: v / total)).alias("influence"))
    out = rows.join(sizes, "g", "left").join(scored, ["g", "key"], "left")
    return out.select(*by, F.col("key").alias(key), F.when(F.col("n").isNull(), 0.0).otherwise(F.col("score")).alias("score"), "influence")
