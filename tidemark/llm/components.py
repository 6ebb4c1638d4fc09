"""Connected components of an undirected graph in DataFrames, by alternating large-star and small-star steps."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, tidy

#: So many edges, 16 bytes each, are solved in one task: fewer jobs, and as many whatever the graph.
FEW_EDGES = 200_000


def _solve(batches):
    """The components of all edges (u, v) of a task by halving paths to the smallest node."""
    parts = [np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]) for b in batches if b.num_rows]
    if not parts:
        return
    nodes, at = np.unique(np.concatenate(parts, axis=1), return_inverse=True)
    above = list(range(len(nodes)))

    def top(i: int) -> int:
        while above[i] != i:
            above[i] = i = above[above[i]]
        return i

    for u, v in at.reshape(2, -1).T.tolist():
        u, v = top(u), top(v)
        above[max(u, v)] = min(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[[top(i) for i in range(len(nodes))]])], names=["node", "component"])


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 64) -> DataFrame:
    """(node, component): for every node with an edge the smallest node it reaches.

    A large star ties each node's larger neighbours to its smallest neighbour, a small star its smaller ones; the
    number of rounds grows with the logarithm of the longest path. Smallest neighbours are found by partial
    aggregation and met by joins that split hot nodes, so no node's neighbours come together in a task. Up to FEW_EDGES
    edges are solved in one task instead.
    """
    ab = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u <> v")
    ab = materialise(ab.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    if ab.count() <= FEW_EDGES and all(t == "bigint" for _, t in ab.dtypes):
        return ab.repartition(1).mapInArrow(tidy(_solve), "node bigint, component bigint")
    mark = None
    for _ in range(max_rounds):
        both = ab.unionByName(ab.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(small_least.select("u", F.col("m").alias("v"))).distinct()
        ab = materialise(small, "edges")
        got = ab.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if (now := tuple(got)) == mark:
            break
        mark = now
    else:
        raise RuntimeError("components did not settle")
    return ab.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(ab.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
