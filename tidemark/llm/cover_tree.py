"""Exact top-k inner-product search by a dual-tree walk over cover trees.

Data and queries are cut into blocks, and each block is indexed by a cover tree. A farthest-first traversal gives
its nested levels: the centres whose insertion distance exceeds r are more than r apart (separation), every point
lies within r of one of them (covering), and the centres of a level are among those of the next (nesting), where
r halves from level to level. Nodes keep the true radius of what lies below them.

Both trees are walked down together. For centres c, d and radii r, s no query of the one node has an inner product
with a point of the other above c.d + r|d| + s|c| + rs; a pair of nodes is dropped when that is below the worst
kth score of the query node's queries. What remains is scored leaf by leaf, best bound first, in exact integers.

Every task takes its data blocks one by one, carrying its queries' kth scores along, and hands on k rows a query.
Queries come in broadcast blocks of at most QUERY_BYTES, one pass over the data for each; the data do not move.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

BLOCK, LEAF, QUERY_BYTES, PILOT = 4096, 32, 32 << 20, 4096
EXACT = float(1 << 53)


class Tree:
    """levels: per level the centres' point numbers, the node's parent in the level above, and its radius.

    The points below node j of the last level are order[starts[j]:starts[j + 1]].
    """

    def __init__(self, points: np.ndarray) -> None:
        x = points.astype(np.float64)
        n = len(x)
        most = max(1, min(n, -(-n // LEAF)))
        first = int(np.argmin(((x - x.mean(axis=0)) ** 2).sum(axis=1)))
        picked, gap = [first], [np.inf]
        near = np.sqrt(((x - x[first]) ** 2).sum(axis=1))
        owner = np.zeros(n, np.int64)
        while len(picked) < most:
            far = int(np.argmax(near))
            if near[far] <= 0:
                break
            gap.append(float(near[far]))
            d = np.sqrt(((x - x[far]) ** 2).sum(axis=1))
            closer = d < near
            owner[closer], near[closer] = len(picked), d[closer]
            picked.append(far)
        centre, gaps = np.array(picked), np.array(gap)
        sizes, r = [1], gaps[1] if len(gaps) > 1 else 0.0
        while sizes[-1] < len(centre):
            r /= 2
            size = int((gaps > r).sum())
            if size > sizes[-1]:
                sizes.append(size if r > gaps[1] / 1e6 else len(centre))
        above, self.levels = owner, []  # of each point, the node on the current level
        parents: list[np.ndarray] = []
        for upper, lower in zip(sizes, sizes[1:], strict=False):
            c, u = x[centre[:lower]], x[centre[:upper]]
            d = (c * c).sum(1)[:, None] - 2 * c @ u.T + (u * u).sum(1)[None]
            p = d.argmin(axis=1)
            p[:upper] = np.arange(upper)  # nesting
            parents.append(p)
        for level in range(len(sizes) - 1, -1, -1):
            at = centre[: sizes[level]]
            radius = np.zeros(len(at))
            np.maximum.at(radius, above, np.sqrt(((x - x[at[above]]) ** 2).sum(axis=1)))
            self.levels.append((at, parents[level - 1] if level else np.zeros(1, np.int64), radius * (1 + 1e-9) + 1e-9))
            if level:
                above = parents[level - 1][above]
        self.levels.reverse()
        self.order = np.argsort(owner, kind="stable")
        self.starts = np.searchsorted(owner[self.order], np.arange(sizes[-1] + 1))
        self.vectors, self.norms = [x[c] for c, _, _ in self.levels], [np.sqrt((x[c] ** 2).sum(axis=1)) for c, _, _ in self.levels]

    def leaf(self, j: int) -> np.ndarray:
        return self.order[self.starts[j] : self.starts[j + 1]]

    def worst(self, kth: np.ndarray) -> list[np.ndarray]:
        """For each level, each node's smallest kth score."""
        out = [np.minimum.reduceat(kth[self.order], self.starts[:-1])]
        for level in range(len(self.levels) - 1, 0, -1):
            up = np.full(len(self.levels[level - 1][0]), np.inf)
            np.minimum.at(up, self.levels[level][1], out[-1])
            out.append(up)
        return out[::-1]


def children(tree: Tree, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in nodes, child) of all children on the next level."""
    parent = tree.levels[level + 1][1]
    order = np.argsort(parent, kind="stable")
    lo, hi = np.searchsorted(parent[order], nodes), np.searchsorted(parent[order], nodes, side="right")
    n = hi - lo
    at = np.repeat(np.arange(len(nodes)), n)
    return at, order[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def bounds(q: Tree, ql: int, a: np.ndarray, d: Tree, dl: int, b: np.ndarray) -> np.ndarray:
    dot = np.einsum("ij,ij->i", q.vectors[ql][a], d.vectors[dl][b]) if len(a) < 4096 else (q.vectors[ql] @ d.vectors[dl].T)[a, b]
    rq, rd, nq, nd = q.levels[ql][2][a], d.levels[dl][2][b], q.norms[ql][a], d.norms[dl][b]
    slack = rq * nd + rd * nq + rq * rd
    return dot + slack + 1e-9 * (nq * nd + slack) + 1e-6


class Best:
    """The k best (score, id) of each query so far; floor is a score that is certainly reached in the end."""

    def __init__(self, n: int, k: int, floor: np.ndarray | None = None) -> None:
        self.k, self.scores, self.ids = k, [np.zeros(0, np.int64)] * n, [np.zeros(0, np.int64)] * n
        self.kth = np.full(n, -np.inf) if floor is None else floor.astype(np.float64)

    def offer(self, i: int, scores: np.ndarray, ids: np.ndarray) -> None:
        ok = scores >= self.kth[i]
        if not ok.any():
            return
        s, v = np.concatenate([self.scores[i], scores[ok]]), np.concatenate([self.ids[i], ids[ok]])
        top = np.lexsort((v, -s))[: self.k]
        self.scores[i], self.ids[i] = s[top], v[top]
        if len(top) == self.k:
            self.kth[i] = max(self.kth[i], float(s[top[-1]]))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if most < EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 2.0**62:
        return a @ b.T
    out = a.astype(object) @ b.T.astype(object)
    if any(abs(int(v)) >= 1 << 63 for v in out.ravel()):
        raise OverflowError("an inner product doesn't fit 64 bits")
    return out.astype(np.int64)


def walk(q: Tree, q_points: np.ndarray, q_ids: np.ndarray, d: Tree, points: np.ndarray, ids: np.ndarray, best: Best) -> int:
    """Offer every query the points that may be among its best; returns how many pairs were scored."""
    a, b, ql, dl, scored = np.zeros(1, np.int64), np.zeros(1, np.int64), 0, 0, 0
    worst = q.worst(best.kth)
    while True:
        bound = bounds(q, ql, a, d, dl, b)
        keep = bound >= worst[ql][a]
        a, b, bound = a[keep], b[keep], bound[keep]
        if not len(a) or (ql == len(q.levels) - 1 and dl == len(d.levels) - 1):
            break
        if ql < len(q.levels) - 1:
            at, a = children(q, ql, a)
            b = b[at]
            ql += 1
        if dl < len(d.levels) - 1:
            at, b = children(d, dl, b)
            a = a[at]
            dl += 1
    order = np.lexsort((-bound, a)) if len(a) else np.zeros(0, np.int64)
    a, b, bound = a[order], b[order], bound[order]
    centres, radius, norms = d.vectors[dl], d.levels[dl][2], d.norms[dl]
    for leaf in np.unique(a):
        lo, hi = np.searchsorted(a, [leaf, leaf + 1])
        mine, at, step = q.leaf(int(leaf)), lo, 4
        # with its own vector in place of the leaf's centre, a query's bound is tighter
        own_bound, norm = q_points[mine].astype(np.float64) @ centres[b[lo:hi]].T, np.sqrt((q_points[mine].astype(np.float64) ** 2).sum(axis=1))
        slack = norm[:, None] * radius[b[lo:hi]][None]
        own_bound += slack + 1e-9 * (norm[:, None] * norms[b[lo:hi]][None] + slack) + 1e-6
        while at < hi and bound[at] >= best.kth[mine].min():
            nodes = slice(at - lo, min(hi, at + step) - lo)
            open_ = own_bound[:, nodes] >= best.kth[mine][:, None]
            at, step = at + step, min(64, step * 2)
            who, what = np.flatnonzero(open_.any(axis=1)), np.flatnonzero(open_.any(axis=0))
            if not len(who):
                continue
            rows = np.concatenate([d.leaf(int(j)) for j in b[lo:hi][nodes][what]])
            scores, own = products(q_points[mine[who]], points[rows]), ids[rows]
            scored += scores.size
            for i, s in zip(mine[who].tolist(), scores, strict=True):
                other = own != q_ids[i]
                best.offer(i, s[other], own[other])
    return scored


def quantise(embedding: Column | str, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as double; null where the vector or a component is null or not finite."""
    e = F.col(embedding) if isinstance(embedding, str) else embedding
    e = e.cast("array<double>")
    usable = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(usable & (F.size(e) > 0), F.transform(e, lambda x: F.floor(x * scale).cast("long")))


def _blocks(rows: DataFrame) -> DataFrame:
    """(dim, ids, vectors) of up to BLOCK rows of one task, packed as 64-bit integers. rows: id bigint, v array<bigint>."""

    def run(batches):
        held: dict[int, tuple[list[int], list[np.ndarray]]] = {}

        def emit(dim):
            ids, parts = held.pop(dim)
            return pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["dim", "ids", "vectors"])

        for batch in batches:
            v = batch.column(1)
            offsets, flat = v.offsets.to_numpy(), v.values.to_numpy(zero_copy_only=False)
            for x, lo, hi in zip(batch.column(0).to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids, parts = held.setdefault(hi - lo, ([], []))
                ids.append(x)
                parts.append(flat[lo:hi])
                if len(ids) == BLOCK:
                    yield emit(hi - lo)
        for dim in list(held):
            yield emit(dim)

    return rows.mapInArrow(run, "dim int, ids binary, vectors binary")


def unpack(ids: bytes, vectors: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(ids, np.int64), np.frombuffer(vectors, np.int64).reshape(-1, dim)


def top_k(data: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "v") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest inner products over data, ties to the smaller id.

    Vectors are arrays of integers; null vectors or keys take no part, and a query meets data of its own length
    only. Data rows with the query's id are its own and left out. Query ids repeated are one query (of their vectors
    the smallest); data rows repeated are as many candidates. Fewer than k candidates give fewer rows, none no row.
    """
    spark = data.sparkSession
    pick = lambda df: df.filter(F.col(key).isNotNull() & F.col(vector).isNotNull() & (F.size(vector) > 0)).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<bigint>").alias("v"))
    blocks = materialise(_blocks(pick(data)), "blocks")
    asked = pick(queries).groupBy("id").agg(F.min("v").alias("v"))
    asked = materialise(asked, "queries")
    size = asked.agg(F.sum(F.size("v") * 8)).first()[0] or 0
    passes = max(1, -(-2 * size // QUERY_BYTES))
    out = None
    for turn in range(passes if size else 0):
        part = asked if passes == 1 else asked.filter(F.pmod(F.xxhash64("id"), F.lit(passes)) == turn)
        for dim in sorted(r["dim"] for r in part.select(F.size("v").alias("dim")).distinct().collect()):
            got = part.filter(F.size("v") == dim).orderBy("id").toPandas()
            q_ids, q_points = got["id"].to_numpy(np.int64), np.stack(got["v"].to_numpy()).astype(np.int64)
            ours = blocks.filter(F.col("dim") == dim)
            found = _pass(spark, ours, dim, q_ids, q_points, k)
            out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id", "turn")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _pass(spark, blocks: DataFrame, dim: int, q_ids: np.ndarray, q_points: np.ndarray, k: int) -> DataFrame:
    """The k best rows of each task for each query of one broadcast block."""
    first = blocks.select("ids", "vectors").limit(1).collect()
    best = Best(len(q_ids), k)
    for row in first:  # at least this score is reached by k rows of the whole data
        ids, points = unpack(bytes(row["ids"])[: 8 * PILOT], bytes(row["vectors"])[: 8 * dim * PILOT], dim)
        walk(Tree(q_points), q_points, q_ids, Tree(points), points, ids, best)
    shared = spark.sparkContext.broadcast((q_ids, q_points, best.kth))

    def run(batches):
        from pyspark import TaskContext

        q_ids, q_points, floor = shared.value
        tree, best = Tree(q_points), Best(len(q_ids), k, floor)
        for batch in batches:
            for i, v in zip(batch.column(0), batch.column(1), strict=True):
                ids, points = unpack(i.as_buffer(), v.as_buffer(), dim)
                walk(tree, q_points, q_ids, Tree(points), points, ids, best)
        n = [len(x) for x in best.ids]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(q_ids, n)), pa.array(np.concatenate([*best.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*best.scores, np.zeros(0, np.int64)])), pa.array(np.full(sum(n), TaskContext.get().partitionId(), np.int32))], names=["query_id", "vec_id", "score", "turn"])

    return blocks.select("ids", "vectors").mapInArrow(run, "query_id bigint, vec_id bigint, score bigint, turn int")
