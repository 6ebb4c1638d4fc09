"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Documents of a source fall into blocks by a keyed hash, and a source's blocks are permuted by another. Each
source's target gives whole passes over it and the quota of blocks of a further, partial pass. Blocks wholly
taken are the quota; the block where the target falls is taken document by document, in permuted order, each
that still fits, so that a source misses its target by less than its smallest document left out of that block.

The output shards share the quota of each pass (all blocks in a whole pass, the blocks it takes in the partial
one) through a binary tree: at each node a multivariate-hypergeometric draw splits the blocks of all sources
between the left and the right shards, so each shard's mixture is that of one random draw without replacement.
A shard then takes the next blocks of each source's permutation, disjoint from those of the others, and shuffles
locally. A document is taken as often as shards draw it. All draws are keyed by the seed: reruns agree. Blocks
are the unit: a source with fewer blocks in its quota than there are shards is missing from some of them.

The driver holds the sources' sizes and quotas only (one row a source, at most MAX_SOURCES). All sources together
have MAX_BLOCKS blocks at most, which bounds the table of blocks that is broadcast; blocks grow instead.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, materialise

WEIGHTS, SHARE, REPEATS = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK_DOCS, MAX_BLOCKS, MAX_SOURCES, FEW = 64, 65536, 65536, 200_000


def word_count(text: Column) -> Column:
    # the starts of words: after one leading space, every run of white space that something follows begins one
    squeezed = F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit(""))), SPACE, " ")
    return (F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit(" "), F.lit(""))) - F.when(F.endswith(squeezed, F.lit(" ")), 1).otherwise(0)).cast("long")


def targets(sizes: list[int], weights: list[float], share: float = SHARE, repeats: float = REPEATS) -> list[float]:
    """share times the sum of sizes, dealt by weight; what is above repeats times a source's size goes to the others."""
    size, w = np.asarray(sizes, np.float64), np.asarray(weights, np.float64)
    out, left, open_ = np.zeros(len(size)), share * size.sum(), np.ones(len(size), bool)
    cap = repeats * size
    while open_.any():
        give = np.zeros(len(size))
        give[open_] = left * w[open_] / w[open_].sum()
        over = open_ & (give > cap)
        if not over.any():
            out[open_] = give[open_]
            break
        out[over] = cap[over]
        left = max(0.0, left - cap[over].sum())
        open_ &= ~over
    return out.tolist()


def split_tree(quotas: np.ndarray, n_shards: int, rng: np.random.Generator) -> np.ndarray:
    """(shards, sources): each source's blocks split over the shards; rows sum to equal shares, columns to quotas."""
    out = np.zeros((n_shards, len(quotas)), np.int64)

    def split(q: np.ndarray, lo: int, hi: int) -> None:
        if hi - lo == 1:
            out[lo] = q
            return
        mid = (lo + hi) // 2
        want = int(q.sum()) * (mid - lo) // (hi - lo)
        left, rest, room = np.zeros(len(q), np.int64), int(q.sum()), want
        for s, n in enumerate(q.tolist()):
            rest -= n
            # numpy's sampler takes populations below 10**9; larger ones are split by their mean, whose error is relatively tiny
            left[s] = rng.hypergeometric(n, rest, room) if 0 < room and n + rest < 10**9 else min(n, round(room * n / max(1, n + rest)))
            room -= int(left[s])
        split(left, lo, mid)
        split(q - left, mid, hi)

    split(np.asarray(quotas, np.int64), 0, n_shards)
    return out


def pass_quotas(passes: list[int], n_blocks: list[int], n_partial: list[int], repeats: int) -> np.ndarray:
    """(repeats, sources): how many blocks each pass takes, which are the first of the source's permutation."""
    whole, n, part = (np.asarray(a, np.int64) for a in (passes, n_blocks, n_partial))
    return np.stack([np.where(p < whole, n, np.where(p == whole, part, 0)) for p in range(repeats)])


def _held(blocks: DataFrame, sources: list) -> tuple[list[int], list[int]]:
    """By source the number of blocks that hold documents, and of those that the partial pass takes, the edge block among them."""
    took = F.sum(F.when(F.col("whole") | F.col("edge"), 1).otherwise(0))
    got = {r["src"]: (r["n"], r["took"]) for r in blocks.groupBy("src").agg(F.count("*").alias("n"), took.alias("took")).collect()}
    return [got[s][0] for s in sources], [got[s][1] for s in sources]


def _draw(docs: DataFrame, text: str, key: str, source: str, weights: tuple[float, ...], share: float, repeats: float, n_shards: int, seed: int):
    """The narrow rows (key, src, size), and a function that adds what the mixture decides to any frame that has them.

    It meets broadcast tables only (sources, blocks, and the documents of boundary blocks up to FEW), so that whole
    documents are decided where they lie.
    """
    if not 0 < repeats <= 2 or repeats != int(repeats):
        raise ValueError("repeats is 1 or 2")
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("src"), word_count(F.col(text)).alias("size"))
    rows = materialise(rows, "sizes")
    by_source = rows.groupBy("src").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    got = by_source.limit(MAX_SOURCES + 1).collect()
    if len(got) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    got.sort(key=lambda r: (r["src"] is None, (r["src"] or "").encode()))
    goal = targets([r["source_size"] for r in got], [weights[i % len(weights)] for i in range(len(got))], share, repeats)
    spark, most = docs.sparkSession, MAX_BLOCKS // max(1, len(got))  # all sources together have MAX_BLOCKS blocks at most
    facts = [(r["src"], r["source_size"], t, int(min(most, max(1, r["n"] // BLOCK_DOCS))), int(min(repeats, t // r["source_size"])) if r["source_size"] else 0) for r, t in zip(got, goal, strict=True)]
    schema = f"src {docs.schema[source].dataType.simpleString()}, source_size bigint, target double, n_blocks int, passes int"
    sources = spark.createDataFrame(facts, schema)
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    src = sources.select(F.col("src").alias("src_"), "source_size", "target", "n_blocks", "passes", (F.col("target") - F.col("passes") * F.col("source_size")).alias("rest"))
    sizes = rows
    rows = rows.join(F.broadcast(src), same("src", "src_")).drop("src_")
    rows = rows.withColumn("block", F.pmod(F.shiftrightunsigned(F.xxhash64(F.lit(seed), "key", "size"), 20), F.col("n_blocks")).cast("int"))
    blocks = rows.groupBy("src", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    order = Window.partitionBy("src").orderBy(F.xxhash64(F.lit(seed + 1), "block"), "block")
    blocks = blocks.withColumn("turn", F.row_number().over(order)).withColumn("upto", F.sum("block_size").over(order))
    blocks = blocks.withColumn("left", F.col("rest") - (F.col("upto") - F.col("block_size")))  # of the partial pass, at this block
    blocks = materialise(blocks.select("src", "block", "turn", "left", (F.col("left") >= F.col("block_size")).alias("whole"), ((F.col("left") > 0) & (F.col("left") < F.col("block_size"))).alias("edge")), "blocks")
    # the boundary blocks, one a source at most, document by document
    b = F.broadcast(blocks.select(F.col("src").alias("src_"), F.col("block").alias("block_"), "turn", "left", "whole", "edge"))

    def placed(rows: DataFrame) -> DataFrame:
        rows = rows.join(F.broadcast(src), same("src", "src_")).drop("src_").withColumn("place", F.xxhash64(F.lit(seed), "key", "size"))
        rows = rows.withColumn("block", F.pmod(F.shiftrightunsigned("place", 20), F.col("n_blocks")).cast("int"))
        return rows.join(b, same("src", "src_") & (F.col("block") == F.col("block_"))).drop("src_", "block_")

    narrow, rows = sizes, placed(sizes)
    edge = rows.filter("edge").groupBy("src", "key", "size", "place", "left").agg(F.count("*").alias("n"))

    def take(table):
        place, keys = table.column("place").to_pylist(), table.column("key").to_pylist()
        order = sorted(range(len(keys)), key=lambda i: (place[i], keys[i] is None, keys[i] if keys[i] is not None else 0))
        left, fits = float(table.column("left")[0].as_py()), [False] * len(keys)
        size, n = table.column("size").to_pylist(), table.column("n").to_pylist()
        for i in order:
            fits[i] = size[i] * n[i] <= left
            left -= size[i] * n[i] if fits[i] else 0
        return pa.table({"key": table.column("key"), "place": table.column("place"), "fits": pa.array(fits, pa.bool_())})

    key_type = docs.schema[key].dataType.simpleString()
    fits = edge.groupBy("src").applyInArrow(take, f"key {key_type}, place bigint, fits boolean").filter("fits").select(F.col("key").alias("key_"), F.col("place").alias("place_"), "fits").distinct()
    fits = materialise(fits, "fits")
    few = fits.count() <= FEW
    # output shards: each pass deals the blocks that it takes of each source, in permuted order, by its own tree
    rng = np.random.default_rng(seed)
    quotas = pass_quotas([f[4] for f in facts], *_held(blocks, [f[0] for f in facts]), int(repeats))
    ends = [np.cumsum(split_tree(q, n_shards, rng), axis=0) if len(facts) else np.zeros((n_shards, 0), np.int64) for q in quotas]
    dealt = spark.createDataFrame([(f[0], [[int(x) for x in e[:, i]] for e in ends]) for i, f in enumerate(facts)], f"src {docs.schema[source].dataType.simpleString()}, ends array<array<bigint>>")
    dealt = F.broadcast(dealt.select(F.col("src").alias("src_"), "ends"))
    drawn = lambda e, i: (F.col("turn") <= F.element_at(e, -1)) & (~F.col("edge") | (i != F.col("passes")) | F.col("fits"))
    shard = lambda e, i: F.when(drawn(e, i), F.size(F.filter(e, lambda x: x < F.col("turn"))))

    def decide(rows: DataFrame) -> DataFrame:
        rows = placed(rows)
        this = same("key", "key_") & (F.col("place") == F.col("place_"))
        if few:
            rows = rows.join(F.broadcast(fits), F.col("edge") & this, "left")
        else:  # only the documents of boundary blocks meet them
            rows = rows.filter("not edge").withColumn("fits", F.lit(False)).unionByName(rows.filter("edge").join(fits, this, "left").drop("key_", "place_"))
        rows = rows.withColumn("fits", F.coalesce("fits", F.lit(False))).join(dealt, same("src", "src_"))
        rows = rows.withColumn("shards", F.filter(F.transform("ends", shard), lambda x: x.isNotNull()))
        return rows.withColumn("copies", F.size("shards"))

    return narrow, decide


def plan(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, n_shards: int = 16, seed: int = 42) -> DataFrame:
    """One row per row of docs: key, size, source, source_size, target, copies, taken, shards (array, the shard of each copy).

    Sources are taken in order of code point, null last, with the weights repeating. A null or empty text has
    size 0 and is taken as its block is. Rows repeated with the same key and text are decided alike, so that both
    are taken or neither is. An empty table gives no rows. No document is taken more than `repeats` (at most 2) times.
    """
    narrow, decide = _draw(docs, text, key, source, weights, share, repeats, n_shards, seed)
    return decide(narrow).select(F.col("key").alias(key), "size", F.col("src").alias(source), "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "shards", "place")


def mix(docs: DataFrame, text: str = "text", key: str = "doc_id", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, repeats: float = REPEATS, n_shards: int = 16, seed: int = 42, shard_out: str | None = None) -> DataFrame:
    """The mixture itself: each row of docs as often as the plan takes it, columns as they were.

    Nulls, ties, repeated rows and empty tables as in plan(). With shard_out the rows carry their output shard (a
    column of that name gives way) and come partitioned by it and shuffled within it; the only shuffle of whole
    documents is that one.
    """
    _, decide = _draw(docs, text, key, source, weights, share, repeats, n_shards, seed)
    columns = [c for c in docs.columns if not shard_out or c.lower() != shard_out.lower()]
    rows = docs.select(F.col(key).alias("key"), F.col(source).alias("src"), word_count(F.col(text)).alias("size"), F.struct(*columns).alias("doc"))
    rows = decide(rows).select("doc", "place", F.explode("shards").alias("shard"))
    if not shard_out:
        return rows.select("doc.*")
    rows = rows.repartition(F.col("shard"), F.pmod(F.col("place"), F.lit(8))).sortWithinPartitions("shard", F.xxhash64(F.lit(seed + 2), "place", "shard"))
    return rows.select("doc.*", F.col("shard").alias(shard_out))
