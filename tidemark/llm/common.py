"""Helpers shared by the training-data operators: scratch tables, hot-group joins, streaming Arrow maps."""

from __future__ import annotations

import atexit
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

#: ASCII white space, the class every contract of this package uses.
SPACE = r"[\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset (tests, a single machine) a local folder is made and set instead.
    """
    if spark.conf.get(BATCH_BYTES, None) is None:  # whole texts are long: bound a batch by its bytes, not its rows alone
        spark.conf.set(BATCH_BYTES, str(4 << 20))
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = getattr(scratch_root, "own", None)
        if not root:
            root = scratch_root.own = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/tidemark-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    root = scratch_root(spark)
    _to_drop[root] = spark
    return f"{root}/{name}-{uuid.uuid4().hex[:12]}"


_to_drop: dict[str, SparkSession] = {}


def release() -> None:
    """Delete the scratch tables of this application; results still to be computed from them are lost."""
    for root, spark in list(_to_drop.items()):
        del _to_drop[root]
        try:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        except Exception:  # the session has ended already; the folder is the cluster's to clean
            if root.startswith("file:") and os.path.isdir(root[7:]):
                import shutil

                shutil.rmtree(root[7:], ignore_errors=True)


atexit.register(release)


def materialise(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: lineage ends there, and any executor can reread it."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_slices(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """(from, to) of slices of a column of strings with about so many bytes each, or one longer text."""
    column = column.cast(pa.large_string())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1]
    lo = 0
    while lo < len(column):
        before = ends[lo - 1] if lo else np.frombuffer(column.buffers()[1], np.int64)[column.offset]
        hi = max(lo + 1, int(np.searchsorted(ends, before + most, "right")))
        yield lo, hi
        lo = hi


def normalised(text: Column | str) -> Column:
    """Runs of ASCII white space become one space; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(c, F.lit("")), SPACE, " ")


def crc_mod(key: str, mod: int) -> Column:
    """crc32 of the key as text, modulo mod; null keys count as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % mod


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: str, n_rows: int, how: str = "inner") -> DataFrame:
    """rows joined with one row per key of groups, whatever the skew of the keys.

    Groups of at least max(1000, n_rows / 5000) rows are hot; as sizes add up to n_rows at most, there are
    5000 hot groups or fewer, so they are broadcast and their rows stay where they are. The others shuffle
    by key, each key with few rows.
    """
    least = max(1000, n_rows // 5000)
    hot = F.broadcast(groups.filter(F.col(size) >= least))
    cold = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(groups.filter(F.col(size) < least), key, how)
    return rows.join(hot, key, "inner").unionByName(cold)


def fresh(taken: list[str], name: str) -> str:
    """name, lengthened until no column is called so (Spark's names ignore case)."""
    have = {c.lower() for c in taken}
    while name.lower() in have:
        name = "_" + name
    return name


_resident: dict = {}


def resident(key, make):
    """The one large model this worker process keeps; another takes its place. Workers outlive tasks and stages."""
    if key not in _resident:
        _resident.clear()
        _resident[key] = make()
    return _resident[key]


def let_go() -> None:
    """Give back what this worker process holds, for an idle worker lives on beside the next stage's tasks."""
    _resident.clear()
    trim()


def trim() -> None:
    """Give freed memory back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not this C library
        pass


def settle(spark: SparkSession) -> None:
    """Let the driver give up what past jobs leave: broadcasts and shuffle files of plans that are gone, freed memory."""
    gc.collect()
    trim()
    spark.sparkContext._jvm.System.gc()


def tidy(fn):
    """fn for mapInArrow, giving back at a task's end what its worker holds."""

    def run(batches):
        yield from fn(batches)
        let_go()

    return run
