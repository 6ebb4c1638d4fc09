"""Exact dedup by two-pass Bloom filtering.

Pass one folds a 64-bit hash of every normalised text into a saturating two-bit Bloom filter: a bit of the
second plane is set once two rows have set the same bit of the first. Pass two tests every row against the
second plane. A row that fails the test certainly stands alone and goes straight through; only the rest, the
rows of real groups and a few false alarms, shuffle by their SHA-256 for the exact decision.

The filter is cut into segments of 8 KB, as many as the rows need. A hash picks one segment, and all of its bits lie
there. Tasks send compressed segments, at most ``max_filter_bytes`` of them at a time, which are merged by segment. A
filter of up to ``max_filter_bytes`` is broadcast. A larger one stays where it was merged, and the rows to be tested,
narrow fingerprints in dedup, go to their segment; a segment that a hot hash fills is copied to several places, over
which its rows are spread.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, join_groups, materialise, normalised, tidy

SEGMENT_BITS = 1 << 16
N_HASHES = 4
MAX_FILTER_BYTES = 64 << 20
BITS_A_ROW = 12
SLICE = 1 << 16


def fingerprint(text: Column | str) -> Column:
    """SHA-256 (32 bytes) of the text with white space normalised; null counts as empty."""
    return F.unhex(F.sha2(normalised(text), 256))


def _segment(h: Column, n_segments: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 40), F.lit(n_segments)).cast("int")


def _bit(h: Column, i: int) -> Column:
    """The i-th bit of a hash in its segment: a pair of 16-bit parts, combined (double hashing)."""
    a, b = h.bitwiseAND(0xFFFF), F.shiftright(h, 16).bitwiseAND(0xFFFF).bitwiseOR(1)
    return (a + b * i).bitwiseAND(SEGMENT_BITS - 1)


def _bits(h: np.ndarray) -> np.ndarray:
    a, b = h & 0xFFFF, (h >> 16) & 0xFFFF | 1
    return np.stack([(a + b * i) & (SEGMENT_BITS - 1) for i in range(N_HASHES)])


class _Planes:
    """Both planes of the segments seen by one task."""

    def __init__(self) -> None:
        self.once: dict[int, np.ndarray] = {}
        self.twice: dict[int, np.ndarray] = {}
        self.n: dict[int, int] = {}

    def _get(self, seg: int) -> tuple[np.ndarray, np.ndarray]:
        if seg not in self.once:
            self.once[seg] = np.zeros(SEGMENT_BITS // 8, np.uint8)
            self.twice[seg] = np.zeros(SEGMENT_BITS // 8, np.uint8)
            self.n[seg] = 0
        return self.once[seg], self.twice[seg]

    def add(self, h: np.ndarray, n_segments: int) -> None:
        seg = (h.view(np.uint64) >> np.uint64(40)).astype(np.int64) % n_segments
        at, n = np.unique((seg * SEGMENT_BITS + _bits(h)).ravel(), return_counts=True)
        for s in np.unique(at // SEGMENT_BITS):
            lo, hi = np.searchsorted(at, [s * SEGMENT_BITS, (s + 1) * SEGMENT_BITS])
            bit, many = at[lo:hi] - s * SEGMENT_BITS, n[lo:hi] > 1
            new, again = np.zeros(SEGMENT_BITS, np.uint8), np.zeros(SEGMENT_BITS, np.uint8)
            new[bit] = 1
            again[bit[many]] = 1
            self.merge(int(s), np.packbits(new, bitorder="little"), np.packbits(again, bitorder="little"), int(n[lo:hi].sum()) // N_HASHES)

    def merge(self, seg: int, once: np.ndarray, twice: np.ndarray, n: int) -> None:
        a, b = self._get(seg)
        self.n[seg] += n
        b |= twice | (a & once)
        a |= once

    def parts(self):
        for s in self.once:
            yield s, self.once[s], self.twice[s], self.n[s]


class _Flat:
    """Both planes of a filter small enough to be held whole, as arrays of bytes."""

    def __init__(self, n_segments: int) -> None:
        self.once, self.twice = (np.zeros(n_segments * SEGMENT_BITS // 8, np.uint8) for _ in range(2))
        self.n = np.zeros(n_segments, np.int64)

    def add(self, h: np.ndarray, n_segments: int) -> None:
        seg = ((h.view(np.uint64) >> np.uint64(40)) % np.uint64(n_segments)).astype(np.int64)
        self.n += np.bincount(seg, minlength=n_segments)
        at, n = np.unique((seg * SEGMENT_BITS + _bits(h)).ravel(), return_counts=True)
        byte, bit = at >> 3, np.left_shift(1, at & 7).astype(np.uint8)
        again = (n > 1) | (self.once[byte] & bit > 0)
        np.bitwise_or.at(self.twice, byte[again], bit[again])
        np.bitwise_or.at(self.once, byte, bit)

    def parts(self):
        size = SEGMENT_BITS // 8
        for s in np.flatnonzero(self.n).tolist():
            yield s, self.once[s * size : (s + 1) * size], self.twice[s * size : (s + 1) * size], int(self.n[s])


def _fold(n_segments: int, max_filter_bytes: int):
    def fold(batches):
        whole = n_segments * SEGMENT_BITS // 8 <= max_filter_bytes
        planes = _Flat(n_segments) if whole else _Planes()

        def send():
            for s, once, twice, n in planes.parts():
                yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()), "once": pa.array([zlib.compress(once.tobytes(), 1)], pa.binary()), "twice": pa.array([zlib.compress(twice.tobytes(), 1)], pa.binary()), "n": pa.array([n], pa.int64())})

        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for lo in range(0, len(h), SLICE):  # bounds the arrays that are sorted
                planes.add(h[lo : lo + SLICE], n_segments)
                if not whole and len(planes.once) * SEGMENT_BITS // 8 > max_filter_bytes:
                    yield from send()
                    planes = _Planes()
        yield from send()

    return fold


def _merge(batches):
    planes = _Planes()
    for batch in batches:
        for s, a, b, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            planes.merge(s, np.frombuffer(zlib.decompress(a), np.uint8), np.frombuffer(zlib.decompress(b), np.uint8), n)
    for s, b in planes.twice.items():
        if b.any():
            yield pa.RecordBatch.from_pydict({"seg": pa.array([s], pa.int32()), "words": pa.array([b.view(np.int64)], pa.list_(pa.int64())), "n": pa.array([planes.n[s]], pa.int64())})


def repeated_bits(hashes: DataFrame, n_rows: int, max_filter_bytes: int = MAX_FILTER_BYTES) -> tuple[DataFrame, int]:
    """The second plane of the filter over a one-column frame of 64-bit hashes: (seg, words, n: its rows), and the
    number of segments."""
    n_segments = max(1, math.ceil(n_rows * BITS_A_ROW / SEGMENT_BITS))
    parts = hashes.mapInArrow(tidy(_fold(n_segments, max_filter_bytes)), "seg int, once binary, twice binary, n bigint")
    merged = parts.repartition(max(min(64, n_segments), math.ceil(n_segments / 1024)), "seg").mapInArrow(tidy(_merge), "seg int, words array<bigint>, n bigint")
    return materialise(merged, "bloom"), n_segments


def flag_repeats(rows: DataFrame, hash_col: str, bits: DataFrame, n_segments: int, flag: str, max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """rows with a boolean column: false only where the hash occurs once."""
    seg, words, copy = fresh(rows.columns, "seg"), fresh(rows.columns, "words"), fresh(rows.columns, "copy")
    h = F.col(hash_col)
    hit = F.lit(True)
    for i in range(N_HASHES):
        bit = _bit(h, i)
        hit = hit & (F.getbit(F.get(F.col(words), F.shiftright(bit, 6).cast("int")), bit.bitwiseAND(63).cast("int")) == 1)
    out = rows.withColumn(seg, _segment(h, n_segments))
    if n_segments * SEGMENT_BITS // 8 <= max_filter_bytes:
        out = out.join(F.broadcast(bits.select(F.col("seg").alias(seg), F.col("words").alias(words))), seg, "left")
    else:
        usual = SEGMENT_BITS // BITS_A_ROW
        copies = F.when(F.col("n") < 16 * usual, 1).otherwise(F.ceil(F.col("n") / (4 * usual))).cast("int")
        spread = bits.select(F.col("seg").alias(seg), F.col("words").alias(words), F.explode(F.sequence(F.lit(0), copies - 1)).alias(copy))
        # segments of 16 times their usual rows, at most one for each 90 000 rows
        hot = F.broadcast(bits.select(F.col("seg").alias(seg), copies.alias(copy)).filter(F.col(copy) > 1))
        salt = F.xxhash64(*[f.name for f in rows.schema.fields if "map<" not in f.dataType.simpleString()])
        out = out.join(hot, seg, "left").withColumn(copy, F.pmod(salt, F.coalesce(F.col(copy), F.lit(1))).cast("int"))
        out = out.join(spread.hint("merge"), [seg, copy], "left")
    return out.withColumn(flag, F.coalesce(hit, F.lit(False))).drop(seg, words, copy)


def _prepare(docs: DataFrame, text: str, key: str, max_filter_bytes: int):
    prints = materialise(docs.select(F.col(key).alias("key"), fingerprint(text).alias("sha")), "fingerprints").withColumn("h", F.xxhash64("sha"))
    n_rows = prints.count()
    bits, n_segments = repeated_bits(prints.select("h"), n_rows, max_filter_bytes)
    flagged = flag_repeats(prints, "h", bits, n_segments, "maybe", max_filter_bytes).drop("h")
    suspects = flagged.filter("maybe").drop("maybe")
    groups = suspects.groupBy("sha", "key").agg(F.count("*").alias("n")).groupBy("sha").agg(F.min("key").alias("keep"), F.sum("n").alias("size"), F.max(F.when(F.col("n") > 1, F.struct("key", "n")).isNotNull()).alias("tied"))
    return flagged, materialise(groups, "groups"), bits, n_segments, n_rows


def decisions(docs: DataFrame, text: str = "text", key: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One row per row of docs: key, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after replacing each run of ASCII white space by one space; a null text
    counts as empty. Of equal texts the row with the smallest key stays; null keys come last. Rows repeated
    with the same key and text are one group of which exactly one row is kept. An empty table gives no rows.
    Other columns play no part.
    """
    flagged, groups, _, _, n_rows = _prepare(docs, text, key, max_filter_bytes)
    alone = flagged.filter(~F.col("maybe")).select("key", F.col("key").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "sha")
    met = join_groups(flagged.filter("maybe").drop("maybe"), groups, "sha", "size", n_rows)
    met = met.withColumn("kept", F.col("key").eqNullSafe(F.col("keep")))
    ties = met.filter(F.col("kept") & F.col("tied"))
    ties = ties.withColumn("kept", F.row_number().over(Window.partitionBy("sha").orderBy("key")) == 1)
    met = met.filter(~(F.col("kept") & F.col("tied"))).unionByName(ties)
    out = alone.unionByName(met.select("key", F.col("keep").alias("keep_id"), F.col("size").alias("group_size"), "kept", "sha"))
    return out.select(F.col("key").alias(key), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


def distinct_texts(texts: DataFrame, text: str = "text", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """One text of each group that is equal with white space normalised: those alone by the filter stay in place, one
    text of each other group is written to the shared folder."""
    rows = texts.select(F.col(text).alias("text")).withColumn("h", F.xxhash64(fingerprint("text")))
    hashes = materialise(rows.select("h"), "hashes")
    bits, n_segments = repeated_bits(hashes, hashes.count(), max_filter_bytes)
    flagged = flag_repeats(rows, "h", bits, n_segments, "maybe", max_filter_bytes)
    # a hot group is one row a task after the map side's aggregation
    once = flagged.filter("maybe").groupBy(fingerprint("text").alias("sha")).agg(F.min("text").alias("text"))
    return flagged.filter("not maybe").select(F.col("text").alias(text)).unionByName(materialise(once.select(F.col("text").alias(text)), "texts"))


def drop_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", max_filter_bytes: int = MAX_FILTER_BYTES) -> DataFrame:
    """The rows of docs that stay, all columns as they were. Rows alone by the filter pass without a shuffle.

    Nulls, empty texts, ties and empty tables as in decisions().
    """
    _, groups, bits, n_segments, n_rows = _prepare(docs, text, key, max_filter_bytes)
    sha, h, maybe = (fresh(docs.columns, c) for c in ("sha_", "h_", "maybe_"))
    rows = docs.withColumn(sha, fingerprint(text))
    rows = flag_repeats(rows.withColumn(h, F.xxhash64(sha)), h, bits, n_segments, maybe, max_filter_bytes).drop(h)
    keep, size, tied = (fresh([*docs.columns, sha, maybe], c) for c in ("keep_", "size_", "tied_"))
    groups = groups.select(F.col("sha").alias(sha), F.col("keep").alias(keep), F.col("size").alias(size), F.col("tied").alias(tied))
    met = join_groups(rows.filter(F.col(maybe)), groups, sha, size, n_rows).filter(F.col(key).eqNullSafe(F.col(keep)))
    ties = met.filter(F.col(tied)).dropDuplicates([sha])
    kept = met.filter(~F.col(tied)).unionByName(ties)
    return rows.filter(~F.col(maybe)).select(*docs.columns).unionByName(kept.select(*docs.columns))
