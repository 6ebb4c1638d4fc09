"""Exact n-gram Jaccard join by grouped prefix filtering, and its connected components.

A document's set holds the distinct shingles of WORDS words, as 64-bit hashes. Two sets can reach the threshold t
only if they share one of their first n - ceil(t n) + 1 shingles in any one global order; the order here is by
rising frequency, read off a hashed table of TABLE counts over all documents, then by hash.

1. Documents with equal sets collapse into one representative (a Bloom filter lets sets that stand alone pass
   without a shuffle).
2. Representatives with an identical prefix and size collapse into a group, which is indexed once per prefix
   shingle, its members riding along in chunks of CHUNK. Entries travel packed to the place of their shingle, once, where those
   that only one group has are dropped.
3. The groups of a shared shingle are filtered by size: they fall into lists of one class of sizes, which hold the
   class below as well, as 1 / t is the width of a class. Of two sets the smaller one needs the shingle in its first
   n - ceil(2 t n / (1 + t)) + 1. The groups are then expanded, and their members compared by parity bitmaps: the Hamming distance of two bitmaps never exceeds the sets' symmetric difference, so no link is lost.
   The members are walked breadth first, and only the edges of a spanning forest become candidates, so a list of
   m members gives m - 1 rows and not m squared. Long lists are cut into blocks and compared pair of blocks by pair.
4. Candidates are verified on the whole sets, star by star: each text travels packed, to the hub it is compared
   with. A list whose candidates all hold is settled, for its forest joined whatever its filters let through. The
   members of the others come together once more with their texts, in parts of SETS shingles at most, and are walked
   along links alone. So pairs that pass the bitmaps and don't link, whose number may grow with the square of a
   group, make no rows, and no link is lost.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialise, settle, tidy
from .components import components
from .exact_dedup import flag_repeats, repeated_bits

TABLE_BITS, CHUNK, LIST_BLOCK, STAR, MAX_BITS = 20, 64, 2048, 64, 1 << 16
#: Shingles of the whole sets that a task compares at a time, 8 bytes each.
SETS = 1 << 20
#: Entries that are packed, and held, at a time.
DEAL = 1 << 20
NULL_KEY = -(1 << 63)

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True
_VALUE = np.where(_BLANK, 0, _LOWER.astype(np.uint64) + 1).astype(np.uint64)


class _Powers:
    """Powers of the hash's base and of its inverse modulo 2**64, as many as the longest text has needed."""

    def __init__(self) -> None:
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up))
            grow = lambda base: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, base, np.uint64), dtype=np.uint64)])
            self.up, self.down = grow(_BASE), grow(_INVERSE)
        return self.up[:n], self.down


_powers = _Powers()


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(data: np.ndarray, words: int) -> np.ndarray:
    """The sorted distinct shingle hashes of a text given as its UTF-8 bytes."""
    blank = _BLANK[data]
    begins = ~blank
    begins[1:] &= blank[:-1]
    starts = np.flatnonzero(begins)
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(data))
    h = _mix(np.add.reduceat(_VALUE[data] * up, starts) * down[starts])
    n = min(words, len(h))
    acc = np.full(len(h) - n + 1, n, np.uint64)
    for i in range(n):
        acc = _mix(acc * _U(_BASE) + h[i : len(h) - n + 1 + i])
    return np.unique(acc)


def texts_of(column: pa.Array):
    """The UTF-8 bytes of each string of an Arrow column, without decoding; null gives none."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield data[a:b]


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def bitmap(s: np.ndarray) -> bytes:
    """Parity bitmap of a set: a power of two of bits, about as many as it has members, from 256 to MAX_BITS."""
    bits = 256
    while bits < len(s) and bits < MAX_BITS:
        bits *= 2
    return np.packbits((np.bincount((s & _U(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _widen(maps: list[bytes]) -> np.ndarray:
    """Bitmaps folded to the smallest width among them, as rows of 64-bit words. Folding keeps parities."""
    width = min(map(len, maps))
    out = np.empty((len(maps), width // 8), np.uint64)
    for i, m in enumerate(maps):
        x = np.frombuffer(m, np.uint64)
        out[i] = x if len(m) == width else np.bitwise_xor.reduce(x.reshape(-1, width // 8), axis=0)
    return out


def frequencies(docs: DataFrame, words: int) -> np.ndarray:
    """For each slot of the hashed table, the logarithm of its count over all documents, in 256 steps.

    Tasks send their counts in chunks, which are added up by chunk in one pass of bounded memory each.
    """
    size, chunk = 1 << TABLE_BITS, 1 << 14
    schema = "c int, n binary"

    def count(batches):
        total, held, n = np.zeros(size, np.int64), [], 0

        def settle():
            nonlocal held, n
            if held:
                np.add(total, np.bincount((np.concatenate(held) >> _U(64 - TABLE_BITS)).astype(np.int64), minlength=size), out=total)
            held, n = [], 0

        for batch in batches:
            for t in texts_of(batch.column(0)):
                held.append(shingles(t, words))
                n += len(held[-1])
                if n > 1 << 20:
                    settle()
        settle()
        for c in range(size // chunk):
            part = total[c * chunk : (c + 1) * chunk]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([part.astype(np.uint16 if part.max() < 1 << 16 else np.int64).tobytes()], pa.binary())], names=["c", "n"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint16 if len(x) == 2 * chunk else np.int64).astype(np.int64)
                held[c] = held[c] + x if c in held else x
        for c, x in held.items():
            steps = np.minimum(255, np.floor(8 * np.log2(1 + x))).astype(np.uint8)  # 32 doublings of eight steps
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([steps.tobytes()], pa.binary())], names=["c", "n"])

    out = np.zeros(size, np.uint8)
    for r in docs.mapInArrow(tidy(count), schema).repartition(size // chunk, "c").mapInArrow(tidy(add), schema).collect():
        out[r["c"] * chunk : (r["c"] + 1) * chunk] = np.frombuffer(bytes(r["n"]), np.uint8)
    return out


def _signatures(docs: DataFrame, words: int, num: int, den: int) -> DataFrame:
    """Per row (key, n, sig, prefix, bitmap); a scratch table. docs: text string, key bigint."""
    table = docs.sparkSession.sparkContext.broadcast(frequencies(docs.select("text"), words))

    def run(batches):
        rank = table.value
        for batch in _slices(batches, 1024):
            n, sig, prefix, maps = [], [], [], []
            for t in texts_of(batch.column(0)):
                s = shingles(t, words)
                n.append(len(s))
                sig.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if not len(s):
                    prefix.append(b"")
                    maps.append(b"")
                    continue
                p = prefix_length(len(s), num, den)
                common = rank[(s >> _U(64 - TABLE_BITS)).astype(np.int64)]
                order = np.argsort(common, kind="stable")[:p]  # s is sorted: ties go by hash
                prefix.append(s[order].tobytes())
                maps.append(bitmap(s))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.array(prefix, pa.binary()), pa.array(maps, pa.binary())], names=["key", "n", "sig", "prefix", "bitmap"])

    return materialise(docs.mapInArrow(tidy(run), "key bigint, n bigint, sig binary, prefix binary, bitmap binary"), "signatures")


def _representatives(rows: DataFrame, n_rows: int) -> tuple[DataFrame, DataFrame]:
    """(key, n, rep) of every row with a set, and the rows of the representatives: of equal sets the smallest key."""
    hashed = rows.filter("n > 0").withColumn("h", F.xxhash64("sig"))
    bits, n_segments = repeated_bits(hashed.select("h"), n_rows)
    flagged = flag_repeats(hashed, "h", bits, n_segments, "maybe").drop("h")
    suspects = flagged.filter("maybe").select("key", "n", "sig")
    groups = materialise(suspects.groupBy("sig").agg(F.min("key").alias("rep"), F.count("*").alias("size")), "equal")
    met = materialise(join_groups(suspects, groups, "sig", "size", n_rows).select("key", "n", "sig", "rep"), "members")
    members = flagged.filter("not maybe").select("key", "n", F.col("key").alias("rep")).unionByName(met.select("key", "n", "rep"))
    first = met.filter("key = rep").select("key", "sig").distinct()
    again = flagged.filter("maybe").join(first, ["key", "sig"], "left_semi").dropDuplicates(["key", "sig"])
    reps = flagged.filter("not maybe").drop("maybe").unionByName(again.drop("maybe"))
    return members, reps.select(F.col("key").alias("rep"), "n", "prefix", "bitmap")


def _groups(reps: DataFrame, n_rows: int) -> DataFrame:
    """(n, prefix, members array<struct<rep, bitmap>>, many): groups of an identical prefix and size, in chunks of CHUNK."""
    rows = reps.withColumn("h", F.xxhash64("prefix", "n"))
    bits, n_segments = repeated_bits(rows.select("h"), n_rows)
    flagged = flag_repeats(rows, "h", bits, n_segments, "maybe")
    member = F.struct("rep", "bitmap")
    alone = flagged.filter("not maybe").select("n", "prefix", F.array(member).alias("members"), F.lit(False).alias("many"))
    met = flagged.filter("maybe").drop("maybe")
    sizes = materialise(met.groupBy("h").agg(F.count("*").alias("size")), "group-sizes")
    met = join_groups(met, sizes, "h", "size", n_rows)
    met = met.withColumn("chunk", F.pmod(F.xxhash64("rep", "bitmap"), F.ceil(F.col("size") / CHUNK)))
    met = met.groupBy("h", "n", "prefix", "chunk").agg(F.collect_list(member).alias("members"), (F.max("size") > 1).alias("many"))
    return alone.unionByName(met.select("n", "prefix", "members", "many"))


def _slices(batches, rows: int = 256):
    """Record batches in slices of few rows, whose entries make up one batch each."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def size_class(n: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets whose sizes are within num / den of each other lie in one class or in neighbouring ones."""
    return n if num >= den else np.floor(np.log(n) / (np.log(den / num) * (1 + 1e-9))).astype(np.int64)


def _met(batches):
    """Of dealt entries, packed, those whose token comes up again in their place.

    Entries are held until DEAL of them are there. Then those of repeated tokens go out and their tokens are
    noted, so what stays is one entry a token at most, and a token in all groups takes no more room than another.
    """
    held, n, known = [], 0, np.zeros(0, np.int64)

    def settle(last: bool):
        nonlocal held, n, known
        token, g, flags = (np.concatenate([h[i] for h in held]) for i in range(3))
        seen, back, count = np.unique(token, return_inverse=True, return_counts=True)
        again = (count > 1) | np.isin(seen, known)
        if not last:
            known = np.union1d(known, seen[again])
        go = again[back]
        held = [(token[~go], g[~go], flags[~go])]
        n = len(held[0][0])
        return pa.RecordBatch.from_arrays([pa.array(token[go]), pa.array(g[go]), pa.array(flags[go] & 1 > 0), pa.array(flags[go] & 2 > 0)], names=["token", "g", "low", "short"])

    most = DEAL
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(1, 4)), strict=True):
            held.append(tuple(np.frombuffer(x, kind) for x, kind in zip(row, (np.int64, np.int64, np.uint8), strict=True)))
            n += len(held[-1][0])
            if n > most:
                yield settle(False)
                most = max(DEAL, 2 * n)
    if held:
        yield settle(True)


def _lists(groups: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(token, part, side, low, short, g): entries of the lists, one for a shingle and a size class, in which some pair
    may link; (g, n, members) of the groups.

    low: of the class below the list's, there to meet the list's own groups only. short: its shingle lies in the
    shorter prefix that the smaller one of two sets needs. Entries are narrow until the lists are known. Lists that
    hold the same entries give the same candidates, so one of them is kept; sameness is that of two independent
    64-bit parities and the count.
    """
    groups = groups.withColumn("g", F.xxhash64("prefix", "n", F.transform("members", lambda m: m["rep"])))
    groups = materialise(groups.withColumn("size", F.size("members")), "groups")

    def entries_of(part):
        prefixes, n = [np.frombuffer(p, np.uint64) for p in part.column(0).to_pylist()], part.column(1).to_numpy()
        lengths = np.array([len(p) for p in prefixes])
        at = np.repeat(np.arange(len(prefixes)), lengths)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        short = place < (n - -(-2 * num * n // (num + den)) + 1)[at]
        token, kind = np.concatenate(prefixes), size_class(n, num, den)[at]
        up = np.flatnonzero(short)  # these meet larger sets as well
        lists = np.concatenate([_mix(token * _U(_BASE) + kind.astype(np.uint64)), _mix(token[up] * _U(_BASE) + (kind[up] + 1).astype(np.uint64))])
        low = np.concatenate([np.zeros(len(at), bool), np.ones(len(up), bool)])
        return lists.view(np.int64), np.concatenate([at, at[up]]), low, np.concatenate([short, short[up]])

    def deal(batches):
        held, n = [], 0

        def send():
            token, g, flags = (np.concatenate([h[i] for h in held]) for i in range(3))
            held.clear()
            place = (token.view(np.uint64) >> _U(32)) % _U(n_deals)
            order = np.argsort(place, kind="stable")
            place, ends = np.unique(place[order], return_index=True)
            cut = [*ends.tolist(), len(order)]
            packed = [pa.array([x[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()) for x in (token[order], g[order], flags[order])]
            return pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64)), *packed], names=["deal", "token", "g", "flags"])

        for batch in batches:
            for part in _slices([batch]):
                token, at, low, short = entries_of(part)
                held.append((token, part.column(2).to_numpy()[at], low + 2 * short.astype(np.uint8)))
                n += len(token)
                if n > DEAL:
                    yield send()
                    n = 0
        if held:
            yield send()

    n_tokens = groups.agg(F.sum(F.octet_length("prefix") / 5).cast("long")).first()[0] or 0
    n_deals = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n_tokens // DEAL))
    dealt = groups.select("prefix", "n", "g").mapInArrow(tidy(deal), "deal bigint, token binary, g binary, flags binary")
    entries = dealt.repartition(n_deals, "deal").mapInArrow(tidy(_met), "token bigint, g bigint, low boolean, short boolean")
    # a group's own members meet in a list of their own
    own = groups.filter("many").select(F.xxhash64("prefix", "n").alias("token"), "g", F.lit(False).alias("low"), F.lit(True).alias("short"))
    entries = materialise(entries.unionByName(own.withColumn("many", F.lit(True)), allowMissingColumns=True).withColumn("many", F.coalesce("many", F.lit(False))), "entries")
    count = lambda c: F.count_if(F.expr(c))
    sizes = entries.groupBy("token").agg(F.count("*").alias("rows"), count("not low").alias("core"), count("not low and short").alias("short"), count("many").alias("many"), F.bit_xor(F.xxhash64("g", "low", "short")).alias("x"), F.bit_xor(F.xxhash64("short", "g", "low")).alias("y"))
    sizes = sizes.filter("many > 0 or core > 1 and short > 0 or core > 0 and rows > core")
    used = sizes.groupBy("rows", "x", "y").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("rows") / LIST_BLOCK).cast("int").alias("blocks"))
    entries = entries.drop("many").join(used, "token").withColumn("part", F.lit("")).withColumn("side", F.lit(0))
    return materialise(_cut(entries), "lists"), groups.select("g", "n", "members")


def _cut(rows: DataFrame) -> DataFrame:
    """Rows of lists, or of parts of them, cut into as many blocks as their column says: each pair of blocks is a part.

    Sides 1 and 2 are compared with each other alone, so of a part that has them each pair of a block of either is one.
    """
    rows = rows.withColumn("block", F.pmod(F.xxhash64("g", "token", "part"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block, other, side = F.col("block"), F.col("other"), F.col("side")
    first = F.when(side == 0, F.least(block, other)).when(side == 1, block).otherwise(other)
    second = block + other - first
    part = F.concat_ws("-", F.nullif("part", F.lit("")), first.cast("string"), second.cast("string"))
    side = F.when(side > 0, side).when(block == other, 0).when(block < other, 1).otherwise(2)
    return rows.select("token", part.alias("part"), side.alias("side"), "low", "short", "g")


class _Sets:
    """The whole sets of a list's rows, as numbers from 0 on."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        values, self.at = np.unique(np.concatenate(sets), return_inverse=True)
        self.ends = np.cumsum([len(s) for s in sets])
        self.starts = self.ends - [len(s) for s in sets]
        self.flag = np.zeros(len(values), np.uint8)

    def shared(self, v: int, rows: np.ndarray) -> np.ndarray:
        """How many members of row v each of some rows has."""
        own = self.at[self.starts[v] : self.ends[v]]
        self.flag[own] = 1
        if 8 * len(rows) < len(self.ends):
            out = np.array([np.count_nonzero(self.flag[self.at[self.starts[u] : self.ends[u]]]) for u in rows.tolist()], np.int64)
        else:
            out = np.add.reduceat(self.flag[self.at], self.starts, dtype=np.int64)[rows]
        self.flag[own] = 0
        return out


def _forest(rep: np.ndarray, n: np.ndarray, maps: np.ndarray, side: np.ndarray, low: np.ndarray, short: np.ndarray, comp: np.ndarray, num: int, den: int, sets: list[np.ndarray] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of one list that pass the filters or, where the sets are given, that link. Pairs
    of one component are joined already."""
    order = np.lexsort((rep, n))
    rep, n, maps, side, low, short, comp = (x[order] for x in (rep, n, maps, side, low, short, comp))
    whole = None if sets is None else _Sets([sets[i] for i in order.tolist()])
    left, out = np.ones(len(rep), bool), []
    two_sided = side.max() > 0
    for first in range(len(rep)):
        if not left[first]:
            continue
        queue = np.flatnonzero(left & (comp == comp[first])).tolist()  # members of one component are reached together
        left[queue] = False
        while queue:
            v = queue.pop()
            ok = left & (n * den >= n[v] * num) & (n[v] * den >= n * num) & (((n <= n[v]) & short) | ((n >= n[v]) & short[v]))
            if low[v]:
                ok &= ~low
            if two_sided:
                ok &= side != side[v]
            (at,) = np.nonzero(ok)
            if not len(at):
                continue
            limit = (n[at] + n[v]) * (den - num) // (den + num)
            at = at[np.bitwise_count(maps[at] ^ maps[v]).sum(axis=1) <= limit]
            if whole is not None and len(at):
                met = whole.shared(v, at)
                at = at[met * den >= (n[at] + n[v] - met) * num]
            for u in at.tolist():
                if not left[u] or rep[v] == rep[u]:
                    continue
                out.append((int(min(rep[v], rep[u])), int(max(rep[v], rep[u]))))
                same = np.flatnonzero(left & (comp == comp[u]))
                left[same] = False
                queue += same.tolist()
    return out


def _walk(rows: DataFrame, num: int, den: int, words: int, name: str) -> DataFrame:
    """(token, part, a, b): candidates of the lists of rows (token, part, side, n, rep, bitmap, component, low, short),
    or their links, where rows have the packed texts z as well; a scratch table."""
    whole = "z" in rows.columns

    def run(batches):
        held: list[tuple] = []
        unpack = zstandard.ZstdDecompressor()

        def close():
            side, n, rep, comp = (np.array([h[i] for h in held], np.int64) for i in (2, 3, 4, 6))
            low, short = (np.array([h[i] for h in held], bool) for i in (7, 8))
            maps = _widen([h[5] for h in held])
            sets = [shingles(np.frombuffer(unpack.decompress(h[9]), np.uint8), words) for h in held] if whole else None
            found = _forest(rep, n, maps, side, low, short, comp, num, den, sets)
            a, b = ([x[i] for x in found] for i in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array([held[0][0]] * len(a), pa.int64()), pa.array([held[0][1]] * len(a), pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["token", "part", "a", "b"])

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                if held and (row[0] != held[0][0] or row[1] != held[0][1]):
                    if len(held) > 1:
                        yield close()
                    held = []
                held.append(row)
        if len(held) > 1:
            yield close()

    rows = rows.select("token", "part", "side", "n", "rep", "bitmap", "component", "low", "short", *["z"] * whole)
    rows = rows.repartition("token", "part").sortWithinPartitions("token", "part")
    return materialise(rows.mapInArrow(tidy(run), "token bigint, part string, a bigint, b bigint"), name)


def _candidates(lists: DataFrame, groups: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """(token, part, a, b): the edges of a forest of each list, by its filters."""
    members = groups.select("g", "n", F.explode("members").alias("m")).select("g", "n", "m.rep", "m.bitmap", F.col("m.rep").alias("component"))
    return _walk(lists.join(members, "g"), num, den, words, "candidates")


def _links(docs: DataFrame, lists: DataFrame, groups: DataFrame, labels: DataFrame, num: int, den: int, words: int) -> DataFrame:
    """(a, b): links that join all of these lists' members that whole sets link. labels: (node, component) of those that
    have links already.

    A key's text travels, packed, to its members and from there to each of their lists. Of a key that has several sets
    each meets the members of its size and bitmap; it is a set of this key in any case.
    """
    weights = lists.join(groups.select("g", (F.col("n") * F.size("members")).alias("w")), "g").groupBy("token", "part").agg(F.sum("w").alias("w"))
    blocks = F.ceil(F.col("w") / SETS).cast("int").alias("blocks")
    lists = materialise(_cut(lists.join(weights.select("token", "part", blocks), ["token", "part"])), "open-parts")
    met = groups.join(lists.select("g").distinct(), "g", "left_semi")
    met = met.select("g", "n", F.explode("members").alias("m")).select("g", "n", "m.rep", "m.bitmap")
    met = materialise(met.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "open-members")
    ids = met.select(F.xxhash64("rep").alias("h")).distinct()
    bits, n_segments = repeated_bits(ids.unionByName(ids), 2 * max(1, ids.count()))
    rows = flag_repeats(docs.withColumn("h", F.xxhash64("key")), "h", bits, n_segments, "maybe").filter("maybe").select("text", "key")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in _slices(batches):
            found = [(len(s := shingles(t, words)), bitmap(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), squeeze.compress(t.tobytes())) for t in texts_of(batch.column(0))]
            n, maps, sig, z = ([x[i] for x in found] for i in range(4))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(n, pa.int64()), *(pa.array(x, pa.binary()) for x in (maps, sig, z))], names=["rep", "n", "bitmap", "sig", "z"])

    packed = rows.mapInArrow(tidy(pack), "rep bigint, n bigint, bitmap binary, sig binary, z binary").dropDuplicates(["rep", "n", "bitmap", "sig"]).drop("sig")
    met = packed.hint("merge").join(met, ["rep", "n", "bitmap"])
    return _walk(lists.join(met.hint("merge"), "g"), num, den, words, "links").select("a", "b")


def _verify(docs: DataFrame, pairs: DataFrame, n_pairs: int, words: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of distinct pairs of keys, by their whole sets, as a scratch table.

    Of a pair the key in more pairs is the hub. A hub's pairs fall into stars of about STAR; a text travels, packed,
    once to its key's stars and from there to each of them, so a task holds a hub's sets and one other text at a time.
    """
    degree = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).groupBy("key").agg(F.count("*").alias("d"))
    ranked = pairs.join(degree.select(F.col("key").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("key").alias("b"), F.col("d").alias("db")), "b")
    hub = F.when(F.col("da") >= F.col("db"), F.col("a")).otherwise(F.col("b"))
    star = ranked.select(hub.alias("hub"), (F.col("a") + F.col("b") - hub).alias("key"), F.greatest("da", "db").alias("d"))
    star = materialise(star.select("hub", F.pmod(F.xxhash64("key"), F.ceil(F.col("d") / STAR)).alias("star"), "key"), "stars")
    needs = star.unionByName(star.select("hub", "star", F.col("hub").alias("key")).distinct())
    ids = degree.select(F.xxhash64("key").alias("h"))
    bits, n_segments = repeated_bits(ids.unionByName(ids), 2 * n_pairs)
    rows = flag_repeats(docs.withColumn("h", F.xxhash64("key")), "h", bits, n_segments, "maybe").filter("maybe").select("text", "key")

    def pack(batches):
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in _slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array([squeeze.compress(t.tobytes()) for t in texts_of(batch.column(0))], pa.binary())], names=["key", "z"])

    def compare(batches):
        unpack, hub, own = zstandard.ZstdDecompressor(), None, []
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part, a, b, linked = batch.slice(lo, 256), [], [], []
                for h, s, k, z in zip(*(part.column(i).to_pylist() for i in range(4)), strict=True):
                    mine = shingles(np.frombuffer(unpack.decompress(z), np.uint8), words)
                    if (h, s) != hub:
                        hub, own = (h, s), []
                    if k == h:  # sorts before the star's other rows
                        own.append(mine)
                        continue
                    met = [len(np.intersect1d(mine, x, assume_unique=True)) for x in own]
                    a.append(min(h, k))
                    b.append(max(h, k))
                    linked.append(any(m and m * den >= (len(mine) + len(x) - m) * num for m, x in zip(met, own, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])

    packed = rows.mapInArrow(tidy(pack), "key bigint, z binary")
    sent = packed.hint("merge").join(needs, "key").select("hub", "star", "key", "z")
    sent = sent.repartition("hub", "star").sortWithinPartitions("hub", "star", F.col("key") != F.col("hub"))
    return materialise(sent.mapInArrow(tidy(compare), "a bigint, b bigint, linked boolean").groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")


def join(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per row of docs: key, n_shingles, component_id, rep_id.

    Words are runs of other characters than ASCII white space, A-Z lower-cased; a set holds the distinct shingles of
    `words` words, or the whole sequence where there are fewer. Two documents link when den * |intersection| >=
    num * |union|; component_id is the smallest key reachable by links, rep_id the smallest key with an equal set. A null
    text, or one without words, has the empty set and links with nothing. Rows that share a key count as one
    document that links by any of its texts; null keys are one document too and sort first. Empty tables give no
    rows; other columns play no part.
    """
    own = docs.select(F.col(text).alias("text"), F.coalesce(F.col(key).cast("long"), F.lit(NULL_KEY)).alias("key"))
    rows = _signatures(own, words, num, den)
    n_rows = rows.count()
    members, reps = _representatives(rows, n_rows)
    members = materialise(members, "membership")
    settle(docs.sparkSession)
    lists, groups = _lists(_groups(reps, n_rows), num, den)
    found, labels = _candidates(lists, groups, num, den, words), None
    pairs = materialise(found.select("a", "b").distinct(), "pairs")
    if n_pairs := pairs.count():
        tested = _verify(own, pairs, n_pairs, words, num, den)
        linked = tested.filter("linked").select("a", "b")
        labels = materialise(components(linked), "labels")
        vain = found.join(tested.filter("not linked").select("a", "b"), ["a", "b"], "left_semi")
        # written, since Spark may drop a repartition above a join that has the same keys and then change the join
        lists = materialise(lists.join(vain.select("token", "part").distinct(), ["token", "part"], "left_semi"), "open-lists")
        settle(docs.sparkSession)
        if not lists.isEmpty():
            linked = linked.unionByName(_links(own, lists, groups, labels, num, den, words))
            labels = materialise(components(linked), "labels")
            settle(docs.sparkSession)
    if labels is None:
        out = members.withColumn("component", F.col("rep"))
    else:
        out = join_labels(members, labels, n_rows)
    out = out.select("key", "n", "component", "rep")
    none = rows.filter("n = 0").select("key", "n", F.col("key").alias("component"), F.col("key").alias("rep"))
    back = lambda c: F.nullif(F.col(c), F.lit(NULL_KEY))
    return out.unionByName(none).select(back("key").alias(key), F.col("n").alias("n_shingles"), back("component").alias("component_id"), back("rep").alias("rep_id"))


def join_labels(members: DataFrame, labels: DataFrame, n_rows: int) -> DataFrame:
    """members with their representative's component. Only representatives that have links meet the labels."""
    sizes = materialise(members.groupBy("rep").agg(F.count("*").alias("size")).join(labels.withColumnRenamed("node", "rep"), "rep"), "label-sizes")
    hashed = members.withColumn("h", F.xxhash64("rep"))
    ids = sizes.select(F.xxhash64("rep").alias("h"))
    bits, n_segments = repeated_bits(ids.unionByName(ids), 2 * max(1, sizes.count()))
    flagged = flag_repeats(hashed, "h", bits, n_segments, "maybe").drop("h")
    least = max(1000, n_rows // 5000)
    maybe = flagged.filter("maybe").drop("maybe")
    hot = F.broadcast(sizes.filter(F.col("size") >= least).drop("size"))
    met = maybe.join(hot, "rep")
    cold = maybe.join(hot.select("rep"), "rep", "left_anti").join(sizes.filter(F.col("size") < least).drop("size"), "rep", "left")
    return flagged.filter("not maybe").drop("maybe").withColumn("component", F.col("rep")).unionByName(met.select("key", "n", "rep", "component")).unionByName(cold.select("key", "n", "rep", F.coalesce("component", "rep").alias("component")))


def drop_near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of docs that stay: of each component the document with the smallest key; columns as they were."""
    settle(docs.sparkSession)
    got = join(docs, text, key, words, num, den).filter(~F.col(key).eqNullSafe(F.col("component_id")))
    gone = materialise(got.select(F.col(key).alias("gone_")).distinct(), "gone")
    ids = gone.select(F.xxhash64("gone_").alias("h"))
    bits, n_segments = repeated_bits(ids.unionByName(ids), 2 * max(1, gone.count()))
    h, maybe = "h__", "maybe__"
    while h in docs.columns or maybe in docs.columns:
        h, maybe = h + "_", maybe + "_"
    rows = flag_repeats(docs.withColumn(h, F.xxhash64(F.col(key).cast("long"))), h, bits, n_segments, maybe)
    met = rows.filter(F.col(maybe)).join(gone, F.col(key).eqNullSafe(F.col("gone_")), "left_anti")
    return rows.filter(~F.col(maybe)).select(*docs.columns).unionByName(met.select(*docs.columns))
