"""Token ids in files: static range asymmetric numeral system (rANS) over one shared frequency table.

A corpus is tokenised once, ranged and sorted by key, and written to a scratch table. Counts of all ids give the
shared table (at most one entry per vocabulary id). Then runs of whole documents are coded as independent blocks.
Each block interleaves LANES coders, so a step codes LANES ids with one vectorised operation, and holds
checkpoints (the coders' states and the place in the stream after every CHECKPOINT steps), from which any stretch
can be decoded without what precedes it, and CRC-32 sums of its header, its stream and its ids.

File format, one or more frames a file; integers little-endian:
  magic b"TMR1", u32 header length, u32 stream length, u32 CRC-32 of header and stream, header, stream, b"\\n"
The header is zlib-compressed JSON-free binary: i64 start, u32 documents, u32 lanes, u32 steps, u32 ids,
u32 CRC-32 of the ids, u32 checkpoints, then the documents' keys (i64) and lengths (u32), the checkpoints
(u32 step, u32 words, lanes x u64 states). Frames of a file ascend by key, and so do folders (shard=00000...).
"""

from __future__ import annotations

import json
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import materialise, resident, text_slices

LANES, BLOCK_IDS, CHECKPOINT = 2048, 1 << 19, 128
SCALE_BITS, LOW = 20, 1 << 31
MAGIC = b"TMR1"
CACHE_WORDS = 400_000


class Table:
    """Frequencies that sum to 2**SCALE_BITS, each id that occurs having one at least."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        total = 1 << SCALE_BITS
        order = np.argsort(ids)
        ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.float64)[order]
        self.size = int(ids[-1]) + 1 if len(ids) else 1
        self.freq = np.zeros(self.size, np.uint64)
        if len(ids):
            if len(ids) > total:
                raise ValueError(f"{len(ids)} ids don't fit a table of {total}")
            f = np.maximum(1, np.floor(counts / counts.sum() * (total - len(ids)))).astype(np.int64)
            f[np.argmax(f)] += total - f.sum()
            self.freq[ids] = f.astype(np.uint64)
        self._finish()

    @classmethod
    def of(cls, ids: np.ndarray, freq: np.ndarray) -> Table:
        """From frequencies that are scaled already."""
        self = cls.__new__(cls)
        self.size = int(ids.max()) + 1 if len(ids) else 1
        self.freq = np.zeros(self.size, np.uint64)
        self.freq[ids] = freq.astype(np.uint64)
        self._finish()
        return self

    def _finish(self) -> None:
        self.cum = np.zeros(self.size, np.uint64)
        self.cum[1:] = np.cumsum(self.freq)[:-1]
        self.slot = np.repeat(np.arange(self.size, dtype=np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> tuple[int, list[tuple[int, int, np.ndarray]], bytes]:
    """Steps, checkpoints (step, words before it, states) from the first step on, and the stream in decoding order."""
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    f_all, c_all = table.freq[ids], table.cum[ids]
    out: list[np.ndarray] = []
    marks: list[tuple[int, int, np.ndarray]] = []
    words, bits, shift = 0, np.uint64(SCALE_BITS), np.uint64(63 - SCALE_BITS)
    w32 = np.uint64(32)
    for s in range(steps - 1, -1, -1):
        f, c = f_all[s * lanes : (s + 1) * lanes], c_all[s * lanes : (s + 1) * lanes]
        n = len(f)
        x = state[:n]
        full = x >= (f << shift)
        if full.any():
            spill = x[full]
            out.append(spill.astype(np.uint32)[::-1])  # the stream is turned round at the end
            words += len(spill)
            x = x.copy()
            x[full] = spill >> w32
        q = x // f
        state[:n] = (q << bits) + (x - q * f) + c
        if s % every == 0:
            marks.append((s, words, state.copy()))
    stream = np.concatenate(out)[::-1] if out else np.zeros(0, np.uint32)
    return steps, [(s, words - w, x) for s, w, x in reversed(marks)], np.ascontiguousarray(stream).tobytes()


def decode_steps(stream: np.ndarray, n_ids: int, table: Table, mark: tuple[int, int, np.ndarray], upto: int, lanes: int) -> np.ndarray:
    """The ids of the steps from a checkpoint to upto (exclusive)."""
    s, at, state = mark[0], mark[1], mark[2].copy()
    first = s * lanes
    out = np.empty(min(upto * lanes, n_ids) - first, np.uint32)
    mask, bits, low, w32 = np.uint64((1 << SCALE_BITS) - 1), np.uint64(SCALE_BITS), np.uint64(LOW), np.uint64(32)
    freq, cum, slot = table.freq, table.cum, table.slot
    while s < upto:
        lo = s * lanes
        n = min(lanes, n_ids - lo)
        x = state[:n]
        r = x & mask
        sym = slot[r]
        out[lo - first : lo - first + n] = sym
        x = freq[sym] * (x >> bits) + r - cum[sym]
        short = x < low
        k = int(np.count_nonzero(short))
        if k:
            x[short] = (x[short] << w32) | stream[at : at + k]
            at += k
        state[:n] = x
        s += 1
    return out


def frame(start: int, keys: np.ndarray, lengths: np.ndarray, ids: np.ndarray, table: Table, lanes: int = LANES, every: int = CHECKPOINT) -> bytes:
    lanes = max(1, min(lanes, len(ids) // 64))
    steps, marks, stream = encode_block(ids, table, lanes, every)
    head = struct.pack("<qIIIIII", start, len(keys), lanes, steps, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), len(marks))
    head += keys.astype("<i8").tobytes() + lengths.astype("<u4").tobytes()
    for s, w, x in marks:
        head += struct.pack("<II", s, w) + x.astype("<u8").tobytes()
    head = zlib.compress(head, 1)
    return MAGIC + struct.pack("<III", len(head), len(stream), zlib.crc32(stream, zlib.crc32(head))) + head + stream


def frames(content: bytes | memoryview):
    """(start, keys, lengths, lanes, steps, n_ids, crc of ids, marks, stream) of each frame; wrong sums raise ValueError."""
    at = 0
    while at < len(content):
        if content[at : at + 4] != MAGIC:
            raise ValueError(f"no frame at byte {at}")
        h, s, crc = struct.unpack_from("<III", content, at + 4)
        body = content[at + 16 : at + 16 + h + s]
        if len(body) != h + s or zlib.crc32(body) != crc:
            raise ValueError(f"frame at byte {at} is damaged")
        head = zlib.decompress(body[:h])
        start, n, lanes, steps, n_ids, ids_crc, n_marks = struct.unpack_from("<qIIIIII", head, 0)
        p = 32
        keys = np.frombuffer(head, "<i8", n, p)
        lengths = np.frombuffer(head, "<u4", n, p + 8 * n)
        p += 12 * n
        marks = []
        for _ in range(n_marks):
            step, w = struct.unpack_from("<II", head, p)
            marks.append((step, w, np.frombuffer(head, "<u8", lanes, p + 8).astype(np.uint64)))
            p += 8 + 8 * lanes
        yield start, keys, lengths, lanes, steps, n_ids, ids_crc, marks, np.frombuffer(body[h:], "<u4").astype(np.uint64)
        at += 16 + h + s + 1


def decode_frame(parts, table: Table, check: bool = True) -> np.ndarray:
    """All ids of a frame, each stretch from its own checkpoint."""
    _, _, _, lanes, steps, n_ids, ids_crc, marks, stream = parts
    if not n_ids:
        return np.zeros(0, np.uint32)
    ends = [m[0] for m in marks[1:]] + [steps]
    ids = np.concatenate([decode_steps(stream, n_ids, table, m, e, lanes) for m, e in zip(marks, ends, strict=True)])
    if check and zlib.crc32(ids.astype("<u4").tobytes()) != ids_crc:
        raise ValueError("the ids of a frame don't have its checksum")
    return ids


#: Classes of characters. OTHER are all that are neither letters, numbers nor white space, but the apostrophe, which may begin a word such as 's.
#: NOT_SPACE may be any of these.
UNKNOWN, NOT_SPACE, LETTER, NUMBER, OTHER, APOSTROPHE, SPACE, WHITE, LINE_END = range(9)


def _kind(code: int) -> int:
    ch = chr(code)
    if ch in "' \n":
        return {"'": APOSTROPHE, " ": SPACE, "\n": LINE_END}[ch]
    if code < 0x80:
        return WHITE if 9 <= code <= 13 else UNKNOWN if 28 <= code <= 31 else LETTER if ch.isalpha() else NUMBER if ch.isdigit() else OTHER
    if ch.isspace():
        return UNKNOWN
    kind = unicodedata.category(ch)
    return NOT_SPACE if kind == "Cn" else {"L": LETTER, "N": NUMBER}.get(kind[0], OTHER)


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Classes of the code points below 2**16, and whether a word always ends between two classes (16 * first + second)."""
    kinds, ends = np.array([_kind(c) for c in range(1 << 16)], np.uint8), np.zeros(256, bool)
    for a in (NOT_SPACE, LETTER, NUMBER, OTHER, APOSTROPHE):
        for b in (SPACE, WHITE, LINE_END):
            ends[16 * a + b] = True
    for a, b in [(LETTER, NUMBER), (LETTER, OTHER), (LETTER, APOSTROPHE), (NUMBER, LETTER), (NUMBER, OTHER), (NUMBER, APOSTROPHE), (OTHER, LETTER), (OTHER, NUMBER), (APOSTROPHE, NUMBER)]:
        ends[16 * a + b] = True
    return kinds, ends


def _classes(raw: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """The class of each byte's character, of valid UTF-8."""
    out = kinds[:256][raw]
    (lead,) = np.nonzero(raw >= 0xC0)
    if len(lead):
        b = raw[lead]
        at = lead[b < 0xE0]
        out[at] = out[at + 1] = kinds[(raw[at] & 31).astype(np.int32) << 6 | raw[at + 1] & 63]
        at = lead[(b >= 0xE0) & (b < 0xF0)]
        out[at] = out[at + 1] = out[at + 2] = kinds[(raw[at] & 15).astype(np.int32) << 12 | (raw[at + 1] & 63).astype(np.int32) << 6 | raw[at + 2] & 63]
        at = lead[b >= 0xF0]
        out[at] = out[at + 1] = out[at + 2] = out[at + 3] = NOT_SPACE  # white space is below 2**16
    return out


def _spread(begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places begins, begins + 1 ... of runs of these sizes one after another, and where each run ends among them."""
    ends = np.cumsum(sizes)
    at = np.repeat(begins - (ends - sizes), sizes)
    at += np.arange(len(at))
    return at, ends


class _Merges:
    """The merges of byte-level BPE over many words at once: a round does the next merge of every word.

    Symbols lie in a matrix, words in columns and places in rows, as a linked list along each column. keys holds
    for each symbol the rank of its pair with the next, times 32, plus its row; so the least of a column is the merge
    that is due, the leftmost of equals. Pairs are looked up in a hash table with open addressing.
    """

    PAD, NONE, LONGEST, WORDS = 0xFFFF, 1 << 30, 32, 8192

    def __init__(self, model: dict, symbols: list[str]) -> None:
        vocab = model["vocab"]
        self.first = np.array([vocab[s] for s in symbols], np.uint32)
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        self.result = np.array([vocab[a + b] for a, b in pairs], np.uint32)
        left = {vocab[a] << 16 | vocab[b]: 32 * rank for rank, (a, b) in enumerate(pairs)}  # of a pair named twice the last rank counts
        pair, rank = np.array([*left], np.uint32), np.array([*left.values()], np.int32)
        self.bits = max(10, (4 * len(pair)).bit_length())
        self.empty = np.uint32(self.PAD << 16 | self.PAD)
        self.pair, self.rank32 = np.full(1 << self.bits, self.empty), np.full(1 << self.bits, self.NONE, np.int32)
        at = self._place(pair)
        while len(pair):
            _, one = np.unique(at, return_index=True)
            one = one[self.pair[at[one]] == self.empty]
            self.pair[at[one]], self.rank32[at[one]] = pair[one], rank[one]
            rest = np.ones(len(pair), bool)
            rest[one] = False
            pair, rank, at = pair[rest], rank[rest], self._after(at[rest])

    def _place(self, pair: np.ndarray) -> np.ndarray:
        return (pair * np.uint32(2654435769) >> np.uint32(32 - self.bits)).astype(np.intp)

    def _after(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """32 times the ranks of pairs of ids; NONE of those that don't merge."""
        pair = a << np.uint32(16) | b
        at = self._place(pair)
        got, out = self.pair[at], self.rank32[at]
        (other,) = np.nonzero(got != pair)
        out[other] = self.NONE
        other = other[got[other] != self.empty]
        at = at[other]
        while len(other):
            at = self._after(at)
            got = self.pair[at]
            same = got == pair[other]
            out[other[same]] = self.rank32[at[same]]
            more = ~same & (got != self.empty)
            other, at = other[more], at[more]
        return out

    def merged(self, raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words in ascending order of size, at most LONGEST bytes, one word after another; and how many each has."""
        n, rows = len(begins), int(sizes[-1])
        sym = np.full((rows + 1, n), self.PAD, np.uint32)
        for j in range(rows):
            lo = int(np.searchsorted(sizes, j, "right"))
            sym[j, lo:] = self.first[raw[begins[lo:] + j]]
        key = np.full((rows + 1, n), self.NONE, np.int32)
        for j in range(rows - 1):
            np.add(self.ranks(sym[j], sym[j + 1]), np.int32(j), out=key[j])
        after = np.arange(n, (rows + 2) * n)
        before = np.arange(-n, (rows + 1) * n)
        before[:n] += (rows + 1) * n  # the row of padding stands before the first and after the last
        syms, keys = sym.reshape(-1), key.reshape(-1)
        while True:
            least = key.min(axis=0)
            (word,) = np.nonzero(least < self.NONE)
            if not len(word):
                break
            least = least[word]
            row = least & np.int32(31)
            a = row * np.intp(n) + word
            b = after[a]
            c, z, new = after[b], before[a], self.result[least >> np.int32(5)]
            syms[a], syms[b], keys[b] = new, self.PAD, self.NONE
            after[a], before[c] = c, a
            keys[a] = self.ranks(new, syms[c]) + row
            keys[z] = self.ranks(syms[z], new) + (z // n).astype(np.int32)
        left = sym.T != self.PAD
        return sym.T[left], np.count_nonzero(left, axis=1)


class _Tokenizer:
    """The tokenizers library's ids of texts, worked out for the distinct pieces of many texts at once.

    Texts are cut, in their bytes, where the byte-level split always begins a new word, whatever stands elsewhere:
    between letters, numbers and other marks, before white space, and around a single line end. The pieces are
    numbered by an Arrow dictionary after those met before (up to CACHE_WORDS, the ones met last staying). New pieces that are
    one word, with a space before it at most, go to the merges all together; the others go to the library one by one, as do
    whole texts with what may be a special token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.special = tuple(t.content for t in self.lib.get_added_tokens_decoder().values())
        self.size = self.lib.get_vocab_size(with_added_tokens=True)
        own = json.loads(self.lib.to_str())
        model, symbols = own["model"], byte_symbols()
        self.plain = own["normalizer"] is None and own["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        usual = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        self.merges = _Merges(model, symbols) if self.plain and usual and self.size < _Merges.PAD and all(s in model["vocab"] for s in symbols) else None
        self.kinds, self.parts = _tables()
        self.clock = 0
        self.words = pa.array([], pa.large_binary())
        self.begins = self.sizes = self.met = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def bounds(self, raw: np.ndarray, texts: pa.Array, ends: np.ndarray) -> np.ndarray:
        """Where pieces begin, and the end of the last. ends: 0 and where each text ends."""
        cut = np.zeros(len(raw) + 1, bool)
        if self.plain and len(raw):
            c = _classes(raw, self.kinds)
            cut[1:-1] = self.parts[c[:-1] << 4 | c[1:]]
            (at,) = np.nonzero(c[1:-1] == LINE_END)
            word = (c > UNKNOWN) & (c < SPACE)
            cut[at[word[at] & word[at + 2]] + 2] = True
            for s in self.special:
                for i in np.flatnonzero(pc.match_substring(texts, s)).tolist():
                    cut[ends[i] : ends[i + 1]] = False
        cut[ends] = True
        return np.flatnonzero(cut)

    def fresh(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of pieces, and where in them each piece's begin and how many they are."""
        raw, ends = _buffers(pieces)
        begins, size = ends[:-1], np.diff(ends)
        fit = np.zeros(len(pieces), bool)
        if self.merges is not None and len(raw):
            c = _classes(raw, self.kinds)
            strange = (c < LETTER) | (c > OTHER)
            seen = np.cumsum(np.append(0, strange))
            fit = (seen[ends[1:]] - seen[begins] - (c[begins] == SPACE) == 0) & (size <= _Merges.LONGEST)
            for s in self.special:
                fit &= ~np.asarray(pc.match_substring(pieces, s))
        at, n = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        order = np.flatnonzero(fit)
        order = order[np.argsort(size[order], kind="stable")]
        out, total = [], 0
        for lo in range(0, len(order), _Merges.WORDS):
            some = order[lo : lo + _Merges.WORDS]
            ids, n[some] = self.merges.merged(raw, begins[some], size[some])
            out.append(ids)
        alone = np.flatnonzero(~fit)
        if len(alone):
            for i, e in zip(alone.tolist(), self.lib.encode_batch_fast(pieces.take(pa.array(alone)).cast(pa.large_string()).to_pylist(), add_special_tokens=False), strict=True):
                out.append(np.array(e.ids, np.uint32))
                n[i] = len(e.ids)
        order = np.concatenate([order, alone])
        at[order] = np.cumsum(n[order]) - n[order]
        return np.concatenate([np.zeros(0, np.uint32), *out]), at, n

    def block(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (large strings), each text's followed by the end id if there is one; and 0 and where each text's end."""
        texts.validate(full=True)  # bytes that are no UTF-8 raise an error
        raw, ends = _buffers(texts)
        bounds = self.bounds(raw, texts, ends)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(raw)])
        known = len(self.words)
        coded = pa.concat_arrays([self.words, pieces]).dictionary_encode()
        index, words = coded.indices.to_numpy()[known:], coded.dictionary
        ids, begins, sizes = self.fresh(words.slice(known))
        begins, sizes, ids = np.append(self.begins, begins + len(self.ids)), np.append(self.sizes, sizes), np.append(self.ids, ids)
        met = np.append(self.met, np.zeros(len(words) - known, np.int64))
        self.clock += 1
        met[index] = self.clock
        self.remember(words, begins, sizes, ids, met)
        stops = np.searchsorted(bounds, ends)
        if end is not None:
            index = np.insert(index, stops[1:], len(sizes))
            begins, sizes, ids = np.append(begins, len(ids)), np.append(sizes, 1), np.append(ids, np.uint32(end))
            stops += np.arange(len(stops))
        at, done = _spread(begins[index], sizes[index])
        return ids[at], np.append(0, done)[stops]

    def remember(self, words: pa.Array, begins: np.ndarray, sizes: np.ndarray, ids: np.ndarray, met: np.ndarray) -> None:
        """Keep short pieces: all, or the half of CACHE_WORDS that was met last."""
        keep = np.diff(_buffers(words)[1]) <= 64
        if np.count_nonzero(keep) > CACHE_WORDS:
            order = np.argsort(np.where(keep, met, -1), kind="stable")
            keep[order[: -(CACHE_WORDS // 2)]] = False
        if not keep.all():
            (kept,) = np.nonzero(keep)
            words, sizes, met = words.take(pa.array(kept)), sizes[kept], met[kept]
            at, ends = _spread(begins[kept], sizes)
            ids, begins = ids[at], ends - sizes
        self.words, self.begins, self.sizes, self.ids, self.met = words, begins, sizes, ids, met

    def encode(self, texts: list[str], dtype: str) -> list[bytes]:
        """The packed ids of each text."""
        ids, ends = self.block(pa.array(texts, pa.large_string()))
        raw, ends = ids.astype(dtype).tobytes(), (ends * np.dtype(dtype).itemsize).tolist()
        return [raw[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of large strings or binaries without nulls; 0 and where each row's end."""
    ends = np.frombuffer(column.buffers()[1] or bytes(8), np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def _tokenizer(path: str) -> _Tokenizer:
    return resident(("tokenizer", path), lambda: _Tokenizer(path))


def tokenise(docs: DataFrame, path: str, text: str, key: str, end_id: int, n_shards: int) -> DataFrame:
    """(shard, key, at: ids before it in its shard, n: ids with the end id, ids packed), ranged and sorted by key, as a scratch table.

    ids are unsigned 16-bit integers where the vocabulary allows, else 32-bit. The last row of a shard has the null
    n and holds the counts of the shard's ids as 64-bit integers. Null keys come first.
    """

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tok = _tokenizer(path)
        dtype = width(max(tok.size, end_id + 1))
        shard, at, total = TaskContext.get().partitionId(), 0, np.zeros(max(tok.size, end_id + 1), np.int64)
        names = ["shard", "key", "at", "n", "ids"]
        for batch in batches:
            for lo, hi in text_slices(batch.column(1), 4 << 20):
                ids, ends = tok.block(batch.column(1).slice(lo, hi - lo).cast(pa.large_string()), end_id)
                total += np.bincount(ids, minlength=len(total))
                ids, n = ids.astype(dtype), np.diff(ends)
                packed = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(ends * ids.itemsize), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), shard, np.int32)), batch.column(0).slice(lo, len(n)), pa.array(at + ends[:-1]), pa.array(n), packed], names=names)
                at += int(ends[-1])
        if at:
            (seen,) = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([None], pa.int64()), pa.array([at], pa.int64()), pa.array([None], pa.int64()), pa.array([np.stack([seen, total[seen]]).astype("<i8").tobytes()], pa.binary())], names=names)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.repartitionByRange(n_shards, "key").sortWithinPartitions("key", F.xxhash64("text"))
    return materialise(rows.mapInArrow(run, "shard int, key bigint, at bigint, n bigint, ids binary"), "tokens")


def width(size: int) -> str:
    return "<u2" if size <= 1 << 16 else "<u4"


def shared_table(tokens: DataFrame) -> Table:
    """The frequency table over all ids; the driver gets one row per vocabulary id at most."""

    def spread(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                ids, n = np.frombuffer(blob, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], names=["id", "n"])

    got = tokens.filter("n is null").select("ids").mapInArrow(spread, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    return Table(got["id"].to_numpy(), got["n"].to_numpy())


def write(docs: DataFrame, folder: str, path: str, text: str = "text", key: str = "doc_id", end_id: int = 2, n_shards: int | None = None, block_ids: int = BLOCK_IDS) -> Table:
    """Encode docs to files below folder in ascending order of key; the shared table is returned and kept beside them.

    A null or empty text has the end id alone. Repeated keys stay in order of their text's hash. Null keys are
    written as the smallest 64-bit integer. An empty table writes a folder without frames.
    """
    spark = docs.sparkSession
    tokens = tokenise(docs, path, text, key, end_id, n_shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism))
    table = shared_table(tokens)
    sizes = tokens.filter("n is null").select("shard", F.col("at").alias("n")).toPandas().sort_values("shard")
    dtype = width(max(_tokenizer(path).size, end_id + 1))
    starts = dict(zip(sizes["shard"].tolist(), (sizes["n"].cumsum() - sizes["n"]).tolist(), strict=True))  # of shards, not documents
    shared = spark.sparkContext.broadcast((table, starts))

    def run(batches):
        table, starts = shared.value
        shard, begin, expected = None, 0, 0
        keys, parts, n = [], [], 0

        def flush():
            nonlocal keys, parts, n
            ids = np.frombuffer(b"".join(parts), dtype).astype(np.uint32)
            lengths = np.array([len(p) for p in parts], np.uint32) // np.dtype(dtype).itemsize
            blob = frame(starts[shard] + begin, np.array(keys, np.int64), lengths, ids, table)
            out = pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([keys[0]], pa.int64()), pa.array([len(ids)], pa.int64()), pa.array([blob], pa.binary())], names=["shard", "first", "n", "blob"])
            keys, parts, n = [], [], 0
            return out

        for batch in batches:
            for s, k, at, size, ids in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if parts and (s != shard or at != expected or n >= block_ids):
                    yield flush()
                if not parts:
                    shard, begin = s, at
                keys.append(-(1 << 63) if k is None else k)
                parts.append(ids)
                n += size
                expected = at + size
        if parts:
            yield flush()

    blobs = tokens.filter("n is not null").mapInArrow(run, "shard int, first bigint, n bigint, blob binary")
    blobs = blobs.select(F.format_string("%06d", "shard").alias("shard"), "first", F.col("blob").cast("string").alias("value"))
    blobs.sortWithinPartitions("shard", "first").select("shard", "value").write.partitionBy("shard").option("lineSep", "\n").text(f"{folder}/frames")
    spark.createDataFrame([(int(i), int(f)) for i, f in enumerate(table.freq.tolist()) if f], "id int, freq int").coalesce(1).write.parquet(f"{folder}/table")
    return table


def read(spark: SparkSession, folder: str, ids: bool = True) -> DataFrame:
    """One row per document written: key, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked, ids.

    Damaged frames fail the job. Frames are decoded by whichever task reads their file; their headers hold the
    global place of their first id.
    """
    freq = spark.read.parquet(f"{folder}/table").toPandas()
    table = spark.sparkContext.broadcast(Table.of(freq["id"].to_numpy(), freq["freq"].to_numpy()))
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if ids else "")

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                for parts in frames(memoryview(content.as_buffer())):
                    got, (start, keys, lengths) = decode_frame(parts, table.value), parts[:3]
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths
                    raw = memoryview(got.astype("<u4").tobytes())
                    columns = [
                        pa.array([None if k == -(1 << 63) else k for k in keys.tolist()], pa.int64()),
                        pa.array(begins + start),
                        pa.array(lengths.astype(np.int64)),
                        pa.array([zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)], pa.int64()),
                    ]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(got.astype(np.int32))))
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: 4 + ids])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(f"{folder}/frames").select("content")
    return files.mapInArrow(run, schema)
