"""Byte-level BPE, encoding and decoding.

A word's symbols form a doubly linked list; a priority queue holds the merges of neighbours by (rank, place).
An entry whose pair has changed since it was queued is stale and skipped when it comes up. Decoding
concatenates the vocabulary's byte strings.

Words repeat, so each worker keeps the ids of the words it has met, in two generations of ``CACHE_WORDS``. Text is cut at its
single spaces first: a space between two other characters always begins a new word of the pre-tokeniser's
pattern, so what lies between two such cuts splits into words by itself and serves as the key of the cache.
Texts with double spaces or a space at the end go through the pattern as a whole.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import resident, text_slices, trim



CACHE_WORDS, FEW_WORDS = 125_000, 50_000
#: The split of byte-level BPE before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^\s{LIN}{NIN}]+|\s+(?!\S)|\s+"


@lru_cache(1)
def patterns() -> tuple[regex.Pattern, regex.Pattern]:
    """For texts in Latin-1, and for all texts.

    The regex module may know letters and numbers of a later Unicode version than the tokenizers library does.
    The standard library's tables (Unicode 15.1) agree with that library, so code points which they leave
    unassigned count as neither.
    """
    import sys
    import unicodedata

    plain = PATTERN.replace("{L}", r"\p{L}").replace("{N}", r"\p{N}").replace("{LIN}", r"\p{L}").replace("{NIN}", r"\p{N}")
    known = regex.compile(r"[\p{L}\p{N}]")
    spans: list[list[int]] = []
    for c in range(0x80, sys.maxunicode + 1):
        if not 0xD800 <= c < 0xE000 and unicodedata.category(ch := chr(c)) == "Cn" and known.match(ch):
            if spans and spans[-1][1] == c - 1:
                spans[-1][1] = c
            else:
                spans.append([c, c])
    late = "".join(f"\\U{a:08X}-\\U{b:08X}" for a, b in spans)
    if not late:
        return regex.compile(plain), regex.compile(plain)
    sub = lambda k: rf"[\p{{{k}}}--[{late}]]"
    full = PATTERN.replace("[^\\s{LIN}{NIN}]", rf"[^\s[\p{{L}}--[{late}]][\p{{N}}--[{late}]]]").replace("{L}", sub("L")).replace("{N}", sub("N"))
    return regex.compile(plain), regex.compile(full, regex.V1)


def split_words(text: str) -> list[str]:
    """The words of the pre-tokeniser."""
    fast, full = patterns()
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return full.findall(text)
    return fast.findall(text)


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where it is printable, else the next code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    out, n = [], 256
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(n))
            n += 1
    return out


class Bpe:
    def __init__(self, path: str, cache_words: int = CACHE_WORDS) -> None:
        self.most = cache_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        back = {s: b for b, s in enumerate(byte_symbols())}
        self.first = [vocab[s] for s in byte_symbols()]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.strings = [b""] * size
        for s, i in vocab.items():
            self.strings[i] = bytes(back[c] for c in s)
        for s, i in self.special.items():
            self.strings[i] = s.encode()
        self._special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.cache: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The ids of one word by a queue of merges over a linked list."""
        merges, sym = self.merges, [self.first[b] for b in word]
        n = len(sym)
        if n < 2:
            return tuple(sym)
        nxt, prv = [*range(1, n), -1], [*range(-1, n - 1)]
        queue = []
        for i in range(n - 1):
            if (m := merges.get((sym[i], sym[i + 1]))) is not None:
                queue.append((m[0], i, m[1], sym[i], sym[i + 1]))
        heapq.heapify(queue)
        while queue:
            _, i, new, a, b = heapq.heappop(queue)
            if sym[i] != a or (j := nxt[i]) < 0 or sym[j] != b:
                continue  # stale
            sym[i], sym[j] = new, -1
            nxt[i] = k = nxt[j]
            if k >= 0:
                prv[k] = i
                if (m := merges.get((new, sym[k]))) is not None:
                    heapq.heappush(queue, (m[0], i, m[1], new, sym[k]))
            if (h := prv[i]) >= 0 and (m := merges.get((sym[h], new))) is not None:
                heapq.heappush(queue, (m[0], h, m[1], sym[h], new))
        return tuple(s for s in sym if s >= 0)

    def _chunk(self, chunk: str) -> tuple[int, ...]:
        if len(self.cache) >= self.most:
            self.old, self.cache = self.cache, {}
        cache, old = self.cache, self.old
        if (ids := old.get(chunk)) is None:
            words = split_words(chunk)
            if len(words) == 1:
                ids = self.encode_word(chunk.encode("utf-8", "surrogatepass"))
            else:
                ids = ()
                for w in words:
                    if (got := cache.get(w)) is None:
                        if (got := old.get(w)) is None:
                            got = self.encode_word(w.encode("utf-8", "surrogatepass"))
                        cache[w] = got
                    ids += got
        cache[chunk] = ids
        return ids

    def _plain(self, text: str) -> list[tuple[int, ...]]:
        if not text:
            return []
        if "  " in text or text[-1] == " ":
            parts = split_words(text)
        else:
            parts = text.replace(" ", "\0 ").split("\0") if "\0" not in text else split_words(text)
            if not parts[0]:
                del parts[0]
        chunk = self._chunk
        return [got if (got := self.cache.get(p)) is not None else chunk(p) for p in parts]

    def encode(self, text: str) -> list[int]:
        """As the tokenizers library with add_special_tokens=False: special tokens' strings in a text become their ids."""
        if self._special is None or not self._special.search(text):
            return list(chain.from_iterable(self._plain(text)))
        out: list[int] = []
        at = 0
        for m in self._special.finditer(text):
            out += chain.from_iterable(self._plain(text[at : m.start()]))
            out.append(self.special[m[0]])
            at = m.end()
        out += chain.from_iterable(self._plain(text[at:]))
        return out

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.strings.__getitem__, ids)).decode("utf-8", "replace")


def load(path: str, cache_words: int = CACHE_WORDS) -> Bpe:
    """One per worker process; the path must hold on every executor."""

    def make() -> Bpe:
        bpe = Bpe(path, cache_words)
        trim()  # the parsed file is larger than what is kept of it
        return bpe

    return resident(("bpe", path), make)


SLICE = 256  # rows encoded or decoded at a time, which bounds a worker's memory


def _mapped(docs: DataFrame, column: str, out: str, kind: T.DataType, fn) -> DataFrame:
    """docs with a column that fn makes of another, slice by slice; an existing column of that name is replaced."""
    rest = [c for c in docs.columns if c.lower() != out.lower()]
    rows = docs.select(*rest) if column in rest else docs.select(*rest, column)
    schema = T.StructType([*docs.select(*rest).schema.fields, T.StructField(out, kind)])
    at = rows.columns.index(column)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, SLICE):
                part = batch.slice(lo, SLICE)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], fn(part.column(at))], names=[*rest, out])

    return rows.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with a column of token ids (array<int>). A null text counts as empty and gives no ids; other columns stay."""

    def run(texts):
        bpe = load(path)
        ids = [np.array(bpe.encode(t or ""), np.int32) for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids)))

    return _mapped(docs, text, out, T.ArrayType(T.IntegerType()), run)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """docs with the text of a column of token ids; null ids give null, bytes that are no UTF-8 the replacement character."""

    def run(lists):
        bpe = load(path)
        return pa.array([None if x is None else bpe.decode(x) for x in lists.to_pylist()], pa.string())

    return _mapped(docs, ids, out, T.StringType(), run)


def encode_checked(docs: DataFrame, path: str, text: str = "text", out: str = "ids", check: str = "round_trip") -> DataFrame:
    """docs with the ids in place of the text, and whether decoding them gives it back, in one pass over one worker.

    A null text counts as empty. Columns called as the new ones are replaced.
    """
    rest = [c for c in docs.columns if c.lower() not in (text.lower(), out.lower(), check.lower())]
    fields = [*docs.select(*rest).schema.fields, T.StructField(out, T.ArrayType(T.IntegerType())), T.StructField(check, T.BooleanType())]

    def run(batches):
        bpe = load(path, FEW_WORDS)  # ids and texts are held as well
        for batch in batches:
            for lo, hi in text_slices(batch.column(len(rest))):
                part = batch.slice(lo, hi - lo)
                texts = [t or "" for t in part.column(len(rest)).to_pylist()]
                ids = [np.array(bpe.encode(t), np.int32) for t in texts]
                same = [bpe.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]).astype(np.int32)), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], lists, pa.array(same, pa.bool_())], names=[*rest, out, check])

    return docs.select(*rest, text).mapInArrow(run, T.StructType(fields))


def digests(docs: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Encode, then decode every whole text; per row: key, n_tokens, ids_sha256, decoded_sha256.

    A null or empty text has no ids and decodes to the empty text. Repeated rows give repeated rows.
    """
    schema = docs.select(F.col(key).alias("key")).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def run(batches):
        bpe = load(path)
        sha = hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1):
                ids = bpe.encode(t.as_py())
                n.append(len(ids))
                a.append(sha(str(ids)[1:-1].replace(" ", "").encode()).hexdigest())
                b.append(sha(bpe.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["key", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)



