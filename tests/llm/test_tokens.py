"""BPE against the tokenizers library, and rANS files as an exact round trip."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import bpe, rans
from tidemark.llm.common import scratch_path
from tidemark.llm.queries import vocabulary

PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "1", "²", "é", "漢", "🙂", "!", ",", ".", "_", "\x1c", "\x85", "\xa0", "՘", "<|endoftext|>", "́", " the", "\r\n", "\0", "-", " Word"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary())


def samples(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(n)] + ["x" * 30_000, "ab " * 5000]


def test_encode_and_decode_as_the_library(library):
    own = bpe.load(vocabulary())
    for t in samples(4000):
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cut_pieces_encode_as_whole_texts(library):
    tok = rans._Tokenizer(vocabulary())
    ts = samples(4000, 2)
    for t, got in zip(ts, tok.encode(ts, "<u2"), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids


def test_new_words_of_letters_go_to_the_merges_many_at_a_time(library):
    tok, asked = rans._Tokenizer(vocabulary()), []

    class Library:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    tok.lib = Library()
    ts = [f"Wort{chr(97 + i % 26)}{chr(97 + i // 26)} stra\u00dfe\u00e9{chr(97 + i % 26)} \u0142\u00f3d{chr(97 + i // 26)} a1{i}" for i in range(600)]
    for t, got in zip(ts, tok.encode(ts, "<u2"), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert len(asked) <= 600 + 26 and not any(p.strip().isalpha() and p.isascii() for p in asked)


def test_marks_after_a_word_are_words_of_their_own(library):
    tok, asked = rans._Tokenizer(vocabulary()), []

    class Library:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    tok.lib, rng = Library(), random.Random(7)
    ends = [*(chr(c) for c in range(33, 127) if not chr(c).isalnum()), ".%", "'$", "'s!", ",'", "''", "(x)", "_", "...", "1%", "!?&*", "|>"]
    words = [f"ab{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)] + ["stra\u00dfe", "\u0142\u00f3d", "\u6f22", "it's", "a'", "x\u0301", "7", "\u00b2"]
    ts = [sep.join(rng.choice(words) + rng.choice(ends) for _ in range(rng.randint(1, 9))) for _ in range(3000) for sep in [rng.choice([" ", "\n", "  ", "\n\n", "\t"])]]
    for t, got in zip(ts, tok.encode(ts, "<u2"), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert not any(p.strip()[:-1].isalpha() and p[-1] in "$&*%#" and p.isascii() for p in asked if len(p) < 9)


def test_words_of_one_kind_go_to_the_merges_together(library):
    tok, asked = rans._Tokenizer(vocabulary()), []

    class Library:
        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    tok.lib, rng = Library(), random.Random(11)
    parts = ["mail", "x", "\u00e9t\u00e9", "\u0436\u0443\u043a", "\u6f22\u5b57", "\u0915\u093f\u0924", "7", "4115431727187735", "\u00b2", "@", ".", "...", "$=", "\u3002", "|", "a" * 32]
    ts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 6))) + rng.choice(" \n") + rng.choice(parts) for _ in range(3000)]
    for t, got in zip(ts, tok.encode(ts, "<u2"), strict=True):
        assert np.frombuffer(got, "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
    assert all(p == "\n" or len(p.encode()) > rans._Merges.LONGEST for p in asked)


def test_cuts_agree_with_the_library_at_every_character(library):
    tok = rans._Tokenizer(vocabulary())
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000), *range(0x10000, 0x110000, 97)]]
    for form in ["a{0}b {0}1{0}!{0}'s {0}", "1{0}\n{0} a\n{0}\n"]:
        ts = [form.format(c) for c in chars]
        want = library.encode_batch_fast(ts, add_special_tokens=False)
        assert all(np.frombuffer(got, "<u2").tolist() == w.ids for got, w in zip(tok.encode(ts, "<u2"), want, strict=True))


def test_forgotten_pieces_and_pieces_without_merges(library, monkeypatch):
    monkeypatch.setattr(rans, "CACHE_WORDS", 40)
    own, plain = rans._Tokenizer(vocabulary()), rans._Tokenizer(vocabulary())
    plain.merges = None
    for seed in range(5):
        ts = samples(300, seed) + [f"{w}{seed % 2} it's {w}" for w in ("one", "two", "three" * 20)] + ["", "it", "'"]
        want = [np.array(library.encode(t, add_special_tokens=False).ids, "<u2").tobytes() for t in ts]
        assert own.encode(ts, "<u2") == plain.encode(ts, "<u2") == want
        assert len(own.words) <= 40
    assert own.encode(["", ""], "<u2") == [b"", b""] and own.encode([], "<u2") == []


def test_other_splits_go_to_the_library_whole():
    path = vocabulary("word_bpe_49k.json")
    other, tok = Tokenizer.from_file(path), rans._Tokenizer(path)
    ts = samples(500, 4)
    for t, got in zip(ts, tok.encode(ts, "<u4"), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == other.encode(t, add_special_tokens=False).ids


def test_columns_nulls_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "c")], "doc_id long, text string")
    got = bpe.decode(bpe.encode(docs, vocabulary()), vocabulary(), out="back").collect()
    assert sorted((r["text"] or "") for r in got) == sorted(r["back"] for r in got)
    d = {r["doc_id"]: r for r in bpe.digests(docs, vocabulary()).collect()}
    assert d[2]["n_tokens"] == d[3]["n_tokens"] == 0 and d[2]["ids_sha256"] == d[3]["ids_sha256"]
    assert bpe.digests(docs.limit(0), vocabulary()).count() == 0


@pytest.mark.parametrize("n", [0, 1, 5, 3000])
def test_block_round_trip_and_checkpoints(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 60_000).astype(np.uint32)
    table = rans.Table(*np.unique(ids, return_counts=True)) if n else rans.Table(np.array([2]), np.array([1]))
    blob = rans.frame(11, np.array([4, 5]), np.array([n, 0], np.uint32), ids, table, lanes=16, every=8)
    (parts,) = rans.frames(memoryview(blob + b"\n"))
    assert parts[0] == 11 and parts[1].tolist() == [4, 5]
    assert (rans.decode_frame(parts, table) == ids).all()
    if n == 3000:
        mark = parts[7][2]  # decoding may begin at any checkpoint
        tail = rans.decode_steps(parts[8], n, table, mark, parts[4], parts[3])
        assert (tail == ids[mark[0] * parts[3] :]).all()
        with pytest.raises(ValueError, match="damaged"):
            list(rans.frames(memoryview(blob[:-9] + bytes([blob[-9] ^ 1]) + blob[-8:] + b"\n")))


def test_files_round_trip(spark, library):
    rows = [(i * 3 % 101, t) for i, t in enumerate(samples(99, 3))] + [(500, None), (501, "")]
    folder = scratch_path(spark, "files")
    rans.write(spark.createDataFrame(rows, "doc_id long, text string"), folder, vocabulary(), n_shards=5, block_ids=40)
    got = sorted(rans.read(spark, folder).collect(), key=lambda r: r["start"])
    want = {k: [*library.encode(t or "", add_special_tokens=False).ids, 2] for k, t in rows}
    assert [r["key"] for r in got] == sorted(want)
    at = 0
    for r in got:
        ids = want[r["key"]]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids)
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_empty_table_writes_no_frame(spark):
    folder = scratch_path(spark, "none")
    rans.write(spark.createDataFrame([], "doc_id long, text string"), folder, vocabulary(), n_shards=2)
    assert spark.read.parquet(f"{folder}/table").count() == 0
