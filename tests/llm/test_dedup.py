"""Exact dedup and the Jaccard join against brute force, with nulls, ties, repeats, empty tables and clashing names."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import components, exact_dedup, jaccard

SPACE = "[\x20\x09-\x0d]+"


def texts(seed: int, n: int) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(0, 40))) for _ in range(n // 4)]
    out = []
    for i in range(n):
        w = rng.choice(base).split(" ")
        if rng.random() < 0.5 and w:
            w[rng.randrange(len(w))] = rng.choice(words)
        t = rng.choice([" ", "\n", "  ", "\t"]).join(w)
        out.append((i, rng.choice([t, t.upper(), t, None]) if rng.random() < 0.2 else t))
    return out


def test_decisions_match_brute_force(spark):
    rows = texts(1, 400) + [(7, "again"), (7, "again"), (None, "again"), (None, ""), (401, "x y"), (402, "x y")]
    got = exact_dedup.decisions(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    norm = lambda t: re.sub(SPACE, " ", t or "")
    groups = {}
    for k, t in rows:
        groups.setdefault(norm(t), []).append(k)
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ks for t, ks in groups.items()}
    for r in got:
        ks = by_sha[r["text_sha256"]]
        assert r["group_size"] == len(ks)
        assert r["keep_id"] == min((k for k in ks if k is not None), default=None)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_drop_duplicates_keeps_columns_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b", 5, "x"), (2, "a  b", 6, "y"), (3, None, 7, "z")], "doc_id long, text string, sha_ int, seg string")
    got = exact_dedup.drop_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 3]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_dedup.decisions(empty).count() == 0
    assert exact_dedup.drop_duplicates(empty).count() == 0
    assert jaccard.join(empty).count() == 0


def test_small_filter_only_costs_shuffles(spark):
    rows = texts(2, 300)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    whole = {(r["doc_id"], r["keep_id"]) for r in exact_dedup.decisions(df).collect()}
    assert {(r["doc_id"], r["keep_id"]) for r in exact_dedup.decisions(df, max_filter_bytes=1).collect()} == whole


def brute_components(rows, words, num, den):
    sets = {}
    for k, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {k: (len(sets[k]), find(k)) for k in keys}


@pytest.mark.parametrize(("words", "num", "den"), [(3, 90, 100), (2, 60, 100)])
def test_jaccard_matches_brute_force(spark, words, num, den):
    rows = texts(3, 300) + [(1000, "one"), (1001, "ONE"), (1002, "one two"), (1003, ""), (1004, None), (1005, " ")]
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words=words, num=num, den=den).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, words, num, den)


def test_long_lists_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "LIST_BLOCK", 8)
    rows = texts(4, 200)
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words=2, num=70, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2, 70, 100)


@pytest.mark.parametrize("most", [1 << 20, 1500])
def test_pairs_that_just_miss_the_threshold_make_no_rows(spark, monkeypatch, most):
    """All pairs but a few share 88 of 112 words, short of 80 %. The bitmaps let through about half of them, and the
    words they share are rarer than the others, which copies of one long text hold."""
    monkeypatch.setattr(jaccard, "SETS", most, raising=False)
    core, own = " ".join(f"c{i}" for i in range(88)), lambda c: "".join(f" u{c}x{k}" for k in range(12))
    rows = [(i, core + own(i - i % 20 // 19) + " more" * (i % 20 == 19)) for i in range(60)]
    rows += [(i, "".join(map(own, [*range(60), "p", "q"]))) for i in range(100, 170)]
    nulls = [(None, core + own(c)) for c in "pqq"]  # one document, of two sets
    made, materialise = [], jaccard.materialise

    def counted(df, name, *a):
        out = materialise(df, name, *a)
        made.append((name, out.count()))
        return out

    monkeypatch.setattr(jaccard, "materialise", counted)
    got = jaccard.join(spark.createDataFrame(rows + nulls, "doc_id long, text string"), words=1).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None} == brute_components(rows, 1, 80, 100)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None] * 3
    assert max(n for name, n in made if name in ("candidates", "pairs", "verified", "failed", "links")) < 10 * 60


def test_shingles_go_through_no_filter_that_grows_with_them(spark, monkeypatch):
    rows, asked = texts(12, 300), []
    monkeypatch.setattr(jaccard, "DEAL", 64)
    monkeypatch.setattr(jaccard, "repeated_bits", lambda hashes, n, *a: asked.append(n) or exact_dedup.repeated_bits(hashes, n, *a))
    got = jaccard.join(spark.createDataFrame(rows, "doc_id long, text string"), words=2, num=50, den=100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, 2, 50, 100)
    assert max(asked) <= 2 * len(rows)


def test_entries_of_repeated_shingles_are_kept_within_bounds(monkeypatch):
    monkeypatch.setattr(jaccard, "DEAL", 50)
    rng = np.random.default_rng(3)
    token = np.concatenate([rng.integers(0, 400, 600), np.full(500, 7), np.arange(1000, 1300)])
    rng.shuffle(token)
    g, flags = np.arange(len(token)), rng.integers(0, 4, len(token)).astype(np.uint8)
    pieces = [slice(lo, lo + 30) for lo in range(0, len(token), 30)]
    batch = pa.RecordBatch.from_arrays([pa.array([0] * len(pieces)), *(pa.array([x[s].tobytes() for s in pieces], pa.binary()) for x in (token, g, flags))], names=["deal", "token", "g", "flags"])
    got = sorted(r for b in jaccard._met([batch]) for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    seen, count = np.unique(token, return_counts=True)
    many = set(seen[count > 1].tolist())
    assert got == sorted((t, i, bool(f & 1), bool(f & 2)) for i, (t, f) in enumerate(zip(token.tolist(), flags.tolist(), strict=True)) if t in many)


def test_parity_bitmaps_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (10, 300, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, n // 5 + 1).astype(np.uint64)]))
        m = jaccard._widen([jaccard.bitmap(a), jaccard.bitmap(b)])
        assert int(np.bitwise_count(m[0] ^ m[1]).sum()) <= len(np.setxor1d(a, b))


def test_near_duplicates_keep_one_of_each_group(spark):
    long = " ".join(f"t{i}" for i in range(60))
    rows = [(3, long, 1), (1, long + " more", 2), (9, "other words stand here", 3), (10, None, 4)]
    got = jaccard.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, key int"))
    assert sorted(r["doc_id"] for r in got.collect()) == [1, 9, 10]
    assert got.columns == ["doc_id", "text", "key"]


def test_components_in_one_task_and_in_rounds_agree(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(rng.randrange(300) - 50, rng.randrange(300) - 50) for _ in range(160)], "a long, b long")
    one = sorted(map(tuple, components.components(edges).collect()))
    monkeypatch.setattr(components, "FEW_EDGES", 0)
    assert one == sorted(map(tuple, components.components(edges).collect()))


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(5, 5)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}
    assert components.components(spark.createDataFrame([], "a long, b long")).filter(F.lit(True)).count() == 0


def test_a_filter_too_large_to_broadcast_meets_its_rows_by_segment(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BITS_A_ROW", 4096)  # many segments of few rows, one of them hot
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i // 2}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.decisions(df, max_filter_bytes=1 << 14).collect()}
    groups: dict[str, list[int]] = {}
    for k, t in rows:
        groups.setdefault(t, []).append(k)
    assert got == {k: (min(groups[t]), len(groups[t])) for k, t in rows}
    plan = exact_dedup.decisions(df, max_filter_bytes=1 << 14)._jdf.queryExecution().toString()
    assert "copy" in plan
