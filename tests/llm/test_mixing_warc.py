"""Mixing keeps its targets; WARC archives are an exact round trip."""

import gzip
import hashlib

import numpy as np
import pytest

from tidemark.llm import mixing, warc
from tidemark.llm.common import scratch_path


def test_targets_water_fill():
    got = mixing.targets([100, 50, 10], [3, 1, 2])
    assert sum(got) == pytest.approx(240) and all(t <= 2 * s + 1e-9 for t, s in zip(got, [100, 50, 10], strict=True))
    assert got[2] == 20
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [1, 1]) == [0, 0]


def test_split_tree_is_exact():
    q = np.array([100, 7, 0, 33])
    t = mixing.split_tree(q, 6, np.random.default_rng(1))
    assert (t.sum(axis=0) == q).all() and t.min() >= 0
    assert t.sum(axis=1).max() - t.sum(axis=1).min() <= 3


def test_plan_meets_targets_and_reruns_agree(spark):
    rng = np.random.default_rng(2)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), [None, "a", "b", "é"][int(rng.choice(4, p=[0.1, 0.5, 0.3, 0.1]))], 1) for i in range(4000)]
    rows += [(5000, None, "a", 1), (5001, " \n", "b", 1), (5000, None, "a", 1), (None, "x y", "a", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mixing.plan(docs).toPandas()
    assert len(got) == len(rows) and (got["taken"] <= 2 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= 60
    key = lambda d: sorted(map(str, zip(d["doc_id"], d["size"], d["copies"], strict=True)))
    assert key(got) == key(mixing.plan(docs.repartition(7)).toPandas())
    mixed = mixing.mix(docs, shard_out="shard")
    assert mixed.columns == [*docs.columns, "shard"] and mixed.count() == got["copies"].sum()


def test_every_shard_has_the_target_mixture(spark):
    docs = spark.range(300_000).selectExpr("id AS doc_id", "repeat('w ', int(1 + id % 9)) AS text", "substr('abc', int(1 + id % 3), 1) AS source")
    got = mixing.plan(docs, weights=(3.0, 1.0, 1.5), share=0.6, n_shards=4).toPandas()  # every source by a partial pass
    assert set(got["copies"]) == {0, 1, 2} and (got["copies"] == got["shards"].map(len)).all()
    goal = got.groupby("source")["target"].first()
    dealt = got[["source", "size", "shards"]].explode("shards").dropna()
    assert dealt["size"].sum() == got["taken"].sum()
    held = dealt.groupby(["shards", "source"])["size"].sum().unstack(fill_value=0)
    assert held.shape == (4, 3)
    # a shard draws some 600 blocks, so the deviation of a share is 0.02 at most; without replacement it is less
    assert (abs(held.div(held.sum(axis=1), axis=0) - goal / goal.sum()) < 0.06).all(axis=None)
    assert (abs(held.sum(axis=1) / held.to_numpy().sum() - 0.25) < 0.02).all()


def test_quota_of_a_pass_is_what_it_takes():
    assert mixing.pass_quotas([0, 1, 2], [1000, 50, 7], [400, 3, 1], 2).tolist() == [[400, 50, 7], [0, 3, 7]]


def test_pipeline_keeps_the_shards(spark):
    import corpus_pipeline as C

    docs = spark.createDataFrame([(i, f"some text {i}", "en", f"s{i % 2}", 11) for i in range(600)], "doc_id long, text string, lang string, source string, n_chars long")
    mixed = C.mix_sources(spark, docs, "")
    assert mixed.columns == [*docs.columns, "shard"] and mixed.select("shard").distinct().count() > 4
    assert "shard" in C.encode_tokens(spark, mixed, "").columns


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_archives_round_trip(spark):
    big, other = "<p>" + "ü" * 600, "x" * 1000
    rows = [(1, "http://a/b?q#f", big, 0), (5, "http://c", big, 0), (3, None, big, 0), (2, "http://d/\r\nX: y", "small", 0), (4, "u", "small", 0), (6, "v", None, 0), (7, "w", "WARC/1.1\r\n\r\n", 0), (8, "w", other, 0), (8, "w", other, 0), (9, "z", "y" * 999, 0), (10, "z", "y" * 999, 0)]
    folder = scratch_path(spark, "warc")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, sha1 int"), folder)
    got = warc.read(spark, folder, bodies=True).collect()
    assert len(got) == len(rows)
    for r in got:
        html = next(h for k, _, h, _ in rows if k == r["page_id"]) or ""
        assert r["payload_bytes"] == len(html.encode()) and r["payload_digest"] == hashlib.sha1(html.encode()).hexdigest()
        want = ("revisit", 5) if r["page_id"] in (1, 3) else ("response", None)
        assert (r["record_type"], r["refers_to"]) == want
        assert r["request"]["http_head"].startswith("GET ") and r["metadata"]["fields"]["page_id"] == str(r["page_id"])
        if want[0] == "response":
            assert bytes(r["body"]) == html.encode()


def test_files_are_plain_gzip_members(spark, tmp_path):
    folder = f"file://{tmp_path}/w"
    warc.write(spark.createDataFrame([(1, "u", "a"), (2, "u", "b")], "page_id long, url string, html string").coalesce(1), folder)
    whole = b"".join(gzip.decompress(p.read_bytes()) for p in (tmp_path / "w").glob("part-*"))
    assert whole.count(b"WARC/1.1\r\n") == 6 and whole.startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_damage_is_noticed():
    good = warc.transaction(1, "u", b"payload", None, "2000-01-01T00:00:00Z")
    assert len(list(warc.records(memoryview(good)))) == 3
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(memoryview(good[:-5])))
    with pytest.raises(ValueError, match="no WARC record"):
        list(warc.records(memoryview(b"plain text")))


def test_empty_pages(spark):
    folder = scratch_path(spark, "none")
    warc.write(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read(spark, folder).count() == 0


def test_links_count_in_both_directions_and_through_the_request(spark, tmp_path):
    def record(name, kind, *to):
        head = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:{name}>"), *(("WARC-Concurrent-To", f"<urn:{t}>") for t in to)]
        return warc._member([*head, ("Content-Type", "application/warc-fields" if kind == "metadata" else f"application/http; msgtype={kind}")], b"x: y\r\n\r\n")

    (tmp_path / "w").mkdir()
    parts = [record("a", "response", "a-req", "a-meta"), record("a-req", "request"), record("a-meta", "metadata", "a"), record("a-next", "metadata", "a-req")]
    parts += [record("b-meta", "metadata", "b-req"), record("b-req", "request", "b"), record("b", "revisit", "b-req")]
    parts += [record("c", "response"), record("c-req", "request", "c-meta", "c"), record("c-meta", "metadata")]
    parts += [record("d", "response"), record("lost", "request", "gone"), record("lost-meta", "metadata", "lost")]
    (tmp_path / "w" / "part-0").write_bytes(b"".join(parts))
    got = {r["record_id"][5:-1]: r for r in warc.assemble(warc.read_records(spark, f"file://{tmp_path}/w")).collect()}
    held = {k: [r[c] and r[c]["record_id"][5:-1] for c in ("request", "metadata")] + [x["record_id"][5:-1] for x in r["others"]] for k, r in got.items()}
    assert held == {"a": ["a-req", "a-meta", "a-next"], "b": ["b-req", "b-meta"], "c": ["c-req", "c-meta"], "d": [None, None]}
