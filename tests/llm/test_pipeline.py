"""The pipeline against a plain composition of what each stage must do, and the registered queries' names."""

import re

import corpus_pipeline as C


def test_stages_and_registration():
    import __spark_entry__ as entry

    assert [s[0] for s in C.STAGES] == ["language_id", "exact_dedup", "jaccard_join", "mixing", "bpe"]
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))


def test_pipeline_keeps_and_drops(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    extra = spark.createDataFrame([(10**6, "12 34 !!", "en", "src1", 8), (10**6 + 1, None, "en", "src1", 0), (10**6 + 2, "", None, None, 0)], docs.schema)
    kept = C.identify_language(spark, docs.unionByName(extra), sf)
    assert kept.columns == docs.columns and kept.count() == docs.count()
    once = C.drop_exact_duplicates(spark, kept, sf).toPandas()
    first = {}
    for k, t in sorted(kept.select("doc_id", "text").collect()):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), k)
    assert sorted(once["doc_id"]) == sorted(first.values())
    near = C.drop_near_duplicates(spark, spark.createDataFrame(once, docs.schema), sf)
    assert set(near.toPandas()["doc_id"]) <= set(once["doc_id"]) and near.columns == docs.columns
    tokens = C.encode_tokens(spark, C.mix_sources(spark, near, sf), sf)
    assert tokens.filter("not round_trip").count() == 0 and tokens.count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in C.STAGES:
        got = stage(spark, docs, "")
        assert got.count() == 0
