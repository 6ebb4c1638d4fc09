"""The corpus pipeline: language identification, exact dedup, near dedup, mixing, tokens.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents; mixing adds
`shard`, the output shard of each copy, which the tokens keep.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, exact_dedup, jaccard, langid, mixing
from tidemark.llm.common import fresh, materialise
from tidemark.llm.queries import vocabulary

#: A language is accepted from this score on; texts without a letter have none.
MIN_LANGUAGE_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't clear go, null texts and texts without a letter among them; a missing lang is
    filled in with the prediction. Repeated rows are decided alike; without any lang all documents go."""
    pred, score = fresh(docs.columns, "pred_"), fresh(docs.columns, "pred_score_")
    got = langid.predict(docs, langid.train(docs), lang_out=pred, score_out=score)
    got = got.filter((F.col(pred) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE))
    return got.withColumn("lang", F.coalesce("lang", pred)).select(*docs.columns)


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by 5-word shingles at a Jaccard similarity of 0.8 or more one document stays."""
    return jaccard.drop_near_duplicates(docs, words=5, num=80, den=100)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mixture takes it: not at all, once or twice; rows lie by output shard."""
    return mixing.mix(docs, shard_out="shard")


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every whole text, and whether decoding them gives the text back."""
    shard = [c for c in docs.columns if c == "shard"]
    rows = bpe.encode_checked(docs.select("doc_id", "lang", "source", "text", *shard), vocabulary())
    return rows.select("doc_id", "lang", "source", *shard, F.size("ids").cast("long").alias("n_tokens"), "ids", "round_trip")


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_duplicates),
    ("jaccard_join", drop_near_duplicates),
    ("mixing", mix_sources),
    ("bpe", encode_tokens),
]

#: SQL has no way to train the language model, draw the mixture or merge symbols; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
