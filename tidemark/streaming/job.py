"""Streaming jobs: the batch kernels as keyed state behind watermarked buckets."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.expressions import CALENDAR_ORIGIN
from tidemark.operators.kernels import TemporalModel

OUTPUT = "series string, bucket bigint, actual double, typical double, p double, score double, kind string"


def buckets(points: DataFrame, span_s: int, grace_s: int, by: str) -> DataFrame:
    """Bucket means of a stream, closed once the watermark has passed; later points are dropped by Spark."""
    w = points.withWatermark("time", f"{grace_s} seconds").groupBy(F.window("time", f"{span_s} seconds", startTime=f"{-CALENDAR_ORIGIN % span_s} seconds"), by).agg(F.avg("value").alias("v"))
    return w.select(F.col(by).alias("series"), F.unix_seconds(F.col("window.start")).alias("bucket"), "v")


def _score(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    model = pickle.loads(state.get[0]) if state.exists else TemporalModel()
    rows = pd.concat(list(frames)).sort_values("bucket")
    out = []
    for b, v in zip(rows["bucket"], rows["v"], strict=True):
        p, score, typical, _, kind = model.observe(float(v))
        out.append((key[0], b, v, typical, p, score, kind))
    state.update((pickle.dumps(model),))
    yield pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])


def score(closed: DataFrame) -> DataFrame:
    """Records of a stream of closed buckets (series, bucket, v); each series' model is its state."""
    return closed.groupBy("series").applyInPandasWithState(_score, OUTPUT, "model binary", "append", "NoTimeout")


def score_batch(closed: DataFrame) -> DataFrame:
    """The same over a batch: what the stream gives when all of it has arrived."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, out = TemporalModel(), []
        pdf = pdf.sort_values("bucket")
        for s, b, v in zip(pdf["series"], pdf["bucket"], pdf["v"], strict=True):
            p, score_, typical, _, kind = m.observe(float(v))
            out.append((s, b, v, typical, p, score_, kind))
        return pd.DataFrame(out, columns=[x.split()[0] for x in OUTPUT.split(", ")])

    return closed.groupBy("series").applyInPandas(run, OUTPUT)
