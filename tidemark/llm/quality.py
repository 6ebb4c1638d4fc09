"""Quality classifier: a support vector machine over naive Bayes features.

Features are indicators of hashed n-grams: of the text's bytes, 1 to MAX_GRAM of them, and of the sequence that
says for each word and each line whether it repeats the one before. Each indicator is scaled by the log ratio of
its smoothed share in either class, the vector is brought to length one, and a linear model with hinge loss is
fitted by dual coordinate descent; its weights are drawn towards their mean magnitude (BETA). A sigmoid, fitted
on rows that the descent did not see, turns margins into scores.

The class counts cover all labelled rows. The descent reads a sample of at most SAMPLE labelled rows, those with
the smallest hash of their key; SAMPLE is the documented bound of what the driver gathers (about 12 KB a row).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise

BITS, MAX_GRAM, SAMPLE, EPOCHS, COST, BETA, SMOOTH, CHUNK = 17, 3, 6000, 20, 1.0, 0.5, 1.0, 1 << 13
SIZE = 1 << BITS
THRESHOLD = 0.3
BROADCAST_LABELS = 2_000_000


def _spread(h: np.ndarray) -> np.ndarray:
    return (h * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _repeats(parts: list[str], salt: int) -> list[np.ndarray]:
    """Hashes of the n-grams, n from 1 to 6, of the sequence of repeats among neighbouring parts."""
    same = np.fromiter((a == b for a, b in zip(parts, parts[1:], strict=False)), np.uint32, max(0, len(parts) - 1))
    out, code = [], np.zeros(len(same), np.uint32)
    for n in range(1, 7):
        if len(same) < n:
            break
        code = same if n == 1 else code[:-1] * np.uint32(2) + same[n - 1 :]
        out.append(np.unique(code) + np.uint32((salt + n) << 24))
    return out


class Features:
    """Sorted distinct feature numbers of texts; keeps one scratch array."""

    def __init__(self) -> None:
        self.seen = np.zeros(SIZE, bool)

    def __call__(self, text: str | None) -> np.ndarray:
        text = text or ""
        b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
        seen, h = self.seen, b
        for n in range(1, MAX_GRAM + 1):
            if len(b) < n:
                break
            if n > 1:
                h = h[:-1] * np.uint32(259) + b[n - 1 :]
            seen[_spread(h + np.uint32(n << 27))] = True
        for codes in _repeats(text.split(), 0x40) + _repeats(text.split("\n"), 0x60):
            seen[_spread(codes)] = True
        at = np.flatnonzero(seen)
        seen[at] = False
        return at


class Model:
    def __init__(self, ratio: np.ndarray, weight: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.ratio, self.weight, self.bias, self.slope, self.shift = ratio, weight, bias, slope, shift
        self.product = ratio * weight
        self.square = ratio * ratio

    def margin(self, at: np.ndarray) -> float:
        norm = float(self.square[at].sum()) ** 0.5
        return float(self.product[at].sum()) / (norm or 1.0) + self.bias

    def score(self, at: np.ndarray) -> float:
        return 1 / (1 + float(np.exp(-np.clip(self.slope * self.margin(at) + self.shift, -500, 500))))


def with_labels(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality") -> DataFrame:
    """The labelled rows of docs with their label; a key labelled twice gives two rows.

    Labels are narrow and are broadcast while there are at most BROADCAST_LABELS, so texts stay where they are;
    beyond that both sides shuffle by key.
    """
    labels = labels.filter(F.col(label).isNotNull()).select(key, label)
    return docs.join(F.broadcast(labels) if labels.count() <= BROADCAST_LABELS else labels, key)


def class_counts(rows: DataFrame, text: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    """For each class, in how many texts each feature occurs, over all rows; and the number of rows of each class.

    Tasks send dense chunks of CHUNK features, which are added up by chunk, each in one pass of bounded memory.
    """

    def count(batches):
        features, total, n = Features(), np.zeros((2, SIZE), np.int64), np.zeros(2, np.int64)
        for batch in batches:
            for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total[y, features(t)] += 1
                n[y] += 1
        if n.any():
            for c in range(SIZE // CHUNK):
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([total[:, c * CHUNK : (c + 1) * CHUNK].tobytes()], pa.binary())], names=["chunk", "counts"])
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int32()), pa.array([n.tobytes()], pa.binary())], names=["chunk", "counts"])

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for c, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = np.frombuffer(x, np.int64)
                held[c] = held[c] + x if c in held else x
        for c, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=["chunk", "counts"])

    schema = "chunk int, counts binary"
    parts = rows.select(F.col(text), F.col(label).cast("int")).mapInArrow(count, schema)
    got = {r["chunk"]: np.frombuffer(bytes(r["counts"]), np.int64) for r in parts.repartition(SIZE // CHUNK, "chunk").mapInArrow(add, schema).collect()}
    total = np.zeros((2, SIZE))
    for c, x in got.items():
        if c >= 0:
            total[:, c * CHUNK : (c + 1) * CHUNK] = x.reshape(2, CHUNK)
    return total, got.get(-1, np.zeros(2, np.int64))


def descend(x: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS, seed: int = 7) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; the last weight, of a constant 1, is the bias."""
    rng = np.random.default_rng(seed)
    w, bias, alpha = np.zeros(len(ratio)), 0.0, np.zeros(len(x))
    values = []
    for at in x:
        v = ratio[at]
        values.append(v / (float(v @ v) ** 0.5 or 1.0))
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(x)):
            at, v = x[i], values[i]
            gradient = y[i] * (float(w[at] @ v) + bias) - 1
            new = min(max(alpha[i] - gradient / (2.0 if len(at) else 1.0), 0.0), cost)  # v has length 1, the constant too
            if (step := (new - alpha[i]) * y[i]) != 0:
                w[at] += step * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def platt(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """The sigmoid's slope and shift by Newton steps, with the usual smoothed targets."""
    pos, neg = float((y > 0).sum()), float((y <= 0).sum())
    t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -500, 500)))
        g = np.array([((p - t) * margin).sum() + 1e-3 * a, (p - t).sum()])
        s = p * (1 - p)
        h = np.array([[(s * margin * margin).sum() + 1e-3, (s * margin).sum()], [(s * margin).sum(), s.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return max(float(a), 1e-3), float(b)


def train(rows: DataFrame, text: str = "text", label: str = "quality", key: str = "doc_id", sample: int = SAMPLE) -> Model:
    """Fit on rows with a text column and a label of 0 or 1; rows with another label, or none, are left out.

    A null text counts as empty. Without rows of both classes every score is the share of class 1 (0.5 without rows).
    """
    rows = materialise(rows.filter(F.col(label).isin(0, 1)).select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(label).cast("int").alias("label")), "labelled")
    total, n = class_counts(rows, "text", "label")
    share = (total + SMOOTH) / (total + SMOOTH).sum(axis=1, keepdims=True)
    ratio = np.log(share[1] / share[0])
    if not n.all():
        odds = np.log((n[1] + 1) / (n[0] + 1))
        return Model(ratio * 0, ratio * 0, 0.0, 1.0, float(odds))

    def featurise(batches):
        features = Features()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([features(t).astype("<i4").tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["label", "at"])

    chosen = rows.withColumn("h", F.xxhash64("key", "text"))
    if (fraction := sample / int(n.sum())) < 1:  # a first cut by hash, so that few rows are sorted
        chosen = chosen.filter(F.col("h") < int(-(2**63) + min(1.0, 1.5 * fraction) * 2**64 - 2**11))
    got = chosen.orderBy("h").limit(sample).select("label", "text").mapInArrow(featurise, "label int, at binary").collect()
    x = [np.frombuffer(bytes(r["at"]), "<i4") for r in got]
    y = np.array([1.0 if r["label"] else -1.0 for r in got])
    held = np.arange(len(x)) % 5 == 4
    w, bias = descend([x[i] for i in np.flatnonzero(~held)], y[~held], ratio)
    mean = np.abs(w).mean()
    model = Model(ratio, BETA * w + (1 - BETA) * mean, bias, 1.0, 0.0)
    if held.any() and len(set(y[held].tolist())) == 2:
        model.slope, model.shift = platt(np.array([model.margin(x[i]) for i in np.flatnonzero(held)]), y[held])
    return model


def score(docs: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """docs with a score from 0 to 1, higher where class 1 is likelier. Null counts as empty; other columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        features, own = Features(), shared.value
        return pd.Series([own.score(features(t)) for t in s], dtype="float64")

    return docs.withColumn(out, run(F.col(text)))
