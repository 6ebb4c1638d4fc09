"""Language identification by word-first backoff.

A word that the model knows adds its log relative frequency in each language. An unseen word is scored by its
longest character n-grams that are known, going down from MAX_GRAM to single characters: each position of the
padded word takes the longest known n-gram that begins there. Where no level knows anything a
position adds nothing to any language. The language with the largest sum wins; its score is its share under a softmax of the mean per word,
sharpened by the number of words up to SHARP.

Counts cover all training rows. The model knows a word or n-gram whose share of its level's tokens is at least
MIN_SHARE in some language, with its true share in every language; rarer ones are unseen words, which the backoff is
for. This is the least relative frequency of the model, the same at any input size: a language knows 1 / MIN_SHARE
terms a level at most, which bounds what is collected and broadcast, at 18 languages to about 100 MB.
"""

from __future__ import annotations

import math
import re
import sys
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, let_go, materialise, resident, settle, text_slices, trim

MAX_GRAM, MIN_SHARE, SHARP, CACHE_WORDS = 5, 1e-5, 8, 100_000
WORD = re.compile(r"[^\W\d_]+")
#: Fractions, superscripts, Roman numerals and the like, which `\w` takes in and which are no letters.
NUMERALS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def words(text: str) -> list[str]:
    if not (text.isascii() or NUMERALS.isdisjoint(text)):
        text = "".join(" " if c in NUMERALS else c for c in text)
    return WORD.findall(text.lower())


def train(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> Model:
    """Fit on all rows with a text and a language. Counts are added up on each task, then by term over the cluster."""

    def count(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def flush():
            for lang, c in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "word", "n"])
            held.clear()

        for batch in batches:
            for lo, hi in text_slices(batch.column(0)):
                part = batch.slice(lo, hi - lo)
                for t, language in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    held[language].update(words(t))
                if sum(map(len, held.values())) > CACHE_WORDS:
                    yield from flush()
        yield from flush()
        let_go()

    def count_grams(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 5000):
                part, held = batch.slice(lo, 5000), defaultdict(dict)
                for language, word, n in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    c, w = held[language], f"\x02{word}\x03"
                    get, size = c.get, len(w)
                    for k in range(1, MAX_GRAM + 1):
                        for a in range(size - k + 1):
                            g = w[a : a + k]
                            c[g] = get(g, 0) + n
                for language, c in held.items():
                    yield pa.RecordBatch.from_arrays([pa.array([language] * len(c), pa.string()), pa.array(list(map(len, c)), pa.int32()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], names=["lang", "k", "term", "n"])
        let_go()

    rows = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    by_word = materialise(rows.mapInArrow(count, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    by_gram = by_word.mapInArrow(count_grams, "lang string, k int, term string, n bigint").groupBy("lang", "k", "term").agg(F.sum("n").alias("n"))
    terms = materialise(by_word.select("lang", F.lit(0).alias("k"), F.col("word").alias("term"), "n").unionByName(by_gram), "terms")
    totals = terms.groupBy("lang", "k").agg(F.sum("n").alias("total"))
    shares = terms.join(F.broadcast(totals), ["lang", "k"]).select("lang", "k", "term", (F.col("n") / F.col("total")).alias("share"))
    known = shares.filter(F.col("share") >= min_share).select("k", "term").distinct()  # bounded as the model is
    got = shares.join(F.broadcast(known), ["k", "term"]).toPandas()
    model = Model.of(got, min_share)
    del got
    settle(docs.sparkSession)
    return model


class Model:
    """levels[k]: term to a row of log shares, one per language; level 0 has words. The rows of all levels are one
    matrix, so a text is a sum over rows. Words that were met are kept in two generations of CACHE_WORDS each, with the
    row that holds their sum."""

    def __init__(self, languages: list[str], levels: list[dict[str, int]], logs: np.ndarray) -> None:
        self.languages, self.levels, self.logs = languages, levels, logs
        self.grams = {g: i for level in levels[1:] for g, i in level.items()}
        self._start()

    def _start(self) -> None:
        self.at: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.seen = np.zeros((1024, len(self.languages)), np.float64)
        self.old_seen = self.seen

    @classmethod
    def of(cls, got, min_share: float) -> Model:
        languages = sorted(got["lang"].unique().tolist())
        at = {x: i for i, x in enumerate(languages)}
        floor = math.log(min_share / 10)
        levels: list[dict[str, int]] = []
        parts, n = [np.zeros((0, len(languages)))], 0
        for k in range(MAX_GRAM + 1):
            part = got[got["k"] == k]
            terms = sorted(part["term"].unique().tolist())
            index = {t: i for i, t in enumerate(terms)}
            m = np.full((len(terms), len(languages)), floor)
            if len(terms):
                m[part["term"].map(index).to_numpy(), part["lang"].map(at).to_numpy()] = np.log(part["share"].to_numpy())
            levels.append({t: n + i for t, i in index.items()})
            parts.append(m)
            n += len(terms)
        return cls(languages, levels, np.concatenate(parts))

    def rows_of(self, w: str) -> tuple[list[int], int]:
        """The rows of the matrix a word is scored by, and how many they are averaged over."""
        if (i := self.levels[0].get(w)) is not None:
            return [i], 1
        padded, out, get = f"\x02{w}\x03", [], self.grams.get
        for a in range(len(padded) - 1):  # slices end with the word, so the first is the longest there is
            if (i := get(padded[a : a + 5])) is None and (i := get(padded[a : a + 4])) is None and (i := get(padded[a : a + 3])) is None and (i := get(padded[a : a + 2])) is None and (i := get(padded[a])) is None:
                continue
            out.append(i)
        return out, len(padded) - 1

    def _remember(self, missing: set[str]) -> None:
        """Add the sums of words that have none yet, all in one go."""
        if len(self.at) > CACHE_WORDS:
            self.old, self.old_seen = self.at, self.seen
            self.at, self.seen = {}, np.zeros((1024, self.seen.shape[1]))
        known = [w for w in missing if w in self.old]
        new = [w for w in missing if w not in self.old]
        flat, counts, share = [], np.zeros(len(new), np.int64), np.ones(len(new))
        for i, w in enumerate(new):
            rows, n = self.rows_of(w)
            flat += rows
            counts[i], share[i] = len(rows), n
        sums = np.zeros((len(new), len(self.languages)))
        if flat:
            at = np.repeat(np.arange(len(new)), counts)
            values = self.logs[flat]
            for j in range(len(self.languages)):
                sums[:, j] = np.bincount(at, values[:, j], minlength=len(new)) / share
        first, last = len(self.at), len(self.at) + len(known) + len(new)
        while last > len(self.seen):
            self.seen = np.concatenate([self.seen, np.zeros_like(self.seen)])
        self.seen[first : first + len(known)] = self.old_seen[[self.old[w] for w in known]]
        self.seen[first + len(known) : last] = sums
        self.at.update(zip(known + new, range(first, last), strict=True))

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        parts = [words(t) if t else [] for t in texts]
        missing = set().union(*parts)
        if len(self.at) <= CACHE_WORDS:  # else a new generation begins: all of these texts' words move to it
            missing.difference_update(self.at)
        if missing:
            self._remember(missing)
        get, out = self.at.__getitem__, []
        for part in parts:
            if not part or not self.languages:
                out.append(("und", 0.0))
                continue
            total = self.seen[list(map(get, part))].sum(axis=0)
            z = total / len(part) * min(len(part), SHARP)
            p = np.exp(z - z.max())
            best = int(np.argmax(total))
            out.append((self.languages[best], float(p[best] / p.sum())))
        return out

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]


def predict(docs: DataFrame, model: Model, text: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """docs with lang_pred and score (0 to 1), all other columns as they were.

    A text that is null or has no letter, or a model without languages, gives `und` and 0. Equal sums go to the
    language that sorts first. Whole texts are read, rows repeated with one text get one answer, and an empty table
    gives no rows. An input column with the name of an output (in any case) gives way to it; pass other output names
    to keep it.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.levels, model.logs))
    trim()  # what pickling took

    @F.arrow_udf("lang string, score double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _cached(shared)
        for batch in batches:
            out = [x for lo, hi in text_slices(batch) for x in own.predict_all(batch.slice(lo, hi - lo).to_pylist())]
            yield pa.StructArray.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.float64())], names=["lang", "score"])
    got = fresh(docs.columns, "got_")
    run = score.asNondeterministic()  # a filter on the outcome isn't pushed below, which would score each text twice
    return docs.withColumn(got, run(F.col(text))).withColumns({lang_out: F.col(f"{got}.lang"), score_out: F.col(f"{got}.score")}).drop(got)


def _cached(shared) -> Model:
    """One model for each broadcast and worker process, with the chunks it has met."""
    return resident(("langid", shared._path), lambda: Model(*shared.value))
