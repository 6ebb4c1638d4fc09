"""Personal data: patterns, and information-theoretic sanitisation of the terms that give them away.

Base detectors find e-mail addresses, IP addresses, card and phone numbers. What they find are the protected
entities. Over the whole corpus, terms are counted in windows of WINDOW words around each entity: a term t
reveals an entity e as far as seeing t removes the uncertainty about e,

    disclosure(e, t) = log2(P(e | t) / P(e)) / -log2(P(e)),

which is 1 where t occurs with e only. Documents count once for each distinct text (white space normalised), so
copies of one add no evidence and take none away: P(e | t) is the number of documents with both in one window over
the number of documents that hold t. A pair needs MIN_SUPPORT distinct windows. Terms
whose disclosure reaches GENERALISE for some entity are spans of kind ``term`` wherever they occur; sanitise()
puts the kind of what they reveal in their place, and drops them altogether from REMOVE on.

Counting goes by (entity, term) with partial aggregation, so a hot entity is no hot task. Terms are broadcast in
blocks of at most BLOCK_TERMS; more terms take more passes, so no bound cuts any off.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, materialise
from .exact_dedup import distinct_texts

KINDS = ("email", "ip", "card", "phone", "term")
WINDOW, MIN_SUPPORT, GENERALISE, REMOVE, BLOCK_TERMS = 8, 3, 0.9, 0.97, 500_000

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match can't begin inside a run of digits: there it would have begun at the run's start, or fail alike.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
DIGIT = re.compile(r"[0-9]")
_NOT_DIGITS = {ord(c): None for c in " ().-+"}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """As the pattern's leftmost non-overlapping matches, in linear time: the local part is the run before an @."""
    done = 0
    for m in DOMAIN.finditer(text):
        a = m.start()
        while a > done and text[a - 1] in LOCAL:
            a -= 1
        if a < m.start():
            yield a, m.end()
            done = m.end()


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, index of kind, end) of the base detectors' spans, sorted."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in emails(text)]
    if DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split("."))]
        for m in CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].translate(_NOT_DIGITS)
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(m[0].translate(_NOT_DIGITS)) <= 15]
    out.sort()
    return out


def entity(kind: int, value: str) -> str:
    """An entity's name: kind and value without case and separators."""
    return f"{KINDS[kind]}:{value.lower() if kind < 2 else value.translate(_NOT_DIGITS)}"


def contexts(text: str, window: int = WINDOW) -> list[tuple[str, list[str], int]]:
    """Each entity of a text with the distinct terms of the window around it and a hash of the window.

    The window is the last `window` terms that end before the entity and the first that begin after it, however far
    away; terms are those of the whole folded text, as in the counts.
    """
    out = []
    if not (spans := base_spans(text)):
        return out
    folded = text.casefold()
    # where folding makes a text longer (ß), offsets are carried over
    at = None if len(folded) == len(text) else [0, *accumulate(len(c.casefold()) for c in text)]
    found = list(TERM.finditer(folded))
    starts, ends = [m.start() for m in found], [m.end() for m in found]
    for a, k, b in spans:
        lo, hi = (a, b) if at is None else (at[a], at[b])
        i, j = bisect_right(ends, lo), bisect_left(starts, hi)
        near = [m[0] for m in found[max(0, i - window) : i]] + [m[0] for m in found[j : j + window]]
        h = int.from_bytes(hashlib.blake2b("\0".join(near).encode("utf-8", "replace"), digest_size=8).digest(), signed=True)
        out.append((entity(k, text[a:b]), sorted(set(near)), h))
    return out


def revealing_terms(docs: DataFrame, text: str = "text", min_support: int = MIN_SUPPORT, threshold: float = GENERALISE) -> DataFrame:
    """(term, kind, disclosure): terms that reveal an entity, with the kind of the one they reveal most."""

    def pairs(batches):
        for batch in batches:
            e, t, h, d = [], [], [], []
            for x in batch.column(0).to_pylist():
                met: set[tuple[str, str | None]] = set()
                for name, terms, ctx in contexts(x):
                    for term in (None, *terms):  # null: the entity itself
                        e.append(name)
                        t.append(term)
                        h.append(ctx)
                        d.append(int((name, term) not in met))  # a document counts at the first window that holds both
                        met.add((name, term))
            yield pa.RecordBatch.from_arrays([pa.array(e, pa.string()), pa.array(t, pa.string()), pa.array(h, pa.int64()), pa.array(d, pa.int64())], names=["entity", "term", "ctx", "first"])

    texts = distinct_texts(docs.filter(F.col(text).isNotNull()).select(F.col(text).alias("text")))
    # a text without @ or digit has no entity: it doesn't leave the JVM
    found = texts.filter(F.col("text").rlike("[@0-9]")).mapInArrow(pairs, "entity string, term string, ctx bigint, first bigint")
    windows = found.groupBy("entity", "term", "ctx").agg(F.sum("first").alias("n"))
    seen = windows.groupBy("entity", "term").agg(F.sum("n").alias("n"), F.count("*").alias("windows"))
    seen = materialise(seen.filter(F.col("windows") >= min_support).drop("windows"), "pairs")
    both = seen.filter("term is not null")
    terms = materialise(both.select("term").distinct(), "terms")
    counts = None
    for block in _blocks(terms):
        one = _documents_with(texts, block)
        counts = one if counts is None else counts.unionByName(one)
    n_docs = texts.count()
    schema = "term string, kind string, disclosure double"
    if counts is None:
        return docs.sparkSession.createDataFrame([], schema)
    alone = seen.filter("term is null").select("entity", (F.col("n") / n_docs).alias("p"))
    info = both.join(alone, "entity").join(counts, "term")
    p_given = F.least(F.lit(1.0), F.col("n") / F.col("docs"))
    info = info.withColumn("disclosure", F.when(F.col("p") < 1, F.log2(p_given / F.col("p")) / -F.log2("p"))).filter(F.col("disclosure") >= threshold)
    return materialise(info.groupBy("term").agg(F.max_by(F.split_part("entity", F.lit(":"), F.lit(1)), F.struct("disclosure", "entity")).alias("kind"), F.max("disclosure").alias("disclosure")), "revealing")


def _blocks(terms: DataFrame) -> Iterator[DataFrame]:
    """The terms in blocks of about BLOCK_TERMS at most."""
    n = terms.count()
    blocks = -(-2 * n // BLOCK_TERMS)
    for b in range(blocks):
        yield terms.filter(F.pmod(F.xxhash64("term"), F.lit(blocks)) == b)


def _documents_with(texts: DataFrame, block: DataFrame) -> DataFrame:
    """How many of the texts, which are distinct, hold each term of a block."""
    shared = texts.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in block.collect()))

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total.update(shared.value.intersection(TERM.findall(x.casefold())))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["term", "n"])

    return materialise(texts.mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("docs")), "holding")


def _find(texts: Column, terms: dict[str, tuple[str, float]] | None, shared) -> Column:
    """The spans of a text column as kind:start:end, comma-joined; base spans where no terms are given."""

    @F.pandas_udf("string")
    def base(s: pd.Series) -> pd.Series:
        return pd.Series([",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in base_spans(t)) for t in s], dtype=object)

    @F.pandas_udf("string")
    def more(s: pd.Series) -> pd.Series:
        held, out = shared.value, []
        for t in s:
            folded = t.casefold()
            if len(folded) == len(t) and held.isdisjoint(TERM.findall(folded)):
                out.append("")
                continue
            taken = np.zeros(len(t) + 1, bool)
            for a, _, b in base_spans(t):
                taken[a:b] = True
            out.append(",".join(f"term:{m.start()}:{m.end()}" for m in TERM.finditer(t) if m[0].casefold() in held and not taken[m.start() : m.end()].any()))
        return pd.Series(out, dtype=object)

    return base(texts) if terms is None else more(texts)


def detect(docs: DataFrame, text: str = "text", out: str = "pii_spans", terms: DataFrame | None = None) -> DataFrame:
    """docs with an array of spans (kind, start, end in code points, end exclusive), by start, then kind.

    Base spans keep to their patterns, per kind leftmost and not overlapping; matches that fail a check are dropped
    without retry. Terms that reveal entities (by default those of docs themselves) add spans of kind `term`
    outside the base spans. A null or empty text has none. Whole texts are read; other columns stay.
    """
    if terms is None:
        terms = revealing_terms(docs, text)
    found = F.coalesce(F.col(text), F.lit(""))
    got = fresh(docs.columns, "base_")
    rows, columns = docs.withColumn(got, _find(found, None, None)), [got]
    for block in _blocks(terms.select("term")):
        shared = docs.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in block.collect()))
        columns.append(fresh(rows.columns, f"term{len(columns)}_"))
        rows = rows.withColumn(columns[-1], _find(found, {}, shared))
    each = F.filter(F.flatten(F.array(*(F.split(c, ",") for c in columns))), lambda x: x != "")
    order = F.array(*map(F.lit, KINDS))

    def span(x: Column) -> Column:
        part = F.split(x, ":")
        return F.struct(part[1].cast("int").alias("start"), F.array_position(order, part[0]).cast("int").alias("rank"), part[2].cast("int").alias("end"), part[0].alias("kind"))

    spans = F.transform(F.sort_array(F.transform(each, span)), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return rows.withColumn(out, spans).drop(*columns)


def sanitise(docs: DataFrame, text: str = "text", remove: float = REMOVE) -> DataFrame:
    """docs with personal data replaced in text: entities by their kind in brackets, revealing terms by the kind of
    what they reveal, or by nothing from a disclosure of `remove` on. A null text stays null."""
    terms = revealing_terms(docs, text)
    spans, kept = fresh(docs.columns, "spans_"), None
    rows = detect(docs, text, spans, terms)
    kept = [docs.sparkSession.sparkContext.broadcast({r["term"]: "" if r["disclosure"] >= remove else f"[{r['kind'].upper()}-TERM]" for r in terms.join(b, "term").collect()}) for b in _blocks(terms.select("term"))]

    @F.pandas_udf("string")
    def replace(s: pd.Series, marked: pd.Series) -> pd.Series:
        out = []
        for t, m in zip(s, marked, strict=True):
            if t is None or not m:
                out.append(t)
                continue
            parts, at = [], 0
            for kind, a, b in (x.split(":") for x in m.split(",")):
                a, b = int(a), int(b)
                if b <= at:
                    continue
                parts.append(t[at : max(a, at)])
                if a >= at:  # of overlapping spans the first gives the label
                    word = t[a:b].casefold()
                    parts.append(f"[{kind.upper()}]" if kind != "term" else next(k.value[word] for k in kept if word in k.value))
                at = b
            out.append("".join(parts) + t[at:])
        return pd.Series(out, dtype=object)

    return rows.withColumn(text, replace(F.col(text), joined(F.col(spans)))).select(*docs.columns)


def joined(spans: Column, base_only: bool = False) -> Column:
    """Spans as kind:start:end, comma-joined."""
    if base_only:
        spans = F.filter(spans, lambda s: s["kind"] != "term")
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
