"""Predicates over records: rules, scopes, calendars, feedback, adaptive sensitivity."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY, WEEK = 86400, 604800


@dataclass(frozen=True)
class Rule:
    """Conditions are alternatives: a record is suppressed if any given one holds, where the scope (if any) does."""

    actual_below: float | None = None
    actual_above: float | None = None
    diff_below: float | None = None
    relative_below: float | None = None
    hours: tuple[int, ...] = ()
    weekdays: tuple[int, ...] = ()  # Sunday is 0
    series: tuple[str, ...] = ()
    influencers: tuple[str, ...] = ()
    scope: tuple[tuple[str, tuple[str, ...], bool], ...] = ()  # field, values, include
    skip_model_update: bool = False


@dataclass(frozen=True)
class Calendar:
    """A span that is left out: once in epoch seconds, or by seconds of the day or of the week (from Sunday)."""

    start: int
    end: int
    repeat: str = "once"


def condition(rule: Rule) -> Column:
    at = F.timestamp_seconds("bucket")
    diff = F.abs(F.col("actual") - F.col("typical"))
    any_of: list[Column] = []
    if rule.actual_below is not None:
        any_of.append(F.col("actual") < rule.actual_below)
    if rule.actual_above is not None:
        any_of.append(F.col("actual") > rule.actual_above)
    if rule.diff_below is not None:
        any_of.append(diff < rule.diff_below)
    if rule.relative_below is not None:
        any_of.append((F.col("typical") != 0) & (diff / F.abs("typical") < rule.relative_below))
    if rule.hours:
        any_of.append(F.hour(at).isin(*rule.hours))
    if rule.weekdays:
        any_of.append((F.dayofweek(at) - 1).isin(*rule.weekdays))
    if rule.series:
        any_of.append(F.col("series").isin(*rule.series))
    if rule.influencers:
        any_of.append(F.exists("influencers", lambda i: i["value"].isin(*rule.influencers)))
    held = reduce(lambda a, b: a | b, any_of, F.lit(False))
    for field, values, include in rule.scope:
        inside = F.coalesce(F.col(field).isin(*values), F.lit(False))
        held = held & (inside if include else ~inside)
    return F.coalesce(held, F.lit(False))


def suppress(records: DataFrame, rules: list[Rule]) -> DataFrame:
    """records (bucket, series, actual, typical, ...) that no rule suppresses; rules that only stop learning don't."""
    active = [condition(r) for r in rules if not r.skip_model_update]
    return records.filter(~reduce(lambda a, b: a | b, active, F.lit(False)))


def in_scope(df: DataFrame, values: DataFrame, field: str, value: str, include: bool = True) -> DataFrame:
    """Rows whose field is (or isn't) in a filter list, as a semi or anti join; AQE broadcasts a list that is small."""
    return df.join(values.select(value).distinct(), df[field] == values[value], "left_semi" if include else "left_anti")


def covered(time: Column | str, calendars: list[Calendar]) -> Column:
    s = F.floor(F.unix_micros(time) / 1e6)
    out = F.lit(False)
    for c in calendars:
        if c.repeat == "once":
            out = out | ((s >= c.start) & (s < c.end))
            continue
        length = DAY if c.repeat == "daily" else WEEK
        at = F.pmod(s + (0 if c.repeat == "daily" else 4 * DAY), F.lit(length))  # 1970 began on a Thursday
        lo, hi = c.start % length, c.end % length
        out = out | (((at >= lo) & (at < hi)) if lo < hi else ((at >= lo) | (at < hi)))
    return out


def outside(df: DataFrame, calendars: list[Calendar], time: str = "time") -> DataFrame:
    return df.filter(~covered(time, calendars))


def penalised(records: DataFrame, marks: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """False-positive marks raise a key's threshold by 8 each, 40 at most."""
    n = records.join(marks, keys, "left")
    return n.filter(F.col("score") >= threshold + F.least(F.lit(40.0), 8.0 * F.coalesce("marks", F.lit(0)))).drop("marks")


def adaptive(records: DataFrame, keys: list[str], score: str, sensitivity: float, keep: int = 512, free: int = 20) -> DataFrame:
    """Of admitted records those at or above a quantile of the last `keep`, itself included; the first pass freely."""
    w = Window.partitionBy(*keys).orderBy("bucket")
    q = F.percentile(score, F.lit(sensitivity)).over(w.rowsBetween(-(keep - 1), 0))
    rows = records.withColumn("n_", F.row_number().over(w)).withColumn("q_", q)
    return rows.filter((F.col("n_") <= free) | (F.col(score) >= F.col("q_"))).drop("n_", "q_")
