"""Scalar functions as column expressions: they stay in the JVM and inside generated code."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCORE_RANGE = 12.0  # severities are capped at a probability of 1e-12
MAD_SCALE = 1.4826
EARTH_KM = 6371.0088
#: Seconds from the calendar's first day, 0001-01-01, to 1970-01-01: buckets align to the former.
CALENDAR_ORIGIN = 62135596800


#: The variable parts of log messages, in the order they are masked.
MASKS = [
    r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    r"\b0x[0-9a-fA-F]+\b",
    r"\b[0-9]+(\.[0-9]+)?\b",
]


def _c(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clamp(x: Column | str, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), _c(x)))


def score_from_p(p: Column | str) -> Column:
    """0 to 100 from a probability: minus its decimal logarithm over twelve decades."""
    p = _c(p)
    return F.when(p <= 0, 100.0).when(p >= 1, 0.0).otherwise(clamp(-F.log10(p) / SCORE_RANGE * 100, 0, 100))


def p_from_score(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s <= 0, 1.0).when(s >= 100, 1e-12).otherwise(F.pow(F.lit(10.0), -s * SCORE_RANGE / 100))


def erfc(x: Column | str) -> Column:
    """Complementary error function by the classic rational-exponent fit, relative error below 1.2e-7 everywhere."""
    x = _c(x)
    z = F.abs(x)
    t = 1 / (1 + 0.5 * z)
    #: The coefficients of that fit, highest power first.
    c = [0.17087277, -0.82215223, 1.48851587, -1.13520398, 0.27886807, -0.18628806, 0.09678418, 0.37409196, 1.00002368]
    poly = reduce(lambda acc, k: F.lit(k) + t * acc, c[1:], F.lit(c[0]))
    y = t * F.exp(-z * z - 1.26551223 + t * poly)
    return F.when(x >= 0, y).otherwise(2 - y)


def normal_sf(z: Column | str) -> Column:
    return 0.5 * erfc(_c(z) / math.sqrt(2))


def z_probability(z: Column | str, side: str = "both") -> Column:
    """Tail probability of a z score; a one-sided detector ignores deviations to the other side."""
    z = _c(z)
    if side == "both":
        return F.least(F.lit(1.0), 2 * normal_sf(F.abs(z)))
    return normal_sf(F.greatest(F.lit(0.0), z if side == "high" else -z))


def chi2_sf_even(x: Column | str, half_dof: int) -> Column:
    """Upper tail of chi square with 2 * half_dof degrees of freedom, in closed form."""
    h = _c(x) / 2
    term, total = F.lit(1.0), F.lit(1.0)
    for i in range(1, half_dof):
        term = term * h / i
        total = total + term
    return F.least(F.lit(1.0), F.exp(-h) * total)


def clean_p(p: Column | str) -> Column:
    """Probabilities into (0, 1]; what is null or not a number counts as 1."""
    p = _c(p)
    return F.when(p.isNull() | F.isnan(p), 1.0).otherwise(clamp(p, 1e-300, 1.0))


def fisher(*ps: Column | str) -> Column:
    return chi2_sf_even(reduce(lambda a, b: a + b, [-2 * F.log(clean_p(p)) for p in ps]), len(ps))


def cauchy(*ps: Column | str, weights: list[float] | None = None) -> Column:
    """Weighted Cauchy combination; below 1e-15 the tangent is replaced by its asymptote."""
    w = weights or [1.0] * len(ps)
    total = sum(w)
    tan = lambda p: F.when(p < 1e-15, 1 / (p * math.pi)).otherwise(F.tan((0.5 - p) * math.pi))
    t = reduce(lambda a, b: a + b, [tan(clean_p(p)) * (k / total) for p, k in zip(ps, w, strict=True)])
    return clamp(F.when(t > 1e15, 1 / (t * math.pi)).otherwise(0.5 - F.atan(t) / math.pi), 0, 1)


def harmonic(*ps: Column | str) -> Column:
    return F.least(F.lit(1.0), len(ps) / reduce(lambda a, b: a + b, [1 / clean_p(p) for p in ps]))


def normal_cdf(z: Column | str) -> Column:
    return 1 - normal_sf(z)


def vote(k: int, tau: float, *ps: Column | str) -> Column:
    """Whether at least k of the probabilities lie below tau."""
    return reduce(lambda a, b: a + b, [F.when(clean_p(p) < tau, 1).otherwise(0) for p in ps]) >= k


def majority(*ps: Column | str) -> Column:
    """agree() with the least k that is more than half."""
    return agree((len(ps) + 2) // 2, *ps)


def sign_test_span(p: Column | str, span: int) -> Column:
    """Probability that the least of `span` uniform values is as small as p."""
    return clamp(1 - F.pow(1 - clean_p(p), F.lit(span)), 1e-300, 1.0)


def agree(k: int, *ps: Column | str) -> Column:
    """Probability that k of m uniform values are as small as the k-th smallest here (a binomial sum)."""
    m = len(ps)
    x = F.get(F.array_sort(F.array(*map(clean_p, ps))), F.lit(k - 1))
    return reduce(lambda a, b: a + b, [math.comb(m, j) * F.pow(x, F.lit(j)) * F.pow(1 - x, F.lit(m - j)) for j in range(k, m + 1)])


def sidak(p: Column | str, n: Column | str) -> Column:
    return F.least(F.lit(1.0), -F.expm1(_c(n) * F.log1p(-F.least(clean_p(p), F.lit(1 - 1e-16)))))


def haversine_km(lat1: Column | str, lon1: Column | str, lat2: Column | str, lon2: Column | str) -> Column:
    a, b = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((b - a) / 2), F.lit(2)) + F.cos(a) * F.cos(b) * F.pow(F.sin((F.radians(_c(lon2)) - F.radians(_c(lon1))) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def bucket_of(time: Column | str, span_s: int) -> Column:
    """Start of the bucket in epoch seconds; buckets align to the calendar's first day."""
    s = F.unix_micros(_c(time))
    shift = CALENDAR_ORIGIN % span_s
    return (F.floor((s / 1_000_000 + shift) / span_s) * span_s - shift).cast("long")


def let(value: Column, body) -> Column:
    """body(value) with value worked out once: Spark would else repeat it wherever the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def array_median(a: Column) -> Column:
    """Exact median of an array of doubles, the mean of both middle values where there are two."""
    n = F.size(a)
    middle = lambda s: (F.get(s, ((F.size(s) - 1) / 2).cast("int")) + F.get(s, (F.size(s) / 2).cast("int"))) / 2
    return F.when(n == 0, F.lit(None).cast("double")).otherwise(let(F.array_sort(a), middle))


def array_mad(a: Column, centre: Column) -> Column:
    return let(centre, lambda c: array_median(F.transform(a, lambda x: F.abs(x - c))))


def mask_template(message: Column | str) -> Column:
    """A log message with its variable parts masked and white space single."""
    c = _c(message)
    for pattern in MASKS:
        c = F.regexp_replace(c, pattern, "<*>")
    return F.trim(F.regexp_replace(c, r"[ \t\r\n]+", " "))


def normalise_path(url: Column | str) -> Column:
    """The path of a URL without query; segments that are mostly digits, or long and hexadecimal, become :id."""
    path = F.split_part(F.regexp_replace(F.regexp_replace(_c(url), r"^[a-z]+://[^/?#]*", ""), r"[?#].*$", ""), F.lit("?"), F.lit(1))
    digits = lambda s: F.length(F.regexp_replace(s, "[^0-9]", ""))
    variable = lambda s: (F.length(s) > 0) & ((digits(s) * 2 >= F.length(s)) | ((F.length(s) >= 16) & s.rlike("^[0-9a-fA-F-]+$")))
    return F.array_join(F.transform(F.split(path, "/"), lambda s: F.when(variable(s), ":id").otherwise(s)), "/")


def status_class(status: Column | str) -> Column:
    s = _c(status).cast("int")
    return F.when(s.between(100, 599), F.concat((s / 100).cast("int").cast("string"), F.lit("xx"))).otherwise("")


def parse_time(text: Column | str) -> Column:
    """RFC 3339, or an epoch number in seconds, milliseconds, microseconds or nanoseconds by its size."""
    t = _c(text)
    n = t.try_cast("double")
    seconds = F.when(F.abs(n) > 1e17, n / 1e9).when(F.abs(n) > 1e14, n / 1e6).when(F.abs(n) > 1e12, n / 1e3).otherwise(n)
    return F.coalesce(F.timestamp_micros((seconds * 1e6).cast("long")), F.try_to_timestamp(t))


def sanitise_name(name: Column | str) -> Column:
    return F.regexp_replace(_c(name), r"[^A-Za-z0-9._-]", "_")


def severity(score: Column | str) -> Column:
    s = _c(score)
    return F.when(s >= 75, "critical").when(s >= 50, "warning").otherwise("info")
