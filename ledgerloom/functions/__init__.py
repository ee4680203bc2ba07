"""Column functions: parsing of report texts, fixed-point numbers, clocks, logarithms of odds, digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Probabilities are kept this far from 0 and 1 before logarithms are taken.
EPSILON = 1e-12


def spaces_collapsed(text: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def number(text: Column) -> Column:
    """A number with commas and spaces in it, null if it is none."""
    return F.regexp_replace(text, r"[,\s]", "").try_cast("double")


def report_time(text: Column) -> Column:
    """yyyy.MM.dd HH:mm:ss with an optional fraction, null if it is none."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in ("yyyy.MM.dd HH:mm:ss", "yyyy.MM.dd HH:mm:ss.SSS")])


def requested_and_filled(text: Column) -> tuple[Column, Column]:
    """The two numbers of 'requested / filled'; the second is null where there is one."""
    parts = F.split(text, "/")
    return number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))


def fixed8(text: Column, digits: int = 8) -> Column:
    """A decimal with up to eight places from its exact spelling, null for any other spelling (signs, exponents, more places)."""
    return F.when(text.rlike(rf"^[0-9]{{1,{digits}}}(\.[0-9]{{1,8}})?$"), text.try_cast("decimal(16,8)"))


def fixed8_text(value: Column) -> Column:
    """A number with eight places, halves to even."""
    return F.bround(value, 8).cast("decimal(18,8)").cast("string")


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(EPSILON)), F.lit(1 - EPSILON))


def log_likelihood(label: Column, p: Column) -> Column:
    """Of a Bernoulli label."""
    p = clipped(p)
    return label * F.ln(p) + (1 - label) * F.log1p(-p)


def logit(p: Column) -> Column:
    p = clipped(p)
    return F.ln(p) - F.log1p(-p)


def expit(z: Column) -> Column:
    return clipped(F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z))))


def smoothed_rate(events: Column, exposure: Column, alpha: float) -> Column:
    """(events + alpha) / (exposure + 2 alpha), null without exposure."""
    return F.when(exposure > 0, (events + alpha) / (exposure + 2 * alpha))


def bucket_label(value: Column, bounds: Sequence[float], labels: Sequence[str]) -> Column:
    """The label of the half-open bucket [bound, next bound); the last one has no end. Null below the first bound."""
    out = F.lit(None).cast("string")
    for low, label in zip(bounds, labels):
        out = F.when(value >= low, F.lit(label)).otherwise(out)
    return out


def age_stratum(age: Column) -> Column:
    return F.when(age <= 6, "0-6s").when(age <= 10, "7-10s").when(age <= 30, "10-30s").when(age <= 60, "30-60s").when(age > 60, ">60s")


def sample_id(*parts: Column) -> Column:
    """A digest of what names a sample, the parts apart."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def stable_seed(text: Column) -> Column:
    """A number from the first eight hexadecimal digits of a digest."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("bigint")


def server_to_utc(us: Column, segments: Sequence[tuple[int, int, int]]) -> tuple[Column, Column]:
    """(status, utc microseconds) of a server's clock whose offset to UTC changes.

    segments: (first UTC microsecond, one after the last, offset in microseconds). A server time is
    unique, nonexistent or ambiguous, by how many different UTC times show it; only a unique one has
    a time.
    """
    found = F.array_distinct(F.filter(F.array(*[F.when((us - o >= a) & (us - o < b), us - o) for a, b, o in segments]), lambda x: x.isNotNull()))
    n = F.size(found)
    return F.when(n == 1, "unique").when(n == 0, "nonexistent").otherwise("ambiguous"), F.when(n == 1, F.get(found, F.lit(0)))
