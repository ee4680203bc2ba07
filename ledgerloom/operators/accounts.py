"""Accounts that other results are checked by."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .intervals import lost_to_gaps

# What a text that is published must not have.
PRIVATE = {"addresses": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+", "numbers": r"(?:^|[^0-9])[0-9]{9,}(?:$|[^0-9])", "paths": r"(?:/home/|/Users/|[A-Z]:\\)[A-Za-z0-9]+"}


def error_metrics(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Number, exact median, 90th and 95th percentile (interpolated) and largest of columns."""
    places = {"median": 0.5, "p90": 0.9, "p95": 0.95}
    aggs = [F.round(F.percentile(c, q), 6).alias(f"{c}_{name}") for c in columns for name, q in places.items()]
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *aggs, *[F.max(c).alias(f"{c}_max") for c in columns])


def funnel(stages: DataFrame, columns: Sequence[str]) -> DataFrame:
    """stages with nulls as zero; a stage that has more than the one before it is an error when read."""
    out = stages.withColumns({c: F.coalesce(c, F.lit(0)) for c in columns})
    grows = F.lit(False)
    for a, b in zip(columns, columns[1:]):
        grows = grows | (F.col(b) > F.col(a))
    return out.filter(F.when(grows, F.raise_error(F.lit("a stage has more than the one before it")).isNull()).otherwise(True))


def bin_gates(bins: DataFrame, gaps: DataFrame, low: int, high: int) -> DataFrame:
    """One row: bins, and how many are in a gap, have a target before their interval's end or two outcomes, or are outside [low, high).

    Bins are counted by their times first, so that gaps are met once by each time rather than by each
    bin. The times are written, as they are read for both ends.
    """
    early, both = (F.col("target") == 1) & (F.col("bin_end") != F.col("interval_end")), (F.col("target") == 1) & (F.col("competing") == 1)
    times = written(bins.groupBy("bin_start", "bin_end").agg(F.count(F.lit(1)).alias("bins"), F.count_if(early).alias("early_targets"), F.count_if(both).alias("both")), "bin-times")
    total = lambda n, where=None: F.coalesce(F.sum(n if where is None else F.when(where, F.col(n))), F.lit(0))
    return lost_to_gaps(times, gaps, "bin_start", "bin_end").agg(
        total("bins").alias("bins"), total("bins", F.col("lost_us") > 0).alias("in_gaps"), total("early_targets").alias("early_targets"), total("both").alias("both"), total("bins", (F.col("bin_start") < low) | (F.col("bin_end") > high)).alias("outside")
    )


def observed_labels(positions: DataFrame, start: int, end: int) -> DataFrame:
    """OPEN and CLOSE times in [start, end) of positions that aren't in doubt, from one pass."""
    event = lambda c, name: F.struct(F.lit(name).alias("label"), F.col(c).alias("us"))
    rows = positions.filter("status <> 'CENSORED'").select("acct", "position_id", "side", F.inline(F.array(event("open_us", "OPEN"), event("close_us", "CLOSE"))))
    return rows.filter((F.col("us") >= start) & (F.col("us") < end))


def by_bounds(time: Column, bounds: Sequence[tuple[str, str]], rest: str) -> Column:
    """The name of the first bound that a time is before, else ``rest``."""
    out = F.lit(rest)
    for bound, name in reversed(bounds):
        out = F.when(time < F.to_timestamp_ntz(F.lit(f"{bound} 00:00:00")), F.lit(name)).otherwise(out)
    return out


def month_stratum(time: Column) -> Column:
    """The third of a year that a time is in."""
    part = F.when(F.month(time) <= 4, "01_to_04").when(F.month(time) <= 8, "05_to_08").otherwise("09_to_12")
    return F.concat_ws("-", F.year(time).cast("string"), part)


def privacy_scan(rows: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """How many texts have what must not be published, by kind."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col(text).rlike(p)).alias(name) for name, p in PRIVATE.items()])
