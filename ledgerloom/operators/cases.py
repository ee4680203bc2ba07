"""Eligibility of intervals, their order, censoring by precedence, classes of gaps, and the choice of cases."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import server_to_utc
from .order import DAY, from_us, overlap_join


def validated_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_unique: bool = False) -> DataFrame:
    """A left join in which right has a key at most once (and left too, if left_unique); a repeated key is an error when read.

    The check is a count over the key that the join shuffles by anyway.
    """

    def once(df: DataFrame) -> DataFrame:
        n = F.count(F.lit(1)).over(W.partitionBy(*keys))
        return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"{', '.join(keys)}: a key is repeated")).isNull()).otherwise(True)).drop("_n")

    return (once(left) if left_unique else left).join(once(right), list(keys), "left")


def eligible(intervals: DataFrame, events: DataFrame, exceptions: DataFrame, keys: Sequence[str], before: dict[str, str], after: dict[str, str], low: int, high: int, least: int) -> DataFrame:
    """Intervals inside [low, high) of ``least`` length in a state of ``before``, between the two events that belong to it.

    At its start and at its end there is exactly one event each, unambiguous and of the behaviour that
    the state begins (before) and ends (after) with; no exception's time lies in it, ends included.
    exceptions: keys and us. Events are counted by their time; exceptions meet intervals by buckets.
    """
    keys = list(keys)
    pick = lambda of: F.coalesce(*[F.when(F.col("state") == s, F.lit(b)) for s, b in of.items()])
    own = intervals.filter((F.col("start_us") >= low) & (F.col("start_us") < F.col("end_us")) & (F.col("end_us") <= high) & (F.col("end_us") - F.col("start_us") >= least) & F.col("state").isin(*before))
    own = own.filter((F.col("behavior") == pick(before)) & (F.col("following") == pick(after)))
    at = events.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("n"), F.max("behavior").alias("only"), F.bool_or(F.col("category") == "ambiguous_ordering").alias("ambiguous"))
    at = at.filter((F.col("n") == 1) & ~F.col("ambiguous"))
    for time, behavior in (("start_us", pick(before)), ("end_us", pick(after))):
        side = at.select(*keys, F.col("us").alias(time), F.col("only").alias("_only"))
        own = own.join(side, [*keys, time]).filter(F.col("_only") == behavior).drop("_only")
    spans = own.select(*keys, "interval_id", F.col("start_us").alias("_a"), (F.col("end_us") + 1).alias("_b"))
    points = exceptions.select(*keys, F.col("us").alias("_c"), (F.col("us") + 1).alias("_d"))
    hit = overlap_join(spans, points, keys, ("_a", "_b"), ("_c", "_d")).select(*[F.col(f"l.{c}").alias(c) for c in (*keys, "interval_id")]).distinct()
    return own.join(hit, [*keys, "interval_id"], "left_anti")


def order_faults(intervals: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """intervals with is_invalid (an end not after its start, or a start not after the one before's) and is_overlap (a start before the one before's end).

    The one before counts only if its own end is after its start.
    """
    w = W.partitionBy(*keys).orderBy(order)
    sound = F.coalesce(F.col("end_us") > F.col("start_us"), F.lit(False))
    out = intervals.withColumn("_before", F.lag(F.when(sound, F.struct("start_us", "end_us"))).over(w))
    earlier = F.coalesce(F.col("start_us") <= F.col("_before.start_us"), F.lit(False))
    overlap = sound & F.coalesce(F.col("start_us") < F.col("_before.end_us"), F.lit(False))
    return out.withColumns({"is_invalid": ~sound | earlier, "is_overlap": overlap}).drop("_before")


# What censors a window, in this order.
CENSORS = ("clock_unresolved", "invalid_transition", "cross_fold_continuation", "left_censored_unknown_bootstrap", "coverage_censored_no_valid_tick", "right_censored_no_terminal")


def window_status(conditions: dict[str, Column]) -> Column:
    """The first of CENSORS whose condition holds, else valid."""
    return F.coalesce(*[F.when(conditions[name], F.lit(name)) for name in CENSORS if name in conditions], F.lit("valid"))


def population_support(windows: DataFrame, bootstraps: dict[str, bool], clocks: dict[str, Sequence[tuple[int, int, int]]], fold: str, least_units: int, least_side: int) -> DataFrame:
    """Per fold, way to begin and clock: windows by status, what the valid ones are of, and whether they suffice.

    windows: fold, report_start, report_end (of the report that tells of the window), start_us, end_us (of
    a server's clock), side, unit, is_rejected, has_tick, has_terminal. bootstraps: by name whether what
    came before the fold is unknown, so that no window counts. clocks: by name the segments of
    server_to_utc. A window that only ends after its report goes on into another one; one that begins
    outside isn't of it. Sufficient: ``least_units`` different units and ``least_side`` windows a side
    among the valid ones. A window is looked at once for each scenario, and they are counted before the shuffle.
    """
    start, end = F.col("start_us"), F.col("end_us")
    scenario = lambda b, c: F.struct(F.lit(b).alias("bootstrap"), F.lit(c).alias("clock"), F.lit(bootstraps[b]).alias("unknown"), (server_to_utc(start, clocks[c])[0] == "unique").alias("resolved"))
    rows = windows.withColumn("s", F.explode(F.array(*[scenario(b, c) for b in bootstraps for c in clocks]))).select(*[c for c in windows.columns], "s.*")
    begins = (start >= F.col("report_start")) & (start < F.col("report_end"))
    goes_on = end > F.col("report_end")
    status = (
        F.when(end <= start, "invalid_transition")
        .when(begins & goes_on, "cross_fold_continuation")
        .when((start < F.col("report_start")) | goes_on, "invalid_transition")
        .when(~F.col("resolved"), "clock_unresolved")
        .when(F.col("is_rejected") | ~F.col("side").isin("ONE_BUY", "ONE_SELL"), "invalid_transition")
        .when(F.col("unknown"), "left_censored_unknown_bootstrap")
        .when(~F.col("has_tick"), "coverage_censored_no_valid_tick")
        .when(~F.col("has_terminal"), "right_censored_no_terminal")
        .otherwise("valid")
    )
    keys = [fold, "bootstrap", "clock"]
    valid = F.col("status") == "valid"
    # By unit first: a unit's windows are combined in each task, so what is shuffled doesn't grow with them.
    of_unit = rows.withColumn("status", status).groupBy(*keys, "unit").agg(
        *[F.count_if(F.col("status") == c).alias(c) for c in CENSORS], F.count(F.lit(1)).alias("windows"), *[F.count_if(valid & (F.col("side") == x)).alias(x) for x in ("ONE_BUY", "ONE_SELL")]
    )
    some = (F.col("ONE_BUY") + F.col("ONE_SELL")) > 0
    out = of_unit.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("windows", *CENSORS, "ONE_BUY", "ONE_SELL")], F.count_if(some & F.col("unit").isNotNull()).alias("units"))
    enough = (F.col("units") >= least_units) & (F.col("ONE_BUY") >= least_side) & (F.col("ONE_SELL") >= least_side)
    return out.withColumn("support", F.when(enough, "sufficient").otherwise("insufficient_population"))


def gap_class(start: Column, end: Column, offset: int) -> Column:
    """weekend_opening_gap: from a Friday to a Saturday or Sunday that is already Monday on the server, whose clock is ``offset`` ahead; else temporal_coverage_gap."""
    day = lambda us: F.weekday(from_us(us))
    return F.when((day(start) == 4) & day(end).isin(5, 6) & (day(end + offset) == 0), "weekend_opening_gap").otherwise("temporal_coverage_gap")


def duration_band(us: Column, bounds: Sequence[int], labels: Sequence[str]) -> Column:
    """The label of the first bound that a duration doesn't exceed, the last label beyond all."""
    out = F.lit(labels[-1])
    for b, label in reversed(list(zip(bounds, labels))):
        out = F.when(us <= b, F.lit(label)).otherwise(out)
    return out


def select_cases(candidates: DataFrame, stratum: Column, n: int = 3) -> DataFrame:
    """Of each date the longest candidate (then the earliest, then by side); of each stratum its earliest date; the earliest other dates up to n in all.

    Candidates are cut to one a date by a maximum before anything is sorted.
    """
    rank = F.struct((-(F.col("end_us") - F.col("start_us"))).alias("long"), "start_us", "side")
    rest = [c for c in candidates.columns if c not in ("start_us", "side")]
    best = candidates.groupBy(F.floor(F.col("start_us") / DAY).alias("day")).agg(F.min_by(F.struct("start_us", "side", *rest), rank).alias("c")).select("day", "c.*")
    best = best.withColumn("stratum", stratum)
    first = F.row_number().over(W.partitionBy("stratum").orderBy("day")) == 1
    best = best.withColumn("first", first & F.col("stratum").isNotNull())
    place = F.row_number().over(W.orderBy(F.desc("first"), "day"))  # one row a date
    chosen = best.withColumn("place", place).filter(F.col("place") <= n)
    return chosen.withColumn("selection", F.when(F.col("first"), "earliest_eligible_date").otherwise("chronological_fallback")).drop("first", "place")


def tick_metrics(ticks: DataFrame, keys: Sequence[str], gap: int) -> DataFrame:
    """Of ticks with us, us_before, valid and repeats: how many, valid, repeated and invalid ones, the longest gap and how many exceed ``gap``."""
    step = F.col("us") - F.col("us_before")
    return ticks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("valid").alias("valid"), F.count_if("repeats").alias("repeated"), F.count_if(~F.col("valid")).alias("invalid"), F.max(step).alias("longest"), F.count_if(step > gap).alias("gaps")
    )


def top_hours(ticks: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k hours of the day with the most ticks, equal ones by hour. Ranked over the 24 sums."""
    n = ticks.groupBy(*keys, F.floor(F.pmod("us", F.lit(DAY)) / (DAY // 24)).alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("place", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "hour")).cast("bigint")).filter(F.col("place") <= k)


def same_ids(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: how many ids are only left, only right, and in both."""
    sides = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full")
    return sides.agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("both"))


def keep_first(df: DataFrame, keys: Sequence[str], *order: Column) -> DataFrame:
    """The first row per key in a total order, as a minimum of structs, so that rows combine before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("row")).select(*keys, "row.*")
