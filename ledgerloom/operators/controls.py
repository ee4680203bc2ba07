"""Positive samples with the interval they end, and matched controls from the risk time of the same state, day and hour."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import age_stratum
from .order import asof_backward, overlap_join

# The state that each behaviour starts from.
REQUIRED_STATE = {"REHEDGE_SELL": "ONE_BUY", "REHEDGE_BUY": "ONE_SELL", "UNLOCK_TO_BUY": "HEDGED_1X1", "UNLOCK_TO_SELL": "HEDGED_1X1"}
#: The youngest age in units at which controls are asked for.
LEAST_AGE = 7
#: Units, 16 bytes each, up to which their ticks are broadcast.
BROADCAST_UNITS = 500_000


def required_state(behavior: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, state in REQUIRED_STATE.items():
        out = F.when(behavior == name, state).otherwise(out)
    return out


def trigger_family(behavior: Column) -> Column:
    return F.when(behavior.startswith("REHEDGE"), "rehedge").otherwise("unlock")


def positives(events: DataFrame, primary: Column) -> DataFrame:
    """Primary events of the four behaviours as samples: at their matched tick for prices, at their reported time for states."""
    own = events.filter(primary & F.col("behavior").isin(*REQUIRED_STATE))
    b = F.col("behavior")
    return own.select(
        "acct", "event_id", F.concat(F.lit("p-"), F.col("event_id").cast("string")).alias("sample_id"), F.col("tick_us").alias("sample_us"), F.col("us").alias("state_us"), b, trigger_family(b).alias("family"), required_state(b).alias("state")
    )


def with_lineage(samples: DataFrame, intervals: DataFrame, keys: Sequence[str], unit: int) -> DataFrame:
    """samples with the interval before them, its age in units and where it comes from.

    The interval that ends at the sample's time in its state and is followed by its behaviour, if there
    is exactly one; else the last interval in that state that holds the time, ends included. Without
    either the id is null. Exact matches are an equi-join; only the other samples meet intervals by
    buckets of time.
    """
    keys = list(keys)
    i = intervals.select(*keys, "interval_id", "start_us", "end_us", "state", "following")
    exact = i.select(*keys, "state", F.col("end_us").alias("state_us"), F.col("following").alias("behavior"), "interval_id", "start_us")
    exact = exact.groupBy(*keys, "state", "state_us", "behavior").agg(F.count(F.lit(1)).alias("n"), F.max("interval_id").alias("exact_id"), F.max("start_us").alias("exact_start")).filter("n = 1").drop("n")
    found = samples.join(exact, [*keys, "state", "state_us", "behavior"], "left")
    rest = found.filter("exact_id IS NULL").select(*keys, "event_id", F.col("state").alias("_state"), F.col("state_us").alias("_a"), (F.col("state_us") + 1).alias("_b"))
    pairs = overlap_join(rest, i.withColumn("_end", F.col("end_us") + 1), keys, ("_a", "_b"), ("start_us", "_end"))
    held = pairs.filter(F.col("l._state") == F.col("r.state")).groupBy(*[F.col(f"l.{c}").alias(c) for c in (*keys, "event_id")]).agg(F.max(F.struct("r.interval_id", "r.start_us")).alias("held"))
    out = found.join(held, [*keys, "event_id"], "left")
    start = F.coalesce("exact_start", "held.start_us")
    age = (F.col("state_us") - start) / unit
    source = F.when(F.col("exact_id").isNotNull(), "interval_lineage").when(F.col("held").isNotNull(), "reported_time_interval_fallback")
    return out.select(*samples.columns, F.coalesce("exact_id", "held.interval_id").alias("interval_id"), age.alias("age"), age_stratum(age).alias("stratum"), source.alias("lineage"))


def control_times(intervals: DataFrame, ticks: DataFrame, keys: Sequence[str], unit: int, exclusion: int, volume: Column, hour: int) -> DataFrame:
    """Eligible one- and two-leg intervals, a row for each hour of theirs, with the array of their candidates' times: the last tick at each whole unit strictly inside.

    Neither the unit nor its tick may be within ``exclusion`` of the book's events, which an interval
    between consecutive events has at its ends, nor the tick outside the interval. Equal candidates
    count once. The hour is the tick's.
    """
    keys = list(keys)
    own = intervals.filter(F.col("state").isin("ONE_BUY", "ONE_SELL", "HEDGED_1X1") & volume)
    low, high = own.agg(F.min("start_us"), F.max("end_us")).first()
    # The last tick is found once for each unit of the time that intervals cover, whatever their number.
    first, last = (low or 0) // unit, (high or 0) // unit
    grid = own.sparkSession.range(first, last + 1).select((F.col("id") * unit).alias("at_us"))
    grid = asof_backward(grid, ticks.select("us", "seq"), [], "at_us", "us", ["seq"], {"sample_us": "us"}).filter("sample_us IS NOT NULL")
    # From the first tick on no unit is missing, and those whose tick is in one hour follow each other.
    found = F.struct("at_us", "sample_us", (F.ceil(F.col("sample_us") / unit).cast("bigint") * unit).alias("first_us"))
    grid = grid.groupBy(F.floor(F.col("sample_us") / hour).alias("hour")).agg(F.min("at_us").alias("first_at"), F.max("at_us").alias("last_at"), F.array_sort(F.collect_list(found)).alias("near"))
    if last - first <= BROADCAST_UNITS:
        grid = F.broadcast(grid)
    # Units strictly inside the interval and farther than the exclusion from both its ends.
    begin = F.greatest(F.ceil(F.col("start_us") / unit).cast("bigint") + 1, F.floor((F.col("start_us") + exclusion) / unit).cast("bigint") + 1)
    end = F.least(F.floor(F.col("end_us") / unit).cast("bigint") - 1, F.ceil((F.col("end_us") - exclusion) / unit).cast("bigint") - 1)
    own = own.withColumns({"begin_us": begin * unit, "until_us": end * unit}).filter("begin_us <= until_us").select(*keys, "interval_id", "state", "start_us", "end_us", "begin_us", "until_us")
    hours = F.sequence(F.floor((F.col("start_us") + exclusion) / hour), F.floor((F.col("end_us") - exclusion) / hour))
    own = own.withColumn("hour", F.explode(hours)).join(grid, "hour")
    a, b = F.greatest("begin_us", "first_at"), F.least("until_us", "last_at")
    near = F.when(a <= b, F.slice("near", ((a - F.col("first_at")) / unit).cast("int") + 1, ((b - a) / unit).cast("int") + 1))
    inside = lambda x: (x["sample_us"] - F.col("start_us") > exclusion) & (F.col("end_us") - x["sample_us"] > exclusion)
    # A tick that is the last one at several units counts at the first of them in the interval.
    times = F.transform(F.filter(near, lambda x: inside(x) & (x["at_us"] == F.greatest(x["first_us"], F.col("begin_us")))), lambda x: x["sample_us"])
    return own.select(*keys, "interval_id", "state", "start_us", "hour", F.coalesce(times, F.array().cast("array<bigint>")).alias("times"))


def control_pool(times: DataFrame, keys: Sequence[str], unit: int) -> DataFrame:
    """The candidates of control_times(), a row each."""
    own = times.select(*keys, "interval_id", "state", "start_us", F.explode("times").alias("sample_us"))
    age = (F.col("sample_us") - F.col("start_us")) / unit
    return own.select(*keys, "interval_id", "state", "sample_us", age.alias("age"), age_stratum(age).alias("stratum"))


def with_support(samples: DataFrame, times: DataFrame, keys: Sequence[str], hour: int) -> DataFrame:
    """samples with the number of candidates (of control_times()) of their state and hour, and whether they can have controls, or why not."""
    keys = list(keys)
    n = times.groupBy(*keys, "state", "hour").agg(F.sum(F.size("times")).alias("eligible"))
    out = samples.withColumn("hour", F.floor(F.col("sample_us") / hour)).join(n, [*keys, "state", "hour"], "left").withColumn("eligible", F.coalesce("eligible", F.lit(0)))
    young = ~F.coalesce(F.col("age") >= LEAST_AGE, F.lit(False))
    reason = F.when(young, "state_age_below_minimum").when(F.col("eligible") == 0, "no_eligible_risk_time").otherwise("supported")
    return out.withColumn("support", reason)


def sample_controls(samples: DataFrame, times: DataFrame, keys: Sequence[str], unit: int, quota: int, seed: str) -> DataFrame:
    """At most ``quota`` candidates for each supported sample, none twice, of its state and hour, with how far they are.

    Candidates of a group (book, state, hour) are dealt out in a seeded order: the samples of a group
    take turns in order of time, so the k-th candidate goes to sample k modulo their number. Groups
    are an hour of one book's time, so a group's candidates are ordered in its row, and only those
    that are dealt out leave it; times are those of control_times().
    """
    keys = list(keys)
    group = [*keys, "state", "hour"]
    s = samples.filter("support = 'supported'")
    asked = s.groupBy(*group).agg((F.count(F.lit(1)) * quota).cast("int").alias("most"))
    own = times.filter(F.size("times") > 0).join(asked, group).groupBy(*group).agg(F.max("most").alias("most"), F.collect_list(F.struct("interval_id", "start_us", "times")).alias("own"))
    digest = lambda i, t: F.sha2(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], i.cast("string"), t.cast("string"), F.lit(seed)), 256)
    each = lambda p: F.transform(p["times"], lambda t: F.struct(digest(p["interval_id"], t).alias("digest"), p["interval_id"].alias("interval_id"), t.alias("sample_us"), p["start_us"].alias("start_us")))
    dealt = F.slice(F.array_sort(F.flatten(F.transform("own", each))), F.lit(1), F.col("most"))
    c = own.select(*group, (F.col("most") / quota).cast("bigint").alias("turns"), F.posexplode(dealt).alias("place", "c"))
    c = c.select(*group, (F.col("place") % F.col("turns")).alias("turn"), (F.floor(F.col("place") / F.col("turns")) + 1).alias("number"), "c.interval_id", "c.sample_us", "c.start_us")
    s = s.withColumn("turn", F.row_number().over(W.partitionBy(*group).orderBy("sample_us", "event_id")).cast("bigint") - 1).select(*group, "turn", "event_id", F.col("sample_us").alias("event_us"))
    age = (F.col("sample_us") - F.col("start_us")) / unit
    j = c.join(s, [*group, "turn"])
    return j.select(*keys, "event_id", F.concat(F.lit("c-"), F.col("event_id").cast("string"), F.lit("-"), F.col("number").cast("string")).alias("sample_id"), "interval_id", "state", "sample_us", age.alias("age"), age_stratum(age).alias("stratum"), F.abs(F.col("sample_us") - F.col("event_us")).alias("distance"))


def with_counts(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """samples with the number of controls that they got."""
    n = controls.groupBy("event_id").agg(F.count(F.lit(1)).alias("controls"))
    return samples.join(n, "event_id", "left").withColumn("controls", F.coalesce("controls", F.lit(0)))


def paired(positive: DataFrame, controls: DataFrame, value: str) -> DataFrame:
    """Each event's own value and the mean of its controls', where both are known, and their difference."""
    c = controls.groupBy("event_id").agg(F.avg(value).alias("of_controls"))
    p = positive.select("event_id", F.col(value).alias("own")).join(c, "event_id").filter("own IS NOT NULL AND of_controls IS NOT NULL")
    return p.withColumn("difference", F.col("own") - F.col("of_controls"))
