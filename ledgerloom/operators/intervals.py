"""Interval algebra: coverage gaps, tails, cuts at midnights and gaps, paused clocks, grids and risk bins."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..schema import ENDPOINTS
from ..sources.shared import written
from .anchors import extremes
from .order import DAY, HOUR, asof_backward, bucket_of, running_sums, with_previous


def coverage_gaps(ticks: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], threshold: int, bucket: int = DAY) -> DataFrame:
    """Spans between consecutive ticks that are strictly longer than the threshold."""
    t = with_previous(ticks, keys, time, ties, {"gap_start": time}, bucket)
    return t.filter(F.col(time) - F.col("gap_start") > threshold).select(*keys, "gap_start", F.col(time).alias("gap_end"))


def checked_breaks(breaks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Breaks (keys, gap_start, gap_end, reason), each once, a missing reason as unknown_coverage_gap. One that doesn't end after its start is an error."""
    reason = F.coalesce("reason", F.lit("unknown_coverage_gap")) if "reason" in breaks.columns else F.lit("unknown_coverage_gap")
    bad = ~F.coalesce(F.col("gap_end") > F.col("gap_start"), F.lit(False))
    sound = F.when(bad, F.raise_error(F.lit("a break must end after its start")).isNull()).otherwise(True)
    return breaks.filter(sound).select(*keys, "gap_start", "gap_end", reason.alias("reason")).distinct()


def recurring(gaps: DataFrame, keys: Sequence[str], tolerance: int, least: int) -> DataFrame:
    """Gaps with how many (itself included) begin and end at about the same time of day, and their class.

    Both clock times are compared modulo a day. Gaps meet by buckets of their start's clock time.
    """
    keys = list(keys)
    g = gaps.withColumns({"c0": F.pmod(F.col("gap_start"), F.lit(DAY)), "c1": F.pmod(F.col("gap_end"), F.lit(DAY))})
    width = 2 * tolerance
    slots = -(-DAY // width)
    own = bucket_of("c0", width)
    near = F.array_distinct(F.transform(F.array(own - 1, own, own + 1), lambda b: F.pmod(b, F.lit(slots))))
    far = lambda a, b: F.least(F.abs(a - b), F.lit(DAY) - F.abs(a - b))
    left = g.withColumn("slot", F.explode(near))
    right = g.select(*[F.col(k).alias(f"r_{k}") for k in keys], F.col("c0").alias("r0"), F.col("c1").alias("r1"), own.alias("r_slot"))
    same = F.col("slot") == F.col("r_slot")
    for k in keys:
        same = same & (F.col(k) == F.col(f"r_{k}"))
    joined = left.join(right, same).filter((far(F.col("c0"), F.col("r0")) <= tolerance) & (far(F.col("c1"), F.col("r1")) <= tolerance))
    n = joined.groupBy(*keys, "gap_start", "gap_end").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("class", F.when(F.col("n") >= least, "scheduled_market_closed").otherwise("unknown_coverage_gap"))


def intervals_to(events: DataFrame, keys: Sequence[str], coverage_end: int) -> DataFrame:
    """Spans between consecutive events up to the coverage's end, the last one of each key right-censored there (is_tail) if it has a length."""
    w = W.partitionBy(*keys).orderBy("seq")
    own = events.filter(F.col("us") <= coverage_end).withColumns({"next_us": F.lead("us").over(w), "following": F.lead("behavior").over(w)})
    own = own.withColumn("is_tail", F.col("next_us").isNull()).filter(~F.col("is_tail") | (F.col("us") < coverage_end))
    end = F.coalesce("next_us", F.lit(coverage_end).cast("bigint")).alias("end_us")
    return own.select(*keys, F.col("seq").alias("interval_id"), F.col("us").alias("start_us"), end, F.col("after").alias("state"), "behavior", "following", "is_tail")


def cut_at(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """Half-open spans cut at multiples of the width (midnights for a day); empty spans vanish."""
    k = F.explode(F.sequence(F.floor(F.col(start) / width).cast("bigint"), F.floor((F.col(end) - 1) / width).cast("bigint")))
    df = df.filter(F.col(start) < F.col(end)).withColumn("_k", k)
    return df.withColumns({start: F.greatest(F.col(start), F.col("_k") * width), end: F.least(F.col(end), (F.col("_k") + 1) * width)}).drop("_k")


def by_day(gaps: DataFrame) -> DataFrame:
    """(day, gaps): the gaps of each day, cut at midnights, in order. A day has as many as its length over their least length."""
    cut = cut_at(gaps.select(F.col("gap_start").alias("a"), F.col("gap_end").alias("b")), "a", "b", DAY)
    return cut.groupBy(F.floor(F.col("a") / DAY).cast("bigint").alias("day")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("gaps"))


def crossed(gaps: str, start: str, end: str) -> Column:
    """What of a day's gaps lies in a span; an empty array where there are none."""
    own = F.transform(F.col(gaps), lambda x: F.struct(F.greatest(x["a"], F.col(start)).alias("a"), F.least(x["b"], F.col(end)).alias("b")))
    return F.coalesce(F.filter(own, lambda x: x["a"] < x["b"]), F.array().cast("array<struct<a:bigint,b:bigint>>"))


def partition_risk(intervals: DataFrame, gaps: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Fragments of intervals inside [low, high), cut at midnights and at gaps (columns gap_start, gap_end, no keys).

    Each is in a gap or not; is_left_truncated says that its interval began before ``low``, is_zero
    marks an interval of no length, which stays as one accounting row. Intervals are read once: a
    part within a day meets that day's gaps.
    """
    bounds = {"interval_start": F.col("start_us"), "interval_end": F.col("end_us"), "is_left_truncated": F.col("start_us") < low, "is_zero": F.col("start_us") == F.col("end_us")}
    own = intervals.filter("start_us <= end_us").withColumns(bounds)
    inside = [F.when(F.col("is_zero"), F.col(c)).otherwise(f(c, F.lit(edge).cast("bigint"))) for c, f, edge in (("start_us", F.greatest, low), ("end_us", F.least, high))]
    own = own.withColumns({"start_us": inside[0], "end_us": inside[1]}).filter(F.col("is_zero") | (F.col("start_us") < F.col("end_us")))
    day = lambda us: F.floor(us / DAY).cast("bigint")
    own = own.withColumn("day", F.explode(F.sequence(day(F.col("start_us")), day(F.greatest(F.col("end_us") - 1, F.col("start_us"))))))
    cut = {"start_us": F.greatest(F.col("start_us"), F.col("day") * DAY), "end_us": F.when(F.col("is_zero"), F.col("end_us")).otherwise(F.least(F.col("end_us"), (F.col("day") + 1) * DAY))}
    own = own.withColumns(cut).join(by_day(gaps), "day", "left").withColumn("gaps", crossed("gaps", "start_us", "end_us"))
    # Between the gaps of a fragment is what is left: from each gap's end to the next one's start.
    edges = F.array_distinct(F.array_sort(F.concat(F.array("start_us", "end_us"), F.flatten(F.transform("gaps", lambda x: F.array(x["a"], x["b"]))))))
    spans = F.when(F.col("is_zero"), F.array(F.struct(F.col("start_us").alias("a"), F.col("end_us").alias("b")))).otherwise(
        F.transform(F.sequence(F.lit(1), F.size("edges") - 1), lambda k: F.struct(F.get("edges", k - 1).alias("a"), F.get("edges", k).alias("b")))
    )
    pieces = own.withColumn("edges", edges).withColumn("piece", F.explode(spans))
    in_gap = ~F.col("is_zero") & F.exists("gaps", lambda x: (x["a"] <= F.col("piece.a")) & (F.col("piece.b") <= x["b"]))
    fields = [c for c in own.columns if c not in ("day", "gaps", "start_us", "end_us", "is_zero")]
    return pieces.select(*fields, F.col("piece.a").alias("start_us"), F.col("piece.b").alias("end_us"), in_gap.alias("is_gap"), "is_zero")


def clip_to_hours(fragments: DataFrame, first_hour: int, last_hour: int) -> DataFrame:
    """Fragments (within days) clipped to [first, last) hours of their day; what is left empty goes."""
    day = F.floor(F.col("start_us") / DAY).cast("bigint") * DAY
    out = fragments.withColumn("_day", day)
    out = out.withColumns({"start_us": F.greatest("start_us", F.col("_day") + first_hour * HOUR), "end_us": F.least("end_us", F.col("_day") + last_hour * HOUR)}).drop("_day")
    return out.filter("start_us < end_us")


def gap_clock(gaps: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """gaps, disjoint within keys, with closed_us: the length of all gaps up to this one's end."""
    length = gaps.withColumn("_length", F.col("gap_end") - F.col("gap_start"))
    return running_sums(length, keys, "gap_start", [], {"closed_us": "_length"}).drop("_length")


def with_closed(df: DataFrame, clock: DataFrame, keys: Sequence[str], times: dict[str, str], bucket: int = DAY) -> DataFrame:
    """df with, {new column: time}, how much time gaps have taken before it.

    Each distinct time of df meets the last gap that begins at or before it, once for all its rows. df is
    never broadcast: Spark takes a compressed file's size for its rows', which are many times as large.
    """
    keys = list(keys)
    points = df.select(*keys, F.explode(F.array(*[F.col(c) for c in set(times.values())])).alias("_at")).distinct()
    points = asof_backward(points, clock, keys, "_at", "gap_start", [], {"_closed": "closed_us", "_gap_end": "gap_end"}, bucket=bucket)
    closed = F.coalesce(F.col("_closed") - F.greatest(F.col("_gap_end") - F.col("_at"), F.lit(0)), F.lit(0))
    points = points.select(*keys, "_at", closed.alias("_closed"))
    for new, time in times.items():
        df = df.join(points.select(*keys, F.col("_at").alias(time), F.col("_closed").alias(new)).hint("merge"), [*keys, time])
    return df


def lost_to_gaps(points: DataFrame, gaps: DataFrame, start: str, end: str) -> DataFrame:
    """points with lost_us: how much of [start, end) gaps cover, from the gap clock at both ends."""
    both = with_closed(points, gap_clock(gaps), [], {"_closed_start": start, "_closed_end": end})
    return both.select(*points.columns, (F.col("_closed_end") - F.col("_closed_start")).alias("lost_us"))


def paused_age(points: DataFrame, gaps: DataFrame, start: str, at: str) -> DataFrame:
    """points with tradeable_us: the time from start to at without what gaps cover of it."""
    return lost_to_gaps(points, gaps, start, at).withColumn("tradeable_us", F.col(at) - F.col(start) - F.col("lost_us")).drop("lost_us")


def crosses_gap(points: DataFrame, gaps: DataFrame, window_start: str, window_end: str) -> DataFrame:
    """points with crosses_gap: whether a gap starts before the window's end and ends after its start."""
    return lost_to_gaps(points, gaps, window_start, window_end).withColumn("crosses_gap", F.col("lost_us") > 0).drop("lost_us")


def grid(df: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """A row for each whole cell of the absolute grid inside a span, as bin_start and bin_end; none where none fits."""
    first = -F.floor(-F.col(start) / width).cast("bigint")
    last = F.floor(F.col(end) / width).cast("bigint") - 1
    cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn("_cell", F.explode(cells)).withColumns({"bin_start": F.col("_cell") * width, "bin_end": (F.col("_cell") + 1) * width}).drop("_cell")


def endpoint_of(state: Column) -> Column:
    out = F.lit(None).cast("string")
    for s, (name, _) in ENDPOINTS.items():
        out = F.when(state == s, name).otherwise(out)
    return out


def is_target(state: Column, following: Column) -> Column:
    out = F.lit(False)
    for s, (_, targets) in ENDPOINTS.items():
        out = out | ((state == s) & F.coalesce(following.isin(*targets), F.lit(False)))
    return out


def risk_bins(fragments: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Whole grid cells of tradeable fragments of intervals in a state with an endpoint.

    A cell that ends exactly when its interval does has the outcome: target 1 if the following event
    is one of the endpoint's, competing 1 if it is another; all others have neither.
    """
    own = fragments.filter(~F.col("is_gap") & ~F.col("is_zero")).withColumn("endpoint", endpoint_of(F.col("state"))).filter(F.col("endpoint").isNotNull())
    bins = grid(own, "start_us", "end_us", width)
    at_end = (F.col("bin_end") == F.col("interval_end")) & F.col("following").isNotNull()
    hit = is_target(F.col("state"), F.col("following"))
    return bins.select(
        *keys, "interval_id", "state", "endpoint", "following", "interval_start", "interval_end", "is_left_truncated", "bin_start", "bin_end", (at_end & hit).cast("int").alias("target"), (at_end & ~hit).cast("int").alias("competing")
    )


def interval_audit(intervals: DataFrame, bins: DataFrame, keys: Sequence[str], low: int) -> DataFrame:
    """Each interval with its cells, its target, the last cell's censor reason and why it is excluded, if so.

    Of several reasons to exclude the last that applies counts: ineligible_state, no_complete_bin, left_truncated.
    """
    n = bins.groupBy(*keys, "interval_id").agg(F.count(F.lit(1)).alias("bins"), F.max("target").alias("target"), F.max("competing").alias("competing"))
    out = intervals.join(n, [*keys, "interval_id"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("bins", "target", "competing")})
    reason = F.when(F.col("start_us") < low, "left_truncated").when(F.col("bins") == 0, F.when(endpoint_of(F.col("state")).isNull(), "ineligible_state").otherwise("no_complete_bin"))
    censor = F.when(F.col("target") == 1, "target_event").when(F.col("competing") == 1, "competing_endpoint").when(F.col("following").isNull(), "synthetic_right_censor")
    return out.select(*keys, "interval_id", "state", F.col("bins").cast("bigint"), "target", "competing", censor.alias("censor_reason"), reason.alias("exclusion_reason"))


def intervals_over(events: DataFrame, keys: Sequence[str], coverage_end: int) -> DataFrame:
    """Spans between consecutive events that begin by the coverage's end, whenever they end; after a key's last event one to the coverage's end (is_tail), if it has a length."""
    w = W.partitionBy(*keys).orderBy("seq")
    own = events.withColumns({"next_us": F.lead("us").over(w), "following": F.lead("behavior").over(w)}).filter(F.col("us") <= coverage_end)
    own = own.withColumn("is_tail", F.col("next_us").isNull()).filter(~F.col("is_tail") | (F.col("us") < coverage_end))
    end = F.coalesce("next_us", F.lit(coverage_end).cast("bigint")).alias("end_us")
    return own.select(*keys, F.col("seq").alias("interval_id"), F.col("us").alias("start_us"), end, F.col("after").alias("state"), "behavior", "following", "is_tail")


def supported_bins(fragments: DataFrame, gaps: DataFrame, keys: Sequence[str], width: int, coverage_end: int, split: Callable[[Column], Column], hours: tuple[int, int]) -> DataFrame:
    """Whole grid cells of tradeable fragments of untruncated intervals in a state with an endpoint, with all that decides which of them a model may use.

    age_us: the time since the interval's start without gaps, at the cell's start. is_common: within the
    hours of the day. split(bin_start) names a cell's part of the data, the same all day; an interval with
    cells in both development and holdout is in neither (is_cross_split). is_eligible: common, in one of
    the two, and not of such an interval. is_last: the interval's last cell, which has the censor_reason.
    fragments: of intervals_over, from partition_risk; what an interval's cells share is found over its
    fragments, before they become cells. Fragments with cells are written: their times and they themselves are read.
    """
    keys = list(keys)
    own = fragments.filter(~F.col("is_gap") & ~F.col("is_zero") & ~F.col("is_left_truncated")).withColumn("endpoint", endpoint_of(F.col("state"))).filter(F.col("endpoint").isNotNull())
    first, last = -F.floor(-F.col("start_us") / width).cast("bigint"), F.floor(F.col("end_us") / width).cast("bigint") - 1
    own = written(own.withColumns({"_first": first * width, "_last": last * width}).filter("_first <= _last").drop("is_gap", "is_zero", "is_left_truncated"), "support-fragments")
    own = with_closed(own, gap_clock(gaps), [], {"_closed_start": "interval_start", "_closed_here": "start_us"})
    own = own.withColumns({"_age": F.col("start_us") - F.col("interval_start") - F.col("_closed_here") + F.col("_closed_start"), "split": split(F.col("_first"))})
    of_interval = W.partitionBy(*keys, "interval_id")
    named = F.when(F.col("split").isin("development", "holdout"), F.col("split"))
    own = own.withColumns({"_end": F.max("_last").over(of_interval), "is_cross_split": F.coalesce(F.min(named).over(of_interval) != F.max(named).over(of_interval), F.lit(False))})
    bins = own.withColumn("bin_start", F.explode(F.sequence("_first", "_last", F.lit(width)))).withColumn("bin_end", F.col("bin_start") + width)
    at_end = (F.col("bin_end") == F.col("interval_end")) & ~F.col("is_tail")
    hit = is_target(F.col("state"), F.col("following"))
    hour = F.pmod("bin_start", F.lit(DAY))
    common = (hour >= hours[0] * HOUR) & (hour + width <= hours[1] * HOUR)
    target, competing = at_end & hit, at_end & ~hit
    is_last = F.col("bin_start") == F.col("_end")
    reason = F.when(target, "target_event").when(competing, "competing_endpoint").when(F.col("is_tail"), "synthetic_right_censor").when(F.col("interval_end") > coverage_end, "coverage_right_censor")
    return bins.select(
        *keys, "interval_id", "state", "endpoint", "interval_start", "interval_end", F.when(at_end, F.col("following")).alias("following"), "bin_start", "bin_end", (F.col("_age") + F.col("bin_start") - F.col("start_us")).alias("age_us"),
        target.cast("int").alias("target"), competing.cast("int").alias("competing"), "split", common.alias("is_common"), "is_cross_split",
        (common & ~F.col("is_cross_split") & F.col("split").isin("development", "holdout")).alias("is_eligible"), is_last.alias("is_last"), F.when(is_last, reason).alias("censor_reason"),
    )


#: Why an interval's last cell is censored, as supported_bins says it, in the order of the alphabet.
CENSORS = ("competing_endpoint", "coverage_right_censor", "synthetic_right_censor", "target_event")


def support_audit(intervals: DataFrame, bins: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Each interval that meets [low, high] with its cells of supported_bins, outcomes, its last cell's censor reason and why no model uses it.

    Of several reasons the last that applies counts: ineligible_state, no_complete_bin, left_truncated, cross_development_holdout.
    """
    # Reasons by number: the largest text of a group would take a sort of all cells, where numbers are summed up in place.
    names = F.array(*[F.lit(c) for c in CENSORS])
    unknown = F.raise_error(F.concat(F.lit("an unknown censor reason: "), "censor_reason")).cast("long")
    number = F.when(F.col("censor_reason").isin(*CENSORS), F.array_position(names, F.col("censor_reason"))).when(F.col("censor_reason").isNotNull(), unknown)
    n = bins.groupBy(*keys, "interval_id").agg(F.count(F.lit(1)).alias("bins"), F.sum("target").alias("targets"), F.sum("competing").alias("competing"), F.bool_or("is_cross_split").alias("is_cross_split"), F.max(number).alias("_censor"))
    n = n.withColumn("censor_reason", F.get(names, F.col("_censor").cast("int") - 1)).drop("_censor")
    out = intervals.filter((F.col("end_us") >= low) & (F.col("start_us") <= high)).join(n, [*keys, "interval_id"], "left")
    out = out.withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("bins", "targets", "competing")} | {"is_cross_split": F.coalesce("is_cross_split", F.lit(False))})
    ineligible = endpoint_of(F.col("state")).isNull()
    reason = F.when(F.col("is_cross_split"), "cross_development_holdout").when(F.col("start_us") < low, "left_truncated").when(ineligible, "ineligible_state").when(F.col("bins") == 0, "no_complete_bin")
    return out.select(*keys, "interval_id", "state", "bins", "targets", "competing", "is_cross_split", "censor_reason", reason.alias("exclusion_reason"))


def day_state_summary(fragments: DataFrame) -> DataFrame:
    """Per day and state: fragments, intervals without length, raw, gap and tradeable time, and fragments that end in a target."""
    length = F.col("end_us") - F.col("start_us")
    ends = ~F.col("is_zero") & ~F.col("is_gap") & (F.col("end_us") == F.col("interval_end"))
    return fragments.groupBy(F.floor(F.col("start_us") / DAY).alias("day"), "state").agg(
        F.count_if(~F.col("is_zero")).alias("fragments"),
        F.count_if("is_zero").alias("zero"),
        F.sum(length).alias("raw_us"),
        F.sum(F.when(F.col("is_gap"), length).otherwise(0)).alias("gap_us"),
        F.sum(F.when(F.col("is_gap"), 0).otherwise(length)).alias("tradeable_us"),
        F.count_if(ends & is_target(F.col("state"), F.col("following"))).alias("targets"),
    )


def day_summary(by_state: DataFrame) -> DataFrame:
    """Eligible states of day_state_summary rolled up to days, with targets per 1000 tradeable seconds, halves to even."""
    own = by_state.filter(F.col("state").isin(*ENDPOINTS))
    out = own.groupBy("day").agg(*[F.sum(c).alias(c) for c in ("fragments", "raw_us", "gap_us", "tradeable_us", "targets")])
    return out.withColumn("density", F.bround(F.try_divide(F.col("targets") * 1e9, F.col("tradeable_us")), 9))


def _covered_before(keys: Sequence[str]) -> Callable:
    """For one bucket of spans: whether some instant of a span is in one that comes before it in the order."""

    def run(rows: pa.Table) -> pa.Table:
        start, end = rows["_start"].to_numpy(), rows["_end"].to_numpy()
        rank = np.unique(rows["_order"].to_numpy(), return_inverse=True)[1]
        cells = np.unique(np.concatenate([start, end]))
        i, j = np.searchsorted(cells, start), np.searchsorted(cells, end)
        # The first span over each cell: a span is two runs of 2^k cells, and a run hands what it has down to its halves.
        level, first = np.frexp((j - i).astype(float))[1] - 1, np.full(len(cells), len(rows))
        for k in range(int(level.max()), -1, -1):
            own = level == k
            np.minimum.at(first, i[own], rank[own])
            np.minimum.at(first, j[own] - 2**k, rank[own])
            if k:
                half = first.copy()
                half[2 ** (k - 1) :] = np.minimum(first[2 ** (k - 1) :], first[: -(2 ** (k - 1))])
                first = half
        covered = first[extremes(first.astype(float), i, j)[1]] < rank
        return pa.table({**{c: rows[c] for c in keys}, "_order": rows["_order"], "is_overlap": pa.array(covered)})

    return run


def overlap_flags(df: DataFrame, keys: Sequence[str], start: str, end: str, order: str, bucket: int = 30 * DAY) -> DataFrame:
    """(keys, order, is_overlap): whether a row's span [start, end) overlaps one that comes before it in the order, which names a key's rows.

    No pairs are listed: within a bucket of time each piece gets the first span over it, and a span is
    compared with the first over any of its pieces. A span without length overlaps nothing.
    """
    keys = list(keys)
    own = df.select(*keys, F.col(order).alias("_order"), F.col(start).cast("bigint").alias("_a"), F.col(end).cast("bigint").alias("_b"))
    cut = own.filter("_a < _b").withColumn("_bucket", F.explode(F.sequence(bucket_of("_a", bucket), bucket_of(F.col("_b") - 1, bucket))))
    cut = cut.withColumns({"_start": F.greatest("_a", F.col("_bucket") * bucket), "_end": F.least("_b", (F.col("_bucket") + 1) * bucket)}).drop("_a", "_b")
    shape = StructType([*[own.schema[c] for c in (*keys, "_order")], StructField("is_overlap", BooleanType())])
    found = cut.groupBy(*keys, "_bucket").applyInArrow(_covered_before(keys), shape)
    return found.groupBy(*keys, F.col("_order").alias(order)).agg(F.bool_or("is_overlap").alias("is_overlap"))


def overlapping(df: DataFrame, keys: Sequence[str], start: str, end: str, order: str) -> DataFrame:
    """Rows whose span overlaps one that comes before them in the order (the later one of a pair is rejected)."""
    flags = overlap_flags(df, keys, start, end, order).filter("is_overlap")
    return df.join(flags, [*keys, order], "left_semi")


def contiguous(df: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Each span with whether it begins where the one before it ends."""
    t = with_previous(df, keys, start, [], {"last_end": end}, 30 * DAY)
    return t.withColumn("contiguous", F.col("last_end") == F.col(start))
