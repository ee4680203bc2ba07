"""Causal look-back windows: ranges, returns, touches and snapshots, by buckets with a halo."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .anchors import extremes, look_back
from .intervals import coverage_gaps
from .order import DAY, HOUR, SECOND, asof_backward, bucket_of, range_join, with_previous


def rolling(ticks: DataFrame, keys: Sequence[str], width: int, gap: int | None = None, bucket: int = DAY) -> DataFrame:
    """For each tick what [us - width, us] holds: range, position in it (one half if flat), distances and times from the last extremes, return, moves, their imbalance and volatility, spread.

    The return is the last price over the first, less one; moves are counted within the window only, so
    the step into its first tick is none of them; volatility is the root of their squares' sum. Valid
    with two ticks at least, a window that doesn't begin before the key's first tick and, where ``gap``
    is given, no gap between ticks longer than that from before the window's end to after its start.
    """
    keys = list(keys)
    rows = ticks.withColumn("spread", F.col("ask") - F.col("bid"))
    gaps = None if gap is None else coverage_gaps(ticks, keys, "us", ["seq"], gap, bucket)
    at = look_back(ticks.select(*keys, "us", "seq"), rows, keys, [width], gaps, touches=False, bucket=bucket).select(*keys, "us", "seq", f"w{width}.*")
    span, mid = F.col("high") - F.col("low"), F.col("last")
    return at.select(
        *keys, "seq", "us", "n", "high", "low", F.round(F.when(span > 0, (mid - F.col("low")) / span).otherwise(0.5), 9).alias("position"), F.round(F.col("high") - mid, 9).alias("from_high"), F.round(mid - F.col("low"), 9).alias("from_low"),
        (F.col("us") - F.col("high_us")).alias("since_high"), (F.col("us") - F.col("low_us")).alias("since_low"), F.round(F.try_divide(mid, F.col("first")) - 1, 9).alias("return"), F.round(mid - F.col("first"), 9).alias("change"), "ups", "downs",
        F.round((F.col("ups") - F.col("downs")) / F.greatest(F.col("n") - 1, F.lit(1)), 9).alias("imbalance"), F.round(F.sqrt(F.greatest("squares", F.lit(0.0))), 6).alias("volatility"), F.round("spread", 9).alias("spread"), "valid",
    )


def of_symbols(df: DataFrame, column: str, symbols: Sequence[str]) -> DataFrame:
    """Rows of the symbols, case and white space around them not minded."""
    return df.filter(F.upper(F.trim(column)).isin(*[s.strip().upper() for s in symbols]))


def boundary_touch(ticks: DataFrame, keys: Sequence[str], width: int, gap: int | None = None, bucket: int = DAY) -> DataFrame:
    """Two stages: the range of [us - 2w, us - w), and whether [us - w, us] reaches beyond either end of it, or [us - w, us) already did.

    touches_* and breach_* are null unless complete: ticks in the earlier part and a range above zero.
    touched_*, what may be known before the tick, need touch_valid: two ticks in each part, none of it
    before the key's first tick, and no gap longer than ``gap``.
    """
    keys = list(keys)
    gaps = None if gap is None else coverage_gaps(ticks, keys, "us", ["seq"], gap, bucket)
    t = look_back(ticks.select(*keys, "us", "seq"), ticks.withColumn("spread", F.lit(0.0)), keys, [width], gaps, bucket=bucket).select(*keys, "us", "seq", f"w{width}.*")
    complete = F.coalesce((F.col("prior_n") > 0) & (F.col("prior_high") > F.col("prior_low")), F.lit(False))
    when = lambda c: F.when(complete, c)
    above = lambda x: F.round(F.greatest(x, F.lit(0.0)), 9)
    known = lambda c: F.when(F.col("touch_valid"), F.coalesce(c, F.lit(False)))
    return t.select(
        *keys, "seq", "us", "prior_n", "prior_high", "prior_low", complete.alias("complete"), "touch_valid", when(F.col("high") >= F.col("prior_high")).alias("touches_high"), when(F.col("low") <= F.col("prior_low")).alias("touches_low"),
        known(F.col("before_high") >= F.col("prior_high")).alias("touched_high"), known(F.col("before_low") <= F.col("prior_low")).alias("touched_low"),
        when(above(F.col("high") - F.col("prior_high"))).alias("breach_high"), when(above(F.col("prior_low") - F.col("low"))).alias("breach_low"),
    )


def retracement(ticks: DataFrame, keys: Sequence[str], width: int, bucket: int = DAY) -> DataFrame:
    """Of ticks whose later part reaches an end of the earlier range: which side, when it first did, and how far the price has come back from its farthest since."""
    keys = list(keys)
    t = look_back(ticks.select(*keys, "us", "seq"), ticks.withColumn("spread", F.lit(0.0)), keys, [width], bucket=bucket).select(*keys, "us", "seq", f"w{width}.*")
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_touch_us").alias("touch_us"), F.col(f"{s}_back").alias("back")) for s in ("high", "low")])
    own = t.filter((F.col("prior_n") > 0) & (F.col("prior_high") > F.col("prior_low"))).select(*keys, "seq", "us", F.inline(sides)).filter("touch_us IS NOT NULL")
    return own.select(*keys, "side", "seq", "us", "touch_us", (F.col("us") - F.col("touch_us")).alias("lead"), F.round("back", 9).alias("retracement"))


def with_repeats(ticks: DataFrame, keys: Sequence[str], bucket: int = DAY) -> DataFrame:
    """ticks with us_before, the time of the one before, and repeats: it has the same time, or the tick is marked as a duplicate."""
    t = with_previous(ticks, keys, "us", ["seq"], {"us_before": "us"}, bucket)
    return t.withColumn("repeats", F.col("duplicate") | F.coalesce(F.col("us") == F.col("us_before"), F.lit(False)))


#: Stands for a price that isn't there, among prices as whole numbers.
NONE = -(1 << 62)


def _prefixes(width: int, lookback: int) -> Callable:
    """For one bucket: what the ticks of each decision's prefix are, and those from its anchor on."""

    def run(rows: pa.Table) -> pa.Table:
        is_tick, us, seq = rows["tick"].to_numpy(), rows["us"].to_numpy(), rows["seq"].to_numpy()
        ticks, decisions = np.flatnonzero(is_tick), np.flatnonzero(~is_tick)
        ticks = ticks[np.lexsort((seq[ticks], us[ticks]))]
        t, at = us[ticks], us[decisions]
        mid, spread = rows["mid"].to_numpy()[ticks], rows["spread"].to_numpy()[ticks]
        # Ticks of one time are in the same buckets, so the one before a repeat is there too.
        repeats = rows["duplicate"].to_numpy()[ticks] | np.r_[False, t[1:] == t[:-1]][: len(t)]
        start, upto = np.searchsorted(t, at - lookback, "left"), np.searchsorted(t, at, "right")
        anchor = np.searchsorted(t, at - width, "right") - 1
        some, anchored = upto > start, anchor >= start
        first = np.where(anchored, anchor, upto)

        def any_of(flags: np.ndarray, begin: np.ndarray) -> pa.Array:
            upto_each = np.r_[0, np.cumsum(flags)]
            return pa.array(upto_each[upto] > upto_each[begin])

        def pick(source: np.ndarray, place: np.ndarray, there: np.ndarray) -> pa.Array:
            found = source[np.where(there, place, 0)] if len(source) else np.full(len(place), NONE)
            return pa.array(found, mask=~there | (found == NONE))

        waits = np.r_[0, np.diff(t)][: len(t)]
        longest = extremes(waits, np.minimum(first + 1, upto), upto)[0]
        high, low = extremes(mid, first, upto)[0], extremes(np.where(mid == NONE, -NONE, mid), first, upto)[1]
        return pa.table(
            {
                "decision_id": rows["decision_id"].take(pa.array(decisions)), "us": pa.array(at), "n": pa.array(upto - np.maximum(np.searchsorted(t, at - width, "left"), start)), "invalid": any_of(rows["invalid"].to_numpy()[ticks], start),
                "anchor_us": pick(t, anchor, anchored), "repeats": any_of(repeats, start), "window_repeats": any_of(repeats, first), "longest": pick(waits, longest, longest >= 0), "last_us": pick(t, upto - 1, some), "high": pick(mid, high, high >= 0),
                "low": pick(mid, low, low >= 0), "first": pick(mid, anchor, anchored), "last": pick(mid, upto - 1, some), "spread": pick(spread, upto - 1, some),
            }
        )

    return run


def snapshot(decisions: DataFrame, ticks: DataFrame, keys: Sequence[str], width: int, gap: int, lookback: int, bucket: int = DAY) -> DataFrame:
    """What a policy may know at a decision, from the ticks of [us - lookback, us], its prefix.

    The anchor is the last tick at or before us - width; what counts is the anchor and all after it.
    Increment, adverse excursions and spread are in points of 0.01, exact in decimals. They are null
    unless support is "supported"; the other reasons, the first that applies: invalid_row (any in the
    prefix isn't valid), empty_prefix, without an anchor duplicate_timestamp (any in the prefix
    repeats a time) or no_anchor, with one duplicate_timestamp (the anchor or a later one does),
    quote_gap (between ticks or up to the decision longer than ``gap``; longest_gap says how long). n:
    ticks of [us - width, us]. decisions needs keys, decision_id and us; ticks seq, us, bid, ask,
    valid and duplicate. Decisions and ticks meet once, in buckets of time with a halo of the look-back;
    counts and extremes there are those of places in the ticks' order, so no decision lists its prefix.
    """
    keys = list(keys)
    exact = "decimal(16,8)"
    whole = lambda x, scale: F.coalesce((x * 10**scale).cast("bigint"), F.lit(NONE))
    flag = lambda x: F.coalesce(x, F.lit(False))
    t = ticks.withColumns({"bid": F.col("bid").cast(exact), "ask": F.col("ask").cast(exact)})
    mid, spread = ((F.col("bid") + F.col("ask")) / 2).cast("decimal(18,9)"), F.col("ask") - F.col("bid")
    none = F.lit(None).cast(decisions.schema["decision_id"].dataType).alias("decision_id")
    t = t.select(*keys, F.lit(True).alias("tick"), F.col("us").cast("bigint").alias("us"), F.col("seq").cast("bigint").alias("seq"), none, whole(mid, 9).alias("mid"), whole(spread, 8).alias("spread"), flag(~F.col("valid")).alias("invalid"), flag(F.col("duplicate")).alias("duplicate"))
    t = t.dropna(subset=[*keys, "us"]).withColumn("_bucket", F.explode(F.sequence(bucket_of("us", bucket), bucket_of(F.col("us") + lookback, bucket))))
    at = decisions.select(*keys, F.lit(False).alias("tick"), F.coalesce(F.col("us").cast("bigint"), F.lit(NONE)).alias("us"), F.lit(0).cast("bigint").alias("seq"), "decision_id", *[F.lit(NONE).alias(c) for c in ("mid", "spread")], *[F.lit(False).alias(c) for c in ("invalid", "duplicate")])
    both = t.unionByName(at.withColumn("_bucket", bucket_of("us", bucket)))
    kinds = {c: "boolean" for c in ("invalid", "repeats", "window_repeats")}
    names = ("us", "n", "invalid", "anchor_us", "repeats", "window_repeats", "longest", "last_us", "high", "low", "first", "last", "spread")
    shape = f"decision_id {decisions.schema['decision_id'].dataType.simpleString()}, " + ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in names)
    out = both.groupBy(*keys, "_bucket").applyInArrow(_prefixes(width, lookback), shape)
    price = lambda c, scale, kind: (F.col(c).cast("decimal(19,0)") * F.lit(f"1e-{scale}").cast(f"decimal({scale},{scale})")).cast(kind)
    out = out.withColumns({"us": F.when(F.col("us") > NONE, F.col("us")), **{c: price(c, 9, "decimal(18,9)") for c in ("high", "low", "first", "last")}, "spread": price("spread", 8, "decimal(17,8)")})
    longest = F.greatest(F.coalesce("longest", F.lit(0)), F.col("us") - F.col("last_us"))
    support = (
        F.when(F.col("invalid"), "invalid_row")
        .when(F.col("last_us").isNull(), "empty_prefix")
        .when(F.col("anchor_us").isNull(), F.when(F.col("repeats"), "duplicate_timestamp").otherwise("no_anchor"))
        .when(F.col("window_repeats"), "duplicate_timestamp")
        .when(longest > gap, "quote_gap")
        .otherwise("supported")
    )
    out = out.withColumns({"support": support, "longest": longest})
    points = lambda x: F.when(F.col("support") == "supported", x * 100)
    return out.select(
        "decision_id", "us", "support", F.coalesce("n", F.lit(0)).alias("n"), points(F.col("last") - F.col("first")).alias("increment"), points(F.col("first") - F.col("low")).alias("buy_adverse"),
        points(F.col("high") - F.col("first")).alias("sell_adverse"), points(F.col("spread")).alias("spread"), F.when(F.col("support").isin("supported", "quote_gap"), F.col("longest")).alias("longest_gap"),
    )


def rule_snapshot(decisions: DataFrame, ticks: DataFrame, keys: Sequence[str], width: int, bucket: int = DAY) -> DataFrame:
    """What a rule may look at when it decides: decisions (keys, decision_id, us, state) with features of the ticks up to then.

    spread (points of 0.01) and quote_gap (since the tick before it, 0 without one) are those of the last
    tick, rate is ticks a second in [us - width, us], session the part of the UTC day (asia to 8, europe
    to 16, us). The anchor is the last tick at or before us - width: increment is the way from it to the
    last tick; adverse, for a state with one leg, the farthest that the price went against that leg from the
    anchor on. Without an anchor both are null, without any tick all are. Ticks (us, seq, bid, ask, mid)
    have different times within a key. As-of joins and windows in buckets: no decision meets the ticks of its past.
    """
    keys = list(keys)
    t = with_previous(ticks, keys, "us", ["seq"], {"us_before": "us"}, bucket)
    out = asof_backward(decisions.withColumn("_early", F.col("us") - width), t, keys, "us", "us", ["seq"], {"_us": "us", "_before": "us_before", "_bid": "bid", "_ask": "ask", "_last": "mid"}, bucket=bucket)
    out = asof_backward(out, t, keys, "_early", "us", ["seq"], {"_first": "mid"}, bucket=bucket)
    moments = decisions.select(*keys, "us").distinct().withColumn("seq", F.lit(0).cast("bigint"))
    seen = look_back(moments, ticks.withColumn("spread", F.lit(0.0)), keys, [width], touches=False, bucket=bucket).select(*keys, "us", f"w{width}.n", f"w{width}.high", f"w{width}.low")
    out = out.join(seen, [*keys, "us"], "left")
    there, anchored = F.col("_us").isNotNull(), F.col("_first").isNotNull()
    hour = F.floor(F.pmod("us", F.lit(DAY)) / HOUR)
    # The anchor is the last tick too where the window is empty: least and greatest pass over nulls.
    against = F.when(F.col("state") == "ONE_BUY", F.col("_first") - F.least("_first", "low")).when(F.col("state") == "ONE_SELL", F.greatest("_first", "high") - F.col("_first"))
    return out.select(
        *decisions.columns, ((F.col("_ask") - F.col("_bid")) / 0.01).alias("spread"), F.when(there, F.coalesce(F.col("_us") - F.col("_before"), F.lit(0))).alias("quote_gap"), F.when(there, F.coalesce("n", F.lit(0)) / (width / SECOND)).alias("rate"),
        F.when(there, F.when(hour < 8, "asia").when(hour < 16, "europe").otherwise("us")).alias("session"), (F.col("_last") - F.col("_first")).alias("increment"), F.when(anchored, against).alias("adverse"),
    )


def quote_times(quotes: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A row for each time of quotes: valid ones at it, whether one of them is a duplicate, whether one isn't valid, the first's sequence."""
    return quotes.groupBy(*keys, "us").agg(
        F.count_if("valid").alias("n"), F.bool_or(F.col("valid") & F.col("duplicate")).alias("duplicate"), F.bool_or(~F.col("valid")).alias("invalid"), F.min(F.when(F.col("valid"), F.col("seq"))).alias("seq")
    )


def execution_quotes(targets: DataFrame, quotes: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """The first valid quote of [us, us + horizon] of each target, refused if there is none, an invalid one comes at or before it, another has its time, or it is a duplicate."""
    pairs = range_join(targets.select(*keys, "anchor_id", "us"), quote_times(quotes, keys), keys, F.col("us"), F.col("us") + horizon + 1, "us", horizon)
    got = pairs.groupBy("l.anchor_id").agg(F.min(F.when(F.col("r.n") > 0, F.col("r"))).alias("q"), F.min(F.when(F.col("r.invalid"), F.col("r.us"))).alias("invalid_us"))
    out = targets.select("anchor_id").join(got.select("anchor_id", "invalid_us", F.col("q.us").alias("q_us"), F.col("q.n").alias("n"), F.col("q.duplicate").alias("duplicate"), F.col("q.seq").alias("seq")), "anchor_id", "left")
    status = F.when(F.col("q_us").isNull(), "no_quote").when(F.col("invalid_us") <= F.col("q_us"), "invalid_quote").when(F.col("n") > 1, "same_time").when(F.col("duplicate"), "duplicate").otherwise("selected")
    return out.select("anchor_id", status.alias("status"), F.when(status == "selected", F.col("q_us")).alias("quote_us"), F.when(status == "selected", F.col("seq")).alias("quote_seq"))


def mark_quotes(marks: DataFrame, quotes: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """The last valid quote of [us - horizon, us] of each mark, refused if there is none, two valid ones there have one time, one is a duplicate, or an invalid one comes at or after it."""
    pairs = range_join(marks.select(*keys, "anchor_id", "us"), quote_times(quotes, keys), keys, F.col("us") - horizon, F.col("us") + 1, "us", horizon)
    good = F.when(F.col("r.n") > 0, F.struct("r.us", "r.seq"))
    got = pairs.groupBy("l.anchor_id").agg(F.max(good).alias("q"), F.max("r.n").alias("n"), F.bool_or("r.duplicate").alias("duplicate"), F.max(F.when(F.col("r.invalid"), F.col("r.us"))).alias("invalid_us"))
    out = marks.select("anchor_id").join(got.select("anchor_id", "n", "duplicate", "invalid_us", F.col("q.us").alias("q_us"), F.col("q.seq").alias("seq")), "anchor_id", "left")
    status = F.when(F.col("q_us").isNull(), "no_quote").when(F.col("n") > 1, "same_time").when(F.col("duplicate"), "duplicate").when(F.col("invalid_us") >= F.col("q_us"), "invalid_quote").otherwise("selected")
    return out.select("anchor_id", status.alias("status"), F.when(status == "selected", F.col("q_us")).alias("quote_us"), F.when(status == "selected", F.col("seq")).alias("quote_seq"))


def first_reason(reasons: dict[str, Column]) -> Column:
    """The name of the first condition that holds, null if none does."""
    return F.coalesce(*[F.when(c, F.lit(name)) for name, c in reasons.items()])


def cap_at(value: Column, cap: Column) -> Column:
    """Clip from above; null stays null."""
    return F.when(value.isNotNull(), F.least(value, cap))
