"""What ticks before a moment say: look-back windows at anchors that needn't be ticks.

Anchors and ticks meet once, in buckets of time with a halo of earlier ticks. Within a bucket counts,
moves and their squares are differences of prefix sums, and extremes come from ranges whose length is
a power of two, so an anchor costs the same however many ticks its windows hold.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import DAY, asof_backward, bucket_of

# Kinds of rows in a bucket.
TICK, ANCHOR, GAP_START, GAP_END = range(4)

#: Fields of a window [us - w, us] and of the two parts [us - 2w, us - w) and [us - w, us).
WINDOW = ("valid boolean", "n long", "first double", "last double", "last_us long", "spread double", "high double", "low double", "high_us long", "low_us long", "ups long", "downs long", "squares double")
#: Of the two parts also when [us - w, us] first reaches an end of the earlier one, and how far the price has come back since from its farthest.
TOUCH = ("touch_valid boolean", "prior_n long", "prior_high double", "prior_low double", "before_high double", "before_low double", "high_touch_us long", "high_back double", "low_touch_us long", "low_back double")


def extremes(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the last largest and the last smallest value of each [start, end); -1 where that is empty.

    Level by level: the best of every run of 2^k values, of which two cover a range. One level is held at a time.
    """
    n = end - start
    level = np.where(n > 0, np.frexp(np.maximum(n, 1).astype(float))[1] - 1, -1)
    out = []
    for turned in (values, -values):
        later = lambda a, b: np.where(turned[b] >= turned[a], b, a)
        found, best = np.full(len(n), -1), np.arange(len(values))
        for k in range(int(level.max(initial=-1)) + 1):
            own = np.flatnonzero(level == k)
            found[own] = later(best[start[own]], best[end[own] - (1 << k)])
            if len(best) > 1 << k:
                best = later(best[: -(1 << k)], best[1 << k :])
        out.append(found)
    return out[0], out[1]


def first_reaching(values: np.ndarray, start: np.ndarray, end: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Place of the first value of each [start, end) that is at least its bound; -1 without one.

    Level k holds the largest of every aligned run of 2^k values. A place goes up while the run that
    begins at it doesn't reach the bound, then down to the value that does.
    """
    levels = [np.append(values, -np.inf)]  # never empty
    while len(levels[-1]) > 1:
        runs = levels[-1] if len(levels[-1]) % 2 == 0 else np.append(levels[-1], -np.inf)
        levels.append(np.maximum(runs[::2], runs[1::2]))
    place, at, climbing = np.array(start), np.zeros(len(start), int), (start < end) & ~np.isnan(bound)
    found = np.zeros(len(start), bool)
    for k, best in enumerate(levels):
        inside = climbing & (place < len(best))
        odd = inside & ((place % 2 == 1) | (k == len(levels) - 1))
        hit = odd & (best[np.where(odd, place, 0)] >= bound)
        found, at, climbing = found | hit, np.where(hit, k, at), inside & ~hit
        place = np.where(climbing, (place + odd) // 2, place)
    for k in range(len(levels) - 1, 0, -1):
        down = found & (at == k)
        left = np.where(down, place * 2, 0)
        place = np.where(down, left + (levels[k - 1][left] < bound), place)
        at = np.where(down, k - 1, at)
    return np.where(found & (place < end), place, -1)


def _windows(widths: Sequence[int], fields: Sequence[str]) -> Callable:
    """For one bucket: a row for each anchor with the fields of each width."""

    def run(rows: pa.Table) -> pa.Table:
        kind = rows["kind"].to_numpy()
        order = np.lexsort((rows["seq"].to_numpy(), rows["us"].to_numpy()))
        order_of = lambda k: order[kind[order] == k]
        us = rows["us"].to_numpy()
        ticks, anchors = order_of(TICK), order_of(ANCHOR)
        t, at = us[ticks], us[anchors]
        mid, spread = rows["mid"].to_numpy()[ticks], rows["spread"].to_numpy()[ticks]
        gap_starts, gap_ends = us[order_of(GAP_START)], us[order_of(GAP_END)]
        moves = np.diff(mid)
        sums = {name: np.concatenate([[0], np.cumsum(x)]) for name, x in (("ups", moves > 0), ("downs", moves < 0), ("squares", moves * moves))}
        first = rows["first_us"].to_numpy()[anchors]

        def crossed(start: np.ndarray) -> np.ndarray:
            """Whether a gap begins in [start, at) or ends in (start, at]; one around it all leaves no tick inside."""
            begun = np.searchsorted(gap_starts, at, "left") - np.searchsorted(gap_starts, start, "left")
            ended = np.searchsorted(gap_ends, at, "right") - np.searchsorted(gap_ends, start, "right")
            return begun + ended > 0

        def pick(source: np.ndarray, place: np.ndarray, there: np.ndarray) -> pa.Array:
            return pa.array(source[np.where(there, place, 0)] if len(source) else np.zeros(len(place), source.dtype), mask=~there)

        out, upto = {}, np.searchsorted(t, at, "right")
        for w in widths:
            begin = np.searchsorted(t, at - w, "left")
            n = upto - begin
            some = n > 0
            high, low = extremes(mid, begin, upto)
            value = {
                "valid": pa.array((n >= 2) & (at - w >= first) & ~crossed(at - w)),
                "n": pa.array(n),
                "first": pick(mid, begin, some),
                "last": pick(mid, upto - 1, some),
                "last_us": pick(t, upto - 1, some),
                "spread": pick(spread, upto - 1, some),
                "high": pick(mid, high, some),
                "low": pick(mid, low, some),
                "high_us": pick(t, high, some),
                "low_us": pick(t, low, some),
            }
            value |= {name: pa.array(np.where(some, s[np.maximum(upto - 1, 0)] - s[np.minimum(begin, len(s) - 1)], 0)) for name, s in sums.items()}
            if "prior_n" in fields:
                earlier, before = np.searchsorted(t, at - 2 * w, "left"), np.searchsorted(t, at, "left")
                high, low = extremes(mid, earlier, begin)
                own_high, own_low = extremes(mid, begin, before)
                value |= {
                    "touch_valid": pa.array((begin - earlier >= 2) & (n >= 2) & (at - 2 * w >= first) & ~crossed(at - 2 * w)),
                    "prior_n": pa.array(begin - earlier),
                    "prior_high": pick(mid, high, begin > earlier),
                    "prior_low": pick(mid, low, begin > earlier),
                    "before_high": pick(mid, own_high, before > begin),
                    "before_low": pick(mid, own_low, before > begin),
                }
                for side, end_of, turned in (("high", high, mid), ("low", low, -mid)):
                    bound = np.where(begin > earlier, turned[end_of] if len(turned) else 0.0, np.nan)
                    touch = first_reaching(turned, begin, upto, bound)
                    reached = touch >= 0
                    farthest = extremes(turned, np.where(reached, touch, 0), np.where(reached, upto, 0))[0]
                    value[f"{side}_touch_us"] = pick(t, touch, reached)
                    value[f"{side}_back"] = pa.array(turned[farthest] - turned[np.maximum(upto - 1, 0)] if len(turned) else np.zeros(len(at)), mask=~reached)
            out[f"w{w}"] = pa.StructArray.from_arrays([value[f] for f in fields], names=list(fields))
        keep = rows.select([c for c in rows.column_names if c not in ("kind", "mid", "spread", "first_us", "_bucket")]).take(pa.array(anchors))
        return pa.table({**{c: keep[c] for c in keep.column_names}, **out})

    return run


def look_back(anchors: DataFrame, ticks: DataFrame, keys: Sequence[str], widths: Sequence[int], gaps: DataFrame | None = None, touches: bool = True, bucket: int = DAY) -> DataFrame:
    """anchors (keys, us, seq) with a struct ``w<width>`` for each width of what its window holds.

    A window is [us - w, us]; of ticks of one time the last by seq counts as the last. valid: it holds two
    ticks or more, doesn't begin before the key's first tick and meets no gap that begins before its end
    and ends after its start. Moves are those between ticks in the window; the struct also has, if
    ``touches``, the extremes of [us - 2w, us - w) and of [us - w, us), and whether both have what they
    need (two ticks in the one, two up to the anchor in the other, no gap, not before the first tick); and
    of each end of the earlier part the first tick up to the anchor that reaches it and the way back since.
    Ticks: keys, us, seq, mid, spread, none of them null. gaps: keys, gap_start, gap_end; disjoint.
    ``bucket`` is so long that a task holds the ticks of one bucket and of the longest look-back before it.
    """
    keys = list(keys)
    reach = max(widths) * (2 if touches else 1)
    none = F.lit(None).cast("double")
    rows = ticks.select(*keys, "us", "seq", F.lit(TICK).alias("kind"), F.col("mid").cast("double").alias("mid"), F.col("spread").cast("double").alias("spread"))
    for name, kind in (("gap_start", GAP_START), ("gap_end", GAP_END)) if gaps is not None else ():
        rows = rows.unionByName(gaps.select(*keys, F.col(name).alias("us"), F.lit(0).cast("long").alias("seq"), F.lit(kind).alias("kind"), none.alias("mid"), none.alias("spread")))
    # What lies before a bucket but within reach of it is in it too.
    rows = rows.withColumn("_bucket", F.explode(F.sequence(bucket_of("us", bucket), bucket_of(F.col("us") + reach, bucket)))).withColumn("first_us", F.lit(None).cast("long"))
    points = anchors.select(*keys, "us", "seq", F.lit(ANCHOR).alias("kind"), none.alias("mid"), none.alias("spread"), bucket_of("us", bucket).alias("_bucket"))
    if keys:
        points = points.join(ticks.groupBy(*keys).agg(F.min("us").alias("first_us")), keys)
    else:
        points = points.withColumn("first_us", F.lit(ticks.agg(F.min("us")).first()[0]).cast("long")).filter("first_us IS NOT NULL")
    kinds = WINDOW + (TOUCH if touches else ())
    names = [f.split()[0] for f in kinds]
    shape = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.select(*keys, "us", "seq").schema) + "".join(f", w{w} struct<{', '.join(f.replace(' ', ':') for f in kinds)}>" for w in widths)
    columns = [*keys, "_bucket", "us", "seq", "kind", "mid", "spread", "first_us"]
    both = rows.select(*columns).unionByName(points.select(*columns))
    return both.groupBy(*keys, "_bucket").applyInArrow(_windows(widths, names), shape)


def state_reference(starts: DataFrame, ticks: DataFrame, keys: Sequence[str], gaps: DataFrame | None = None) -> DataFrame:
    """starts (keys, us) with reference, the mid of the last tick at or before it; null if there is none or a gap lies between."""
    found = asof_backward(starts, ticks, keys, "us", "us", ["seq"], {"reference": "mid", "reference_us": "us"})
    if gaps is None:
        return found.drop("reference_us")
    # A gap begins at a tick, so only one that begins at the reference itself can lie between.
    gap = gaps.select(*keys, F.col("gap_start").alias("reference_us"), F.lit(True).alias("_gap")).distinct()
    found = found.join(gap, [*keys, "reference_us"], "left")
    broken = F.col("_gap").isNotNull() & (F.col("reference_us") < F.col("us"))
    return found.withColumn("reference", F.when(~broken, F.col("reference"))).drop("reference_us", "_gap")


# Which way a price must move for an endpoint.
SIGNS = {"rehedge_sell_occurrence": 1.0, "rehedge_buy_occurrence": -1.0}
#: Validity flags in the order in which they exclude.
CHECKS = ("window_10_valid", "window_5_valid", "window_2_valid", "touch_5_valid", "touch_2_valid", "reference_valid", "snapshot_valid")


def share_of_range(value: Column, w: Column) -> Column:
    """Where in a window's range a value lies, one half if it is flat."""
    return F.when(w["high"] > w["low"], (value - w["low"]) / (w["high"] - w["low"])).otherwise(0.5)


def signed_features(bins: DataFrame, windows: dict[int, str], reference: str, endpoint: str = "endpoint") -> DataFrame:
    """bins with features of the windows 2, 5 and 10 (columns of structs) signed by the endpoint, their flags and all_features_valid.

    A feature is null where its window isn't valid, a signed one also where the endpoint has no sign.
    """
    sign = F.coalesce(*[F.when(F.col(endpoint) == e, F.lit(s)) for e, s in SIGNS.items()])
    w = {k: F.col(c) for k, c in windows.items()}
    flags = {f"window_{k}_valid": F.coalesce(w[k]["valid"], F.lit(False)) for k in (2, 5, 10)} | {f"touch_{k}_valid": F.coalesce(w[k]["touch_valid"], F.lit(False)) for k in (2, 5)}
    flags |= {"reference_valid": F.col(reference).isNotNull(), "snapshot_valid": flags["window_10_valid"] & w[10]["last"].isNotNull() & w[10]["spread"].isNotNull()}
    out: dict[str, Column] = {}
    for k in (2, 5):
        ok, touch_ok = flags[f"window_{k}_valid"], flags[f"touch_{k}_valid"]
        change = w[k]["last"] - w[k]["first"]
        imbalance = (w[k]["ups"] - w[k]["downs"]) / F.greatest(w[k]["n"] - 1, F.lit(1))
        up = w[k]["before_high"] >= w[k]["prior_high"]
        down = w[k]["before_low"] <= w[k]["prior_low"]
        out |= {
            f"signed_change_{k}": F.when(ok, sign * change),
            f"absolute_change_{k}": F.when(ok, F.abs(change)),
            f"signed_imbalance_{k}": F.when(ok, sign * imbalance),
            f"absolute_imbalance_{k}": F.when(ok, F.abs(imbalance)),
            f"width_{k}": F.when(ok, w[k]["high"] - w[k]["low"]),
            f"proximity_{k}": F.when(ok, F.when(sign > 0, share_of_range(w[k]["last"], w[k])).otherwise(F.when(w[k]["high"] > w[k]["low"], 1 - share_of_range(w[k]["last"], w[k])).otherwise(0.5))),
            f"side_touch_{k}": F.when(touch_ok, F.coalesce(F.when(sign > 0, up).otherwise(down), F.lit(False)).cast("double")),
            f"either_touch_{k}": F.when(touch_ok, (F.coalesce(up, F.lit(False)) | F.coalesce(down, F.lit(False))).cast("double")),
        }
    ten, shift = flags["window_10_valid"], w[10]["last"] - F.col(reference)
    out |= {"width_10": F.when(ten, w[10]["high"] - w[10]["low"]), "volatility_10": F.when(ten, F.sqrt(w[10]["squares"])), "spread": F.when(ten, w[10]["spread"])}
    out |= {"absolute_displacement": F.when(ten, F.abs(shift)), "signed_displacement": F.when(ten, sign * shift)}
    both = ["volatility_10", "spread", "absolute_displacement"]
    rehedge = [f"{x}_{k}" for x in ("signed_change", "signed_imbalance", "proximity", "side_touch") for k in (2, 5)] + [*both, "signed_displacement"]
    unlock = [f"{x}_{k}" for x in ("absolute_change", "absolute_imbalance", "width", "either_touch") for k in (2, 5)] + [*both, "width_10"]
    has = lambda names: F.forall(F.array(*[out[c] for c in names]), lambda x: x.isNotNull())
    every = F.when(sign.isNotNull(), has(rehedge)).otherwise(has(unlock))
    return bins.withColumns({**out, **flags, "all_features_valid": every}).drop(*windows.values())


def cause_features(events: DataFrame, windows: dict[int, str], reference: str, unbroken: Column) -> DataFrame:
    """events with features without an endpoint's sign: places in the ranges, changes, imbalances, touches above and below, displacement since the state's start.

    ``unbroken``: no gap lies between the state's start and the anchor; else the reference isn't valid.
    """
    w = {k: F.col(c) for k, c in windows.items()}
    flags = {f"window_{k}_valid": F.coalesce(w[k]["valid"], F.lit(False)) for k in (2, 5, 10)} | {f"touch_{k}_valid": F.coalesce(w[k]["touch_valid"], F.lit(False)) for k in (2, 5)}
    flags |= {"reference_valid": F.col(reference).isNotNull() & unbroken, "snapshot_valid": flags["window_10_valid"] & w[10]["last"].isNotNull() & w[10]["spread"].isNotNull()}
    out = {f"position_{k}": F.when(flags[f"window_{k}_valid"], share_of_range(w[k]["last"], w[k])) for k in (2, 5, 10)}
    for k in (2, 5):
        ok, touch_ok = flags[f"window_{k}_valid"], flags[f"touch_{k}_valid"]
        out[f"change_{k}"] = F.when(ok, w[k]["last"] - w[k]["first"])
        out[f"imbalance_{k}"] = F.when(ok, (w[k]["ups"] - w[k]["downs"]) / F.greatest(w[k]["n"] - 1, F.lit(1)))
        out[f"upper_touch_{k}"] = F.when(touch_ok, F.coalesce(w[k]["before_high"] >= w[k]["prior_high"], F.lit(False)).cast("double"))
        out[f"lower_touch_{k}"] = F.when(touch_ok, F.coalesce(w[k]["before_low"] <= w[k]["prior_low"], F.lit(False)).cast("double"))
    ten = flags["window_10_valid"]
    out["displacement"] = F.when(ten & flags["reference_valid"], w[10]["last"] - F.col(reference))
    out |= {"anchor_mid": F.when(ten, w[10]["last"]), "spread": F.when(ten, w[10]["spread"])}
    return events.withColumns({**out, **flags}).drop(*windows.values())


CAUSE_FEATURES = (*(f"position_{k}" for k in (2, 5, 10)), *(f"{x}_{k}" for x in ("change", "imbalance", "upper_touch", "lower_touch") for k in (2, 5)), "displacement")


def _span_extremes(rows: pa.Table) -> pa.Table:
    """For one bucket: the extremes of the ticks in each span (kind ANCHOR, from us to ``to``, ends included)."""
    kind, us = rows["kind"].to_numpy(), rows["us"].to_numpy()
    ticks, spans = np.flatnonzero(kind == TICK), np.flatnonzero(kind == ANCHOR)
    ticks = ticks[np.argsort(us[ticks], kind="stable")]
    t, values = us[ticks], rows["mid"].to_numpy()[ticks]
    start, end = np.searchsorted(t, us[spans], "left"), np.searchsorted(t, rows["to"].to_numpy()[spans], "right")
    high, low = extremes(values, start, np.maximum(start, end))
    there = high >= 0
    pick = lambda at: pa.array(values[np.where(there, at, 0)] if len(values) else np.zeros(len(at)), mask=~there)
    return pa.table({"span": rows["span"].take(pa.array(spans)), "high": pick(high), "low": pick(low)})


def extremes_between(spans: DataFrame, ticks: DataFrame, value: str, bucket: int, group: int) -> DataFrame:
    """spans (a column ``span`` that names them, start, end) with the highest and lowest value of the ticks in [start, end], null without a tick.

    A span's first and last bucket are looked into; the whole buckets between are met by their extremes,
    and where whole groups of ``group`` buckets lie between, by those of the groups. So a span costs two
    looks, two groups' buckets at most, and its length in groups.
    """
    wide = bucket * group
    by = lambda df, width: df.groupBy(bucket_of("us", width).alias("cell")).agg(F.max("_v").alias("high"), F.min("_v").alias("low"))
    t = ticks.select("us", F.col(value).cast("double").alias("_v"))
    small = by(t, bucket).withColumn("width", F.lit(bucket))
    large = small.groupBy(F.floor(F.col("cell") / group).cast("bigint").alias("cell")).agg(F.max("high").alias("high"), F.min("low").alias("low")).withColumn("width", F.lit(wide).cast("bigint"))
    own = spans.select("span", F.col("start").cast("bigint").alias("a"), F.col("end").cast("bigint").alias("b")).filter("a <= b")
    first, last = bucket_of("a", bucket), bucket_of("b", bucket)
    end_of_first = F.least(F.col("b"), (first + 1) * bucket - 1)
    looks = F.array(F.struct(F.col("a").alias("us"), end_of_first.alias("to")), F.when(first < last, F.struct((last * bucket).alias("us"), F.col("b").alias("to"))))
    ends = own.select("span", F.explode(looks).alias("x")).filter("x IS NOT NULL").select("span", F.col("x.us").alias("us"), F.col("x.to").alias("to"), F.lit(ANCHOR).alias("kind"), F.lit(None).cast("double").alias("mid"))
    both = ends.unionByName(t.select(F.lit(None).cast(spans.schema["span"].dataType).alias("span"), "us", F.lit(None).cast("bigint").alias("to"), F.lit(TICK).alias("kind"), F.col("_v").alias("mid")))
    shape = f"span {spans.schema['span'].dataType.simpleString()}, high double, low double"
    found = both.withColumn("_bucket", bucket_of("us", bucket)).groupBy("_bucket").applyInArrow(_span_extremes, shape)
    # Cells between the ends: small ones up to the first whole group, groups, small ones after the last.
    lo, hi = first + 1, last - 1
    g0, g1 = F.ceil(lo / group).cast("bigint"), F.floor((hi + 1) / group).cast("bigint") - 1
    none = F.array().cast("array<bigint>")
    run = lambda x, y: F.when(x <= y, F.sequence(x, y)).otherwise(none)
    cells = lambda ids, width: F.transform(ids, lambda c: F.struct(c.alias("cell"), F.lit(width).cast("bigint").alias("width")))
    wholes = F.when(g0 <= g1, F.concat(cells(run(lo, g0 * group - 1), bucket), cells(run(g0, g1), wide), cells(run((g1 + 1) * group, hi), bucket))).otherwise(cells(run(lo, hi), bucket))
    between = own.select("span", F.explode(wholes).alias("c")).select("span", "c.cell", "c.width")
    table = small.withColumn("width", F.col("width").cast("bigint")).unionByName(large)
    found = found.unionByName(between.join(table, ["cell", "width"]).select("span", "high", "low"))
    best = found.groupBy("span").agg(F.max("high").alias("high"), F.min("low").alias("low"))
    return spans.join(best, "span", "left")
