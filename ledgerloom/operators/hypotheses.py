"""What a hypothesis expects of the price before an event, against the event's controls, by window and by shift of the event's time."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .anchors import look_back, share_of_range


def expected(behavior: Column, us: Column, w: Column) -> dict[str, Column]:
    """Scores that are large where a hypothesis holds, null where its window isn't valid or it says nothing of the behaviour.

    h1: the price stands near the end of its range that a re-hedge sells or buys at. The second has two
    stages, and needs an earlier range above zero: before the event the price has touched that range's
    end on the side that is traded (h2_touch), has come back from its farthest since, as a share of the
    earlier range (h2_retracement_raw), or both (h2). h3: it has moved the way that an unlock leaves open.
    """
    sell, rehedge, to_buy = behavior == "REHEDGE_SELL", behavior.startswith("REHEDGE"), behavior == "UNLOCK_TO_BUY"
    place = share_of_range(w["last"], w)
    of_side = lambda f: F.when(sell, w[f"high_{f}"]).otherwise(w[f"low_{f}"])
    touched = F.coalesce(of_side("touch_us") < us, F.lit(False))
    back = F.when(touched, F.greatest(of_side("back"), F.lit(0.0))).otherwise(0.0)
    two_stages = rehedge & w["touch_valid"] & (w["prior_high"] > w["prior_low"])
    change = F.try_divide(w["last"], w["first"]) - 1
    return {
        "h1": F.when(w["valid"] & rehedge, F.when(sell, place).otherwise(1 - place)),
        "h2_touch": F.when(two_stages, touched.cast("double")),
        "h2_retracement_raw": F.when(two_stages, back / (w["prior_high"] - w["prior_low"])),
        "h2": F.when(two_stages, (touched & (back > 0)).cast("double")),
        "h3": F.when(w["valid"] & ~rehedge, F.when(to_buy, change).otherwise(-change)),
    }


#: The scores of expected() in order, and that of one of them clipped from above.
SCORES = ("h1", "h2_touch", "h2_retracement_raw", "h2", "h3")
RAW, CAPPED = "h2_retracement_raw", "h2_retracement"


def places(widths: Sequence[int], shifts: Sequence[int]) -> list[tuple[str, int, int]]:
    """Which (hypothesis, window, shift) each place of paired_scores()' differences is."""
    return [(h, w, s) for s in shifts for w in widths for h in (*SCORES, CAPPED)]


def _differences(shifts: Sequence[int], caps: Sequence[float | None]) -> Callable:
    """Of rows in the order of events: a row an event with its scores at each shift, less the mean of its controls'."""
    raw = SCORES.index(RAW)
    limits = np.array([np.nan if c is None else c for c in caps])
    shape = (-1, len(caps), len(SCORES))

    def of_events(rows: pa.Table) -> pa.RecordBatch:
        scores = rows["scores"].combine_chunks().flatten()
        known = ~scores.is_null().to_numpy(zero_copy_only=False).reshape(shape)
        value = np.where(known, scores.to_numpy(zero_copy_only=False).reshape(shape), 0.0)
        value, known = (np.concatenate([x, x[:, :, raw : raw + 1]], axis=2) for x in (value, known))
        value[:, :, -1] = np.fmin(value[:, :, -1], limits[None, :])
        events, shift = rows["event_id"].to_numpy(), rows["shift"].combine_chunks()
        first = np.flatnonzero(np.r_[True, events[1:] != events[:-1]])
        event = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(events)]))
        control = shift.is_null().to_numpy(zero_copy_only=False)
        add = lambda x: np.add.reduceat(np.where(control[:, None, None], x, 0), first, axis=0)
        n = add(known.astype(np.int64))
        mean = add(value) / np.maximum(n, 1)
        out, there = np.zeros((len(first), len(shifts), *value.shape[1:])), np.zeros((len(first), len(shifts), *value.shape[1:]), bool)
        at = shift.fill_null(0).to_numpy()
        for k, s in enumerate(shifts):
            own = np.flatnonzero(~control & (at == s))
            out[event[own], k], there[event[own], k] = value[own] - mean[event[own]], known[own] & (n[event[own]] > 0)
        ends = np.arange(len(first) + 1, dtype=np.int32) * out[0].size
        differences = pa.ListArray.from_arrays(pa.array(ends), pa.array(out.ravel(), mask=~there.ravel()))
        return pa.RecordBatch.from_arrays([rows[c].combine_chunks().take(pa.array(first)) for c in ("event_id", "split")] + [differences], names=["event_id", "split", "differences"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if not rows.num_rows:
                continue
            # The last event may go on in the next batch.
            events = rows["event_id"].to_numpy()
            whole = np.count_nonzero(events != events[-1])
            if whole:
                yield of_events(rows.slice(0, whole))
            held = rows.slice(whole)
        if held is not None:
            yield of_events(held)

    return run


def paired_scores(positives: DataFrame, controls: DataFrame, ticks: DataFrame, widths: Sequence[int], shifts: Sequence[int], bucket: int, quantile: float = 0.99) -> DataFrame:
    """(event_id, split, differences): an event's scores less the mean of its controls', null where one of both has none; at which place which is says places().

    positives: event_id (which names one event), behavior, split, sample_us; controls: event_id, sample_us. Both are read
    more than once. Events are looked at ``shift`` away from their time, controls at theirs; each distinct moment of a behaviour is scored
    a single time, and scores stay in one row an event, never a row each. h2_retracement is the raw one clipped, by window, at
    its quantile among the events of the split "development" at their own times; without any of them nothing is clipped.
    """
    own = positives.select("event_id", "behavior", "split", F.explode(F.array(*[F.lit(s).cast("bigint") for s in shifts])).alias("shift"), "sample_us").withColumn("us", F.col("sample_us") + F.col("shift")).drop("sample_us")
    others = controls.join(positives.select("event_id", "behavior", "split"), "event_id").select("event_id", "behavior", "split", F.lit(None).cast("bigint").alias("shift"), F.col("sample_us").alias("us"))
    rows = own.unionByName(others)
    moments = written(rows.select("us", "behavior").distinct(), "hypothesis-moments")
    at = look_back(moments.select("us").distinct().withColumn("seq", F.lit(0).cast("bigint")), ticks, [], widths, bucket=bucket).drop("seq")
    scores = F.array(*[expected(F.col("behavior"), F.col("us"), F.col(f"w{w}"))[h].cast("double") for w in widths for h in SCORES])
    scored = moments.join(at.hint("merge"), "us").select("us", "behavior", scores.alias("scores")).filter(F.exists("scores", lambda x: x.isNotNull()))
    scored = written(scored, "hypothesis-scores")
    # The quantile is over events, which are counted by moment; a row a window comes to the driver.
    fitted = positives.filter("split = 'development'").groupBy(F.col("sample_us").alias("us"), "behavior").agg(F.count(F.lit(1)).alias("n")).join(scored.hint("merge"), ["us", "behavior"])
    raw = F.array(*[F.struct(F.lit(k).alias("place"), F.col("scores")[k * len(SCORES) + SCORES.index(RAW)].alias("score")) for k in range(len(widths))])
    caps = fitted.select("n", F.inline(raw)).filter("score IS NOT NULL").groupBy("place", "score").agg(F.sum("n").alias("n")).groupBy("place").agg(F.percentile("score", quantile, F.col("n")).alias("cap"))
    cap = {r.place: r.cap for r in caps.collect()}
    rows = rows.join(scored.hint("merge"), ["us", "behavior"]).select("event_id", "split", "shift", "scores")
    return rows.repartition("event_id").sortWithinPartitions("event_id").mapInArrow(_differences(shifts, [cap.get(k) for k in range(len(widths))]), "event_id bigint, split string, differences array<double>")


def stability(verdicts: DataFrame, keys: Sequence[str], shift: int) -> DataFrame:
    """Of verdicts by keys and shift those at the event's own time and at ``shift`` before it, and whether both are of one class.

    Classes: supported, rejected and mixed are each their own, all others are unresolved. Verdicts at
    later moments are not asked.
    """
    kind = lambda c: F.when(F.col(c).isin("supported", "rejected", "mixed"), F.col(c)).otherwise("unresolved")
    pick = lambda s: F.max(F.when(F.col("shift") == s, F.col("verdict")))
    out = verdicts.groupBy(*keys).agg(pick(0).alias("at_event"), pick(shift).alias("before_event"))
    return out.withColumn("stable", F.coalesce(kind("at_event") == kind("before_event"), F.lit(False)))
