"""Which bins may be used, and the table of what came before each unlock: candidates, exclusions, one row an event, four tables from one plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import sample_id
from .features import first_reason
from .intervals import crosses_gap


def fails(condition: Column, message: str) -> Column:
    """True, or an error when a row is read for which the condition holds."""
    return F.when(condition, F.raise_error(F.lit(message)).isNull()).otherwise(True)


def candidate_bins(bins: DataFrame, role: Column, floor: int) -> DataFrame:
    """Bins in common hours of intervals within one part of the data, on days with a role; below_floor: an unlock's whose state is younger than ``floor``.

    bins: of supported_bins, which carries the interval's start. A bin without one is an error.
    """
    own = bins.filter(F.col("is_common") & ~F.col("is_cross_split")).withColumn("role", role).filter(F.col("role").isNotNull())
    own = own.filter(fails(F.col("interval_start").isNull(), "a bin without its interval's start"))
    return own.withColumn("below_floor", (F.col("endpoint") == "unlock_occurrence") & (F.col("age_us") < floor))


def audited(rows: DataFrame, rules: dict[str, Column], flags: Sequence[str], features: Sequence[str] | None = None) -> DataFrame:
    """rows with reason, the first rule that holds or flag that doesn't (without its _valid), and is_joint_valid.

    A row without a reason whose features aren't all there is an error: the flags must say all that can
    be missing. Features: those named, or what all_features_valid says.
    """
    reason = first_reason({**rules, **{f.removesuffix("_valid"): ~F.col(f) for f in flags}})
    complete = F.col("all_features_valid") if features is None else F.forall(F.array(*features), lambda x: x.isNotNull())
    out = rows.withColumn("reason", reason)
    return out.filter(fails(F.col("reason").isNull() & ~complete, "a joint-valid row lacks a feature")).withColumn("is_joint_valid", F.col("reason").isNull())


def unlock_events(candidates: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """The one terminal bin of each unlock among candidates, with its cause (1 if it unlocks to buy) and a digest as its name.

    Errors when read: another following event than the two unlocks, a bin outside common hours or of an
    interval in both parts, two bins of one interval.
    """
    own = candidates.filter((F.col("endpoint") == "unlock_occurrence") & (F.col("target") == 1))
    copies = F.count(F.lit(1)).over(W.partitionBy(*keys, "interval_id"))
    own = own.withColumn("_copies", copies)
    own = own.filter(fails(~F.coalesce(F.col("following").isin("UNLOCK_TO_BUY", "UNLOCK_TO_SELL"), F.lit(False)), "an unlock by another event"))
    own = own.filter(fails(~F.col("is_common") | F.col("is_cross_split"), "an unlock outside the support")).filter(fails(F.col("_copies") > 1, "an unlock twice")).drop("_copies")
    return own.withColumns({"cause": (F.col("following") == "UNLOCK_TO_BUY").cast("int"), "sample_id": sample_id(*[F.col(k) for k in keys], F.col("interval_id"), F.lit(width))})


def unbroken(rows: DataFrame, gaps: DataFrame, start: str, at: str) -> DataFrame:
    """rows with unbroken: no gap lies between a state's start and the anchor, however long that is."""
    return crosses_gap(rows, gaps, start, at).withColumn("unbroken", ~F.col("crosses_gap")).drop("crosses_gap")


def cause_tables(audit: DataFrame, features: Sequence[str], flags: Sequence[str], keys: Sequence[str] = ("acct",)) -> dict[str, DataFrame]:
    """audit: every event with its flags and reason; predictors, targets, and both with what names them (design): the joint-valid ones."""
    valid = audit.filter("is_joint_valid")
    named = [*keys, "interval_id", "role", "day", "bin_start", "age_us"]
    return {
        "audit": audit.select("sample_id", *named, "following", "cause", "anchor_mid", "spread", *flags, "reason", "is_joint_valid"),
        "predictors": valid.select("sample_id", *features),
        "targets": valid.select("sample_id", "cause"),
        "design": valid.select("sample_id", *named, "cause", *features),
    }


def counted_bins(candidates: DataFrame) -> DataFrame:
    """Candidates by all that their windows, their reference and the rules that exclude them depend on, with how many there are (bins) and their targets.

    There are as many rows as pairs of times that occur, however many intervals share them.
    """
    return candidates.groupBy("bin_start", "interval_start", "endpoint", "below_floor").agg(F.count(F.lit(1)).alias("bins"), F.sum("target").alias("targets"))


def accounts(audit: DataFrame, time: Column, windows: dict[str, tuple[int, int]], width: int) -> DataFrame:
    """By window (of a bin's time of day), endpoint and reason: bins, events and their time, with a total for each endpoint and for each window.

    audit: of counted_bins. A row is dealt to the windows that hold it and summed once for all groupings;
    the null reason is a group of its own, joint_valid, and not a total. Reasons that don't add up to
    their endpoint's total are an error when read.
    """
    inside = F.array_compact(F.array(*[F.when((time >= a) & (time < b), F.lit(name)) for name, (a, b) in windows.items()]))
    rows = audit.select(F.explode(inside).alias("hours"), "endpoint", F.coalesce("reason", F.lit("joint_valid")).alias("reason"), "bins", "targets")
    cells = rows.groupBy("hours", "endpoint", "reason").agg(F.sum("bins").alias("bins"), F.sum("targets").alias("targets"))
    sums = [F.sum("bins").alias("bins"), F.sum("targets").alias("targets")]
    sets = cells.groupingSets([[F.col("hours"), F.col("endpoint"), F.col("reason")], [F.col("hours"), F.col("endpoint")], [F.col("hours")]], "hours", "endpoint", "reason")
    out = sets.agg(F.grouping("reason").alias("_total"), *sums).withColumn("reason", F.when(F.col("_total") == 1, "total").otherwise(F.col("reason")))
    parts = F.sum(F.when(F.col("_total") == 0, F.col("bins"))).over(W.partitionBy("hours", "endpoint"))
    out = out.withColumn("_parts", parts).filter(fails((F.col("_total") == 1) & (F.col("_parts") != F.col("bins")), "reasons don't add up to their total"))
    return out.select("hours", "endpoint", "reason", "bins", "targets", (F.col("bins") * width).alias("us"))
