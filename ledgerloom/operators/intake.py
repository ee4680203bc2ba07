"""What exported quote files cover: spans and their union, sessions, repeats across files, gaps and what independent exports say of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import DAY, with_previous


def file_spans(ticks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each file's rows, first and last time, and how many of its rows have a time that others of it have, too."""
    times = ticks.groupBy(*keys, "us").agg(F.count(F.lit(1)).alias("n"))
    return times.groupBy(*keys).agg(F.sum("n").alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("repeated"))


def covered(spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The union of [first_us, last_us]: for each piece without a hole its bounds and how many spans make it.

    A sweep by start with the largest end so far; a span that begins beyond it begins a new piece. One
    row a file, not a tick.
    """
    order = W.partitionBy(*keys).orderBy("first_us", "last_us")
    reach = F.max("last_us").over(order.rowsBetween(W.unboundedPreceding, -1))
    new = F.coalesce(F.col("first_us") > reach, F.lit(True)).cast("int")
    pieces = spans.withColumn("_new", new).withColumn("piece", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    return pieces.groupBy(*keys, "piece").agg(F.min("first_us").alias("start_us"), F.max("last_us").alias("end_us"), F.count(F.lit(1)).alias("files"))


def repeated_across(ticks: DataFrame, keys: Sequence[str], content: Sequence[str], file: str) -> DataFrame:
    """For each key how many contents, and how many times alone, stand in more than one file. Counted, never dropped.

    A content is reduced to its smallest and largest file in each task before the shuffle.
    """
    both = (F.min(file) < F.max(file)).cast("bigint")
    rows = ticks.groupBy(*keys, *content).agg(both.alias("_content"), F.min(file).alias("_low"), F.max(file).alias("_high"))
    times = rows.groupBy(*keys, content[0]).agg(F.sum("_content").alias("contents"), (F.min("_low") < F.max("_high")).cast("bigint").alias("_time"))
    return times.groupBy(*keys).agg(F.sum("contents").alias("contents"), F.sum("_time").alias("times"))


def signed_gaps(ticks: DataFrame, keys: Sequence[str], threshold: int, sides: Sequence[str] = ("bid", "ask"), bucket: int = DAY) -> DataFrame:
    """Gaps longer than the threshold with the prices on both their sides, which say whether two exports have the same gap."""
    t = with_previous(ticks, keys, "us", ["seq"], {"gap_start": "us", **{f"left_{s}": s for s in sides}}, bucket)
    return t.filter(F.col("us") - F.col("gap_start") > threshold).select(*keys, "gap_start", F.col("us").alias("gap_end"), *[f"left_{s}" for s in sides], *[F.col(s).alias(f"right_{s}") for s in sides])


def session_coverage(ticks: DataFrame, gaps: DataFrame, keys: Sequence[str], first_by: int, last_from: int, registered: DataFrame | None = None) -> DataFrame:
    """Each key's days: rows, bounds, whether the first tick comes by ``first_by`` and the last from ``last_from`` (of the day) on, gaps within the day, status.

    PASS: on time at both ends and without a gap; else FAIL. With registered (keys, day), one row a key and
    day, only those days count and one without ticks is INCOMPLETE.
    """
    keys = list(keys)
    day = lambda us: F.floor(F.col(us) / DAY)
    days = ticks.groupBy(*keys, day("us").alias("day")).agg(F.count(F.lit(1)).alias("rows"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))
    inside = gaps.filter(day("gap_start") == day("gap_end")).groupBy(*keys, day("gap_start").alias("day")).agg(F.count(F.lit(1)).alias("gaps"))
    out = days.join(inside, [*keys, "day"], "left")
    out = out if registered is None else registered.select(*keys, "day").join(out, [*keys, "day"], "left")
    starts, ends = F.pmod("first_us", F.lit(DAY)) <= first_by, F.pmod("last_us", F.lit(DAY)) >= last_from
    none = F.col("rows").isNull()
    out = out.withColumns({"starts_on_time": starts, "ends_on_time": ends, "gaps": F.when(~none, F.coalesce("gaps", F.lit(0))), "rows": F.coalesce("rows", F.lit(0))})
    status = F.when(none, "INCOMPLETE").when(F.col("starts_on_time") & F.col("ends_on_time") & (F.col("gaps") == 0), "PASS").otherwise("FAIL")
    return out.withColumn("status", F.when(F.col("rows") == 0, "INCOMPLETE").otherwise(status)).select(*keys, "day", "rows", "first_us", "last_us", "starts_on_time", "ends_on_time", "gaps", "status")


def with_evidence(gaps: DataFrame, replicas: DataFrame, sessions: DataFrame, longest: int, run: str = "run", sides: Sequence[str] = ("bid", "ask")) -> DataFrame:
    """gaps (of signed_gaps with a class) with evidence, the first other run that has the very same gap, and whether a gap is accepted.

    A replica's gap must have the same bounds and the same ticks on both sides, and come from a run that
    covers the gap's day at both ends: a cut export has gaps of its own making. A gap longer than
    ``longest`` is excessive whatever else; a scheduled one is accepted, an unknown one only by evidence.
    """
    same = ["gap_start", "gap_end", *[f"left_{s}" for s in sides], *[f"right_{s}" for s in sides]]
    whole = sessions.filter("starts_on_time AND ends_on_time").select(F.col(run).alias("_run"), F.col("day").alias("_day"))
    other = replicas.select(F.col(run).alias("_run"), *same).withColumn("_day", F.floor(F.col("gap_start") / DAY)).join(whole, ["_run", "_day"])
    found = gaps.join(other, same).filter(F.col(run) != F.col("_run")).groupBy(run, *same).agg(F.min("_run").alias("evidence"))
    out = gaps.join(found, [run, *same], "left")
    excessive = F.col("gap_end") - F.col("gap_start") > longest
    kind = F.when(excessive, "excessive_coverage_gap").when((F.col("class") == "unknown_coverage_gap") & F.col("evidence").isNotNull(), "replicated_coverage_gap").otherwise(F.col("class"))
    out = out.withColumn("class", kind)
    used = F.when(F.col("class") == "replicated_coverage_gap", F.col("evidence"))
    return out.withColumns({"evidence": used, "accepted": F.col("class").isin("scheduled_market_closed", "replicated_coverage_gap")})


def amended(sessions: DataFrame, gaps: DataFrame, registered: DataFrame, keys: Sequence[str]) -> DataFrame:
    """sessions (keys, day, status) with the verdict on their key's registered gap, and the status that follows.

    registered: a row a key with gap_start and gap_end, within one day. It is accepted if all other
    sessions pass and the gap's own session has no gap within the day but this very one; that session
    then is PASS_WITH_REGISTERED_GAP. Else the verdict is the first of session_missing,
    unexpected_failure, gap_count and gap_changed, and nothing changes. Keys without a registered gap
    have none. gaps: of signed_gaps with the keys.
    """
    keys, day = list(keys), lambda c: F.floor(F.col(c) / DAY)
    one = registered.select(*keys, F.col("gap_start").alias("_from"), F.col("gap_end").alias("_to"), day("gap_start").alias("_day"))
    inside = gaps.filter(day("gap_start") == day("gap_end")).join(one, keys).filter(day("gap_start") == F.col("_day"))
    same = (F.col("gap_start") == F.col("_from")) & (F.col("gap_end") == F.col("_to"))
    found = inside.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.bool_or(same).alias("_same"))
    own = F.col("day") == F.col("_day")
    of_key = sessions.join(one, keys).groupBy(*keys).agg(F.bool_or(own).alias("_has"), F.bool_or(~own & (F.col("status") != "PASS")).alias("_failed"))
    verdict = F.when(~F.col("_has"), "session_missing").when(F.col("_failed"), "unexpected_failure").when(F.coalesce("_n", F.lit(0)) != 1, "gap_count").when(~F.col("_same"), "gap_changed").otherwise("accepted")
    verdicts = one.join(of_key, keys).join(found, keys, "left").select(*keys, "_day", verdict.alias("verdict"))
    out = sessions.join(verdicts, keys, "left")
    status = F.when(own & (F.col("verdict") == "accepted"), "PASS_WITH_REGISTERED_GAP").otherwise(F.col("status"))
    return out.withColumn("status", status).drop("_day")
