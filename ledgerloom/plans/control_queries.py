"""Matched samples of the aligned events: positives, their lineage, the control pool and the controls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import controls as C
from ..operators import lifecycle as L
from ..operators.order import HOUR
from ..sources.shared import written
from .tick_queries import ALIGN_SQL, UNIT, quotes
from .views import positions

Q, SQL = {}, {}
SPAN = 24 * HOUR
EXCLUSION = 3 * UNIT * 10
STEP = 10 * UNIT


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# All aligned events of the four behaviours with a match are samples; a unit is ten minutes, a sample's hour a day.
FAMILY = "CASE WHEN behavior LIKE 'REHEDGE%' THEN 'rehedge' ELSE 'unlock' END"
STATE = "CASE behavior " + " ".join(f"WHEN '{b}' THEN '{s}'" for b, s in C.REQUIRED_STATE.items()) + " END"
STRATUM = "CASE WHEN {0} <= 6 THEN '0-6s' WHEN {0} <= 10 THEN '7-10s' WHEN {0} <= 30 THEN '10-30s' WHEN {0} <= 60 THEN '30-60s' WHEN {0} > 60 THEN '>60s' END"
POSITIVES_SQL = f"""{ALIGN_SQL}, positives AS (SELECT m.acct, m.event_id, 'p-' || m.event_id AS sample_id, m.tick_us AS sample_us, l.us AS state_us, behavior, {FAMILY} AS family, {STATE} AS state
  FROM matched m JOIN events_m2 l ON m.event_id = l.acct * 1000000 + l.seq WHERE m.quality <> 'UNMATCHED' AND behavior IN {tuple(C.REQUIRED_STATE)})"""
LINEAGE_SQL = f"""{POSITIVES_SQL}, ex AS (SELECT acct, state, end_us, following, max(interval_id) AS id, max(start_us) AS start_us FROM intervals WHERE interval_id % 5 <> 0 GROUP BY ALL HAVING count(*) = 1),
fb AS (SELECT p.event_id, max((i.interval_id, i.start_us)) AS h FROM positives p JOIN intervals i ON i.acct = p.acct AND i.state = p.state AND i.start_us <= p.state_us AND i.end_us >= p.state_us AND i.interval_id % 5 <> 0 GROUP BY 1),
lineage AS (SELECT p.*, coalesce(ex.id, h[1]) AS interval_id, (p.state_us - coalesce(ex.start_us, h[2])) / {float(STEP)} AS age, CASE WHEN ex.id IS NOT NULL THEN 'interval_lineage' WHEN h IS NOT NULL THEN 'reported_time_interval_fallback' END AS lineage
  FROM positives p LEFT JOIN ex ON ex.acct = p.acct AND ex.state = p.state AND ex.end_us = p.state_us AND ex.following = p.behavior LEFT JOIN fb ON fb.event_id = p.event_id)"""
POOL_SQL = f"""pool AS (SELECT DISTINCT acct, interval_id, state, q.us AS sample_us, (q.us - start_us) / {float(STEP)} AS age FROM (
  SELECT i.*, unnest(range((start_us + {STEP} - 1) // {STEP} + 1, end_us // {STEP})) * {STEP} AS at_us FROM intervals i WHERE state IN ('ONE_BUY', 'ONE_SELL', 'HEDGED_1X1')) c
  ASOF JOIN quotes q ON c.at_us >= q.us WHERE at_us - start_us > {EXCLUSION} AND end_us - at_us > {EXCLUSION} AND q.us - start_us > {EXCLUSION} AND end_us - q.us > {EXCLUSION})"""
SUPPORT_SQL = f"""{LINEAGE_SQL}, {POOL_SQL}, counts AS (SELECT acct, state, sample_us // {SPAN} AS hour, count(*) AS n FROM pool GROUP BY ALL),
support AS (SELECT l.*, l.sample_us // {SPAN} AS hour, coalesce(n, 0) AS eligible, CASE WHEN NOT coalesce(age >= {C.LEAST_AGE}, false) THEN 'state_age_below_minimum' WHEN n IS NULL THEN 'no_eligible_risk_time' ELSE 'supported' END AS support
  FROM lineage l LEFT JOIN counts c ON c.acct = l.acct AND c.state = l.state AND c.hour = l.sample_us // {SPAN})"""
CONTROLS_SQL = f"""{SUPPORT_SQL}, dealt AS (SELECT *, sample_us // {SPAN} AS hour, row_number() OVER (PARTITION BY acct, state, sample_us // {SPAN} ORDER BY sha256(acct || '|' || interval_id || '|' || sample_us || '|controls-1'), interval_id, sample_us) - 1 AS place FROM pool),
turns AS (SELECT *, row_number() OVER (PARTITION BY acct, state, hour ORDER BY sample_us, event_id) - 1 AS turn, count(*) OVER (PARTITION BY acct, state, hour) AS turns FROM support WHERE support = 'supported'),
controls AS (SELECT c.acct, t.event_id, 'c-' || t.event_id || '-' || (place // turns + 1) AS sample_id, c.interval_id, c.state, c.sample_us, c.age, abs(c.sample_us - t.sample_us) AS distance
  FROM dealt c JOIN turns t ON t.acct = c.acct AND t.state = c.state AND t.hour = c.hour AND place % turns = turn AND place // turns < 5)"""


def lifecycle(spark, d):
    used = ("acct", "seq", "position_id", "us", "type", "side", "price", "behavior", "after", "same")
    return written(L.lifecycle(positions(spark, d)).select(*used), "controls-lifecycle")


def positives_of(spark, d, events):
    off = F.when(F.col("position_id") % 4 == 0, 0.04).when(F.col("position_id") % 4 == 1, 0.3).otherwise(0.0)
    e = events.select(
        (F.col("acct") * 1_000_000 + F.col("seq")).alias("event_id"), "acct", (F.floor(F.col("us") / UNIT) * UNIT).alias("us"), "type", "side", (F.col("price") + off).alias("price"), "behavior", F.col("us").alias("exact_us")
    )
    m = A.best_matches(A.best_candidates(e, quotes(spark, d), [], UNIT), 0.01, 0.05, 0.5)
    return C.positives(m.withColumn("us", F.col("exact_us")), F.col("quality") != "UNMATCHED")


def lineage_of(spark, d, events, intervals):
    """Every fifth interval is missing from what the samples are joined to, so that some fall back or find none."""
    return C.with_lineage(written(positives_of(spark, d, events), "positives"), intervals.filter("interval_id % 5 <> 0"), ["acct"], STEP)


def times_of(spark, d, intervals):
    return C.control_times(intervals, quotes(spark, d), ["acct"], STEP, EXCLUSION, F.lit(True), SPAN)


def all_of(spark, d):
    events = lifecycle(spark, d)
    intervals = L.intervals(events)
    times = times_of(spark, d, intervals)
    samples = written(C.with_support(lineage_of(spark, d, events, intervals), times, ["acct"], SPAN), "controls-samples")
    return samples, times


def controls_of(samples, times):
    return C.sample_controls(samples, times, ["acct"], STEP, 5, "controls-1")


@query("positive_samples", f"WITH {POSITIVES_SQL} SELECT * FROM positives")
def positive_samples(spark, d):
    return positives_of(spark, d, L.lifecycle(positions(spark, d)))


@query("sample_lineage", f"WITH {LINEAGE_SQL} SELECT event_id, interval_id, round(age, 9) AS age, {STRATUM.format('age')} AS stratum, lineage FROM lineage")
def sample_lineage(spark, d):
    events = lifecycle(spark, d)
    return lineage_of(spark, d, events, L.intervals(events)).select("event_id", "interval_id", F.round("age", 9).alias("age"), "stratum", "lineage")


@query("control_pool", f"WITH {SUPPORT_SQL} SELECT acct, interval_id, state, sample_us, round(age, 9) AS age, {STRATUM.format('age')} AS stratum FROM pool")
def control_pool(spark, d):
    return C.control_pool(times_of(spark, d, L.intervals(L.lifecycle(positions(spark, d)))), ["acct"], STEP).withColumn("age", F.round("age", 9))


@query("control_support", f"WITH {SUPPORT_SQL} SELECT event_id, hour, eligible, support FROM support")
def control_support(spark, d):
    return all_of(spark, d)[0].select("event_id", "hour", "eligible", "support")


@query("matched_controls", f"WITH {CONTROLS_SQL} SELECT acct, event_id, sample_id, interval_id, state, sample_us, round(age, 9) AS age, {STRATUM.format('age')} AS stratum, distance FROM controls")
def matched_controls(spark, d):
    samples, times = all_of(spark, d)
    return controls_of(samples, times).withColumn("age", F.round("age", 9))


@query("control_counts", f"WITH {CONTROLS_SQL}, n AS (SELECT event_id, count(*) AS n FROM controls GROUP BY 1) SELECT support, coalesce(n, 0) AS controls, count(*) AS n FROM support LEFT JOIN n USING (event_id) GROUP BY ALL")
def control_counts(spark, d):
    samples, times = all_of(spark, d)
    counted = C.with_counts(samples, controls_of(samples, times))
    return counted.groupBy("support", "controls").agg(F.count(F.lit(1)).alias("n"))


@query("paired_ages", f"WITH {CONTROLS_SQL} SELECT s.event_id, round(s.age, 6) AS own, round(avg(c.age), 6) AS of_controls, round(s.age - avg(c.age), 6) AS difference FROM support s JOIN controls c USING (event_id) WHERE s.age IS NOT NULL GROUP BY s.event_id, s.age")
def paired_ages(spark, d):
    samples, times = all_of(spark, d)
    p = C.paired(samples, controls_of(samples, times), "age")
    return p.select("event_id", *[F.round(c, 6).alias(c) for c in ("own", "of_controls", "difference")])
