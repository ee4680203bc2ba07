"""Coverage, fragments, risk bins and their accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import intervals as I
from ..operators import lifecycle as L
from ..operators.order import DAY, HOUR, MINUTE, with_previous
from ..sources.shared import written
from .views import QUOTES_SQL, positions, positions_sql, quotes, timeline_sql

Q, SQL = {}, {}
GAP = 10 * MINUTE
WIDTH = 10 * MINUTE


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query(
    "coverage_gaps",
    f"WITH {QUOTES_SQL}, g AS (SELECT symbol, lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS gap_start, us AS gap_end FROM quotes) SELECT * FROM g WHERE gap_end - gap_start > {GAP}",
)
def coverage_gaps(spark, d):
    return I.coverage_gaps(quotes(spark, d), ["symbol"], "us", ["seq"], GAP)


# One symbol's gaps serve as the coverage of all books.
GAPS_SQL = f"""{QUOTES_SQL}, gaps AS (SELECT * FROM (SELECT lag(us) OVER (ORDER BY us, seq) AS gap_start, us AS gap_end FROM quotes) WHERE gap_end - gap_start > {GAP})"""
BOUNDS_SQL = "bounds AS (SELECT (min(open_us) // 86400000000 + 1) * 86400000000 AS lo, (max(open_us) // 86400000000) * 86400000000 AS hi FROM positions)"


def gaps_of(spark, d):
    return I.coverage_gaps(quotes(spark, d), [], "us", ["seq"], GAP)


def bounds_of(p):
    lo, hi = p.agg(F.min("open_us"), F.max("open_us")).first()
    return (lo // DAY + 1) * DAY, hi // DAY * DAY


@query(
    "gap_recurrence",
    f"""WITH {GAPS_SQL}, c AS (SELECT *, gap_start % 86400000000 AS c0, gap_end % 86400000000 AS c1 FROM gaps)
SELECT a.gap_start, a.gap_end, count(*) AS n, CASE WHEN count(*) >= 3 THEN 'scheduled_market_closed' ELSE 'unknown_coverage_gap' END AS class FROM c a JOIN c b
ON least(abs(a.c0 - b.c0), 86400000000 - abs(a.c0 - b.c0)) <= 120000000 AND least(abs(a.c1 - b.c1), 86400000000 - abs(a.c1 - b.c1)) <= 120000000 GROUP BY ALL""",
)
def gap_recurrence(spark, d):
    return I.recurring(gaps_of(spark, d), [], 2 * MINUTE, 3)


@query(
    "gap_contiguity",
    f"""WITH {GAPS_SQL}, days AS (SELECT us // 86400000000 AS day, min(us) AS start_us, max(us) AS end_us FROM quotes GROUP BY 1)
SELECT day, start_us, end_us, start_us - lag(end_us) OVER (ORDER BY day) <= {GAP} AS contiguous FROM days""",
)
def gap_contiguity(spark, d):
    days = quotes(spark, d).groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(F.min("us").alias("start_us"), F.max("us").alias("end_us"))
    t = with_previous(days, [], "day", [], {"last_end": "end_us"}, bucket=3650)
    return t.select("day", "start_us", "end_us", (F.col("start_us") - F.col("last_end") <= GAP).alias("contiguous"))


INTERVALS_SQL = f"{positions_sql()}, {timeline_sql()}, {BOUNDS_SQL}"
TAIL_SQL = f"""{INTERVALS_SQL}, tailed AS (SELECT acct, interval_id, start_us, end_us, state, behavior, following, false AS is_tail FROM intervals, bounds WHERE end_us <= hi
  UNION ALL SELECT acct, seq, us, hi, after, behavior, NULL, true FROM (SELECT e.*, hi, row_number() OVER (PARTITION BY acct ORDER BY us DESC, seq DESC) AS rn FROM events_m2 e, bounds WHERE us <= hi) WHERE rn = 1 AND us < hi)"""


def tailed(spark, d, unit=1):
    p = positions(spark, d, unit=unit)
    lo, hi = bounds_of(p)
    return I.intervals_to(L.lifecycle(p), ["acct"], hi), lo, hi


@query("risk_tail", f"WITH {TAIL_SQL} SELECT acct, interval_id, start_us, end_us, state, behavior, following, is_tail FROM tailed")
def risk_tail(spark, d):
    return tailed(spark, d)[0]


CUT_SQL = f"""{GAPS_SQL}, cutd AS (
  SELECT acct, interval_id, state, behavior, following, is_tail, start_us AS interval_start, end_us AS interval_end, start_us < lo AS is_left_truncated,
    greatest(start_us, lo, k * 86400000000) AS a, least(end_us, hi, (k + 1) * 86400000000) AS b
  FROM (SELECT *, unnest(range(greatest(start_us, lo) // 86400000000, (least(end_us, hi) - 1) // 86400000000 + 1)) AS k FROM tailed, bounds WHERE start_us < end_us AND greatest(start_us, lo) < least(end_us, hi))
), edges AS (
  SELECT acct, interval_id, a, b, a AS e FROM cutd UNION SELECT acct, interval_id, a, b, b FROM cutd
  UNION SELECT acct, interval_id, a, b, greatest(a, gap_start) FROM cutd JOIN gaps ON gap_start < b AND gap_end > a
  UNION SELECT acct, interval_id, a, b, least(b, gap_end) FROM cutd JOIN gaps ON gap_start < b AND gap_end > a
), pieces AS (SELECT acct, interval_id, a, b, e AS p0, lead(e) OVER (PARTITION BY acct, interval_id, a ORDER BY e) AS p1 FROM edges),
fragments AS (
  SELECT c.acct, c.interval_id, c.state, c.behavior, c.following, c.is_tail, c.interval_start, c.interval_end, c.is_left_truncated, p0 AS start_us, p1 AS end_us,
    EXISTS (SELECT 1 FROM gaps WHERE gap_start <= p0 AND p1 <= gap_end) AS is_gap, false AS is_zero
  FROM pieces p JOIN cutd c ON c.acct = p.acct AND c.interval_id = p.interval_id AND c.a = p.a WHERE p1 IS NOT NULL
  UNION ALL SELECT acct, interval_id, state, behavior, following, is_tail, start_us, end_us, start_us < lo, start_us, end_us, false, true FROM tailed, bounds WHERE start_us = end_us
)"""
FRAGMENTS_SQL = f"{TAIL_SQL}, {CUT_SQL}"


def fragments_of(spark, d, unit=1, gaps=None):
    i, lo, hi = tailed(spark, d, unit)
    return I.partition_risk(i, gaps_of(spark, d) if gaps is None else gaps, ["acct"], lo, hi)


@query("risk_fragments", f"WITH {FRAGMENTS_SQL} SELECT acct, interval_id, state, start_us, end_us, interval_start, interval_end, is_left_truncated, is_gap, is_zero FROM fragments")
def risk_fragments(spark, d):
    return fragments_of(spark, d).select("acct", "interval_id", "state", "start_us", "end_us", "interval_start", "interval_end", "is_left_truncated", "is_gap", "is_zero")


TARGET_SQL = "((state = 'HEDGED_1X1' AND following IN ('UNLOCK_TO_BUY', 'UNLOCK_TO_SELL')) OR (state = 'ONE_BUY' AND following = 'REHEDGE_SELL') OR (state = 'ONE_SELL' AND following = 'REHEDGE_BUY'))"
SUMMARY_SQL = f"""{FRAGMENTS_SQL}, summary AS (SELECT start_us // 86400000000 AS day, state, count(*) FILTER (NOT is_zero) AS fragments, count(*) FILTER (is_zero) AS zero, CAST(sum(end_us - start_us) AS BIGINT) AS raw_us,
  CAST(sum(CASE WHEN is_gap THEN end_us - start_us ELSE 0 END) AS BIGINT) AS gap_us, CAST(sum(CASE WHEN is_gap THEN 0 ELSE end_us - start_us END) AS BIGINT) AS tradeable_us,
  count(*) FILTER (NOT is_zero AND NOT is_gap AND end_us = interval_end AND coalesce({TARGET_SQL}, false)) AS targets FROM fragments GROUP BY ALL)"""


@query("risk_by_day_state", f"WITH {SUMMARY_SQL} SELECT * FROM summary")
def risk_by_day_state(spark, d):
    return I.day_state_summary(fragments_of(spark, d))


@query(
    "risk_by_day",
    f"""WITH {SUMMARY_SQL} SELECT day, CAST(sum(fragments) AS BIGINT) AS fragments, CAST(sum(raw_us) AS BIGINT) AS raw_us, CAST(sum(gap_us) AS BIGINT) AS gap_us, CAST(sum(tradeable_us) AS BIGINT) AS tradeable_us,
  CAST(sum(targets) AS BIGINT) AS targets, round_even(sum(targets) * 1e9 / nullif(sum(tradeable_us), 0), 9) AS density FROM summary WHERE state IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL') GROUP BY day""",
)
def risk_by_day(spark, d):
    return I.day_summary(I.day_state_summary(fragments_of(spark, d)))


@query(
    "start_date_summary",
    f"WITH {INTERVALS_SQL} SELECT start_us // 86400000000 AS day, state, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM intervals GROUP BY ALL",
)
def start_date_summary(spark, d):
    i = L.intervals(L.lifecycle(positions(spark, d)))
    return i.groupBy(F.floor(F.col("start_us") / DAY).alias("day"), "state").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"))


@query(
    "hour_clip",
    f"""WITH {FRAGMENTS_SQL}, c AS (SELECT acct, interval_id, is_gap, greatest(start_us, (start_us // 86400000000) * 86400000000 + {12 * HOUR}) AS start_us, least(end_us, (start_us // 86400000000 + 1) * 86400000000) AS end_us FROM fragments)
SELECT * FROM c WHERE start_us < end_us""",
)
def hour_clip(spark, d):
    return I.clip_to_hours(fragments_of(spark, d), 12, 24).select("acct", "interval_id", "is_gap", "start_us", "end_us")


@query(
    "tradeable_age",
    f"""WITH {INTERVALS_SQL}, {GAPS_SQL} SELECT i.acct, i.interval_id, i.end_us - i.start_us - CAST(coalesce(sum(CASE WHEN gap_end IS NOT NULL THEN least(i.end_us, gap_end) - greatest(i.start_us, gap_start) END), 0) AS BIGINT) AS tradeable_us
FROM intervals i LEFT JOIN gaps g ON g.gap_start < i.end_us AND g.gap_end > i.start_us GROUP BY i.acct, i.interval_id, i.start_us, i.end_us""",
)
def tradeable_age(spark, d):
    i = L.intervals(L.lifecycle(positions(spark, d))).select("acct", "interval_id", "start_us", "end_us")
    return I.paused_age(i, gaps_of(spark, d), "start_us", "end_us").select("acct", "interval_id", "tradeable_us")


@query("crosses_gap", f"WITH {INTERVALS_SQL}, {GAPS_SQL} SELECT acct, interval_id, EXISTS (SELECT 1 FROM gaps WHERE gap_start < end_us AND gap_end > start_us AND start_us < end_us) AS crosses_gap FROM intervals")
def crosses_gap(spark, d):
    i = L.intervals(L.lifecycle(positions(spark, d))).select("acct", "interval_id", "start_us", "end_us")
    return I.crosses_gap(i, gaps_of(spark, d), "start_us", "end_us").select("acct", "interval_id", "crosses_gap")


BINS_SQL = f"""{FRAGMENTS_SQL}, bins AS (SELECT acct, interval_id, state, following, interval_start, interval_end, is_left_truncated, k * {WIDTH} AS bin_start, (k + 1) * {WIDTH} AS bin_end,
  CASE state WHEN 'HEDGED_1X1' THEN 'unlock_occurrence' WHEN 'ONE_BUY' THEN 'rehedge_sell_occurrence' ELSE 'rehedge_buy_occurrence' END AS endpoint,
  CAST((k + 1) * {WIDTH} = interval_end AND following IS NOT NULL AND coalesce({TARGET_SQL}, false) AS INT) AS target, CAST((k + 1) * {WIDTH} = interval_end AND following IS NOT NULL AND NOT coalesce({TARGET_SQL}, false) AS INT) AS competing
  FROM (SELECT *, unnest(range((start_us + {WIDTH} - 1) // {WIDTH}, end_us // {WIDTH})) AS k FROM fragments WHERE NOT is_gap AND NOT is_zero AND state IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL')))"""


def bins_of(spark, d, unit=1, gaps=None):
    return I.risk_bins(fragments_of(spark, d, unit, gaps), ["acct"], WIDTH)


@query("risk_bins", f"WITH {BINS_SQL} SELECT acct, interval_id, endpoint, bin_start, bin_end, target, competing, is_left_truncated FROM bins")
def risk_bins(spark, d):
    return bins_of(spark, d).select("acct", "interval_id", "endpoint", "bin_start", "bin_end", "target", "competing", "is_left_truncated")


#: Bins of events at whole bins, so that some end in one.
WHOLE_BINS_SQL = BINS_SQL.replace(positions_sql(), positions_sql(unit=WIDTH))


@query("bin_labels", f"WITH {WHOLE_BINS_SQL} SELECT endpoint, target, competing, count(*) AS n FROM bins GROUP BY ALL")
def bin_labels(spark, d):
    return bins_of(spark, d, WIDTH).groupBy("endpoint", "target", "competing").agg(F.count(F.lit(1)).alias("n"))


@query(
    "bin_accounting",
    f"""WITH {BINS_SQL}, f AS (SELECT state, CAST(sum(end_us - start_us) AS BIGINT) AS us FROM fragments WHERE NOT is_gap AND NOT is_zero GROUP BY 1), b AS (SELECT state, count(*) * {WIDTH} AS binned FROM bins GROUP BY 1)
SELECT state, us, binned, us - binned AS left_over FROM f JOIN b USING (state)""",
)
def bin_accounting(spark, d):
    """Tradeable time is the bins' time and what is left at the fragments' edges."""
    f = fragments_of(spark, d).filter("NOT is_gap AND NOT is_zero").groupBy("state").agg(F.sum(F.col("end_us") - F.col("start_us")).alias("us"))
    b = bins_of(spark, d).groupBy("state").agg((F.count(F.lit(1)) * WIDTH).alias("binned"))
    return f.join(b, "state").select("state", "us", "binned", (F.col("us") - F.col("binned")).alias("left_over"))


@query(
    "interval_audit",
    f"""WITH {WHOLE_BINS_SQL}, n AS (SELECT acct, interval_id, count(*) AS bins, max(target) AS target, max(competing) AS competing FROM bins GROUP BY ALL)
SELECT t.acct, t.interval_id, t.state, coalesce(n.bins, 0) AS bins, coalesce(n.target, 0) AS target, coalesce(n.competing, 0) AS competing,
  CASE WHEN n.target = 1 THEN 'target_event' WHEN n.competing = 1 THEN 'competing_endpoint' WHEN t.following IS NULL THEN 'synthetic_right_censor' END AS censor_reason,
  CASE WHEN t.start_us < lo THEN 'left_truncated' WHEN n.bins IS NULL AND t.state NOT IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL') THEN 'ineligible_state' WHEN n.bins IS NULL THEN 'no_complete_bin' END AS exclusion_reason
FROM bounds, tailed t LEFT JOIN n ON n.acct = t.acct AND n.interval_id = t.interval_id""",
)
def interval_audit(spark, d):
    i, lo, hi = tailed(spark, d, WIDTH)
    bins = I.risk_bins(I.partition_risk(i, gaps_of(spark, d), ["acct"], lo, hi), ["acct"], WIDTH)
    return I.interval_audit(i, bins, ["acct"], lo)


# Intervals that the coverage's end may cut; the first two thirds of its days are for development, the rest is held out.
OVER_SQL = f"""{positions_sql(unit=WIDTH)}, {timeline_sql()}, {BOUNDS_SQL}, parts AS (SELECT lo + (hi - lo) // {DAY} * 2 // 3 * {DAY} AS part FROM bounds),
tailed AS (SELECT acct, seq AS interval_id, us AS start_us, coalesce(next_us, hi) AS end_us, after AS state, behavior, following, next_us IS NULL AS is_tail FROM (
  SELECT *, lead(behavior) OVER (PARTITION BY acct ORDER BY seq) AS following FROM events_m2), bounds WHERE us <= hi AND (next_us IS NOT NULL OR us < hi)), {CUT_SQL}"""
SUPPORT_SQL = f"""{OVER_SQL}, risk_cells AS (
  SELECT f.*, k * {WIDTH} AS bin_start, (k + 1) * {WIDTH} AS bin_end FROM (
    SELECT *, unnest(range((start_us + {WIDTH} - 1) // {WIDTH}, end_us // {WIDTH})) AS k FROM fragments WHERE NOT is_gap AND NOT is_zero AND NOT is_left_truncated AND state IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL')) f
), lost AS (
  SELECT c.acct, c.interval_id, c.bin_start, CAST(sum(least(c.bin_start, g.gap_end) - greatest(c.interval_start, g.gap_start)) AS BIGINT) AS us FROM risk_cells c JOIN gaps g ON g.gap_start < c.bin_start AND g.gap_end > c.interval_start GROUP BY ALL
), flagged AS (
  SELECT c.*, CASE c.state WHEN 'HEDGED_1X1' THEN 'unlock_occurrence' WHEN 'ONE_BUY' THEN 'rehedge_sell_occurrence' ELSE 'rehedge_buy_occurrence' END AS endpoint, c.bin_start - c.interval_start - coalesce(l.us, 0) AS age_us,
    c.bin_end = c.interval_end AND NOT c.is_tail AS at_end, CASE WHEN c.bin_start < part THEN 'development' ELSE 'holdout' END AS split, c.bin_start % {DAY} >= {12 * HOUR} AS is_common
  FROM parts, risk_cells c LEFT JOIN lost l ON l.acct = c.acct AND l.interval_id = c.interval_id AND l.bin_start = c.bin_start
), labelled AS (
  SELECT *, CAST(at_end AND coalesce({TARGET_SQL}, false) AS INT) AS target, CAST(at_end AND NOT coalesce({TARGET_SQL}, false) AS INT) AS competing,
    min(split) OVER (PARTITION BY acct, interval_id) <> max(split) OVER (PARTITION BY acct, interval_id) AS is_cross_split, bin_start = max(bin_start) OVER (PARTITION BY acct, interval_id) AS is_last FROM flagged
), support AS (
  SELECT acct, interval_id, state, endpoint, interval_start, interval_end, CASE WHEN at_end THEN following END AS following, bin_start, bin_end, age_us, target, competing, split, is_common, is_cross_split, is_common AND NOT is_cross_split AS is_eligible, is_last,
    CASE WHEN is_last THEN CASE WHEN target = 1 THEN 'target_event' WHEN competing = 1 THEN 'competing_endpoint' WHEN is_tail THEN 'synthetic_right_censor' WHEN interval_end > hi THEN 'coverage_right_censor' END END AS censor_reason FROM labelled, bounds
)"""


def over(spark, d):
    """Intervals, the coverage, and the function of the parts."""
    p = positions(spark, d, unit=WIDTH)
    lo, hi = bounds_of(p)
    part = lo + (hi - lo) // DAY * 2 // 3 * DAY
    return I.intervals_over(L.lifecycle(p), ["acct"], hi), lo, hi, lambda us: F.when(us < part, "development").otherwise("holdout")


def support_of(spark, d, gaps=None):
    i, lo, hi, split = over(spark, d)
    gaps = written(gaps_of(spark, d), "gaps") if gaps is None else gaps
    return I.supported_bins(I.partition_risk(i, gaps, ["acct"], lo, hi), gaps, ["acct"], WIDTH, hi, split, (12, 24))


@query("supported_bins", f"WITH {SUPPORT_SQL} SELECT acct, interval_id, endpoint, following, bin_start, age_us, target, competing, split, is_common, is_cross_split, is_eligible, is_last, censor_reason FROM support")
def supported_bins(spark, d):
    return support_of(spark, d).select("acct", "interval_id", "endpoint", "following", "bin_start", "age_us", "target", "competing", "split", "is_common", "is_cross_split", "is_eligible", "is_last", "censor_reason")


@query(
    "support_audit",
    f"""WITH {SUPPORT_SQL}, n AS (SELECT acct, interval_id, count(*) AS bins, CAST(sum(target) AS BIGINT) AS targets, CAST(sum(competing) AS BIGINT) AS competing, bool_or(is_cross_split) AS is_cross_split, max(censor_reason) AS censor_reason FROM support GROUP BY ALL)
SELECT t.acct, t.interval_id, t.state, coalesce(n.bins, 0) AS bins, coalesce(n.targets, 0) AS targets, coalesce(n.competing, 0) AS competing, coalesce(n.is_cross_split, false) AS is_cross_split, n.censor_reason,
  CASE WHEN n.is_cross_split THEN 'cross_development_holdout' WHEN t.start_us < lo THEN 'left_truncated' WHEN t.state NOT IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL') THEN 'ineligible_state' WHEN n.bins IS NULL THEN 'no_complete_bin' END AS exclusion_reason
FROM bounds, tailed t LEFT JOIN n ON n.acct = t.acct AND n.interval_id = t.interval_id WHERE t.end_us >= lo AND t.start_us <= hi""",
)
def support_audit(spark, d):
    i, lo, hi, split = over(spark, d)
    i, gaps = written(i, "intervals"), written(gaps_of(spark, d), "gaps")
    bins = I.supported_bins(I.partition_risk(i, gaps, ["acct"], lo, hi), gaps, ["acct"], WIDTH, hi, split, (12, 24))
    return I.support_audit(i, bins, ["acct"], lo, hi)


@query(
    "overlap_rejects",
    f"WITH {positions_sql()}, {timeline_sql()} SELECT DISTINCT p.acct, p.position_id FROM positions p JOIN positions q ON q.acct = p.acct AND q.position_id < p.position_id AND q.open_us < p.close_us AND p.open_us < q.close_us",
)
def overlap_rejects(spark, d):
    return I.overlapping(positions(spark, d).filter("close_us IS NOT NULL"), ["acct"], "open_us", "close_us", "position_id").select("acct", "position_id")
