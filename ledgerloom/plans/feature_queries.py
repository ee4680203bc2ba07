"""Features of risk bins before they begin: look-back windows, signed features, what excludes a bin, and what caused an unlock."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import anchors as X
from ..operators import causes as U
from ..operators.order import DAY, HOUR, MINUTE
from ..sources.shared import written
from .interval_queries import SUPPORT_SQL, WIDTH, gaps_of, support_of
from .views import QUOTES_SQL, positions, positions_sql, quotes

Q, SQL = {}, {}
#: What the reference's seconds are here.
UNIT = 5 * MINUTE
WIDTHS = {k: k * UNIT for k in (2, 5, 10)}
#: An unlock's state must be older than this.
FLOOR = 5 * WIDTH


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def ticks_of(spark, d):
    """All quotes as the one stream that all books trade on."""
    return quotes(spark, d).select("us", "seq", "mid", F.round(F.col("ask") - F.col("bid"), 9).alias("spread"))


# Every seventh day has no role.
CANDIDATES_SQL = f"""{SUPPORT_SQL}, candidates AS (
  SELECT *, bin_start // {DAY} AS day, CASE WHEN split = 'development' THEN 'development' ELSE 'internal_reuse' END AS role, endpoint = 'unlock_occurrence' AND age_us < {FLOOR} AS below_floor
  FROM support WHERE is_common AND NOT is_cross_split AND bin_start // {DAY} % 7 <> 3
)"""


def candidates_of(spark, d, support=None):
    """Candidates among the bins of support_of, or of a part of them that has all in common hours of one part of the data."""
    day = F.floor(F.col("bin_start") / DAY)
    role = F.when(day % 7 == 3, None).when(F.col("split") == "development", "development").otherwise("internal_reuse")
    return U.candidate_bins(support_of(spark, d) if support is None else support, role, FLOOR).withColumn("day", day)


@query("candidate_bins", f"WITH {CANDIDATES_SQL} SELECT acct, interval_id, endpoint, role, day, bin_start, interval_start, age_us, target, below_floor FROM candidates")
def candidate_bins(spark, d):
    return candidates_of(spark, d).select("acct", "interval_id", "endpoint", "role", "day", "bin_start", "interval_start", "age_us", "target", "below_floor")


def _window_sql(k: int) -> str:
    w = WIDTHS[k]
    own, prior, before = f"q.us >= a.us - {w}", f"q.us < a.us - {w}", f"q.us >= a.us - {w} AND q.us < a.us"
    inside = f"{own} AND q.us_before >= a.us - {w}"
    return f"""w{k} AS (SELECT a.us, count(*) FILTER ({own}) AS n, arg_min(q.mid, (q.us, q.seq)) FILTER ({own}) AS first, arg_max(q.mid, (q.us, q.seq)) FILTER ({own}) AS last, arg_max(q.spread, (q.us, q.seq)) FILTER ({own}) AS spread,
  max(q.mid) FILTER ({own}) AS high, min(q.mid) FILTER ({own}) AS low, count(*) FILTER ({inside} AND q.step > 0) AS ups, count(*) FILTER ({inside} AND q.step < 0) AS downs, coalesce(sum(q.step * q.step) FILTER ({inside}), 0) AS squares,
  count(*) FILTER ({prior}) AS prior_n, max(q.mid) FILTER ({prior}) AS prior_high, min(q.mid) FILTER ({prior}) AS prior_low, max(q.mid) FILTER ({before}) AS before_high, min(q.mid) FILTER ({before}) AS before_low,
  count(*) FILTER ({own}) >= 2 AND a.us - {w} >= f.first_us AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.gap_start < a.us AND g.gap_end > a.us - {w}) AS valid,
  count(*) FILTER ({own}) >= 2 AND count(*) FILTER ({prior}) >= 2 AND a.us - {2 * w} >= f.first_us AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.gap_start < a.us AND g.gap_end > a.us - {2 * w}) AS touch_valid
  FROM points a CROSS JOIN f LEFT JOIN stepped q ON q.us >= a.us - {2 * w} AND q.us <= a.us GROUP BY a.us, f.first_us)"""


WINDOWS_SQL = f"""{CANDIDATES_SQL}, points AS (SELECT DISTINCT bin_start AS us FROM candidates), f AS (SELECT min(us) AS first_us FROM quotes),
stepped AS (SELECT us, seq, mid, round(ask - bid, 9) AS spread, mid - lag(mid) OVER (ORDER BY us, seq) AS step, lag(us) OVER (ORDER BY us, seq) AS us_before FROM quotes),
{", ".join(_window_sql(k) for k in WIDTHS)},
refs AS (SELECT s.us, max((q.us, q.seq, q.mid)) AS r FROM (SELECT DISTINCT interval_start AS us FROM candidates) s JOIN quotes q ON q.us <= s.us GROUP BY s.us),
ref AS (SELECT us, CASE WHEN NOT EXISTS (SELECT 1 FROM gaps g WHERE g.gap_start < refs.us AND g.gap_end > r[1]) THEN r[3] END AS reference FROM refs)"""


def _features_sql(columns: str) -> str:
    """Candidates c with the windows w2, w5, w10 of their start and the reference."""
    return f"SELECT {columns} FROM candidates c JOIN w2 ON w2.us = c.bin_start JOIN w5 ON w5.us = c.bin_start JOIN w10 ON w10.us = c.bin_start LEFT JOIN ref ON ref.us = c.interval_start"


SIGN = "CASE c.endpoint WHEN 'rehedge_sell_occurrence' THEN 1.0 WHEN 'rehedge_buy_occurrence' THEN -1.0 END"


def _pair_sql(k: int) -> str:
    w, up, down = f"w{k}", f"coalesce(w{k}.before_high >= w{k}.prior_high, false)", f"coalesce(w{k}.before_low <= w{k}.prior_low, false)"
    place = f"CASE WHEN {w}.high > {w}.low THEN ({w}.last - {w}.low) / ({w}.high - {w}.low) ELSE 0.5 END"
    turn = f"({w}.ups - {w}.downs) / greatest({w}.n - 1, 1)"
    return f"""CASE WHEN {w}.valid THEN {SIGN} * ({w}.last - {w}.first) END AS signed_change_{k}, CASE WHEN {w}.valid THEN abs({w}.last - {w}.first) END AS absolute_change_{k},
  CASE WHEN {w}.valid THEN {SIGN} * {turn} END AS signed_imbalance_{k}, CASE WHEN {w}.valid THEN abs({turn}) END AS absolute_imbalance_{k}, CASE WHEN {w}.valid THEN {w}.high - {w}.low END AS width_{k},
  CASE WHEN {w}.valid THEN CASE WHEN c.endpoint = 'rehedge_sell_occurrence' THEN {place} WHEN {w}.high > {w}.low THEN ({w}.high - {w}.last) / ({w}.high - {w}.low) ELSE 0.5 END END AS proximity_{k},
  CASE WHEN {w}.touch_valid THEN CAST(CASE WHEN c.endpoint = 'rehedge_sell_occurrence' THEN {up} ELSE {down} END AS DOUBLE) END AS side_touch_{k}, CASE WHEN {w}.touch_valid THEN CAST({up} OR {down} AS DOUBLE) END AS either_touch_{k}"""


FLAGS_SQL = "w10.valid AS window_10_valid, w5.valid AS window_5_valid, w2.valid AS window_2_valid, w5.touch_valid AS touch_5_valid, w2.touch_valid AS touch_2_valid, w10.valid AS snapshot_valid"
SIGNED_SQL = f"""{WINDOWS_SQL}, signed AS ({_features_sql(f'''c.*, {_pair_sql(2)}, {_pair_sql(5)}, CASE WHEN w10.valid THEN w10.high - w10.low END AS width_10, CASE WHEN w10.valid THEN sqrt(w10.squares) END AS volatility_10,
  CASE WHEN w10.valid THEN w10.spread END AS spread, CASE WHEN w10.valid THEN abs(w10.last - reference) END AS absolute_displacement, CASE WHEN w10.valid THEN {SIGN} * (w10.last - reference) END AS signed_displacement, {FLAGS_SQL}, reference IS NOT NULL AS reference_valid''')})"""
PAIRED = [f"{x}_{k}" for k in (2, 5) for x in ("signed_change", "absolute_change", "signed_imbalance", "absolute_imbalance", "width", "proximity", "side_touch", "either_touch")]
VALUES = [*PAIRED, "width_10", "volatility_10", "spread", "absolute_displacement", "signed_displacement"]
FLAGS = [*X.CHECKS]


def windows_of(spark, d, rows, gaps):
    """rows (interval_start, bin_start) with the windows at bin_start and the reference at interval_start, each found once for each time.

    rows is never broadcast, whatever the size of the file it is read from.
    """
    ticks = ticks_of(spark, d)
    times = rows.select(F.col("bin_start").alias("us")).distinct().withColumn("seq", F.lit(0).cast("long"))
    at = X.look_back(times, ticks, [], list(WIDTHS.values()), gaps).drop("seq").withColumnRenamed("us", "bin_start")
    starts = X.state_reference(rows.select(F.col("interval_start").alias("us")).distinct(), ticks, [], gaps).withColumnRenamed("us", "interval_start")
    return rows.join(at.hint("merge"), "bin_start").join(starts.hint("merge"), "interval_start", "left")


STRUCTS = {k: f"w{w}" for k, w in WIDTHS.items()}


def signed_of(spark, d, candidates=None, gaps=None):
    """Candidates with their features and flags, which are found once for each endpoint and pair of times rather than for each bin. candidates is read twice."""
    gaps = written(gaps_of(spark, d), "gaps") if gaps is None else gaps
    candidates = written(candidates_of(spark, d, support_of(spark, d, gaps)), "candidate-bins") if candidates is None else candidates
    by = ["bin_start", "interval_start", "endpoint"]
    times = written(candidates.select(*by).distinct(), "bin-times")
    features = X.signed_features(windows_of(spark, d, times, gaps), STRUCTS, "reference").drop("reference")
    return candidates.join(features.hint("merge"), by).select(*[candidates[c] for c in candidates.columns], *[features[c] for c in features.columns if c not in by])


@query("anchor_features", f"WITH {SIGNED_SQL} SELECT acct, interval_id, endpoint, bin_start, {', '.join(f'round({c}, 6) AS {c}' for c in VALUES)}, {', '.join(FLAGS)} FROM signed")
def anchor_features(spark, d):
    return signed_of(spark, d).select("acct", "interval_id", "endpoint", "bin_start", *[F.round(c, 6).alias(c) for c in VALUES], *FLAGS)


REASON_SQL = "CASE WHEN below_floor THEN 'below_floor' " + " ".join(f"WHEN NOT {c} THEN '{c.removesuffix('_valid')}'" for c in FLAGS) + " END"


@query("feature_audit", f"WITH {SIGNED_SQL} SELECT endpoint, role, {REASON_SQL} AS reason, count(*) AS bins, count(DISTINCT (acct, interval_id)) AS intervals, CAST(sum(target) AS BIGINT) AS targets FROM signed GROUP BY ALL")
def feature_audit(spark, d):
    """How many bins and events each reason takes, the first that applies; the null reason is the design's support."""
    audit = U.audited(signed_of(spark, d), {"below_floor": F.col("below_floor")}, FLAGS)
    return audit.groupBy("endpoint", "role", "reason").agg(F.count(F.lit(1)).alias("bins"), F.count_distinct("acct", "interval_id").alias("intervals"), F.sum("target").alias("targets"))


@query("feature_design", f"WITH {SIGNED_SQL} SELECT acct, interval_id, endpoint, role, bin_start, age_us, target, {', '.join(f'round({c}, 6) AS {c}' for c in VALUES)} FROM signed WHERE {REASON_SQL} IS NULL")
def feature_design(spark, d):
    audit = U.audited(signed_of(spark, d), {"below_floor": F.col("below_floor")}, FLAGS)
    return audit.filter("is_joint_valid").select("acct", "interval_id", "endpoint", "role", "bin_start", "age_us", "target", *[F.round(c, 6).alias(c) for c in VALUES])


def _cause_sql(k: int) -> str:
    w = f"w{k}"
    out = f"CASE WHEN {w}.valid THEN CASE WHEN {w}.high > {w}.low THEN ({w}.last - {w}.low) / ({w}.high - {w}.low) ELSE 0.5 END END AS position_{k}"
    if k == 10:
        return out
    return f"""{out}, CASE WHEN {w}.valid THEN {w}.last - {w}.first END AS change_{k}, CASE WHEN {w}.valid THEN ({w}.ups - {w}.downs) / greatest({w}.n - 1, 1) END AS imbalance_{k},
  CASE WHEN {w}.touch_valid THEN CAST(coalesce({w}.before_high >= {w}.prior_high, false) AS DOUBLE) END AS upper_touch_{k}, CASE WHEN {w}.touch_valid THEN CAST(coalesce({w}.before_low <= {w}.prior_low, false) AS DOUBLE) END AS lower_touch_{k}"""


CAUSES_SQL = f"""{WINDOWS_SQL}, caused AS (SELECT *, CASE WHEN window_10_valid AND reference_valid THEN last - reference END AS displacement FROM ({_features_sql(f'''c.*, sha256(concat_ws('|', c.acct, c.interval_id, {WIDTH})) AS sample_id, CAST(c.following = 'UNLOCK_TO_BUY' AS INT) AS cause,
  {_cause_sql(2)}, {_cause_sql(5)}, {_cause_sql(10)}, w10.last, reference, CASE WHEN w10.valid THEN w10.last END AS anchor_mid, CASE WHEN w10.valid THEN w10.spread END AS spread, {FLAGS_SQL},
  reference IS NOT NULL AND NOT EXISTS (SELECT 1 FROM gaps g WHERE g.gap_start < c.bin_start AND g.gap_end > c.interval_start) AS reference_valid''')} WHERE c.endpoint = 'unlock_occurrence' AND c.target = 1)),
cause_audit AS (SELECT *, CASE WHEN age_us < {FLOOR} THEN 'state_age' {" ".join(f"WHEN NOT {c} THEN '{c.removesuffix('_valid')}'" for c in FLAGS)} END AS reason FROM caused)"""


def causes_of(spark, d):
    gaps = written(gaps_of(spark, d), "gaps")
    events = written(U.unlock_events(candidates_of(spark, d, support_of(spark, d, gaps)), ["acct"], WIDTH), "unlock-events")
    rows = U.unbroken(windows_of(spark, d, events, gaps), gaps, "interval_start", "bin_start")
    rows = X.cause_features(rows, STRUCTS, "reference", F.col("unbroken"))
    return U.audited(rows, {"state_age": F.col("age_us") < FLOOR}, FLAGS, X.CAUSE_FEATURES)


@query("cause_audit", f"WITH {CAUSES_SQL} SELECT sample_id, acct, interval_id, role, day, bin_start, age_us, following, cause, round(anchor_mid, 6) AS anchor_mid, round(spread, 6) AS spread, {', '.join(FLAGS)}, reason, reason IS NULL AS is_joint_valid FROM cause_audit")
def cause_audit(spark, d):
    """One row for each unlock in a candidate bin, with the first reason that excludes it."""
    return U.cause_tables(causes_of(spark, d), X.CAUSE_FEATURES, FLAGS)["audit"].withColumns({c: F.round(c, 6) for c in ("anchor_mid", "spread")})


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in X.CAUSE_FEATURES)


@query("cause_predictors", f"WITH {CAUSES_SQL} SELECT sample_id, {ROUNDED} FROM cause_audit WHERE reason IS NULL")
def cause_predictors(spark, d):
    return U.cause_tables(causes_of(spark, d), X.CAUSE_FEATURES, FLAGS)["predictors"].select("sample_id", *[F.round(c, 6).alias(c) for c in X.CAUSE_FEATURES])


@query("cause_targets", f"WITH {CAUSES_SQL} SELECT sample_id, cause FROM cause_audit WHERE reason IS NULL")
def cause_targets(spark, d):
    return U.cause_tables(causes_of(spark, d), X.CAUSE_FEATURES, FLAGS)["targets"]


@query("cause_design", f"WITH {CAUSES_SQL} SELECT sample_id, acct, interval_id, role, day, bin_start, age_us, cause, {ROUNDED} FROM cause_audit WHERE reason IS NULL")
def cause_design(spark, d):
    design = U.cause_tables(causes_of(spark, d), X.CAUSE_FEATURES, FLAGS)["design"]
    return design.withColumns({c: F.round(c, 6) for c in X.CAUSE_FEATURES})


@query(
    "position_excursions",
    f"""WITH {positions_sql()}, {QUOTES_SQL}, x AS (SELECT p.acct, p.position_id, p.side, p.open_price, max(q.mid) AS high, min(q.mid) AS low FROM positions p LEFT JOIN quotes q ON q.us >= p.open_us AND q.us <= p.close_us WHERE p.close_us IS NOT NULL GROUP BY ALL)
SELECT acct, position_id, round(CASE WHEN side = 'buy' THEN open_price - low ELSE high - open_price END, 9) AS adverse, round(CASE WHEN side = 'buy' THEN high - open_price ELSE open_price - low END, 9) AS favourable FROM x""",
)
def position_excursions(spark, d):
    """How far the price went against and for every closed position between its opening and its close."""
    p = positions(spark, d).filter("close_us IS NOT NULL").select("acct", "position_id", "side", "open_price", F.col("open_us").alias("start"), F.col("close_us").alias("end"), F.struct("acct", "position_id").alias("span"))
    p = X.extremes_between(p, quotes(spark, d), "mid", HOUR, 24)
    down, up, buy = F.col("open_price") - F.col("low"), F.col("high") - F.col("open_price"), F.col("side") == "buy"
    return p.select("acct", "position_id", F.round(F.when(buy, down).otherwise(up), 9).alias("adverse"), F.round(F.when(buy, up).otherwise(down), 9).alias("favourable"))


# Windows of the day, any of which may hold a bin, and the rows of an account: by window and endpoint with reason, without, and by window alone.
HOURS = (("all_common", 12, 24), ("afternoon", 12, 18), ("evening", 18, 24))
INSIDE_SQL = " UNION ALL ".join(f"SELECT '{name}' AS hours, * FROM signed WHERE bin_start % {DAY} >= {a * HOUR} AND bin_start % {DAY} < {b * HOUR}" for name, a, b in HOURS)


@query(
    "exclusion_accounts",
    f"""WITH {SIGNED_SQL}, ex AS (SELECT *, {REASON_SQL} AS reason FROM ({INSIDE_SQL})) SELECT hours, endpoint, CASE WHEN grouping(reason) = 1 THEN 'total' ELSE coalesce(reason, 'joint_valid') END AS reason, count(*) AS bins, CAST(sum(target) AS BIGINT) AS targets,
  CAST(count(*) * {WIDTH} AS BIGINT) AS us FROM ex GROUP BY GROUPING SETS ((hours, endpoint, reason), (hours, endpoint), (hours))""",
)
def exclusion_accounts(spark, d):
    """Bins, events and time by window of the day, endpoint and reason, with totals over reasons and endpoints, from one pass; parts that don't add up are an error.

    Bins are counted by what decides their reason first, so that windows and references are met by those counts.
    """
    gaps = written(gaps_of(spark, d), "gaps")
    bins = written(U.counted_bins(candidates_of(spark, d, support_of(spark, d, gaps))), "counted-bins")
    audit = U.audited(signed_of(spark, d, bins, gaps), {"below_floor": F.col("below_floor")}, FLAGS)
    return U.accounts(audit, F.pmod("bin_start", F.lit(DAY)), {name: (a * HOUR, b * HOUR) for name, a, b in HOURS}, WIDTH)
