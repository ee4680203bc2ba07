"""As-of joins, alignment and window features on quotes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import align as A
from ..operators import features as X
from ..operators import lifecycle as L
from ..operators.order import DAY, HOUR, MINUTE, SECOND, asof_backward, asof_forward, running_sums
from ..sources.shared import written
from .views import QUOTES_SQL, positions, positions_sql, quotes, table, timeline_sql

Q, SQL = {}, {}
UNIT = MINUTE
WINDOW = HOUR
BROKEN = 40 * MINUTE


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Anchors: every quote's time, moved by 37 seconds.
ANCHORS_SQL = f"{QUOTES_SQL}, anchors AS (SELECT symbol, seq AS anchor_id, us + 37000000 AS us FROM quotes)"


def anchors(spark, d):
    return quotes(spark, d).select("symbol", F.col("seq").alias("anchor_id"), (F.col("us") + 37 * SECOND).alias("us"))


@query("asof_backward", f"WITH {ANCHORS_SQL} SELECT a.anchor_id, q.us AS tick_us, q.seq AS tick_seq, q.mid FROM anchors a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.us >= q.us")
def backward(spark, d):
    return asof_backward(anchors(spark, d), quotes(spark, d), ["symbol"], "us", "us", ["seq"], {"tick_us": "us", "tick_seq": "seq", "mid": "mid"}).select("anchor_id", "tick_us", "tick_seq", "mid")


@query("asof_backward_strict", f"WITH {QUOTES_SQL} SELECT a.seq, q.us AS tick_us FROM quotes a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.us > q.us")
def backward_strict(spark, d):
    """The time of the event before each, strictly."""
    t = quotes(spark, d).select("symbol", "seq", "us")
    return asof_backward(t, t, ["symbol"], "us", "us", ["seq"], {"tick_us": "us"}, strict=True).select("seq", "tick_us")


@query(
    "asof_forward_window",
    f"""WITH {ANCHORS_SQL} SELECT a.anchor_id, min(q.us) AS tick_us, arg_min(q.mid, (q.us, q.seq)) AS mid, count(q.us) AS n
FROM anchors a LEFT JOIN quotes q ON a.symbol = q.symbol AND q.us >= a.us AND q.us < a.us + {30 * MINUTE} GROUP BY a.anchor_id""",
)
def forward_window(spark, d):
    """The first tick in a half-open window, and how many there are: by the ticks' running number, so no window is listed."""
    q = quotes(spark, d).select("symbol", "us", "seq", "mid", F.lit(1).cast("bigint").alias("one"))
    numbered = written(running_sums(q, ["symbol"], "us", ["seq"], {"number": "one"}, bucket=DAY).select("symbol", "us", "seq", "mid", "number"), "numbered-ticks")
    a = anchors(spark, d).withColumn("end_us", F.col("us") + 30 * MINUTE)
    a = asof_forward(a, numbered, ["symbol"], "us", "us", ["seq"], {"tick_us": "us", "mid": "mid"})
    a = asof_backward(a, numbered, ["symbol"], "us", "us", ["seq"], {"before": "number"}, strict=True)
    a = asof_backward(a, numbered, ["symbol"], "end_us", "us", ["seq"], {"upto": "number"}, strict=True)
    inside = F.col("tick_us") < F.col("end_us")
    return a.select("anchor_id", *[F.when(inside, F.col(c)).alias(c) for c in ("tick_us", "mid")], (F.coalesce("upto", F.lit(0)) - F.coalesce("before", F.lit(0))).alias("n"))


@query("asof_forward", f"WITH {ANCHORS_SQL} SELECT a.anchor_id, q.us AS tick_us, q.mid FROM anchors a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.us <= q.us")
def forward(spark, d):
    return asof_forward(anchors(spark, d), quotes(spark, d), ["symbol"], "us", "us", ["seq"], {"tick_us": "us", "mid": "mid"}).select("anchor_id", "tick_us", "mid")


@query(
    "asof_nearest",
    f"""WITH {ANCHORS_SQL}, b AS (SELECT a.anchor_id, a.us, q.us AS back FROM anchors a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.us >= q.us),
f AS (SELECT a.anchor_id, q.us AS fwd FROM anchors a ASOF LEFT JOIN quotes q ON a.symbol = q.symbol AND a.us <= q.us)
SELECT anchor_id, CASE WHEN d <= {10 * MINUTE} THEN t END AS tick_us FROM (SELECT anchor_id, us, CASE WHEN back IS NULL OR fwd - us < us - back THEN fwd ELSE back END AS t,
 abs(us - CASE WHEN back IS NULL OR fwd - us < us - back THEN fwd ELSE back END) AS d FROM b JOIN f USING (anchor_id))""",
)
def nearest(spark, d):
    """The nearest tick within a tolerance; of two as near the earlier one."""
    a, q = anchors(spark, d), quotes(spark, d)
    a = asof_backward(a, q, ["symbol"], "us", "us", ["seq"], {"back": "us"})
    a = asof_forward(a, q, ["symbol"], "us", "us", ["seq"], {"fwd": "us"})
    t = F.when(F.col("back").isNull() | (F.col("fwd") - F.col("us") < F.col("us") - F.col("back")), F.col("fwd")).otherwise(F.col("back"))
    return a.withColumn("t", t).select("anchor_id", F.when(F.abs(F.col("us") - F.col("t")) <= 10 * MINUTE, F.col("t")).alias("tick_us"))


# Quotes at whole ten minutes, so that some share a time; some aren't valid, some are marked as duplicates.
MARKED_SQL = f"{ANCHORS_SQL}, m AS (SELECT symbol, seq, us // {10 * MINUTE} * {10 * MINUTE} AS us, bid, ask, seq % 7 <> 0 AS valid, seq % 23 = 0 AS duplicate FROM quotes)"


def marked(spark, d):
    return quotes(spark, d).select(
        "symbol", "seq", (F.floor(F.col("us") / (10 * MINUTE)) * 10 * MINUTE).alias("us"), "bid", "ask", (F.col("seq") % 7 != 0).alias("valid"), (F.col("seq") % 23 == 0).alias("duplicate")
    )


@query(
    "execution_quote",
    f"""WITH {MARKED_SQL}, p AS (SELECT a.anchor_id, m.* FROM anchors a JOIN m ON m.symbol = a.symbol AND m.us >= a.us AND m.us <= a.us + {40 * MINUTE}),
f AS (SELECT anchor_id, min(us) FILTER (valid) AS t, min(us) FILTER (NOT valid) AS bad FROM p GROUP BY 1),
c AS (SELECT f.*, count(p.seq) FILTER (p.valid) AS n, bool_or(p.valid AND p.duplicate) AS dup, min(p.seq) FILTER (p.valid) AS seq FROM f LEFT JOIN p ON p.anchor_id = f.anchor_id AND p.us = f.t GROUP BY ALL),
r AS (SELECT a.anchor_id, t, seq, CASE WHEN t IS NULL THEN 'no_quote' WHEN bad <= t THEN 'invalid_quote' WHEN n > 1 THEN 'same_time' WHEN dup THEN 'duplicate' ELSE 'selected' END AS status FROM anchors a LEFT JOIN c USING (anchor_id))
SELECT anchor_id, status, CASE WHEN status = 'selected' THEN t END AS quote_us, CASE WHEN status = 'selected' THEN seq END AS quote_seq FROM r""",
)
def execution_quote(spark, d):
    return X.execution_quotes(anchors(spark, d), marked(spark, d), ["symbol"], 40 * MINUTE)


@query(
    "mark_quote",
    f"""WITH {MARKED_SQL}, p AS (SELECT a.anchor_id, m.us, count(*) FILTER (valid) AS n, bool_or(valid AND duplicate) AS dup, bool_or(NOT valid) AS bad, min(m.seq) FILTER (valid) AS seq
  FROM anchors a JOIN m ON m.symbol = a.symbol AND m.us >= a.us - {40 * MINUTE} AND m.us <= a.us GROUP BY ALL),
c AS (SELECT anchor_id, max((us, seq)) FILTER (n > 0) AS q, max(n) AS n, bool_or(dup) AS dup, max(us) FILTER (bad) AS bad_us FROM p GROUP BY 1),
r AS (SELECT a.anchor_id, q[1] AS t, q[2] AS seq, CASE WHEN q IS NULL THEN 'no_quote' WHEN n > 1 THEN 'same_time' WHEN dup THEN 'duplicate' WHEN bad_us >= q[1] THEN 'invalid_quote' ELSE 'selected' END AS status FROM anchors a LEFT JOIN c USING (anchor_id))
SELECT anchor_id, status, CASE WHEN status = 'selected' THEN t END AS quote_us, CASE WHEN status = 'selected' THEN seq END AS quote_seq FROM r""",
)
def mark_quote(spark, d):
    return X.mark_quotes(anchors(spark, d), marked(spark, d), ["symbol"], 40 * MINUTE)


# Events to align: the lifecycle's, reported in whole minutes, priced a little off.
ALIGN_SQL = f"""{positions_sql()}, {timeline_sql()}, {QUOTES_SQL},
ev AS (SELECT acct * 1000000 + seq AS event_id, acct, us // {UNIT} * {UNIT} AS us, type, side, price + CASE WHEN position_id % 4 = 0 THEN 0.04 WHEN position_id % 4 = 1 THEN 0.3 ELSE 0.0 END AS price, volume, category, before, after FROM events_m2),
cand AS (SELECT *, CASE WHEN delta >= 0 AND delta < {UNIT} THEN 'A' WHEN delta >= -{UNIT} AND delta < {2 * UNIT} THEN 'B' ELSE 'C' END AS tier FROM (
  SELECT e.event_id, e.us, e.price, q.us AS tick_us, q.seq AS tick_seq, q.us - e.us AS delta,
    CASE WHEN (type = 'OPEN' AND side = 'buy') OR (type = 'CLOSE' AND side = 'sell') THEN q.ask ELSE q.bid END AS quote,
    round(abs(CASE WHEN (type = 'OPEN' AND side = 'buy') OR (type = 'CLOSE' AND side = 'sell') THEN q.ask ELSE q.bid END - e.price), 9) AS error
  FROM ev e JOIN quotes q ON q.us >= e.us - {2 * UNIT} AND q.us < e.us + {3 * UNIT})),
ranked AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY tier, error, abs(delta), tick_us, tick_seq) AS rank FROM cand),
best AS (SELECT * FROM ranked WHERE rank = 1),
ties AS (SELECT c.event_id, count(*) AS ties FROM ranked c JOIN best b ON c.event_id = b.event_id AND c.tier = b.tier AND c.error = b.error AND abs(c.delta) = abs(b.delta) GROUP BY 1),
matched AS (SELECT e.event_id, e.acct, e.us, e.volume, e.category, e.before, e.after, b.tick_us, b.tick_seq, b.error, b.tier, t.ties,
  CASE WHEN b.tick_us IS NULL THEN 'UNMATCHED' WHEN tier = 'A' AND error <= 0.01 AND ties = 1 THEN 'HIGH' WHEN tier IN ('A', 'B') AND error <= 0.05 AND ties = 1 THEN 'MEDIUM'
    WHEN error <= 0.5 AND ties = 1 THEN 'LOW' WHEN error <= 0.5 THEN 'AMBIGUOUS' ELSE 'UNMATCHED' END AS quality,
  CASE WHEN b.tick_us IS NULL THEN 'no_ticks_in_search_window' WHEN error > 0.5 THEN 'price_error_above_threshold' END AS unmatched_reason
  FROM ev e LEFT JOIN best b USING (event_id) LEFT JOIN ties t USING (event_id))"""


def align_events(spark, d, apart=SECOND):
    e = L.lifecycle(positions(spark, d, apart=apart))
    off = F.when(F.col("position_id") % 4 == 0, 0.04).when(F.col("position_id") % 4 == 1, 0.3).otherwise(0.0)
    return e.select(
        (F.col("acct") * 1_000_000 + F.col("seq")).alias("event_id"), "acct", (F.floor(F.col("us") / UNIT) * UNIT).alias("us"), "type", "side", (F.col("price") + off).alias("price"), "volume", "category", "before", "after"
    )


def ranked(spark, d):
    return A.candidates(align_events(spark, d).select("event_id", "us", "type", "side", "price"), quotes(spark, d), [], UNIT, keep=["event_id"])


def matched(spark, d):
    return A.best_matches(A.best_candidates(align_events(spark, d), quotes(spark, d), [], UNIT), 0.01, 0.05, 0.5)


@query("align_candidates", f"WITH {ALIGN_SQL} SELECT event_id, tick_seq, delta, error, tier, rank FROM ranked")
def align_candidates(spark, d):
    return ranked(spark, d).filter("tick_us IS NOT NULL").select("event_id", "tick_seq", "delta", "error", "tier", "rank")


@query("align_best", f"WITH {ALIGN_SQL} SELECT event_id, tick_us, tick_seq, error, tier, ties, quality, unmatched_reason FROM matched")
def align_best(spark, d):
    return matched(spark, d).select("event_id", "tick_us", "tick_seq", "error", "tier", "ties", "quality", "unmatched_reason")


@query("align_quality_counts", f"WITH {ALIGN_SQL} SELECT quality, unmatched_reason, count(*) AS n, round(median(error), 6) AS median_error FROM matched GROUP BY ALL")
def align_quality_counts(spark, d):
    return matched(spark, d).groupBy("quality", "unmatched_reason").agg(F.count(F.lit(1)).alias("n"), F.round(F.median("error"), 6).alias("median_error"))


@query(
    "same_second_resolution",
    f"""WITH {ALIGN_SQL.replace(positions_sql(), positions_sql(2, 0))}, g AS (SELECT acct, us, category, count(*) AS size, bool_and(quality IN ('HIGH', 'MEDIUM')) AS good, count(DISTINCT tick_us) AS times FROM matched GROUP BY ALL),
r AS (SELECT m.*, g.size, m.category = 'ambiguous_ordering' AND size > 1 AND good AND times = size AS resolvable FROM matched m JOIN g USING (acct, us, category))
SELECT event_id, size, resolvable, CASE WHEN category <> 'ambiguous_ordering' THEN 'not_applicable' WHEN resolvable THEN 'resolved' ELSE 'still_ambiguous' END AS resolution,
  CASE WHEN resolvable THEN row_number() OVER (PARTITION BY acct, us, category ORDER BY tick_us NULLS LAST, tick_seq, event_id) END AS place FROM r""",
)
def same_second_resolution(spark, d):
    """Positions that close when another opens, so that their events are ambiguous."""
    m = A.best_matches(A.best_candidates(align_events(spark, d, apart=0), quotes(spark, d), [], UNIT), 0.01, 0.05, 0.5)
    return A.same_time_order(m, ["acct"]).select("event_id", "size", "resolvable", "resolution", "place")


@query("primary_samples", f"WITH {ALIGN_SQL} SELECT quality, count(*) AS n FROM matched WHERE volume = 0.3 AND category = 'classified_standard' AND (before IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL') OR after IN ('HEDGED_1X1', 'ONE_BUY', 'ONE_SELL')) AND quality IN ('HIGH', 'MEDIUM') GROUP BY quality")
def primary_samples(spark, d):
    m = matched(spark, d)
    return m.filter(A.is_primary(*[F.col(c) for c in ("volume", "category", "before", "after", "quality")])).groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


@query("effective_times", f"WITH {ALIGN_SQL} SELECT event_id, coalesce(CASE WHEN quality IN ('HIGH', 'MEDIUM', 'LOW') THEN tick_us END, us) AS effective_us FROM matched")
def effective_times(spark, d):
    good = F.when(F.col("quality").isin("HIGH", "MEDIUM", "LOW"), F.col("tick_us"))
    return matched(spark, d).select("event_id", F.coalesce(good, F.col("us")).alias("effective_us"))


ROLL_SQL = f"""{QUOTES_SQL}, st AS (SELECT *, ask - bid AS spread, mid - lag(mid) OVER (PARTITION BY symbol ORDER BY us, seq) AS step, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS wait, min(us) OVER (PARTITION BY symbol) AS first_us FROM quotes),
roll AS (SELECT symbol, seq, us, first_us, count(*) OVER w AS n, max(mid) OVER w AS high, min(mid) OVER w AS low, max((mid, us)) OVER w AS h, max((-mid, us)) OVER w AS l, spread,
  arg_min(mid, (us, seq)) OVER w AS first_mid, mid AS last_mid, arg_min(coalesce(step, 0), (us, seq)) OVER w AS first_step, count(*) FILTER (step > 0) OVER w AS ups, count(*) FILTER (step < 0) OVER w AS downs, sum(step * step) OVER w AS squares,
  max(wait) OVER (PARTITION BY symbol ORDER BY us RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS longest
  FROM st WINDOW w AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW)),
rolled AS (SELECT *, ups - CAST(first_step > 0 AS BIGINT) AS up, downs - CAST(first_step < 0 AS BIGINT) AS down FROM roll)"""


@query(
    "window_features",
    f"""WITH {ROLL_SQL} SELECT symbol, seq, us, n, high, low, round(CASE WHEN high > low THEN (last_mid - low) / (high - low) ELSE 0.5 END, 9) AS position, round(high - last_mid, 9) AS from_high, round(last_mid - low, 9) AS from_low, us - h[2] AS since_high, us - l[2] AS since_low,
  round(CASE WHEN first_mid <> 0 THEN last_mid / first_mid END - 1, 9) AS "return", round(last_mid - first_mid, 9) AS change, up AS ups, down AS downs, round((up - down) / greatest(n - 1, 1), 9) AS imbalance,
  round(sqrt(greatest(coalesce(squares, 0) - first_step * first_step, 0)), 6) AS volatility, round(spread, 9) AS spread, n >= 2 AND us - {WINDOW} >= first_us AND coalesce(longest <= {BROKEN}, true) AS valid FROM rolled""",
)
def window_features(spark, d):
    return X.rolling(quotes(spark, d), ["symbol"], WINDOW, BROKEN)


TOUCH_SQL = f"""{QUOTES_SQL}, tg AS (SELECT *, us - lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS wait, min(us) OVER (PARTITION BY symbol) AS first_us FROM quotes),
tw AS (SELECT symbol, seq, us, count(mid) OVER p AS prior_n, max(mid) OVER p AS prior_high, min(mid) OVER p AS prior_low, max(mid) OVER n AS high, min(mid) OVER n AS low, max(mid) OVER b AS high_before, min(mid) OVER b AS low_before,
  count(mid) OVER p >= 2 AND count(mid) OVER n >= 2 AND us - {2 * WINDOW} >= first_us AND coalesce(max(wait) OVER g <= {BROKEN}, true) AS touch_valid FROM tg
  WINDOW p AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {2 * WINDOW} PRECEDING AND {WINDOW + 1} PRECEDING), n AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {WINDOW} PRECEDING AND CURRENT ROW),
    b AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {WINDOW} PRECEDING AND 1 PRECEDING), g AS (PARTITION BY symbol ORDER BY us RANGE BETWEEN {2 * WINDOW - 1} PRECEDING AND CURRENT ROW)),
touch AS (SELECT *, prior_n > 0 AND coalesce(prior_high > prior_low, false) AS complete FROM tw)"""


@query(
    "boundary_sequence",
    f"""WITH {TOUCH_SQL} SELECT symbol, seq, us, prior_n, prior_high, prior_low, complete, touch_valid, CASE WHEN complete THEN high >= prior_high END AS touches_high, CASE WHEN complete THEN low <= prior_low END AS touches_low,
  CASE WHEN touch_valid THEN coalesce(high_before >= prior_high, false) END AS touched_high, CASE WHEN touch_valid THEN coalesce(low_before <= prior_low, false) END AS touched_low,
  CASE WHEN complete THEN round(greatest(high - prior_high, 0.0), 9) END AS breach_high, CASE WHEN complete THEN round(greatest(prior_low - low, 0.0), 9) END AS breach_low FROM touch""",
)
def boundary_sequence(spark, d):
    return X.boundary_touch(quotes(spark, d), ["symbol"], WINDOW, BROKEN)


def _back_sql(side: str, sign: str, end: str, reach: str, best: str) -> str:
    return f"""SELECT f.symbol, '{side}' AS side, f.seq, f.us, f.touch_us, f.us - f.touch_us AS lead, round({sign} * ({best}(q.mid) - arg_max(q.mid, (q.us, q.seq))), 9) AS retracement
FROM (SELECT b.symbol, b.seq, b.us, min(q.us) AS touch_us FROM touch b JOIN quotes q ON q.symbol = b.symbol AND q.us >= b.us - {WINDOW} AND q.us <= b.us AND q.mid {reach} b.{end} WHERE b.complete GROUP BY ALL) f JOIN quotes q ON q.symbol = f.symbol AND q.us >= f.touch_us AND q.us <= f.us GROUP BY ALL"""


@query("boundary_retracement", f"WITH {TOUCH_SQL} {_back_sql('high', '1', 'prior_high', '>=', 'max')} UNION ALL {_back_sql('low', '-1', 'prior_low', '<=', 'min')}")
def boundary_retracement(spark, d):
    return X.retracement(quotes(spark, d), ["symbol"], WINDOW)


SNAP_SQL = f"""{MARKED_SQL}, t AS (SELECT symbol, seq, us, lag(us) OVER w AS us_before, coalesce(duplicate OR us = lag(us) OVER w, duplicate) AS repeats, seq % 97 <> 0 AS valid,
    CAST((CAST(bid AS DECIMAL(16,8)) + CAST(ask AS DECIMAL(16,8))) / 2 AS DECIMAL(18,9)) AS mid, CAST(ask AS DECIMAL(16,8)) - CAST(bid AS DECIMAL(16,8)) AS spread
  FROM (SELECT symbol, seq, us, bid, ask, seq % 23 = 0 AS duplicate FROM quotes) WINDOW w AS (PARTITION BY symbol ORDER BY us, seq)),
p AS (SELECT a.anchor_id, a.us AS decided, t.*, max(CASE WHEN t.us <= a.us - {WINDOW} THEN (t.us, t.seq) END) OVER (PARTITION BY a.anchor_id) AS anchor FROM anchors a JOIN t ON t.symbol = a.symbol AND t.us >= a.us - {3 * WINDOW} AND t.us <= a.us),
g AS (SELECT anchor_id, count(*) FILTER (us >= decided - {WINDOW}) AS n, bool_or(NOT valid) AS invalid, max(anchor) AS anchor, bool_or(repeats) AS repeats, bool_or((us, seq) >= anchor AND repeats) AS window_repeats,
  max(us - us_before) FILTER ((us, seq) > anchor) AS longest, max(us) AS last_us, max(mid) FILTER ((us, seq) >= anchor) AS high, min(mid) FILTER ((us, seq) >= anchor) AS low, arg_min(mid, (us, seq)) FILTER ((us, seq) >= anchor) AS first,
  arg_max(mid, (us, seq)) AS last, arg_max(spread, (us, seq)) AS spread FROM p GROUP BY 1),
sn AS (SELECT a.anchor_id AS decision_id, a.us, g.*, greatest(coalesce(longest, 0), a.us - last_us) AS gap, CASE WHEN invalid THEN 'invalid_row' WHEN last_us IS NULL THEN 'empty_prefix' WHEN anchor IS NULL THEN CASE WHEN repeats THEN 'duplicate_timestamp' ELSE 'no_anchor' END
    WHEN window_repeats THEN 'duplicate_timestamp' WHEN greatest(coalesce(longest, 0), a.us - last_us) > {HOUR} THEN 'quote_gap' ELSE 'supported' END AS support FROM anchors a LEFT JOIN g USING (anchor_id))"""


@query(
    "snapshot_60",
    f"""WITH {SNAP_SQL} SELECT decision_id, us, support, coalesce(n, 0) AS n, CASE WHEN support = 'supported' THEN CAST((last - first) * 100 AS DOUBLE) END AS increment, CASE WHEN support = 'supported' THEN CAST((first - low) * 100 AS DOUBLE) END AS buy_adverse,
  CASE WHEN support = 'supported' THEN CAST((high - first) * 100 AS DOUBLE) END AS sell_adverse, CASE WHEN support = 'supported' THEN CAST(spread * 100 AS DOUBLE) END AS spread, CASE WHEN support IN ('supported', 'quote_gap') THEN gap END AS longest_gap FROM sn""",
)
def snapshot_60(spark, d):
    ticks = quotes(spark, d).withColumns({"valid": F.col("seq") % 97 != 0, "duplicate": F.col("seq") % 23 == 0})
    found = X.snapshot(anchors(spark, d).withColumnRenamed("anchor_id", "decision_id"), ticks, ["symbol"], WINDOW, HOUR, 3 * WINDOW)
    return found.withColumns({c: F.col(c).cast("double") for c in ("increment", "buy_adverse", "sell_adverse", "spread")})


STATE_SQL = "CASE anchor_id % 3 WHEN 0 THEN 'ONE_BUY' WHEN 1 THEN 'ONE_SELL' ELSE 'HEDGED' END"


@query(
    "rule_features",
    f"""WITH {ANCHORS_SQL}, q AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us) AS us_before FROM (SELECT symbol, us, max(seq) AS seq, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask, arg_max(mid, seq) AS mid FROM quotes GROUP BY ALL)),
d AS (SELECT symbol, anchor_id, us, us - {WINDOW} AS early, {STATE_SQL} AS state FROM anchors), l AS (SELECT d.*, q.us AS last_us, us_before, bid, ask, mid AS last FROM d ASOF LEFT JOIN q ON d.symbol = q.symbol AND d.us >= q.us),
f AS (SELECT l.*, q.mid AS first FROM l ASOF LEFT JOIN q ON l.symbol = q.symbol AND l.early >= q.us), w AS (SELECT anchor_id, count(*) AS n, max(q.mid) AS high, min(q.mid) AS low FROM d JOIN q ON q.symbol = d.symbol AND q.us >= d.early AND q.us <= d.us GROUP BY anchor_id)
SELECT f.anchor_id AS decision_id, state, round((ask - bid) / 0.01, 6) AS spread, coalesce(last_us - us_before, 0) AS quote_gap, round(coalesce(n, 0) / {WINDOW / SECOND}, 9) AS rate, CASE WHEN us % {DAY} < {8 * HOUR} THEN 'asia' WHEN us % {DAY} < {16 * HOUR} THEN 'europe' ELSE 'us' END AS session,
  round(last - first, 9) AS increment, round(CASE WHEN first IS NULL THEN NULL WHEN state = 'ONE_BUY' THEN first - least(first, low) WHEN state = 'ONE_SELL' THEN greatest(first, high) - first END, 9) AS adverse FROM f LEFT JOIN w ON w.anchor_id = f.anchor_id""",
)
def rule_features(spark, d):
    """What a rule may look at soon after each quote; of quotes of one time the last."""
    last = F.max(F.struct("seq", "bid", "ask", "mid")).alias("q")
    ticks = written(quotes(spark, d).groupBy("symbol", "us").agg(last).select("symbol", "us", "q.*"), "single-ticks")
    state = F.when(F.col("anchor_id") % 3 == 0, "ONE_BUY").when(F.col("anchor_id") % 3 == 1, "ONE_SELL").otherwise("HEDGED")
    found = X.rule_snapshot(anchors(spark, d).select("symbol", F.col("anchor_id").alias("decision_id"), "us", state.alias("state")), ticks, ["symbol"], WINDOW)
    return found.select("decision_id", "state", F.round("spread", 6).alias("spread"), "quote_gap", F.round("rate", 9).alias("rate"), "session", F.round("increment", 9).alias("increment"), F.round("adverse", 9).alias("adverse"))


@query(
    "exclusion_waterfall",
    f"""WITH {ROLL_SQL}, r AS (SELECT symbol, CASE WHEN NOT (us - {WINDOW} >= first_us) THEN 'window_before_first_tick' WHEN n < 2 THEN 'too_few_ticks' WHEN high = low THEN 'flat_window' WHEN last_mid < 20 THEN 'current_snapshot' END AS reason FROM roll)
SELECT symbol, reason, count(*) AS n FROM r GROUP BY ALL""",
)
def exclusion_waterfall(spark, d):
    """The first reason that applies; rows without one stay (the null group)."""
    r = X.rolling(quotes(spark, d), ["symbol"], WINDOW).join(quotes(spark, d).select("symbol", "seq", "mid"), ["symbol", "seq"])
    first = quotes(spark, d).groupBy("symbol").agg(F.min("us").alias("first_us"))
    r = r.join(first, "symbol")
    reason = X.first_reason(
        {"window_before_first_tick": F.col("us") - WINDOW < F.col("first_us"), "too_few_ticks": F.col("n") < 2, "flat_window": F.col("high") == F.col("low"), "current_snapshot": F.col("mid") < 20}
    )
    return r.groupBy("symbol", reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "winsor_caps",
    f"""WITH {ROLL_SQL}, caps AS (SELECT symbol, quantile_cont(high - low, 0.99) FILTER (us % {2 * DAY} < {DAY}) AS cap FROM roll GROUP BY symbol)
SELECT symbol, round(cap, 6) AS cap, round(avg(least(high - low, cap)), 6) AS clipped, count(*) FILTER (high - low > cap) AS above FROM roll JOIN caps USING (symbol) GROUP BY symbol, cap""",
)
def winsor_caps(spark, d):
    """Caps are fitted on every second day, and clip all."""
    r = written(X.rolling(quotes(spark, d), ["symbol"], WINDOW).select("symbol", "us", (F.col("high") - F.col("low")).alias("span")), "spans")
    caps = r.filter(F.col("us") % (2 * DAY) < DAY).groupBy("symbol").agg(F.percentile("span", 0.99).alias("cap"))
    r = r.join(caps, "symbol")
    return r.groupBy("symbol", "cap").agg(F.round(F.avg(X.cap_at(F.col("span"), F.col("cap"))), 6).alias("clipped"), F.count_if(F.col("span") > F.col("cap")).alias("above")).withColumn("cap", F.round("cap", 6))


@query("json_props", "SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY ALL")
def json_props(spark, d):
    e = table(spark, d, "events").withColumn("p", F.from_json("props", "k bigint"))
    return e.groupBy("event_type", (F.col("p.k") % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))
