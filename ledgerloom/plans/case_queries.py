"""Eligibility, order, censoring and choice of cases, validated joins, clocks and text functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fn
from ..operators import cases as C
from ..operators import features as X
from ..operators import intervals as I
from ..operators import lifecycle as L
from ..operators.order import DAY, HOUR, MINUTE, asof_backward
from .interval_queries import BOUNDS_SQL, GAPS_SQL, bounds_of, gaps_of
from .views import QUOTES_SQL, positions, positions_sql, quotes, table, timeline_sql

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# The events that a one-leg state begins and ends with.
BEFORE = {"ONE_BUY": "UNLOCK_TO_BUY", "ONE_SELL": "UNLOCK_TO_SELL"}
AFTER = {"ONE_BUY": "REHEDGE_SELL", "ONE_SELL": "REHEDGE_BUY"}

# Positions that close half-way to the event that would close them, so that one leg stays alone for hours.
APART_SQL = f"{positions_sql(share=2)}, {timeline_sql()}, {BOUNDS_SQL}"
# Every 40th event of a book is taken for an exception.
ELIGIBLE_SQL = f"""{APART_SQL}, one_event AS (SELECT acct, us, max(behavior) AS only_one FROM events_m2 GROUP BY ALL HAVING count(*) = 1 AND NOT bool_or(category = 'ambiguous_ordering')),
eligible AS (SELECT i.acct, i.interval_id, i.state, i.start_us, i.end_us FROM bounds, intervals i JOIN one_event a ON a.acct = i.acct AND a.us = i.start_us JOIN one_event b ON b.acct = i.acct AND b.us = i.end_us
  WHERE i.start_us >= lo AND i.start_us < i.end_us AND i.end_us <= hi AND i.end_us - i.start_us >= {MINUTE} AND ((state = 'ONE_BUY' AND behavior = 'UNLOCK_TO_BUY' AND following = 'REHEDGE_SELL') OR (state = 'ONE_SELL' AND behavior = 'UNLOCK_TO_SELL' AND following = 'REHEDGE_BUY'))
    AND a.only_one = i.behavior AND b.only_one = i.following AND NOT EXISTS (SELECT 1 FROM events_m2 e WHERE e.acct = i.acct AND e.seq % 40 = 0 AND e.us >= i.start_us AND e.us <= i.end_us))"""


def eligible_of(spark, d):
    p = positions(spark, d, share=2)
    low, high = bounds_of(p)
    e = L.lifecycle(p)
    return C.eligible(L.intervals(e), e, e.filter("seq % 40 = 0"), ["acct"], BEFORE, AFTER, low, high, MINUTE).select("acct", "interval_id", "state", "start_us", "end_us")


@query("eligible_intervals", f"WITH {ELIGIBLE_SQL} SELECT * FROM eligible")
def eligible_intervals(spark, d):
    return eligible_of(spark, d)


BANDS = ([HOUR, 6 * HOUR, DAY], ["up_to_1h", "up_to_6h", "up_to_1d", "longer"])


@query(
    "selected_cases",
    f"""WITH {ELIGIBLE_SQL}, day AS (SELECT *, start_us // {DAY} AS day, row_number() OVER (PARTITION BY start_us // {DAY} ORDER BY start_us - end_us, start_us, state, acct) AS rn FROM eligible),
s AS (SELECT *, day // 30 % 5 AS stratum FROM day WHERE rn = 1), f AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY day) = 1 AND stratum < 3 AS first FROM s), o AS (SELECT *, row_number() OVER (ORDER BY first DESC, day) AS place FROM f)
SELECT day, acct, interval_id, state, CASE WHEN stratum < 3 THEN stratum END AS stratum, CASE WHEN first THEN 'earliest_eligible_date' ELSE 'chronological_fallback' END AS selection,
  CASE WHEN end_us - start_us <= {HOUR} THEN 'up_to_1h' WHEN end_us - start_us <= {6 * HOUR} THEN 'up_to_6h' WHEN end_us - start_us <= {DAY} THEN 'up_to_1d' ELSE 'longer' END AS band FROM o WHERE place <= 5""",
)
def selected_cases(spark, d):
    """One case a date; of three strata of months the earliest date, then others, five in all."""
    e = eligible_of(spark, d).withColumn("side", F.struct("state", "acct"))
    s = F.floor(F.col("day") / 30) % 5
    c = C.select_cases(e, F.when(s < 3, s), 5)
    return c.select("day", "acct", "interval_id", "state", "stratum", "selection", C.duration_band(F.col("end_us") - F.col("start_us"), *BANDS).alias("band"))


@query(
    "interval_order_faults",
    """WITH p AS (SELECT o_custkey AS acct, o_orderkey AS id, epoch_us(o_orderdate) AS start_us, epoch_us(o_orderdate) + CAST((o_orderkey % 9 - 1) * 86400000000 * 20 AS BIGINT) AS end_us FROM orders),
l AS (SELECT *, lag(CASE WHEN end_us > start_us THEN start_us END) OVER w AS bs, lag(CASE WHEN end_us > start_us THEN end_us END) OVER w AS be FROM p WINDOW w AS (PARTITION BY acct ORDER BY id))
SELECT acct, id, end_us <= start_us OR coalesce(start_us <= bs, false) AS is_invalid, end_us > start_us AND coalesce(start_us < be, false) AS is_overlap FROM l""",
)
def interval_order_faults(spark, d):
    from ..operators.order import to_us

    o = table(spark, d, "orders").select(F.col("o_custkey").alias("acct"), F.col("o_orderkey").alias("id"), to_us("o_orderdate").alias("start_us"))
    o = o.withColumn("end_us", F.col("start_us") + (F.col("id") % 9 - 1) * 20 * DAY)
    return C.order_faults(o, ["acct"], "id").select("acct", "id", "is_invalid", "is_overlap")


@query(
    "window_censoring",
    f"""WITH {APART_SQL} SELECT CASE WHEN interval_id % 13 = 0 THEN 'clock_unresolved' WHEN end_us <= start_us OR state NOT IN ('ONE_BUY', 'ONE_SELL') THEN 'invalid_transition' WHEN start_us < lo OR end_us > hi THEN 'cross_fold_continuation'
  WHEN interval_id = 1 THEN 'left_censored_unknown_bootstrap' WHEN end_us - start_us < {HOUR} THEN 'coverage_censored_no_valid_tick' WHEN following NOT LIKE 'REHEDGE%' THEN 'right_censored_no_terminal' ELSE 'valid' END AS status, count(*) AS n FROM intervals, bounds GROUP BY ALL""",
)
def window_censoring(spark, d):
    p = positions(spark, d, share=2)
    low, high = bounds_of(p)
    status = C.window_status(
        {
            "clock_unresolved": F.col("interval_id") % 13 == 0,
            "invalid_transition": (F.col("end_us") <= F.col("start_us")) | ~F.col("state").isin("ONE_BUY", "ONE_SELL"),
            "cross_fold_continuation": (F.col("start_us") < low) | (F.col("end_us") > high),
            "left_censored_unknown_bootstrap": F.col("interval_id") == 1,
            "coverage_censored_no_valid_tick": F.col("end_us") - F.col("start_us") < HOUR,
            "right_censored_no_terminal": ~F.col("following").startswith("REHEDGE"),
        }
    )
    return L.intervals(L.lifecycle(p)).groupBy(status.alias("status")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "gap_classes",
    f"""WITH {GAPS_SQL} SELECT CASE WHEN isodow(make_timestamp(gap_start)) = 5 AND isodow(make_timestamp(gap_end)) IN (6, 7) AND isodow(make_timestamp(gap_end + {3 * HOUR})) = 1 THEN 'weekend_opening_gap' ELSE 'temporal_coverage_gap' END AS class,
  isodow(make_timestamp(gap_end)) = 1 AS monday, count(*) AS n, CAST(sum(gap_end - gap_start) AS BIGINT) AS us FROM gaps GROUP BY ALL""",
)
def gap_classes(spark, d):
    from ..operators.order import from_us

    g = gaps_of(spark, d)
    kind, monday = C.gap_class(F.col("gap_start"), F.col("gap_end"), 3 * HOUR), F.weekday(from_us(F.col("gap_end"))) == 0
    return g.groupBy(kind.alias("class"), monday.alias("monday")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("us"))


@query(
    "tick_metrics",
    f"""WITH {QUOTES_SQL}, t AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY us, seq) AS before FROM (SELECT symbol, seq, us // {MINUTE} * {MINUTE} AS us, seq % 7 <> 0 AS valid FROM quotes))
SELECT symbol, count(*) AS n, count(*) FILTER (valid) AS valid, count(*) FILTER (us = before) AS repeated, count(*) FILTER (NOT valid) AS invalid, max(us - before) AS longest, count(*) FILTER (us - before > {HOUR}) AS gaps FROM t GROUP BY symbol""",
)
def tick_metrics(spark, d):
    t = quotes(spark, d).select("symbol", "seq", (F.floor(F.col("us") / MINUTE) * MINUTE).alias("us"), (F.col("seq") % 7 != 0).alias("valid"), F.lit(False).alias("duplicate"))
    return C.tick_metrics(X.with_repeats(t, ["symbol"]), ["symbol"], HOUR)


@query("top_hours", f"WITH {QUOTES_SQL}, h AS (SELECT symbol, us % {DAY} // {HOUR} AS hour, count(*) AS n FROM quotes GROUP BY ALL) SELECT symbol, hour, n, row_number() OVER (PARTITION BY symbol ORDER BY n DESC, hour) AS place FROM h QUALIFY place <= 5")
def top_hours(spark, d):
    return C.top_hours(quotes(spark, d), ["symbol"], 5)


@query("validated_join", "SELECT o_orderkey, o_custkey, c_name, n_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey")
def validated_join(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_nationkey")
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    o = C.validated_join(table(spark, d, "orders").select("o_orderkey", "o_custkey"), c, ["o_custkey"])
    return C.validated_join(o, n, ["c_nationkey"]).select("o_orderkey", "o_custkey", "c_name", "n_name")


@query(
    "same_row_ids",
    "SELECT count(*) FILTER (b IS NULL) AS only_left, count(*) FILTER (a IS NULL) AS only_right, count(*) FILTER (a = b) AS \"both\" FROM (SELECT DISTINCT o_orderkey AS a FROM orders WHERE o_orderstatus <> 'P') FULL JOIN (SELECT DISTINCT l_orderkey AS b FROM lineitem WHERE l_quantity > 25) ON a = b",
)
def same_row_ids(spark, d):
    left = table(spark, d, "orders").filter("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("id"))
    return C.same_ids(left, table(spark, d, "lineitem").filter("l_quantity > 25").select(F.col("l_orderkey").alias("id")), "id")


@query("kept_first", "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_quantity) AS rn FROM lineitem) WHERE rn = 1")
def kept_first(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    return C.keep_first(li, ["l_orderkey"], *[F.col(c) for c in ("l_shipdate", "l_linenumber", "l_partkey", "l_quantity")]).drop("l_shipdate")


# A clock two hours ahead of UTC, three from the 11th to the 21st of January 2024.
FORWARD, BACK = 1704931200000000, 1705795200000000
CLOCK = [(0, FORWARD, 2 * HOUR), (FORWARD, BACK, 3 * HOUR), (BACK, 4102444800000000, 2 * HOUR)]


@query(
    "clock_mapping",
    "WITH s AS (SELECT event_id, epoch_us(ts) // 900000000 * 900000000 AS us FROM events), c AS (SELECT event_id, us, list_distinct(list_filter(["
    + ", ".join(f"CASE WHEN us - {o} >= {a} AND us - {o} < {b} THEN us - {o} END" for a, b, o in CLOCK)
    + "], lambda x: x IS NOT NULL)) AS found FROM s) SELECT event_id, CASE len(found) WHEN 1 THEN 'unique' WHEN 0 THEN 'nonexistent' ELSE 'ambiguous' END AS status, CASE WHEN len(found) = 1 THEN found[1] END AS utc_us FROM c",
)
def clock_mapping(spark, d):
    """Events' times as a server's, to UTC."""
    from ..operators.order import to_us

    e = table(spark, d, "events").select("event_id", (F.floor(to_us("ts") / 900_000_000) * 900_000_000).alias("us"))
    status, utc = fn.server_to_utc(F.col("us"), CLOCK)
    return e.select("event_id", status.alias("status"), utc.alias("utc_us"))


@query(
    "sample_ids",
    "SELECT o_orderkey, sha256(concat_ws('|', o_custkey, o_orderkey, o_orderpriority)) AS sample_id, list_reduce(list_prepend(0, [instr('0123456789abcdef', substr(sha256(o_orderpriority), i, 1)) - 1 for i in range(1, 9)]), lambda a, x: a * 16 + x) AS seed FROM orders",
)
def sample_ids(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", fn.sample_id(F.col("o_custkey"), F.col("o_orderkey"), F.col("o_orderpriority")).alias("sample_id"), fn.stable_seed(F.col("o_orderpriority")).alias("seed"))


@query(
    "report_numbers",
    r"""SELECT l_orderkey, l_linenumber, TRY_CAST(regexp_replace(n, '[,\s]', '', 'g') AS DOUBLE) AS number, CAST(l_quantity AS DOUBLE) AS requested, CASE WHEN l_linenumber % 3 <> 0 THEN CAST(l_linenumber AS DOUBLE) END AS filled, trim(regexp_replace(w, '\s+', ' ', 'g')) AS words
FROM (SELECT *, CASE WHEN l_partkey % 7 = 0 THEN 'none' ELSE ' 1 ' || l_linenumber || ',00' || l_linenumber END AS n, '  ' || l_returnflag || chr(9) || '  ' || l_linestatus || ' ' AS w FROM lineitem)""",
)
def report_numbers(spark, d):
    """Numbers with commas and spaces, pairs of volumes, words with white space."""
    li = table(spark, d, "lineitem")
    line = F.col("l_linenumber").cast("string")
    n = F.when(F.col("l_partkey") % 7 == 0, "none").otherwise(F.concat(F.lit(" 1 "), line, F.lit(",00"), line))
    volumes = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity").cast("string")).otherwise(F.concat(F.col("l_quantity").cast("string"), F.lit(" / "), line))
    requested, filled = fn.requested_and_filled(volumes)
    words = fn.spaces_collapsed(F.concat(F.lit("  "), "l_returnflag", F.lit("\t  "), "l_linestatus", F.lit(" ")))
    return li.select("l_orderkey", "l_linenumber", fn.number(n).alias("number"), requested.alias("requested"), filled.alias("filled"), words.alias("words"))


@query("symbol_filter", "SELECT p_brand, count(*) AS n FROM part WHERE upper(trim(p_brand)) IN ('BRAND#11', 'BRAND#12', 'BRAND#23') GROUP BY p_brand")
def symbol_filter(spark, d):
    return X.of_symbols(table(spark, d, "part"), "p_brand", ["brand#11", "Brand#12", "BRAND#23"]).groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))


# Reports of five days, folds of three of them; every 50th interval is in the next report's list. Ticks that count are each 40th.
REPORT, FOLD = 5 * DAY, 3
CLOCKS = {"utc_plus_2": [(0, 4102444800000000, 2 * HOUR)], "utc_plus_3": [(0, 4102444800000000, 3 * HOUR)], "changing": CLOCK}
BOOTSTRAPS = {"left_censored": True, "assumed_hedged": False}
LEAST_UNITS, LEAST_SIDE = 300, 150


def _resolved(segments) -> str:
    return " + ".join(f"CAST(start_us - {o} >= {a} AND start_us - {o} < {b} AS INT)" for a, b, o in segments) + " = 1"


@query(
    "population_support",
    f"""WITH {APART_SQL}, {QUOTES_SQL}, w AS (SELECT acct, interval_id, state AS side, start_us, end_us, start_us // {REPORT} + CAST(interval_id % 50 = 0 AS INT) AS report, acct || '|' || start_us // {DAY} AS unit, coalesce(following LIKE 'REHEDGE%', false) AS has_terminal FROM intervals WHERE state IN ('ONE_BUY', 'ONE_SELL', 'MULTI_POSITION')),
r AS (SELECT *, report // {FOLD} AS fold FROM w), longer AS (SELECT * REPLACE (end_us + CASE WHEN interval_id % 30 = 1 THEN {2 * DAY} ELSE 0 END AS end_us) FROM r),
rejected AS (SELECT DISTINCT x.acct, x.fold, x.interval_id FROM longer x JOIN longer y ON y.acct = x.acct AND y.fold = x.fold AND y.interval_id < x.interval_id AND y.start_us < x.end_us AND x.start_us < y.end_us AND x.start_us < x.end_us AND y.start_us < y.end_us),
ticked AS (SELECT l.*, coalesce(q.us >= l.start_us, false) AS has_tick FROM longer l ASOF LEFT JOIN (SELECT us FROM quotes WHERE seq % 40 = 0) q ON l.end_us >= q.us),
sc AS (SELECT t.*, j.interval_id IS NOT NULL AS is_rejected, c.clock, c.resolved, b.bootstrap, b.bootstrap = 'left_censored' AS unknown, t.report * {REPORT} AS rs, (t.report + 1) * {REPORT} AS re FROM ticked t LEFT JOIN rejected j ON j.acct = t.acct AND j.fold = t.fold AND j.interval_id = t.interval_id,
  (SELECT unnest(['left_censored', 'assumed_hedged']) AS bootstrap) b, LATERAL (SELECT unnest({list(CLOCKS)}) AS clock, unnest([{', '.join(_resolved(x) for x in CLOCKS.values())}]) AS resolved) c),
st AS (SELECT *, CASE WHEN end_us <= start_us THEN 'invalid_transition' WHEN start_us >= rs AND start_us < re AND end_us > re THEN 'cross_fold_continuation' WHEN start_us < rs OR end_us > re THEN 'invalid_transition' WHEN NOT resolved THEN 'clock_unresolved'
  WHEN is_rejected OR side = 'MULTI_POSITION' THEN 'invalid_transition' WHEN unknown THEN 'left_censored_unknown_bootstrap' WHEN NOT has_tick THEN 'coverage_censored_no_valid_tick' WHEN NOT has_terminal THEN 'right_censored_no_terminal' ELSE 'valid' END AS status FROM sc),
g AS (SELECT fold, bootstrap, clock, count(*) AS windows, {', '.join(f"count(*) FILTER (status = '{x}') AS {x}" for x in C.CENSORS)}, count(*) FILTER (status = 'valid' AND side = 'ONE_BUY') AS "ONE_BUY", count(*) FILTER (status = 'valid' AND side = 'ONE_SELL') AS "ONE_SELL", count(DISTINCT CASE WHEN status = 'valid' THEN unit END) AS units FROM st GROUP BY ALL)
SELECT *, CASE WHEN units >= {LEAST_UNITS} AND "ONE_BUY" >= {LEAST_SIDE} AND "ONE_SELL" >= {LEAST_SIDE} THEN 'sufficient' ELSE 'insufficient_population' END AS support FROM g""",
)
def population_support(spark, d):
    """Windows of one leg, some of them longer than the book says, by fold, way to begin and clock."""
    i = L.intervals(L.lifecycle(positions(spark, d, share=2))).filter(F.col("state").isin("ONE_BUY", "ONE_SELL", "MULTI_POSITION"))
    report = F.floor(F.col("start_us") / REPORT) + (F.col("interval_id") % 50 == 0).cast("int")
    w = i.select(
        "acct", "interval_id", F.col("state").alias("side"), "start_us", (F.col("end_us") + F.when(F.col("interval_id") % 30 == 1, 2 * DAY).otherwise(0)).alias("end_us"), (report * REPORT).alias("report_start"), ((report + 1) * REPORT).alias("report_end"),
        F.floor(report / FOLD).alias("fold"), F.concat_ws("|", "acct", F.floor(F.col("start_us") / DAY)).alias("unit"), F.coalesce(F.col("following").startswith("REHEDGE"), F.lit(False)).alias("has_terminal"),
    )
    w = asof_backward(w, quotes(spark, d).filter("seq % 40 = 0"), [], "end_us", "us", ["seq"], {"tick_us": "us"})
    w = w.withColumn("has_tick", F.coalesce(F.col("tick_us") >= F.col("start_us"), F.lit(False))).drop("tick_us")
    flags = I.overlap_flags(w, ["acct", "fold"], "start_us", "end_us", "interval_id")
    w = w.join(flags, ["acct", "fold", "interval_id"], "left").withColumn("is_rejected", F.coalesce("is_overlap", F.lit(False)))
    return C.population_support(w, BOOTSTRAPS, CLOCKS, "fold", LEAST_UNITS, LEAST_SIDE)
