"""Quotes, positions, states, intervals and concurrency."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import lifecycle as L
from ..operators.order import DAY, SECOND, to_us, with_previous
from ..schema import OBSERVED_STATES, STATES
from .views import QUOTES_SQL, positions, positions_sql, quotes, table, timeline_sql

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query("tick_quotes", f"WITH {QUOTES_SQL} SELECT symbol, seq, us, round(bid, 6) AS bid, round(ask, 6) AS ask, round(mid, 6) AS mid FROM quotes WHERE bid > 0 AND ask >= bid")
def tick_quotes(spark, d):
    return quotes(spark, d).filter("bid > 0 AND ask >= bid").select("symbol", "seq", "us", *[F.round(c, 6).alias(c) for c in ("bid", "ask", "mid")])


@query(
    "tick_validity_counts",
    "SELECT event_type AS symbol, count(*) AS n, count(*) FILTER (value > 0) AS valid, count(*) FILTER (value <= 0 OR value IS NULL) AS invalid FROM events GROUP BY event_type",
)
def tick_validity_counts(spark, d):
    ok = (F.col("bid") > 0) & (F.col("ask") > 0) & (F.col("ask") >= F.col("bid"))
    return quotes(spark, d).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("valid"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("invalid"))


@query(
    "tick_ffill",
    f"""WITH {QUOTES_SQL}, holes AS (SELECT symbol, seq, us, CASE WHEN seq % 4 <> 0 THEN bid END AS bid, CASE WHEN seq % 3 <> 0 THEN ask END AS ask FROM quotes)
SELECT symbol, seq, last_value(bid IGNORE NULLS) OVER w AS bid, last_value(ask IGNORE NULLS) OVER w AS ask, bid IS NULL AS bid_missing, ask IS NULL AS ask_missing
FROM holes WINDOW w AS (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING)""",
)
def tick_ffill(spark, d):
    """Sides updated separately: holes are filled forward, by bucket with the last value of earlier buckets."""
    from ..sources.ticks import fill_forward

    holes = quotes(spark, d).select("symbol", "seq", "us", F.when(F.col("seq") % 4 != 0, F.col("bid")).alias("bid"), F.when(F.col("seq") % 3 != 0, F.col("ask")).alias("ask"))
    holes = holes.withColumns({"bid_missing": F.col("bid").isNull(), "ask_missing": F.col("ask").isNull()})
    return fill_forward(holes, ["symbol"], "us", ["seq"], ["bid", "ask"]).select("symbol", "seq", "bid", "ask", "bid_missing", "ask_missing")


@query(
    "tick_dup_order_counters",
    """WITH o AS (SELECT o_custkey AS k, o_orderkey AS seq, epoch_us(o_orderdate) AS us, lag(epoch_us(o_orderdate)) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS before FROM orders)
SELECT count(*) AS n, count(*) FILTER (us = before) AS duplicate, count(*) FILTER (us < before) AS out_of_order, min(us) AS first_us, max(us) AS last_us FROM o""",
)
def tick_dup_order_counters(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("seq"), to_us("o_orderdate").alias("us"))
    o = with_previous(o, ["k"], "seq", [], {"before": "us"}, bucket=1_000_000)
    return o.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("us") == F.col("before")).alias("duplicate"), F.count_if(F.col("us") < F.col("before")).alias("out_of_order"), F.min("us").alias("first_us"), F.max("us").alias("last_us")
    )


@query(
    "minute_bars",
    f"""WITH {QUOTES_SQL} SELECT symbol, us // 60000000 AS minute, arg_min(mid, (us, seq)) AS open, max(mid) AS high, min(mid) AS low, arg_max(mid, (us, seq)) AS close, count(*) AS n
FROM quotes GROUP BY ALL""",
)
def minute_bars(spark, d):
    order = F.struct("us", "seq")
    return (
        quotes(spark, d)
        .groupBy("symbol", F.floor(F.col("us") / 60_000_000).alias("minute"))
        .agg(F.min_by("mid", order).alias("open"), F.max("mid").alias("high"), F.min("mid").alias("low"), F.max_by("mid", order).alias("close"), F.count(F.lit(1)).alias("n"))
    )


@query(
    "position_dedupe",
    """SELECT l_orderkey AS k, l_linenumber AS line, count(*) AS n,
  CASE WHEN count(DISTINCT (l_partkey, l_quantity, l_shipdate)) > 1 THEN 'CENSORED' ELSE 'OBSERVED' END AS status, epoch_us(min(l_shipdate)) AS start,
  CASE WHEN count(l_shipdate) = count(*) THEN epoch_us(max(l_shipdate)) END AS "end" FROM lineitem GROUP BY ALL""",
)
def position_dedupe(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("line"), "l_partkey", "l_quantity", to_us("l_shipdate").alias("us"))
    rows = rows.withColumn("us2", F.col("us"))
    return L.dedupe_conservative(rows, ["k", "line"], ["l_partkey", "l_quantity"], "us", "us2")


@query(
    "position_conflicts",
    """WITH g AS (SELECT l_orderkey, l_linenumber, count(DISTINCT (l_partkey, l_quantity)) AS v, min(l_quantity) AS q, min(l_returnflag) AS f FROM lineitem GROUP BY ALL)
SELECT f AS flag, v = 1 AS agreed, count(*) AS n, CAST(sum(CASE WHEN v = 1 THEN q ELSE 0 END) AS BIGINT) AS quantity FROM g GROUP BY ALL""",
)
def position_conflicts(spark, d):
    """Ids whose rows disagree are dropped, and counted."""
    g = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.countDistinct(F.struct("l_partkey", "l_quantity")).alias("v"), F.min("l_quantity").alias("q"), F.min("l_returnflag").alias("flag")
    )
    return g.groupBy("flag", (F.col("v") == 1).alias("agreed")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("v") == 1, F.col("q")).otherwise(0)).cast("bigint").alias("quantity"))


@query(
    "state_events",
    f"WITH {positions_sql()}, {timeline_sql()} SELECT acct, seq, position_id, us, type, side, buys, sells, CAST(buy_volume AS DECIMAL(22,8)) AS buy_volume, CAST(sell_volume AS DECIMAL(22,8)) AS sell_volume, before, after, behavior, category FROM events_m2",
)
def state_events(spark, d):
    e = L.lifecycle(positions(spark, d))
    return e.select("acct", "seq", "position_id", "us", "type", "side", "buys", "sells", F.col("buy_volume").cast("decimal(22,8)"), F.col("sell_volume").cast("decimal(22,8)"), "before", "after", "behavior", "category")


@query(
    "state_transitions",
    f"""WITH {positions_sql()}, {timeline_sql()}, s AS (SELECT unnest({list(STATES)}) AS s)
SELECT a.s AS before, b.s AS after, count(e.acct) AS n FROM s a CROSS JOIN s b LEFT JOIN events_m2 e ON e.before = a.s AND e.after = b.s GROUP BY ALL""",
)
def state_transitions(spark, d):
    return L.transitions(L.lifecycle(positions(spark, d)), STATES)


@query("state_transitions_three_legs", f"""WITH {positions_sql(3)}, {timeline_sql()} SELECT before, after, category, count(*) AS n FROM events_m2 GROUP BY ALL""")
def state_transitions_three_legs(spark, d):
    return L.lifecycle(positions(spark, d, legs=3)).groupBy("before", "after", "category").agg(F.count(F.lit(1)).alias("n"))


@query("behavior_counts", f"WITH {positions_sql()}, {timeline_sql()} SELECT behavior, category, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM events_m2 GROUP BY ALL")
def behavior_counts(spark, d):
    return L.lifecycle(positions(spark, d)).groupBy("behavior", "category").agg(F.count(F.lit(1)).alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


@query("ambiguity", f"WITH {positions_sql(2, 0)}, {timeline_sql()} SELECT category, same, count(*) AS n FROM events_m2 GROUP BY ALL")
def ambiguity(spark, d):
    """Positions that close when another opens: events of one time are ambiguous, whatever else they are."""
    return L.lifecycle(positions(spark, d, apart=0)).groupBy("category", "same").agg(F.count(F.lit(1)).alias("n"))


@query("order_collisions", "SELECT n, count(*) AS groups FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, o_orderdate) GROUP BY n")
def order_collisions(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey", "o_orderdate").agg(F.count(F.lit(1)).alias("n")).groupBy("n").agg(F.count(F.lit(1)).alias("groups"))


@query("state_intervals", f"WITH {positions_sql()}, {timeline_sql()} SELECT acct, interval_id, start_us, end_us, state, behavior, following FROM intervals")
def state_intervals(spark, d):
    return L.intervals(L.lifecycle(positions(spark, d))).select("acct", "interval_id", "start_us", "end_us", "state", "behavior", "following")


@query(
    "duration_by_state",
    f"WITH {positions_sql()}, {timeline_sql()} SELECT state, count(*) AS n, CAST(sum(end_us - start_us) AS BIGINT) AS us, min(end_us - start_us) AS shortest, max(end_us - start_us) AS longest FROM intervals GROUP BY state",
)
def duration_by_state(spark, d):
    i = L.intervals(L.lifecycle(positions(spark, d))).withColumn("len", F.col("end_us") - F.col("start_us"))
    return i.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("us"), F.min("len").alias("shortest"), F.max("len").alias("longest"))


OBSERVED_SQL = f"""{positions_sql()}, p AS (SELECT *, CASE WHEN position_id % 17 = 0 THEN 'CENSORED' ELSE 'OBSERVED' END AS status FROM positions),
b AS (SELECT min(open_us) + 86400000000 AS lo, max(open_us) - 86400000000 AS hi FROM positions),
t AS (SELECT acct, position_id, side, volume, open_us AS us, CASE status WHEN 'CENSORED' THEN 2 ELSE 3 END AS rank, 1 AS d FROM p
  UNION ALL SELECT acct, position_id, side, volume, close_us, CASE status WHEN 'CENSORED' THEN 0 ELSE 1 END, -1 FROM p WHERE close_us IS NOT NULL),
r AS (SELECT *, sum(CASE WHEN rank IN (1, 3) AND side = 'buy' THEN d ELSE 0 END) OVER o AS buys, sum(CASE WHEN rank IN (1, 3) AND side = 'sell' THEN d ELSE 0 END) OVER o AS sells,
  sum(CASE WHEN rank IN (1, 3) AND side = 'buy' THEN d * volume ELSE 0 END) OVER o AS bv, sum(CASE WHEN rank IN (1, 3) AND side = 'sell' THEN d * volume ELSE 0 END) OVER o AS sv,
  sum(CASE WHEN rank IN (0, 2) THEN d ELSE 0 END) OVER o AS censored
  FROM t WHERE us < (SELECT hi FROM b) WINDOW o AS (PARTITION BY acct ORDER BY us, rank, position_id ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, CASE WHEN censored > 0 THEN 'CENSORED' WHEN buys + sells = 0 THEN 'FLAT' WHEN buys + sells = 1 AND buys = 1 THEN 'ONE_BUY' WHEN buys + sells = 1 THEN 'ONE_SELL'
  WHEN buys = 1 AND sells = 1 AND bv = sv THEN 'HEDGED_1X1' WHEN buys = 1 AND sells = 1 THEN 'UNBALANCED_HEDGE' ELSE 'MULTI_POSITION' END AS after FROM r),
e AS (SELECT *, coalesce(lag(after) OVER (PARTITION BY acct ORDER BY us, rank, position_id), 'FLAT') AS before FROM s)"""


@query(
    "observed_replay_transitions",
    f"""WITH {OBSERVED_SQL}, u AS (SELECT unnest({list(OBSERVED_STATES)}) AS s), x AS (SELECT before, after FROM e WHERE us >= (SELECT lo FROM b))
SELECT a.s AS before, c.s AS after, count(x.before) AS n FROM u a CROSS JOIN u c LEFT JOIN x ON x.before = a.s AND x.after = c.s GROUP BY ALL""",
)
def observed_replay_transitions(spark, d):
    p = positions(spark, d).withColumn("status", F.when(F.col("position_id") % 17 == 0, "CENSORED").otherwise("OBSERVED"))
    lo, hi = p.agg(F.min("open_us") + DAY, F.max("open_us") - DAY).first()
    return L.transitions(L.observed_replay(p, lo, hi), OBSERVED_STATES)


CONCURRENCY_SQL = f"""{positions_sql(3)}, ch AS (SELECT acct, us, sum(b) AS b, sum(s) AS s FROM (
  SELECT acct, open_us AS us, CASE WHEN side = 'buy' THEN 1 ELSE 0 END AS b, CASE WHEN side = 'sell' THEN 1 ELSE 0 END AS s FROM positions WHERE close_us > open_us
  UNION ALL SELECT acct, close_us, CASE WHEN side = 'buy' THEN -1 ELSE 0 END, CASE WHEN side = 'sell' THEN -1 ELSE 0 END FROM positions WHERE close_us > open_us) GROUP BY ALL),
sp AS (SELECT acct, us AS start_us, lead(us) OVER o AS end_us, CAST(sum(b) OVER o AS BIGINT) AS buys, CAST(sum(s) OVER o AS BIGINT) AS sells FROM ch WINDOW o AS (PARTITION BY acct ORDER BY us)),
spans AS (SELECT *, buys + sells AS legs FROM sp WHERE end_us IS NOT NULL)"""


@query("concurrency_segments", f"WITH {CONCURRENCY_SQL} SELECT acct, start_us, end_us, buys, sells, legs FROM spans WHERE legs > 2")
def concurrency_segments(spark, d):
    return L.concurrency(positions(spark, d, legs=3)).filter("legs > 2")


@query("concurrency_max", f"WITH {CONCURRENCY_SQL} SELECT acct, max(legs) AS total, max(buys) AS buys, max(sells) AS sells FROM spans GROUP BY acct")
def concurrency_max(spark, d):
    return L.concurrency(positions(spark, d, legs=3)).groupBy("acct").agg(F.max("legs").alias("total"), F.max("buys").alias("buys"), F.max("sells").alias("sells"))


@query(
    "concurrency_episodes",
    f"""WITH {CONCURRENCY_SQL}, x AS (SELECT *, CASE WHEN lag(end_us) OVER (PARTITION BY acct ORDER BY start_us) = start_us THEN 0 ELSE 1 END AS fresh FROM spans WHERE legs > 2),
y AS (SELECT *, sum(fresh) OVER (PARTITION BY acct ORDER BY start_us) AS episode FROM x)
SELECT acct, CAST(episode AS BIGINT) AS episode, min(start_us) AS start_us, max(end_us) AS end_us, max(legs) AS most FROM y GROUP BY ALL""",
)
def concurrency_episodes(spark, d):
    return L.episodes(L.concurrency(positions(spark, d, legs=3)), F.col("legs") > 2)


@query(
    "concurrency_by_month",
    f"""WITH {CONCURRENCY_SQL}, days AS (SELECT acct, legs, greatest(start_us, k * 86400000000) AS a, least(end_us, (k + 1) * 86400000000) AS b
  FROM (SELECT *, unnest(range(start_us // 86400000000, (end_us - 1) // 86400000000 + 1)) AS k FROM spans WHERE legs > 2))
SELECT strftime(make_timestamp(a), '%Y-%m') AS month, count(*) AS parts, CAST(sum(b - a) AS BIGINT) AS us, count(*) FILTER (isodow(make_timestamp(a)) = 1) AS monday FROM days GROUP BY ALL""",
)
def concurrency_by_month(spark, d):
    """Spans with more than two legs, cut at midnights."""
    from ..operators.intervals import cut_at
    from ..operators.order import from_us

    parts = cut_at(L.concurrency(positions(spark, d, legs=3)).filter("legs > 2"), "start_us", "end_us", DAY)
    day = from_us(F.col("start_us"))
    return parts.groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("parts"), F.sum(F.col("end_us") - F.col("start_us")).alias("us"), F.count_if(F.weekday(day) == 0).alias("monday")
    )


@query("orphan_closes", f"""WITH {positions_sql()}, {timeline_sql()} SELECT acct, position_id, us FROM timeline c WHERE type = 'CLOSE' AND NOT EXISTS
 (SELECT 1 FROM timeline o WHERE o.type = 'OPEN' AND o.acct = c.acct AND o.position_id = c.position_id AND o.us <= c.us AND o.position_id % 11 <> 0)""")
def orphan_closes(spark, d):
    t = L.timeline(positions(spark, d))
    return L.orphan_closes(t.filter("type = 'CLOSE'"), t.filter("type = 'OPEN' AND position_id % 11 <> 0"), ["acct"]).select("acct", "position_id", "us")


# Lines of orders as reports: by line status closed positions or open snapshots; the snapshots of three orders in four agree.
REPORTS_SQL = """lines AS (SELECT l_orderkey AS position_id, CAST(l_suppkey % 3 AS VARCHAR) AS report_id, CASE WHEN l_orderkey % 4 = 0 THEN l_returnflag ELSE 'N' END AS symbol, l_orderkey % 100 AS open_price,
  l_linestatus = 'F' AS closed, CASE WHEN l_linestatus = 'F' THEN epoch_us(l_shipdate) END AS close_us FROM lineitem),
snapshots AS (SELECT position_id, count(DISTINCT (symbol, open_price)) AS versions, array_to_string(list_sort(list_distinct(list(report_id))), ',') AS sources, count(DISTINCT report_id) > 1 AS is_carry_over FROM lines WHERE NOT closed GROUP BY position_id),
good AS (SELECT position_id, report_id AS sources, true AS is_closed, false AS is_carry_over, close_us FROM lines WHERE closed
  UNION ALL SELECT position_id, sources, false, is_carry_over, NULL FROM snapshots s WHERE versions = 1 AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.closed AND c.position_id = s.position_id))"""


def merged(spark, d):
    key = F.col("l_orderkey")
    lines = table(spark, d, "lineitem").select(
        key.alias("position_id"), (F.col("l_suppkey") % 3).cast("string").alias("report_id"), F.when(key % 4 == 0, F.col("l_returnflag")).otherwise("N").alias("symbol"), F.lit("buy").alias("side"),
        F.lit(1).alias("volume"), key.alias("open_us"), (key % 100).alias("open_price"), to_us("l_shipdate").alias("close_us"), (key % 100).alias("close_price"), F.col("l_linestatus").alias("status"),
    )
    return L.merge_positions(lines.filter("status = 'F'").drop("status"), lines.filter("status = 'O'").drop("status", "close_us", "close_price"))


@query("merged_positions", f"WITH {REPORTS_SQL} SELECT * FROM good")
def merged_positions(spark, d):
    return merged(spark, d)[0].select("position_id", "sources", "is_closed", "is_carry_over", "close_us")


@query("merged_reports", f"WITH {REPORTS_SQL} SELECT position_id, versions FROM snapshots WHERE versions > 1")
def merged_reports(spark, d):
    """The ids whose open snapshots disagree, and how many versions they have."""
    return merged(spark, d)[1]


@query(
    "duration_rank",
    f"WITH {positions_sql()}, {timeline_sql()} SELECT acct, interval_id, rank() OVER (PARTITION BY acct, state ORDER BY end_us - start_us DESC) AS place FROM intervals",
)
def duration_rank(spark, d):
    i = L.intervals(L.lifecycle(positions(spark, d)))
    w = W.partitionBy("acct", "state").orderBy((F.col("end_us") - F.col("start_us")).desc())
    return i.select("acct", "interval_id", F.rank().over(w).cast("bigint").alias("place"))


__all__ = ["Q", "SQL", "SECOND"]
