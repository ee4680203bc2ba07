"""Accounts: alignment errors, days, funnels of events, gates that must count zero, labels, strata and a privacy scan."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import accounts as A
from ..operators import lifecycle as L
from ..operators.order import DAY, HOUR
from ..sources.shared import written
from .interval_queries import TARGET_SQL, WHOLE_BINS_SQL, WIDTH, bins_of, bounds_of, gaps_of, tailed
from .tick_queries import ALIGN_SQL, matched
from .views import positions, positions_sql, table, timeline_sql

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


@query(
    "alignment_metrics",
    f"""WITH {ALIGN_SQL}, e AS (SELECT ev.type, m.quality, abs(m.tick_us - m.us) AS off, m.error FROM matched m JOIN ev USING (event_id) WHERE m.tick_us IS NOT NULL)
SELECT type, quality, count(*) AS n, """
    + ", ".join(f"round(quantile_cont({c}, {q}), 6) AS {c}_{name}" for c in ("off", "error") for name, q in (("median", 0.5), ("p90", 0.9), ("p95", 0.95)))
    + ", max(off) AS off_max, round(max(error), 6) AS error_max FROM e GROUP BY ALL",
)
def alignment_metrics(spark, d):
    m = matched(spark, d).filter("tick_us IS NOT NULL").withColumn("off", F.abs(F.col("tick_us") - F.col("us")))
    return A.error_metrics(m, ["type", "quality"], ["off", "error"]).withColumns({"error_max": F.round("error_max", 6), "off_max": F.col("off_max")})


@query(
    "daily_events",
    f"""WITH {positions_sql(2, 0)}, {timeline_sql()} SELECT us // {DAY} AS day, count(*) AS events, count(*) FILTER (category = 'ambiguous_ordering') AS ambiguous, count(*) FILTER (after = 'HEDGED_1X1') AS hedged, count(DISTINCT acct) AS books FROM events_m2 GROUP BY ALL""",
)
def daily_events(spark, d):
    e = L.lifecycle(positions(spark, d, apart=0))
    return e.groupBy(F.floor(F.col("us") / DAY).alias("day")).agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("category") == "ambiguous_ordering").alias("ambiguous"), F.count_if(F.col("after") == "HEDGED_1X1").alias("hedged"), F.count_distinct("acct").alias("books")
    )


@query(
    "event_funnel",
    f"""WITH {WHOLE_BINS_SQL}, s AS (SELECT state, count(*) AS source FROM tailed WHERE following IS NOT NULL AND {TARGET_SQL} GROUP BY 1),
b AS (SELECT state, count(*) AS representable, count(*) FILTER (bin_start % {DAY} >= {12 * HOUR}) AS common, count(*) FILTER (bin_start % {DAY} >= {12 * HOUR} AND NOT is_left_truncated) AS complete FROM bins WHERE target = 1 GROUP BY 1)
SELECT s.state, source, coalesce(representable, 0) AS representable, coalesce(common, 0) AS common, coalesce(complete, 0) AS complete FROM s LEFT JOIN b USING (state)""",
)
def event_funnel(spark, d):
    """Events of an endpoint, those that end in a whole bin, those in common hours, those of intervals that began inside."""
    from ..operators.intervals import is_target

    source = tailed(spark, d, WIDTH)[0].filter(F.col("following").isNotNull() & is_target(F.col("state"), F.col("following"))).groupBy("state").agg(F.count(F.lit(1)).alias("source"))
    common = F.pmod("bin_start", F.lit(DAY)) >= 12 * HOUR
    hits = bins_of(spark, d, WIDTH).filter("target = 1").groupBy("state").agg(F.count(F.lit(1)).alias("representable"), F.count_if(common).alias("common"), F.count_if(common & ~F.col("is_left_truncated")).alias("complete"))
    return A.funnel(source.join(hits, "state", "left"), ["source", "representable", "common", "complete"])


@query(
    "bin_gates",
    f"""WITH {WHOLE_BINS_SQL} SELECT count(*) AS bins, count(*) FILTER (EXISTS (SELECT 1 FROM gaps WHERE gap_start < bin_end AND gap_end > bin_start)) AS in_gaps, count(*) FILTER (target = 1 AND bin_end <> interval_end) AS early_targets,
  count(*) FILTER (target = 1 AND competing = 1) AS both, count(*) FILTER (bin_start < lo OR bin_end > hi) AS outside FROM bins, bounds""",
)
def bin_gates(spark, d):
    """What no bin may be: in a gap, a target before its interval's end, of two outcomes, outside the bounds."""
    low, high = bounds_of(positions(spark, d, unit=WIDTH))
    gaps = written(gaps_of(spark, d), "gaps")
    return A.bin_gates(bins_of(spark, d, WIDTH, gaps), gaps, low, high)


@query(
    "observed_labels",
    f"""WITH {positions_sql()}, b AS (SELECT min(open_us) + {DAY} AS lo, max(open_us) - {DAY} AS hi FROM positions), e AS (SELECT 'OPEN' AS label, side, open_us AS us FROM positions WHERE position_id % 17 <> 0 UNION ALL SELECT 'CLOSE', side, close_us FROM positions WHERE position_id % 17 <> 0 AND close_us IS NOT NULL)
SELECT label, side, us // {DAY} AS day, count(*) AS n FROM e, b WHERE us >= lo AND us < hi GROUP BY ALL""",
)
def observed_labels(spark, d):
    """Positions that aren't in doubt (every 17th is) as labels of a half-open population."""
    p = positions(spark, d)
    low, high = p.agg(F.min("open_us") + DAY, F.max("open_us") - DAY).first()
    labels = A.observed_labels(p.withColumn("status", F.when(F.col("position_id") % 17 == 0, "CENSORED").otherwise("OBSERVED")), low, high)
    return labels.groupBy("label", "side", F.floor(F.col("us") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "date_roles",
    """SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-01-01' THEN 'development' WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'validation' ELSE 'holdout' END AS role,
  year(o_orderdate) || '-' || CASE WHEN month(o_orderdate) <= 4 THEN '01_to_04' WHEN month(o_orderdate) <= 8 THEN '05_to_08' ELSE '09_to_12' END AS stratum, count(*) AS n, count(DISTINCT o_custkey) AS books,
  count(*) - count(DISTINCT (o_custkey, o_orderdate)) AS repeated FROM orders GROUP BY ALL""",
)
def date_roles(spark, d):
    o = table(spark, d, "orders")
    role = A.by_bounds(F.col("o_orderdate"), [("1995-01-01", "development"), ("1997-01-01", "validation")], "holdout")
    return o.groupBy(role.alias("role"), A.month_stratum(F.col("o_orderdate")).alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("books"), (F.count(F.lit(1)) - F.count_distinct("o_custkey", "o_orderdate")).alias("repeated")
    )


@query(
    "privacy_scan",
    r"""SELECT role, count(*) AS n, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+')) AS addresses, count(*) FILTER (regexp_matches(text, '(?:^|[^0-9])[0-9]{9,}(?:$|[^0-9])')) AS numbers,
  count(*) FILTER (regexp_matches(text, '(?:/home/|/Users/|[A-Z]:\\)[A-Za-z0-9]+')) AS paths FROM conversations GROUP BY role""",
)
def privacy_scan(spark, d):
    return A.privacy_scan(table(spark, d, "conversations"), ["role"], "text")
