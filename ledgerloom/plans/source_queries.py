"""Sources: quotes and trade reports are written as files to the shared folder, and read by the readers."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import DAY, SECOND, from_us
from ..sources import reports as R
from ..sources import ticks as T
from ..sources.shared import new_path, written
from .views import positions, positions_sql, quotes

Q, SQL = {}, {}
MILLI = 1000


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def price(c):
    return F.col(c).cast("decimal(16,8)").cast("string")


def export_path(spark, d) -> str:
    """A tab-separated file for each symbol, in order of time, a side left out where seq says that it didn't change."""
    q = quotes(spark, d).filter("bid > 0").withColumns({"first": F.row_number().over(W.partitionBy("symbol").orderBy("us", "seq")) == 1, "t": from_us(F.floor(F.col("us") / MILLI) * MILLI)})
    side = lambda c, k: F.when(F.col("first") | (F.col("seq") % k != 0), price(c)).otherwise(F.lit(""))
    rows = q.select(
        "symbol", "us", "seq", F.date_format("t", "yyyy.MM.dd").alias("<DATE>"), F.date_format("t", "HH:mm:ss.SSS").alias("<TIME>"), side("bid", 4).alias("<BID>"), side("ask", 3).alias("<ASK>"),
        F.lit("").alias("<LAST>"), F.lit("").alias("<VOLUME>"), F.col("seq").alias("<FLAGS>"),
    )
    path = new_path(spark, "export")
    rows.repartition("symbol").sortWithinPartitions("symbol", "us", "seq").drop("us", "seq").write.partitionBy("symbol").option("sep", "\t").option("header", True).option("emptyValue", "").csv(path)
    return path


EXPORT_SQL = f"""WITH e AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS us, CAST(value AS DECIMAL(16,8)) AS bid, CAST(value + 0.2 AS DECIMAL(16,8)) AS ask FROM events WHERE value > 0),
h AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR seq % 4 <> 0 THEN bid END AS b, CASE WHEN row_number() OVER o = 1 OR seq % 3 <> 0 THEN ask END AS a FROM e WINDOW o AS (PARTITION BY symbol ORDER BY us, seq)),
f AS (SELECT symbol, seq, us // {MILLI} * {MILLI} AS us, CAST(last_value(b IGNORE NULLS) OVER o AS DOUBLE) AS bid, CAST(last_value(a IGNORE NULLS) OVER o AS DOUBLE) AS ask, b IS NULL AS bid_missing, a IS NULL AS ask_missing
  FROM h WINDOW o AS (PARTITION BY symbol ORDER BY us, seq ROWS UNBOUNDED PRECEDING))"""


@query("export_read", f"{EXPORT_SQL} SELECT seq, us, round(bid, 6) AS bid, round(ask, 6) AS ask, round((bid + ask) / 2, 6) AS mid, bid_missing, ask_missing FROM f WHERE ask >= bid")
def export_read(spark, d):
    """Prices with holes are filled by side; a filled ask may fall below the bid, which is what ``crossed`` keeps apart."""
    read = T.read_export(spark, export_path(spark, d), crossed="drop")
    return read.select(F.col("flags").alias("seq"), "us", *[F.round(c, 6).alias(c) for c in ("bid", "ask", "mid")], "bid_missing", "ask_missing")


def archive_path(spark, d) -> str:
    """A comma-separated file for each symbol, with every kind of bad row."""
    q = quotes(spark, d).withColumn("t", from_us(F.floor(F.col("us") / (600 * SECOND)) * 600 * SECOND))
    bid = F.when(F.col("seq") % 19 == 0, "1.000000000").when(F.col("seq") % 17 == 0, "0").otherwise(F.abs("bid").cast("decimal(16,8)").cast("string"))
    ask = F.when(F.col("seq") % 13 == 0, "0.00000001").otherwise((F.abs("bid") + 0.2).cast("decimal(16,8)").cast("string"))
    stamp = F.when(F.col("seq") % 29 == 0, "soon").otherwise(F.date_format("t", "yyyy-MM-dd HH:mm:ss"))
    path = new_path(spark, "archive")
    rows = q.select("symbol", "us", "seq", stamp.alias("time_utc"), bid.alias("bid"), ask.alias("ask"))
    rows.repartition("symbol").sortWithinPartitions("symbol", "us", "seq").drop("us", "seq").write.partitionBy("symbol").option("header", True).csv(path)
    return path


ARCHIVE_SQL = f"""WITH q AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS t, CASE WHEN event_id % 29 = 0 THEN NULL ELSE epoch_us(ts) // {600 * SECOND} * {600 * SECOND} END AS us,
  CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 17 = 0 THEN 0 ELSE CAST(abs(value) AS DECIMAL(16,8)) END AS bid, CASE WHEN event_id % 13 = 0 THEN 0.00000001 ELSE CAST(abs(value) + 0.2 AS DECIMAL(16,8)) END AS ask FROM events),
r AS (SELECT *, lag(us) OVER (PARTITION BY symbol ORDER BY t, seq) AS before, CASE WHEN us IS NULL THEN 'invalid_timestamp' WHEN bid IS NULL OR ask IS NULL THEN 'invalid_price' WHEN bid <= 0 OR ask <= 0 THEN 'not_positive' WHEN ask < bid THEN 'crossed' END AS invalid_reason FROM q)"""


@query("archive_read", f"{ARCHIVE_SQL} SELECT us, CAST(bid AS DOUBLE) AS bid, CAST(ask AS DOUBLE) AS ask, invalid_reason, coalesce(us = before, false) AS duplicate, coalesce(us < before, false) AS out_of_order FROM r")
def archive_read(spark, d):
    read = T.read_archive(spark, archive_path(spark, d))
    return read.select("us", F.col("bid").cast("double"), F.col("ask").cast("double"), "invalid_reason", "duplicate", "out_of_order")


@query(
    "archive_audit",
    f"{ARCHIVE_SQL} SELECT count(*) AS n, min(us) AS first_us, max(us) AS last_us, count(*) FILTER (us = before) AS repeated, count(*) FILTER (bid = 0 OR ask = 0) AS zero, count(*) FILTER (ask < bid) AS crossed FROM r GROUP BY symbol",
)
def archive_audit(spark, d):
    return T.audit(T.read_archive(spark, archive_path(spark, d))).drop("file")


@query(
    "both_dialects",
    f"""{ARCHIVE_SQL}, a AS (SELECT us FROM r WHERE invalid_reason IS NULL), {EXPORT_SQL[5:]}, x AS (SELECT us FROM f WHERE ask >= bid)
SELECT 'archive' AS dialect, us // {DAY} AS day, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'export', us // {DAY}, count(*) FROM x GROUP BY ALL""",
)
def both_dialects(spark, d):
    b = T.read_both(spark, export_path(spark, d), archive_path(spark, d), crossed="drop")
    return b.groupBy("dialect", F.floor(F.col("us") / DAY).alias("day")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "weekly_slice",
    f"""WITH b AS (SELECT (min(epoch_us(ts)) // {DAY} + 20) * {DAY} AS lo FROM events) SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS us, date_trunc('week', ts)::DATE::VARCHAR AS week FROM events, b WHERE epoch_us(ts) >= lo AND epoch_us(ts) <= lo + {10 * DAY}""",
)
def weekly_slice(spark, d):
    """Ten days of quotes from folders by week; only the weeks that the slice touches are read."""
    q = quotes(spark, d)
    path = new_path(spark, "weeks")
    T.write_by_week(q, path)
    low = (q.agg(F.min("us")).first()[0] // DAY + 20) * DAY
    return T.read_weeks(spark, path, low, low + 10 * DAY).select("symbol", "seq", "us", F.col("week").cast("string").alias("week"))


#: Books of one report.
BOOKS = 8


def reports_path(spark, d) -> str:
    """A report for eight books and a month of opening, as a page of table rows; the last two positions of a book are still open. Every seventh report's total is 5.00 too high."""
    p = positions(spark, d)
    at = lambda c: F.coalesce(F.date_format(from_us(F.floor(F.col(c) / SECOND) * SECOND), "yyyy.MM.dd HH:mm:ss"), F.lit(""))
    cell = lambda *x: F.concat(F.lit("<tr>"), *[F.concat(F.lit("<td>"), y, F.lit("</td>")) for y in x], F.lit("</tr>"))
    money = lambda c: F.coalesce(F.col(c).cast("decimal(12,2)").cast("string"), F.lit(""))
    name = F.col("position_id").cast("string")
    blank, zero, symbol = F.lit(""), F.lit("0.00"), F.lit("GOLD")
    profit = F.coalesce((F.col("close_price") - F.col("open_price")).cast("decimal(12,2)"), F.lit(0).cast("decimal(12,2)"))
    volume = F.col("volume").cast("decimal(8,1)").cast("string")
    closed = cell(at("open_us"), name, symbol, F.col("side"), volume, money("open_price"), blank, blank, at("close_us"), money("close_price"), zero, zero, profit.cast("string"))
    held = cell(at("open_us"), name, symbol, F.col("side"), volume, money("open_price"), blank, blank, zero, zero, zero, blank)
    order = cell(at("open_us"), name, symbol, F.col("side"), F.concat(volume, F.lit(" / "), volume), F.lit("market"), blank, blank, at("open_us"), F.lit("filled"), blank)
    deal = cell(at("open_us"), name, symbol, F.col("side"), F.lit("in"), volume, money("open_price"), name, blank, zero, zero, zero, zero, F.lit("1 000.00"), blank)
    is_open = F.col("close_us").isNull()
    month = F.date_format(from_us(F.col("open_us")), "yyyyMM").alias("month")
    rows = p.select(F.floor(F.col("acct") / BOOKS).alias("books"), month, "position_id", F.when(~is_open, closed).alias("c"), F.when(is_open, held).alias("h"), order.alias("o"), deal.alias("d"), F.when(~is_open, profit).alias("profit"))
    ordered = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("position_id", c)))), lambda x: x[c]), "")
    title = lambda t: F.lit(f"<tr><th colspan='14'>{t}</th></tr>")
    pages = rows.groupBy("books", "month").agg(
        F.concat(
            F.lit("<html><body><table><tr><td>Date:</td><td>2026.07.24 00:00:00</td></tr>"), title("Positions"), ordered("c"), title("Orders"), ordered("o"), title("Deals"), ordered("d"), title("Open Positions"), ordered("h"),
            F.lit("<tr><td>Total Net Profit:</td><td>"), (F.coalesce(F.sum("profit"), F.lit("0.00").cast("decimal(12,2)")) + F.when(F.col("books") % 7 == 1, F.lit("5.00")).otherwise(F.lit("0.00")).cast("decimal(12,2)")).cast("string"), F.lit("</td></tr></table></body></html>"),
        ).alias("page")
    )
    path = new_path(spark, "reports")
    pages.repartition("books", "month").write.partitionBy("books", "month").text(path)
    return path


def report_rows(spark, d):
    rows = R.read_rows(spark, reports_path(spark, d), F.concat(F.regexp_extract("path", r"books=(\d+)/", 1), F.lit("-"), F.regexp_extract("path", r"month=(\d+)/", 1)))
    return R.check_sections(written(rows, "report-rows"))


REPORTED_SQL = f"""WITH {positions_sql()}, r AS (SELECT (acct // {BOOKS}) || '-' || strftime(make_timestamp(open_us), '%Y%m') AS report_id, acct // {BOOKS} AS books, CAST(position_id AS VARCHAR) AS position_id, side, CAST(volume AS DOUBLE) AS volume, CAST(volume AS VARCHAR) AS volume_exact, open_us // {SECOND} * {SECOND} AS open_us, close_us // {SECOND} * {SECOND} AS close_us,
  CAST(CAST(open_price AS DECIMAL(12,2)) AS DOUBLE) AS open_price, CAST(CAST(close_price AS DECIMAL(12,2)) AS DOUBLE) AS close_price, CAST(CAST(close_price - open_price AS DECIMAL(12,2)) AS DOUBLE) AS profit FROM positions)"""


@query("report_positions", f"{REPORTED_SQL} SELECT * EXCLUDE (books) FROM r WHERE close_us IS NOT NULL")
def report_positions(spark, d):
    from ..operators.order import to_us

    p = R.positions(report_rows(spark, d))
    return p.select("report_id", "position_id", "side", "volume", F.col("volume_exact").cast("string").alias("volume_exact"), to_us("open_time").alias("open_us"), to_us("close_time").alias("close_us"), "open_price", "close_price", "profit")


@query("report_tables", f"{REPORTED_SQL} SELECT report_id, count(*) FILTER (close_us IS NOT NULL) AS positions, count(*) FILTER (close_us IS NULL) AS open_positions, count(*) AS orders, count(*) AS deals, round(sum(volume), 6) AS filled FROM r GROUP BY report_id")
def report_tables(spark, d):
    rows = report_rows(spark, d)
    n = [t.groupBy("report_id").agg(F.count(F.lit(1)).alias(c)) for c, t in (("positions", R.positions(rows)), ("open_positions", R.open_positions(rows)), ("deals", R.deals(rows)))]
    out = R.orders(rows).groupBy("report_id").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("volume_filled"), 6).alias("filled"))
    for t in n:
        out = out.join(t, "report_id")
    return out.select("report_id", "positions", "open_positions", "orders", "deals", "filled")


@query("report_reconciliation", f"{REPORTED_SQL}, n AS (SELECT report_id, any_value(books) AS books, round(sum(profit), 6) AS profit, round(coalesce(sum(profit), 0) + CASE WHEN any_value(books) % 7 = 1 THEN 5 ELSE 0 END, 6) AS net_profit FROM r WHERE close_us IS NOT NULL GROUP BY report_id) SELECT report_id, profit, net_profit, CASE WHEN books % 7 = 1 THEN 'FAIL' ELSE 'PASS' END AS status FROM n")
def report_reconciliation(spark, d):
    rows = report_rows(spark, d)
    return R.reconciled(R.positions(rows), R.totals(rows)).filter("profit IS NOT NULL").select("report_id", F.round("profit", 6).alias("profit"), F.round("net_profit", 6).alias("net_profit"), "status")


@query(
    "inventory_conservation",
    f"""WITH {positions_sql()}, b AS (SELECT min(open_us) + {30 * DAY} AS lo, max(open_us) - {30 * DAY} AS hi FROM positions),
g AS (SELECT acct, count(*) FILTER (open_us <= lo AND close_us > lo) AS at_start, count(*) FILTER (open_us > lo AND open_us <= hi AND close_us IS NOT NULL) AS opens, count(*) FILTER (close_us > lo AND close_us <= hi) AS closes,
  count(*) FILTER (open_us <= hi AND close_us > hi) AS at_end FROM positions, b GROUP BY acct)
SELECT *, at_start + opens - closes AS result, CASE WHEN at_start + opens - closes = at_end THEN 'PASS' ELSE 'FAIL' END AS status FROM g""",
)
def inventory_conservation(spark, d):
    from ..operators.lifecycle import conservation

    p = positions(spark, d)
    low, high = p.agg(F.min("open_us") + 30 * DAY, F.max("open_us") - 30 * DAY).first()
    return conservation(p, ["acct"], low, high)
