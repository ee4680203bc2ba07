"""Quotes and positions derived from the events table, for Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import SECOND, to_us


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One quote stream per event type."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("seq"), to_us("ts").alias("us"), F.col("value").alias("bid"), (F.col("value") + 0.2).alias("ask"), (F.col("value") + 0.1).alias("mid")
    )


QUOTES_SQL = "quotes AS (SELECT event_type AS symbol, event_id AS seq, epoch_us(ts) AS us, value AS bid, value + 0.2 AS ask, value + 0.1 AS mid FROM events)"


def positions(spark: SparkSession, sf_dir: str, legs: int = 2, apart: int = SECOND, unit: int = 1, share: int | None = None) -> DataFrame:
    """One book per user: each event opens a position that the event ``legs`` later closes, ``apart`` before it (or a ``share``-th of the time since the event before that one); times in whole units."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("acct"), F.col("event_id").alias("position_id"), to_us("ts").alias("open_us"), F.col("value").alias("open_price"))
    w = W.partitionBy("acct").orderBy("open_us", "position_id")
    before = F.lit(apart) if share is None else F.floor((F.lead("open_us", legs).over(w) - F.lead("open_us", legs - 1).over(w)) / share)
    e = e.withColumns({"close_us": F.lead("open_us", legs).over(w) - before, "close_price": F.lead("open_price", legs).over(w)})
    side = F.when(F.col("position_id") % 2 == 0, "buy").otherwise("sell").alias("side")
    volume = F.when(F.col("position_id") % 5 == 0, F.lit("0.2")).otherwise(F.lit("0.3")).cast("decimal(12,8)").alias("volume")
    whole = lambda c: (F.floor(F.col(c) / unit) * unit).alias(c) if unit > 1 else F.col(c)
    return e.select("acct", "position_id", side, volume, whole("open_us"), "open_price", whole("close_us"), "close_price")


def positions_sql(legs: int = 2, apart: int = SECOND, unit: int = 1, share: int | None = None) -> str:
    before = f"{apart}" if share is None else f"(epoch_us(lead(ts, {legs}) OVER w) - epoch_us(lead(ts, {legs - 1}) OVER w)) // {share}"
    whole = f" // {unit} * {unit}" if unit > 1 else ""
    return f"""positions AS (SELECT user_id AS acct, event_id AS position_id, CASE WHEN event_id % 2 = 0 THEN 'buy' ELSE 'sell' END AS side,
  CAST(CASE WHEN event_id % 5 = 0 THEN 0.2 ELSE 0.3 END AS DECIMAL(12,8)) AS volume, epoch_us(ts){whole} AS open_us, value AS open_price,
  (epoch_us(lead(ts, {legs}) OVER w) - {before}){whole} AS close_us, lead(value, {legs}) OVER w AS close_price
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def timeline_sql() -> str:
    """Events with their states, from positions."""
    return """timeline AS (
  SELECT acct, position_id, side, volume, open_us AS us, open_price AS price, 'OPEN' AS type, open_us, 1 AS d FROM positions
  UNION ALL SELECT acct, position_id, side, volume, close_us, close_price, 'CLOSE', open_us, -1 FROM positions WHERE close_us IS NOT NULL
), running AS (
  SELECT *, row_number() OVER o AS seq,
    CAST(sum(CASE WHEN side = 'buy' THEN d ELSE 0 END) OVER o AS BIGINT) AS buys, CAST(sum(CASE WHEN side = 'sell' THEN d ELSE 0 END) OVER o AS BIGINT) AS sells,
    sum(CASE WHEN side = 'buy' THEN d * volume ELSE 0 END) OVER o AS buy_volume, sum(CASE WHEN side = 'sell' THEN d * volume ELSE 0 END) OVER o AS sell_volume,
    count(*) OVER (PARTITION BY acct, us) AS same
  FROM timeline WINDOW o AS (PARTITION BY acct ORDER BY us, open_us, CAST(position_id AS VARCHAR), type ROWS UNBOUNDED PRECEDING)
), stated AS (
  SELECT *, CASE WHEN buys + sells = 0 THEN 'FLAT' WHEN buys + sells = 1 AND buys = 1 THEN 'ONE_BUY' WHEN buys + sells = 1 THEN 'ONE_SELL'
    WHEN buys + sells > 2 THEN 'MULTI_POSITION' WHEN buys = 1 AND sells = 1 AND buy_volume = sell_volume THEN 'HEDGED_1X1' ELSE 'UNBALANCED_HEDGE' END AS after
  FROM running
), states AS (
  SELECT *, coalesce(lag(after) OVER (PARTITION BY acct ORDER BY seq), 'FLAT') AS before, lead(us) OVER (PARTITION BY acct ORDER BY seq) AS next_us FROM stated
), lifecycle AS (
  SELECT *, CASE
    WHEN type = 'OPEN' AND before = 'FLAT' THEN 'INITIAL_OPEN_' || upper(side)
    WHEN type = 'OPEN' AND before = 'ONE_BUY' AND side = 'sell' AND after = 'HEDGED_1X1' THEN 'REHEDGE_SELL'
    WHEN type = 'OPEN' AND before = 'ONE_SELL' AND side = 'buy' AND after = 'HEDGED_1X1' THEN 'REHEDGE_BUY'
    WHEN type = 'OPEN' THEN 'OPEN_ADDITIONAL_' || upper(side)
    WHEN before = 'HEDGED_1X1' AND side = 'sell' AND after = 'ONE_BUY' THEN 'UNLOCK_TO_BUY'
    WHEN before = 'HEDGED_1X1' AND side = 'buy' AND after = 'ONE_SELL' THEN 'UNLOCK_TO_SELL'
    WHEN after = 'FLAT' THEN 'CLOSE_TO_FLAT' ELSE 'UNCLASSIFIED' END AS behavior
  FROM states
), events_m2 AS (
  SELECT *, CASE WHEN same > 1 THEN 'ambiguous_ordering' WHEN behavior LIKE 'INITIAL_%' OR behavior = 'CLOSE_TO_FLAT' THEN 'boundary'
    WHEN before = 'MULTI_POSITION' OR after = 'MULTI_POSITION' THEN 'multi_position' WHEN before = 'UNBALANCED_HEDGE' OR after = 'UNBALANCED_HEDGE' THEN 'unbalanced_hedge'
    WHEN behavior LIKE 'REHEDGE_%' OR behavior LIKE 'UNLOCK_%' THEN 'classified_standard' ELSE 'unsupported' END AS category
  FROM lifecycle
), intervals AS (
  SELECT acct, seq AS interval_id, us AS start_us, next_us AS end_us, after AS state, type, behavior, lead(behavior) OVER (PARTITION BY acct ORDER BY seq) AS following, same,
    lead(same) OVER (PARTITION BY acct ORDER BY seq) AS following_same
  FROM events_m2 QUALIFY next_us IS NOT NULL
)"""
