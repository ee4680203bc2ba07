"""Streams: quotes are written as files in parts, each part is streamed when it is there, and the sink is read."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.order import DAY, HOUR
from ..sources.shared import new_path
from ..streaming import tick_groups as T
from .views import quotes

Q, SQL = {}, {}
PARTS = 4


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


# Times in whole hours; every 97th row is two days late, one row in 3,001 has no time. Sequences are as in time.
STREAM_SQL = f"""st AS (SELECT event_type AS symbol, row_number() OVER (ORDER BY ts, event_id) AS seq, epoch_us(ts) // {HOUR} * {HOUR} AS t, value AS bid, value + 0.2 AS ask, event_id FROM events),
ticks AS (SELECT symbol, seq, CASE WHEN event_id % 3001 = 900 THEN NULL WHEN event_id % 97 = 0 THEN t - {2 * DAY} ELSE t END AS us, bid, ask FROM st),
lim AS (SELECT (min(t) // {DAY} + 3) * {DAY} AS population FROM st)"""


def stream_ticks(spark, d):
    q = quotes(spark, d)
    t = F.floor(F.col("us") / HOUR).cast("bigint") * HOUR
    us = F.when(F.col("seq") % 3001 == 900, None).when(F.col("seq") % 97 == 0, t - 2 * DAY).otherwise(t)
    return q.select("symbol", F.col("us").alias("at"), F.col("seq").alias("event_id"), us.alias("us"), "bid", "ask"), (q.agg(F.min("us")).first()[0] // DAY + 3) * DAY


@query(
    "streamed_groups",
    f"""WITH {STREAM_SQL}, p AS (SELECT *, min(CASE WHEN us IS NULL THEN seq END) OVER (PARTITION BY symbol) AS poison, max(us) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM ticks),
e AS (SELECT *, CASE WHEN seq > poison THEN 'poisoned' WHEN us IS NULL THEN 'invalid_time' WHEN us < reach THEN 'late' END AS error FROM p),
g AS (SELECT symbol, us, max(seq) AS seq, count(*) AS n, arg_max(bid, seq) AS bid, arg_max(ask, seq) AS ask, max(poison) AS poison FROM e WHERE error IS NULL GROUP BY ALL),
w AS (SELECT *, us - lag(us) OVER o AS since, (bid + ask) / 2 - lag((bid + ask) / 2) OVER o AS move, lead(us) OVER o AS next FROM g WINDOW o AS (PARTITION BY symbol ORDER BY us))
SELECT 'group' AS kind, symbol, us, n, round(bid, 6) AS bid, since, round(move, 6) AS move, us < population AS warm FROM w, lim WHERE next IS NOT NULL OR poison IS NOT NULL
UNION ALL SELECT error, symbol, us, 1, round(bid, 6), NULL, NULL, NULL FROM e WHERE error IS NOT NULL""",
)
def streamed_groups(spark, d):
    """Four parts of the quotes in order of time, each streamed by a query that starts again from the checkpoint."""
    ticks, population = stream_ticks(spark, d)
    low, high = ticks.agg(F.min("at"), F.max("at")).first()
    source, sink, checkpoint = (new_path(spark, f"stream-{x}") for x in ("source", "sink", "checkpoint"))
    # A sequence that grows with time and ends in the event's number, so that no row has to be counted.
    seq = (F.col("at") - low) * 1024 + F.col("event_id") % 1024
    for part in range(PARTS):
        place = F.least(F.floor((F.col("at") - low) * PARTS / (high - low + 1)), F.lit(PARTS - 1))
        ticks.filter(place == part).select("symbol", seq.alias("seq"), "us", "bid", "ask").write.mode("append").parquet(source)
        T.start(spark, source, sink, checkpoint, population).awaitTermination()
    found = spark.read.schema(T.OUTPUT).parquet(sink)
    return found.select("kind", "symbol", "us", "n", F.round("bid", 6).alias("bid"), "since", F.round("move", 6).alias("move"), "warm")
