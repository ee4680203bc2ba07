"""Ticks as a stream of files: ticks of one time are one group, and what can't be placed goes to an error table.

The state of a key is its last time, the group that is still open at it, and whether it is poisoned; it
doesn't grow with the stream. The batch version says the same with windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

INPUT = "symbol string, seq long, us long, bid double, ask double"
OUTPUT = "kind string, symbol string, us long, seq long, n long, bid double, ask double, since long, move double, warm boolean"
STATE = "last_us long, n long, seq long, bid double, ask double, before_us long, before_mid double, poisoned boolean"
FIELDS = [f.split()[0] for f in OUTPUT.split(", ")]


def grouped(population: int):
    """Advance one key by the rows of a micro-batch, in their sequence.

    A group is given out when a later time follows it, or the key is poisoned: its last quote, how many
    ticks it has, the time and the move of the mid since the group before; warm: it comes before the
    population's start, so it is only what later groups are compared with. Errors, one row each: late (a
    time before the last one), invalid_time (which poisons the key for good) and poisoned (all after).
    """

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, n, at, bid, ask, before, before_mid, poisoned = state.get if state.exists else (None, 0, None, None, None, None, None, False)
        out = []

        def close() -> None:
            nonlocal before, before_mid
            mid = (bid + ask) / 2
            since, move = (None, None) if before is None else (last - before, mid - before_mid)
            out.append(("group", key[0], last, at, n, bid, ask, since, move, last < population))
            before, before_mid = last, mid

        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, us, b, a in zip(rows.seq.tolist(), rows.us.astype("Int64").tolist(), rows.bid.tolist(), rows.ask.tolist()):
            known = not pd.isna(us)
            error = "poisoned" if poisoned else "invalid_time" if not known else "late" if last is not None and us < last else None
            if error:
                if error == "invalid_time":
                    if n:
                        close()
                    n, poisoned = 0, True
                out.append((error, key[0], us if known else None, seq, 1, b, a, None, None, None))
                continue
            if n and us > last:
                close()
                n = 0
            last, n, at, bid, ask = us, n + 1, seq, b, a
        state.update((last, n, at, bid, ask, before, before_mid, poisoned))
        frame = pd.DataFrame(out, columns=FIELDS)
        yield frame.astype({"us": "Int64", "seq": "Int64", "n": "Int64", "since": "Int64", "bid": float, "ask": float, "move": float, "warm": "boolean"})

    return run


def start(spark: SparkSession, source: str, sink: str, checkpoint: str, population: int, files: int | None = None):
    """A query that reads all new Parquet files of ``source`` and ends; started again with the same checkpoint it goes on where it ended.

    A key's rows must come in order of seq from one micro-batch to the next, in any order within one.
    """
    reader = spark.readStream.schema(INPUT)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    rows = reader.parquet(source).groupBy("symbol").applyInPandasWithState(grouped(population), OUTPUT, STATE, "append", GroupStateTimeout.NoTimeout)
    return rows.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def in_batch(ticks: DataFrame, population: int) -> DataFrame:
    """What a stream that has read all of ticks has given out."""
    by_seq = W.partitionBy("symbol").orderBy("seq")
    t = ticks.withColumn("poison", F.min(F.when(F.col("us").isNull(), F.col("seq"))).over(W.partitionBy("symbol")))
    t = t.withColumn("reach", F.max("us").over(by_seq.rowsBetween(W.unboundedPreceding, -1)))
    error = F.when(F.col("seq") > F.col("poison"), "poisoned").when(F.col("us").isNull(), "invalid_time").when(F.col("us") < F.col("reach"), "late")
    t = t.withColumn("error", error)
    errors = t.filter("error IS NOT NULL").select(F.col("error").alias("kind"), "symbol", "us", "seq", F.lit(1).cast("bigint").alias("n"), "bid", "ask", F.lit(None).cast("bigint").alias("since"), F.lit(None).cast("double").alias("move"), F.lit(None).cast("boolean").alias("warm"))
    g = t.filter("error IS NULL").groupBy("symbol", "us").agg(F.max("seq").alias("seq"), F.count(F.lit(1)).alias("n"), F.max_by("bid", "seq").alias("bid"), F.max_by("ask", "seq").alias("ask"), F.max("poison").alias("poison"))
    by_time = W.partitionBy("symbol").orderBy("us")
    mid = (F.col("bid") + F.col("ask")) / 2
    g = g.withColumns({"since": F.col("us") - F.lag("us").over(by_time), "move": mid - F.lag(mid).over(by_time), "next": F.lead("us").over(by_time)})
    g = g.filter(F.col("next").isNotNull() | F.col("poison").isNotNull()).withColumn("warm", F.col("us") < population)
    return g.select(F.lit("group").alias("kind"), "symbol", "us", "seq", "n", "bid", "ask", "since", "move", "warm").unionByName(errors)
