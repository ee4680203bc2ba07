"""Positions to event logs, states and intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merge_positions(closed: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(positions, conflicts): every closed row, and one row for each id of open snapshots that isn't closed.

    Snapshots of one id must agree in symbol, side, volume, open_us and open_price (null is a value),
    else the id is a conflict, with its number of versions; a closed row of that id stays all the same. A
    closed row has its report as its source and is no carry-over. Snapshots list their reports,
    comma-joined; several make a carry-over. Both sides are grouped once, in one shuffle by id.
    """
    facts = ("symbol", "side", "volume", "open_us", "open_price")
    both = closed.withColumn("is_closed", F.lit(True)).unionByName(snapshots.withColumn("is_closed", F.lit(False)), allowMissingColumns=True)
    of_id = W.partitionBy("position_id")
    both = both.withColumns(
        {
            "has_closed": F.max("is_closed").over(of_id),
            "versions": F.size(F.collect_set(F.when(~F.col("is_closed"), F.to_json(F.struct(*facts), {"ignoreNullFields": "false"}))).over(of_id)),
            "sources": F.when(F.col("is_closed"), F.col("report_id")).otherwise(F.array_join(F.array_sort(F.collect_set(F.when(~F.col("is_closed"), F.col("report_id"))).over(of_id)), ",")),
        }
    )
    good = both.filter(F.col("is_closed") | (~F.col("has_closed") & (F.col("versions") == 1)))
    good = good.withColumn("is_carry_over", ~F.col("is_closed") & F.contains("sources", F.lit(",")))
    # Of an id's snapshots, which agree, the first one stands for all.
    place = F.row_number().over(W.partitionBy("position_id", "is_closed").orderBy("report_id", *facts))
    good = good.withColumn("place", place).filter(F.col("is_closed") | (F.col("place") == 1))
    good = good.select("position_id", *facts, "close_us", "close_price", "sources", "is_closed", "is_carry_over")
    conflicts = both.filter(~F.col("is_closed") & (F.col("versions") > 1)).groupBy("position_id").agg(F.max("versions").cast("bigint").alias("versions"))
    return good, conflicts


def dedupe_conservative(rows: DataFrame, key: Sequence[str], facts: Sequence[str], start: str, end: str) -> DataFrame:
    """One row per key. Where facts or ends differ the row is CENSORED from the first start to the last end (null if any is)."""
    return rows.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.countDistinct(F.struct(*facts, start, end)) > 1, "CENSORED").otherwise("OBSERVED").alias("status"),
        F.min(start).alias("start"),
        F.when(F.count(end) == F.count(F.lit(1)), F.max(end)).alias("end"),
    )


def timeline(positions: DataFrame, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """OPEN and CLOSE events, from one pass over positions.

    Of one time they are in the order of their positions' opening, then of ids as text, then CLOSE
    first. d is what an event adds to its side: a close before its position's opening finds none to
    close and adds nothing, so the position stays open; one at the time of the opening takes it back.
    """
    event = lambda us, price, kind, d: F.struct(F.col(us).alias("us"), F.col(price).alias("price"), F.lit(kind).alias("type"), d.alias("d"))
    closes = event("close_us", "close_price", "CLOSE", F.when(F.col("close_us") < F.col("open_us"), 0).otherwise(-1))
    both = F.when(F.col("close_us").isNull(), F.array(event("open_us", "open_price", "OPEN", F.lit(1)))).otherwise(F.array(event("open_us", "open_price", "OPEN", F.lit(1)), closes))
    return positions.select(*keys, "position_id", "side", "volume", "open_us", F.col("position_id").cast("string").alias("tie"), F.inline(both))


def m2_state(buys: Column, sells: Column, buy_volume: Column, sell_volume: Column) -> Column:
    n = buys + sells
    return (
        F.when(n == 0, "FLAT")
        .when((n == 1) & (buys == 1), "ONE_BUY")
        .when(n == 1, "ONE_SELL")
        .when(n > 2, "MULTI_POSITION")
        .when((buys == 1) & (sells == 1) & (buy_volume == sell_volume), "HEDGED_1X1")
        .otherwise("UNBALANCED_HEDGE")
    )


def observed_state(buys: Column, sells: Column, censored: Column, buy_volume: Column, sell_volume: Column) -> Column:
    """As m2_state, but a censored leg decides, and two legs of one side are MULTI_POSITION."""
    n = buys + sells
    return (
        F.when(censored > 0, "CENSORED")
        .when(n == 0, "FLAT")
        .when((n == 1) & (buys == 1), "ONE_BUY")
        .when(n == 1, "ONE_SELL")
        .when((buys == 1) & (sells == 1), F.when(buy_volume == sell_volume, "HEDGED_1X1").otherwise("UNBALANCED_HEDGE"))
        .otherwise("MULTI_POSITION")
    )


def behavior(type_: Column, side: Column, before: Column, after: Column) -> Column:
    opens, hedged = type_ == "OPEN", after == "HEDGED_1X1"
    unlocks = ~opens & (before == "HEDGED_1X1")
    return (
        F.when(opens & (before == "FLAT"), F.concat(F.lit("INITIAL_OPEN_"), F.upper(side)))
        .when(opens & (before == "ONE_BUY") & (side == "sell") & hedged, "REHEDGE_SELL")
        .when(opens & (before == "ONE_SELL") & (side == "buy") & hedged, "REHEDGE_BUY")
        .when(opens, F.concat(F.lit("OPEN_ADDITIONAL_"), F.upper(side)))
        .when(unlocks & (side == "sell") & (after == "ONE_BUY"), "UNLOCK_TO_BUY")
        .when(unlocks & (side == "buy") & (after == "ONE_SELL"), "UNLOCK_TO_SELL")
        .when(after == "FLAT", "CLOSE_TO_FLAT")
        .otherwise("UNCLASSIFIED")
    )


def category(behavior_: Column, before: Column, after: Column, same: Column) -> Column:
    either = lambda s: (before == s) | (after == s)
    return (
        F.when(same > 1, "ambiguous_ordering")
        .when(behavior_.startswith("INITIAL_") | (behavior_ == "CLOSE_TO_FLAT"), "boundary")
        .when(either("MULTI_POSITION"), "multi_position")
        .when(either("UNBALANCED_HEDGE"), "unbalanced_hedge")
        .when(behavior_.startswith("REHEDGE_") | behavior_.startswith("UNLOCK_"), "classified_standard")
        .otherwise("unsupported")
    )


def book_order(keys: Sequence[str], *order: str) -> tuple[WindowSpec, WindowSpec]:
    """The window over a book's events in their order, for lag and lead, and its frame up to the event, for running sums.

    A book is what one account does, so it is sorted in one task; all windows over it share one shuffle.
    """
    w = W.partitionBy(*keys).orderBy(*order)
    return w, w.rowsBetween(W.unboundedPreceding, W.currentRow)


def running_legs(side: Column, d: Column, volume: Column, upto: WindowSpec) -> dict[str, Column]:
    """Running numbers and volumes of open legs by side."""
    out = {}
    for s in ("buy", "sell"):
        own = F.when(side == s, d).otherwise(0)
        out[f"{s}s"] = F.sum(own).over(upto)
        out[f"{s}_volume"] = F.sum((own * volume).cast("decimal(22,8)")).over(upto)
    return out


def lifecycle(positions: DataFrame, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """The event log with running legs, states before and after, behaviour and accounting category.

    Legs are running sums, so a position opened and closed at one time leaves nothing behind.
    """
    keys = list(keys)
    w, upto = book_order(keys, "us", "open_us", "tie", "type")
    t = timeline(positions, keys).withColumns({"seq": F.row_number().over(w).cast("bigint"), **running_legs(F.col("side"), F.col("d"), F.col("volume"), upto)})
    t = t.withColumn("after", m2_state(F.col("buys"), F.col("sells"), F.col("buy_volume"), F.col("sell_volume")))
    t = t.withColumns({"before": F.coalesce(F.lag("after").over(w), F.lit("FLAT")), "same": F.count(F.lit(1)).over(W.partitionBy(*keys, "us"))})
    t = t.withColumn("behavior", behavior(F.col("type"), F.col("side"), F.col("before"), F.col("after")))
    t = t.withColumn("category", category(F.col("behavior"), F.col("before"), F.col("after"), F.col("same")))
    return t.drop("d", "tie")


def intervals(events: DataFrame, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """Half-open spans between consecutive events with the state in them and the events at both ends."""
    keys = list(keys)
    w, _ = book_order(keys, "seq")
    following = {"end_us": F.lead("us").over(w), "following": F.lead("behavior").over(w), "following_same": F.lead("same").over(w)}
    return events.withColumns(following).filter(F.col("end_us").isNotNull()).select(
        *keys, F.col("seq").alias("interval_id"), F.col("us").alias("start_us"), "end_us", F.col("after").alias("state"), "type", "behavior", "following", "same", "following_same"
    )


def orphan_closes(closes: DataFrame, opens: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Closes whose position was never opened before: exceptions that change no state."""
    o = opens.select(*keys, "position_id", F.col("us").alias("opened_us"))
    return closes.join(o, [*keys, "position_id"], "left").filter(F.col("opened_us").isNull() | (F.col("opened_us") > F.col("us"))).drop("opened_us")


def observed_replay(positions: DataFrame, start: int, end: int, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """Events of [start, end) with the observed state before and after each, positions from before carried in.

    positions has status OBSERVED or CENSORED; a censored one is in doubt from its start to its end.
    At one time the order is: end of doubt, close, start of doubt, open.
    """
    keys = list(keys)
    doubt = F.col("status") == "CENSORED"
    event = lambda us, rank, d: F.struct(F.col(us).alias("us"), rank.alias("rank"), F.lit(d).alias("d"))
    opens, closes = event("open_us", F.when(doubt, 2).otherwise(3), 1), event("close_us", F.when(doubt, 0).otherwise(1), -1)
    both = F.when(F.col("close_us").isNull(), F.array(opens)).otherwise(F.array(opens, closes))
    t = positions.filter(F.col("status").isin("OBSERVED", "CENSORED")).select(*keys, "position_id", "side", "volume", F.inline(both)).filter(F.col("us") < end)
    live = F.col("rank").isin(1, 3)
    w, upto = book_order(keys, "us", "rank", "position_id")
    t = t.withColumns({**running_legs(F.col("side"), F.when(live, F.col("d")).otherwise(0), F.col("volume"), upto), "censored": F.sum(F.when(live, 0).otherwise(F.col("d"))).over(upto)})
    t = t.withColumn("after", observed_state(F.col("buys"), F.col("sells"), F.col("censored"), F.col("buy_volume"), F.col("sell_volume")))
    t = t.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit("FLAT")))
    return t.filter(F.col("us") >= start).select(*keys, "position_id", "us", "rank", "before", "after")


def concurrency(positions: DataFrame, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """Sweep line: spans between times at which the number of open legs changes, with the numbers of legs in them."""
    keys = list(keys)
    closed = positions.filter(F.col("close_us").isNotNull() & (F.col("close_us") > F.col("open_us")))
    ends = F.array(F.struct(F.col("open_us").alias("us"), F.lit(1).alias("d")), F.struct(F.col("close_us").alias("us"), F.lit(-1).alias("d")))
    changes = closed.select(*keys, "side", F.inline(ends)).groupBy(*keys, "us").agg(*[F.sum(F.when(F.col("side") == s, F.col("d")).otherwise(0)).alias(f"d_{s}") for s in ("buy", "sell")])
    w, upto = book_order(keys, "us")
    t = changes.withColumns({"buys": F.sum("d_buy").over(upto), "sells": F.sum("d_sell").over(upto), "end_us": F.lead("us").over(w)})
    return t.filter(F.col("end_us").isNotNull()).select(*keys, F.col("us").alias("start_us"), "end_us", "buys", "sells", (F.col("buys") + F.col("sells")).alias("legs"))


def episodes(spans: DataFrame, where: Column, keys: Sequence[str] = ("acct",)) -> DataFrame:
    """Maximal runs of adjoining spans for which the condition holds (gaps and islands)."""
    keys = list(keys)
    w, upto = book_order(keys, "start_us")
    own = spans.filter(where).withColumn("new", F.when(F.lag("end_us").over(w).eqNullSafe(F.col("start_us")), 0).otherwise(1))
    own = own.withColumn("episode", F.sum("new").over(upto))
    return own.groupBy(*keys, "episode").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"), F.max("legs").alias("most"))


def transitions(events: DataFrame, states: Sequence[str]) -> DataFrame:
    """Counts of (before, after) over the closed universe, zero where none occurred."""
    spark = events.sparkSession
    one = spark.createDataFrame([(s,) for s in states], "s string")
    pairs = one.select(F.col("s").alias("before")).crossJoin(one.select(F.col("s").alias("after")))
    n = events.groupBy("before", "after").agg(F.count(F.lit(1)).alias("n"))
    return F.broadcast(pairs).join(n, ["before", "after"], "left").select("before", "after", F.coalesce("n", F.lit(0)).alias("n"))


def conservation(positions: DataFrame, keys: Sequence[str], low: int, high: int) -> DataFrame:
    """Of closed positions per key: open at ``low``, opened and closed in (low, high], open at ``high``, and whether that adds up."""
    opened, closed = F.col("open_us"), F.col("close_us")
    out = positions.groupBy(*keys).agg(
        F.count_if((opened <= low) & (closed > low)).alias("at_start"),
        F.count_if((opened > low) & (opened <= high) & closed.isNotNull()).alias("opens"),
        F.count_if((closed > low) & (closed <= high)).alias("closes"),
        F.count_if((opened <= high) & (closed > high)).alias("at_end"),
    )
    result = F.col("at_start") + F.col("opens") - F.col("closes")
    return out.withColumns({"result": result, "status": F.when(result == F.col("at_end"), "PASS").otherwise("FAIL")})
