"""Rules of single operators on small tables."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import align, cases, features, intervals, lifecycle
from ledgerloom.schema import allow_only

HOUR = 3_600_000_000


def positions(spark, rows):
    return spark.createDataFrame([(1, i, side, volume, o, 10.0, c, 11.0 if c is not None else None) for i, side, volume, o, c in rows], "acct int, position_id int, side string, volume double, open_us long, open_price double, close_us long, close_price double").withColumn("volume", F.col("volume").cast("decimal(12,8)"))


def test_merging_reports(spark):
    schema = "position_id int, report_id string, symbol string, side string, volume double, open_us long, open_price double, close_us long, close_price double"
    closed = spark.createDataFrame([(1, "a", "G", "buy", 0.3, 1, 1.0, 5, 2.0), (1, "a", "G", "buy", 0.3, 1, 1.0, 5, 2.0), (2, "a", "G", "buy", 0.3, 1, 1.0, 6, 2.0)], schema)
    snapshots = spark.createDataFrame([(2, "b", "G", "buy", 0.3, 1, 9.0), (2, "c", "G", "buy", 0.3, 1, 1.0), (3, "b", "G", "sell", 0.3, 1, None), (3, "a", "G", "sell", 0.3, 1, None), (4, "a", "G", "sell", 0.3, 1, 1.0), (4, "b", "G", "sell", 0.3, 1, None), (5, "b", "G", "sell", 0.3, 1, 1.0)], schema.split(", close_us")[0])
    good, conflicts = lifecycle.merge_positions(closed, snapshots)
    assert sorted((r.position_id, r.sources, r.is_closed, r.is_carry_over) for r in good.collect()) == [(1, "a", True, False), (1, "a", True, False), (2, "a", True, False), (3, "a,b", False, True), (5, "b", False, False)]
    assert sorted(tuple(r) for r in conflicts.collect()) == [(2, 2), (4, 2)]


def test_a_close_before_its_opening_changes_nothing_and_one_at_it_takes_it_back(spark):
    found = lifecycle.lifecycle(positions(spark, [(1, "buy", 0.3, 10, 5), (2, "sell", 0.3, 20, 20), (3, "sell", 0.3, 30, None)])).orderBy("seq").collect()
    assert [(r.type, r.position_id, r.before, r.after) for r in found] == [
        ("CLOSE", 1, "FLAT", "FLAT"), ("OPEN", 1, "FLAT", "ONE_BUY"), ("CLOSE", 2, "ONE_BUY", found[3].before), ("OPEN", 2, found[3].before, "ONE_BUY"), ("OPEN", 3, "ONE_BUY", "HEDGED_1X1"),
    ]
    assert found[2].category == found[3].category == "ambiguous_ordering" and found[4].behavior == "REHEDGE_SELL"


def test_same_time_needs_ticks_of_different_times(spark):
    rows = [(1, 0, 1, "HIGH", 5, 1, "ambiguous_ordering"), (1, 0, 2, "MEDIUM", 5, 2, "ambiguous_ordering"), (2, 0, 3, "HIGH", 7, 1, "ambiguous_ordering"), (2, 0, 4, "HIGH", 6, 2, "ambiguous_ordering"), (3, 0, 5, "HIGH", 6, 2, "boundary")]
    m = spark.createDataFrame(rows, "acct int, us long, event_id int, quality string, tick_us long, tick_seq int, category string")
    found = {r.event_id: (r.resolution, r.place) for r in align.same_time_order(m, ["acct"]).collect()}
    assert found == {1: ("still_ambiguous", None), 2: ("still_ambiguous", None), 3: ("resolved", 2), 4: ("resolved", 1), 5: ("not_applicable", None)}


@pytest.mark.parametrize(
    ("quotes", "status"),
    [
        ([(1, 50, True, False)], "selected"), ([], "no_quote"), ([(1, 161, True, False)], "no_quote"), ([(1, 160, True, False)], "selected"), ([(1, 55, False, False), (2, 60, True, False)], "invalid_quote"),
        ([(1, 60, True, False), (2, 60, True, False)], "same_time"), ([(1, 60, True, True)], "duplicate"), ([(1, 60, True, False), (2, 70, False, False)], "selected"), ([(1, 60, True, False), (2, 60, False, False)], "invalid_quote"),
    ],
)
def test_execution_quotes(spark, quotes, status):
    targets = spark.createDataFrame([("s", 1, 50)], "symbol string, anchor_id int, us long")
    q = spark.createDataFrame([("s", *x) for x in quotes], "symbol string, seq int, us long, valid boolean, duplicate boolean")
    assert features.execution_quotes(targets, q, ["symbol"], 110).first().status == status


def test_fragments_of_a_span_over_midnights_and_gaps(spark):
    day = 24 * HOUR
    i = spark.createDataFrame([(1, 1, 22 * HOUR, day + 4 * HOUR, "ONE_BUY", "REHEDGE_SELL"), (1, 2, 5 * HOUR, 5 * HOUR, "FLAT", "x")], "acct int, interval_id int, start_us long, end_us long, state string, following string")
    gaps = spark.createDataFrame([(23 * HOUR, day + HOUR), (day + 2 * HOUR, day + 3 * HOUR)], "gap_start long, gap_end long")
    found = sorted((r.interval_id, r.start_us // HOUR, r.end_us // HOUR, r.is_gap, r.is_zero) for r in intervals.partition_risk(i, gaps, ["acct"], 0, 10 * day).collect())
    assert found == [(1, 22, 23, False, False), (1, 23, 24, True, False), (1, 24, 25, True, False), (1, 25, 26, False, False), (1, 26, 27, True, False), (1, 27, 28, False, False), (2, 5, 5, False, True)]
    assert [r.tradeable_us // HOUR for r in intervals.paused_age(i.filter("interval_id = 1"), gaps, "start_us", "end_us").collect()] == [3]


def test_snapshot_reasons(spark):
    ticks = lambda rows: spark.createDataFrame([("s", k, us, 2000.0 + us / 100, 2000.2 + us / 100, ok, dup) for k, (us, ok, dup) in enumerate(rows)], "symbol string, seq int, us long, bid double, ask double, valid boolean, duplicate boolean")
    decision = spark.createDataFrame([("s", 1, 1000)], "symbol string, decision_id int, us long")
    reason = lambda rows: features.snapshot(decision, ticks(rows), ["symbol"], 60, 30, 500).first()
    dense = [(us, True, False) for us in range(920, 1001, 20)]
    r = reason(dense)
    assert (r.support, r.n, float(r.increment), float(r.buy_adverse), float(r.sell_adverse), float(r.spread), r.longest_gap) == ("supported", 4, 60.0, 0.0, 60.0, 20.0, 20)
    assert reason([]).support == reason([(100, True, False)]).support == "empty_prefix"
    assert reason([*dense, (990, False, False)]).support == "invalid_row"
    assert reason([(950, True, False), (990, True, False)]).support == "no_anchor" and reason([(950, True, False), (950, True, False)]).support == "duplicate_timestamp"
    assert reason([*dense[:-1], (999, True, True)]).support == "duplicate_timestamp" and reason([(930, True, False), (990, True, False)]).support == "quote_gap"


def test_order_faults_and_validated_joins(spark):
    i = spark.createDataFrame([(1, k, a, b) for k, (a, b) in enumerate([(0, 10), (5, 12), (12, 12), (3, 4), (3, 9)])], "acct int, k int, start_us long, end_us long")
    assert [(r.is_invalid, r.is_overlap) for r in cases.order_faults(i, ["acct"], "k").orderBy("k").collect()] == [(False, False), (False, True), (True, False), (False, False), (True, True)]
    left, right = spark.createDataFrame([(1,), (1,), (2,)], "id int"), spark.createDataFrame([(1, "x")], "id int, v string")
    assert cases.validated_join(left, right, ["id"]).count() == 3
    for l, r, unique in ((left, right, True), (left, right.unionByName(right), False)):
        with pytest.raises(Exception, match="repeated"):
            cases.validated_join(l, r, ["id"], unique).collect()
    with pytest.raises(ValueError, match="target"):
        allow_only(right.withColumn("target", F.lit(1)), ["v", "target"], forbidden=["target"])


def test_overlaps_with_earlier_rows_in_any_order_and_bucket(spark):
    rng = random.Random(7)
    rows = [(rng.randrange(2), k, a, a + rng.choice([0, 0, 3, 20, 150])) for k, a in enumerate(rng.sample(range(4000), 160))]
    frame = spark.createDataFrame(rows, "fold int, id long, a long, b long")
    expected = {(f, k) for f, k, a, b in rows for g, j, c, d in rows if f == g and j < k and a < b and c < d and c < b and a < d}
    for bucket in (37, 1000, 100_000):
        found = intervals.overlap_flags(frame, ["fold"], "a", "b", "id", bucket)
        assert {(r.fold, r.id) for r in found.collect() if r.is_overlap} == expected
    assert {(r.fold, r.id) for r in intervals.overlapping(frame, ["fold"], "a", "b", "id").collect()} == expected
    assert not intervals.overlap_flags(frame.limit(0), ["fold"], "a", "b", "id").collect()


def test_a_population_suffices_by_units_and_sides(spark):
    def support(rows, **least):
        schema = "fold int, unit string, side string, start_us long, end_us long, report_start long, report_end long, is_rejected boolean, has_tick boolean, has_terminal boolean"
        frame = spark.createDataFrame([(1, *r) for r in rows], schema)
        found = cases.population_support(frame, {"unknown": True, "known": False}, {"utc": [(0, 10**6, 0)], "late": [(0, 40, 0), (50, 10**6, 10)]}, "fold", least.get("units", 2), least.get("sides", 1))
        return {(r.bootstrap, r.clock): r for r in found.collect()}

    ok = (0, 100, False, True, True)
    rows = [("a", "ONE_BUY", 5, 9, *ok), ("a", "ONE_BUY", 20, 30, *ok), ("b", "ONE_SELL", 45, 60, *ok), ("c", "ONE_BUY", 30, 120, *ok), ("c", "ONE_BUY", 130, 140, *ok), ("d", "ONE_SELL", 9, 9, *ok)]
    rows += [("e", "ONE_BUY", 1, 2, 0, 100, True, True, True), ("f", "ONE_BUY", 1, 2, 0, 100, False, False, False), ("g", "ONE_SELL", 1, 2, 0, 100, False, True, False), ("h", "MULTI_POSITION", 1, 2, *ok)]
    found = support(rows)
    known = found["known", "utc"]
    assert (known.windows, known.ONE_BUY, known.ONE_SELL, known.units, known.support) == (10, 2, 1, 2, "sufficient")
    assert (known.invalid_transition, known.cross_fold_continuation, known.coverage_censored_no_valid_tick, known.right_censored_no_terminal) == (4, 1, 1, 1)
    late = found["known", "late"]  # 45 was never shown by this clock
    assert (late.clock_unresolved, late.units, late.support) == (1, 1, "insufficient_population")
    assert found["unknown", "utc"].left_censored_unknown_bootstrap == 5 and found["unknown", "utc"].units == 0
    assert support(rows, sides=2)["known", "utc"].support == "insufficient_population"
