"""Steps whose rows must not be gathered in the driver or by one task, however small the file is that they are read from."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ledgerloom.operators import accounts as A
from ledgerloom.operators import intervals as I
from ledgerloom.plans import feature_queries
from ledgerloom.sources.shared import written

MINUTE = 60_000_000


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_rows_that_meet_the_gap_clock_are_not_broadcast(spark):
    rng = random.Random(3)
    gaps = [(k * 100, k * 100 + rng.randrange(1, 60)) for k in range(40)]
    rows = written(spark.createDataFrame([(k, rng.randrange(4000)) for k in range(300)], "id long, at long"), "rows")
    found = I.with_closed(rows, I.gap_clock(written(spark.createDataFrame(gaps, "gap_start long, gap_end long"), "gaps")), [], {"closed": "at"})
    assert "BuildLeft" not in plan(found)
    assert {(r.at, r.closed) for r in found.collect()} == {(r.at, sum(max(0, min(b, r.at) - a) for a, b in gaps)) for r in rows.collect()}


def test_gates_are_those_of_each_bin(spark):
    rng = random.Random(5)
    gaps = [(1000, 1030), (1480, 1600), (2100, 2110)]
    bins = [(k, rng.randrange(90, 230) * 10, rng.random() < 0.2, rng.random() < 0.2, rng.randrange(3)) for k in range(500)]
    frame = spark.createDataFrame([(k, k, s, s + 10, s + 10 * late, int(t), int(c)) for k, s, t, c, late in bins], "acct long, interval_id long, bin_start long, bin_end long, interval_end long, target int, competing int")
    found = A.bin_gates(written(frame, "bins"), spark.createDataFrame(gaps, "gap_start long, gap_end long"), 1000, 2200)
    assert "BuildLeft" not in plan(found)
    assert tuple(found.first()) == (
        500,
        sum(any(a < s + 10 and b > s for a, b in gaps) for _, s, *_ in bins),
        sum(t and late != 1 for _, _, t, _, late in bins),
        sum(t and c for _, _, t, c, _ in bins),
        sum(s < 1000 or s + 10 > 2200 for _, s, *_ in bins),
    )
    empty = A.bin_gates(frame.limit(0), spark.createDataFrame(gaps, "gap_start long, gap_end long"), 1000, 2200)
    assert tuple(empty.first()) == (0, 0, 0, 0, 0)


def test_bins_that_meet_their_windows_are_not_broadcast(spark):
    d = "/root/testdata/sf0.001"
    rows = written(spark.createDataFrame([(1_704_103_200_000_000 + k * 10 * MINUTE, 1_704_099_600_000_000) for k in range(50)], "bin_start long, interval_start long"), "bins")
    gaps = spark.createDataFrame([(1_704_100_000_000_000, 1_704_101_000_000_000)], "gap_start long, gap_end long")
    found = feature_queries.windows_of(spark, d, rows, gaps)
    assert "BuildLeft" not in plan(found)
    assert found.count() == 50


def test_cells_of_an_interval_are_counted_without_a_sort(spark):
    cells = [("a", 1, 0, 0, False, None), ("a", 1, 1, 0, False, "target_event"), ("a", 2, 0, 1, True, "competing_endpoint"), ("b", 1, 0, 0, False, "coverage_right_censor"), ("b", 1, 0, 0, False, "synthetic_right_censor")]
    bins = written(spark.createDataFrame(cells, "acct string, interval_id long, target int, competing int, is_cross_split boolean, censor_reason string"), "cells")
    intervals = spark.createDataFrame([("a", 1, 10, 20, "ONE_BUY"), ("a", 2, 10, 20, "ONE_BUY"), ("b", 1, 10, 20, "FLAT"), ("b", 2, 10, 20, "ONE_BUY")], "acct string, interval_id long, start_us long, end_us long, state string")
    found = I.support_audit(intervals, bins, ["acct"], 0, 100)
    assert "SortAggregate" not in plan(found)
    assert {(r.acct, r.interval_id): (r.bins, r.targets, r.competing, r.censor_reason, r.exclusion_reason) for r in found.collect()} == {
        ("a", 1): (2, 1, 0, "target_event", None), ("a", 2): (1, 0, 1, "competing_endpoint", "cross_development_holdout"), ("b", 1): (2, 0, 0, "synthetic_right_censor", "ineligible_state"), ("b", 2): (0, 0, 0, None, "no_complete_bin"),
    }


def test_exclusions_meet_windows_by_counts_of_bins(spark, tmp_path, monkeypatch):
    """Accounts repeated with the same times have as many rows that meet windows and references, and as many more bins."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows, bins, windows_of = [], [], feature_queries.windows_of
    monkeypatch.setattr(feature_queries, "windows_of", lambda s, d, own, gaps: rows.append(own.count()) or windows_of(s, d, own, gaps))
    for copies in (1, 3):
        d = f"{tmp_path}/{copies}"
        repeated = e.crossJoin(spark.range(copies).select((F.col("id") * 1_000_000).alias("_r")))
        repeated.withColumns({"event_id": F.col("event_id") + F.col("_r"), "user_id": F.col("user_id") + F.col("_r")}).drop("_r").write.parquet(f"{d}/events.parquet")
        found = feature_queries.exclusion_accounts(spark, d).filter("endpoint IS NULL").collect()
        bins.append({r.hours: (r.bins, r.targets, r.us) for r in found})
    assert rows[0] == rows[1] > 0
    assert bins[1] == {hours: tuple(3 * x for x in own) for hours, own in bins[0].items()} and len(bins[0]) == 3


def test_features_are_found_once_for_bins_of_the_same_times(spark, monkeypatch):
    """Each candidate keeps its row and gets its endpoint's features, however many share its times."""
    d, rows, windows_of = "/root/testdata/sf0.001", [], feature_queries.windows_of
    monkeypatch.setattr(feature_queries, "windows_of", lambda s, d, own, gaps: rows.append(own.count()) or windows_of(s, d, own, gaps))
    times = [(1_704_103_200_000_000 + k * 600 * MINUTE, 1_704_099_600_000_000, e) for k in range(6) for e in ("unlock_occurrence", "rehedge_buy_occurrence")]
    candidates = written(spark.createDataFrame([(a, *t) for a in range(4) for t in times], "acct long, bin_start long, interval_start long, endpoint string"), "bins")
    gaps = written(spark.createDataFrame([], "gap_start long, gap_end long"), "gaps")
    found = feature_queries.signed_of(spark, d, candidates, gaps).toPandas()
    assert rows == [len(times)]
    assert sorted(zip(found.acct, found.bin_start, found.interval_start, found.endpoint)) == sorted((a, *t) for a in range(4) for t in times)
    assert found.drop(columns="acct").drop_duplicates().shape[0] == len(times) and found.window_10_valid.any()
