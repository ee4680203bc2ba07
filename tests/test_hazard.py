"""Hazard tables, scores and fits on small tables, against numbers worked out by hand or numpy."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import functions as fn
from ledgerloom.operators import hazard as H
from ledgerloom.plans import registry


def test_rates_are_smoothed_and_empty_buckets_fall_back(spark):
    bins = spark.createDataFrame([("e", 1, 0.5), ("e", 0, 0.5), ("e", 0, 7.0), ("f", 0, 60.0)], "endpoint string, target int, age double")
    table = {(r.endpoint, r.bucket): r for r in H.hazard_table(bins).collect()}
    assert len(table) == 22
    assert table["e", "age_0_1"].p == pytest.approx(1.5 / 3) and table["e", "age_6_8"].no_events and table["e", "age_1_2"].no_exposure
    assert table["e", "age_1_2"].p is None and table["e", "age_1_2"].p_const == pytest.approx(1.5 / 4)
    new = spark.createDataFrame([("e", 0, 1.0), ("e", 0, 59.9)], "endpoint string, target int, age double")
    found = H.predict_hazard(new, H.hazard_table(bins)).collect()
    assert [r.fallback for r in found] == [True, True] and found[0].p_age == pytest.approx(1.5 / 4)
    for strict in (H.predict_hazard(new, H.hazard_table(bins), strict=True), H.predict_hazard(new.withColumn("endpoint", F.lit("x")), H.hazard_table(bins))):
        with pytest.raises(Exception, match="without"):
            strict.collect()


def test_scores_with_ties(spark):
    rng = np.random.default_rng(1)
    p, y = rng.integers(0, 8, 300) / 8, rng.integers(0, 2, 300)
    rows = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y)], "p double, target int")
    s = H.scores(rows, [], "p").first()
    pairs = (p[y == 1][:, None] > p[y == 0]) + 0.5 * (p[y == 1][:, None] == p[y == 0])
    assert s.auc == pytest.approx(pairs.mean()) and s.brier == pytest.approx(((p - y) ** 2).mean()) and s.accuracy == pytest.approx(((p >= 0.5) == y).mean())
    assert H.scores(rows.filter("target = 1"), [], "p").first().auc is None


def test_logistic_fit_is_numpys(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.3 + x @ [1.0, -0.5])))).astype(int)
    rows = spark.createDataFrame([(float(a), float(b), int(c), 0.2) for (a, b), c in zip(x, y)], "a double, b double, y int, o double")
    for lam, offset in ((0.0, None), (0.1, "o")):
        found = H.fit_logistic(rows, ["a", "b"], "y", regularization=lam, offset=offset)
        design, theta = np.column_stack([np.ones(500), x]), np.zeros(3)
        for _ in range(50):
            q = 1 / (1 + np.exp(-(design @ theta + (0.2 if offset else 0.0))))
            penalty = lam * np.array([0, 1, 1])
            theta -= np.linalg.solve((design.T * (q * (1 - q))) @ design / 500 + np.diag(penalty), design.T @ (q - y) / 500 + penalty * theta)
        assert [found[0], *found[1]] == pytest.approx(theta.tolist(), abs=1e-8)
    shift = H.fit_offset_intercept(rows.withColumn("p", F.lit(0.25)), "y", "p")
    assert 1 / (1 + np.exp(-(np.log(1 / 3) + shift))) == pytest.approx(y.mean())


def test_scaler(spark):
    rows = spark.createDataFrame([(1.0, 5.0, 0.0), (3.0, 5.0, 1.0)], "a double, b double, t double")
    assert H.fit_scaler(rows, ["a", "b", "t"], unscaled=["t"]) == {"a": (2.0, 1.0), "b": (5.0, 1.0), "t": (0.0, 1.0)}
    with pytest.raises(ValueError, match="a"):
        H.fit_scaler(rows.withColumn("a", F.lit(float("nan"))), ["a"])


def test_session_blocks_refuse_other_hours(spark):
    hours = spark.createDataFrame([(12,), (19,), (23,)], "h int")
    assert [tuple(r)[1:] for r in hours.withColumns(H.session_blocks(F.col("h"))).collect()] == [(1, 0, 0), (0, 1, 0), (0, 0, 1)]
    with pytest.raises(Exception, match="outside"):
        spark.createDataFrame([(11,)], "h int").withColumns(H.session_blocks(F.col("h"))).collect()
    assert registry.QUERIES["session_baseline"](spark, "/root/testdata/sf0.001").count() == 3


def test_server_clock(spark):
    hour = 3_600_000_000
    spring, autumn = 1774746000_000_000, 1792890000_000_000  # 2026-03-29 and 2026-10-25, 01:00 UTC
    segments = [(0, spring, 2 * hour), (spring, autumn, 3 * hour), (autumn, 2 * autumn, 2 * hour)]
    times = ["2026-03-29 03:30:00", "2026-10-25 03:30:00", "2026-03-29 04:30:00"]
    us = F.unix_micros(F.to_timestamp("t"))
    status, utc = fn.server_to_utc(us, segments)
    found = spark.createDataFrame([(t,) for t in times], "t string").select(status.alias("s"), utc.alias("u")).collect()
    assert [r.s for r in found] == ["nonexistent", "ambiguous", "unique"] and found[2].u == spring + hour // 2


def test_numbers_and_times_of_reports(spark):
    texts = spark.createDataFrame([("1 234,567.5", "0.3 / 0.2", "2026.07.23 12:00:00", "1.00000000", "  a \t b "), ("", "1", "x", "1.000000000", ""), ("n/a", "", "2026.07.23 12:00:00.250", "-0.1", " ")], "n string, v string, t string, f string, w string")
    requested, filled = fn.requested_and_filled(F.col("v"))
    found = texts.select(fn.number(F.col("n")), requested, filled, fn.report_time(F.col("t")).cast("string"), fn.fixed8(F.col("f")).cast("double"), fn.spaces_collapsed(F.col("w"))).collect()
    assert [tuple(r) for r in found] == [(1234567.5, 0.3, 0.2, "2026-07-23 12:00:00", 1.0, "a b"), (None, 1.0, None, None, None, ""), (None, None, None, "2026-07-23 12:00:00.25", None, "")]
    halves = spark.sql("SELECT CAST(0.000000005 AS DECIMAL(20,10)) AS a, CAST(0.000000015 AS DECIMAL(20,10)) AS b").select(fn.fixed8_text(F.col("a")), fn.fixed8_text(F.col("b"))).first()
    assert tuple(halves) == ("0.00000000", "0.00000002")
