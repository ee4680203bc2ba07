"""Gap clocks, supported bins, features at anchors, causes, many fits, resampling, intake and digests on small cases."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import anchors, causes, intake, models
from ledgerloom.operators import features as X
from ledgerloom.operators import intervals as I
from ledgerloom.operators.order import DAY, HOUR, SECOND
from ledgerloom.sources import digests

NOON = 20000 * DAY + 12 * HOUR
INTERVAL = "acct long, interval_id long, start_us long, end_us long, state string, behavior string, following string, is_tail boolean"


def bins_of(spark, rows, low, high, width=SECOND, gaps=(), split=lambda us: F.lit("development")):
    intervals = spark.createDataFrame(rows, INTERVAL)
    gaps = spark.createDataFrame(list(gaps), "gap_start long, gap_end long")
    fragments = I.partition_risk(intervals, gaps, ["acct"], low, high)
    bins = I.supported_bins(fragments, gaps, ["acct"], width, high, split, (12, 24))
    return bins.orderBy("interval_id", "bin_start").collect(), {r.interval_id: r for r in I.support_audit(intervals, bins, ["acct"], low, high).collect()}


def own(start, end, following="UNLOCK_TO_BUY", number=1, state="HEDGED_1X1", tail=False):
    return (1, number, NOON + start, NOON + end, state, "REHEDGE_SELL", following, tail)


def test_ages_pause_in_gaps_and_bins_never_cross_them(spark):
    bins, audit = bins_of(spark, [own(0, 5 * SECOND)], NOON, NOON + 5 * SECOND, gaps=[(NOON + 2 * SECOND, NOON + 3 * SECOND + SECOND // 2)])
    assert [((b.bin_start - NOON) // SECOND, b.age_us / SECOND, b.target, b.is_last, b.censor_reason) for b in bins] == [(0, 0.0, 0, False, None), (1, 1.0, 0, False, None), (4, 2.5, 1, True, "target_event")]
    assert (audit[1].bins, audit[1].targets, audit[1].exclusion_reason) == (3, 1, None)


def test_half_second_bins_are_whole_cells(spark):
    bins, _ = bins_of(spark, [own(SECOND // 4, 2 * SECOND)], NOON + SECOND // 4, NOON + 2 * SECOND, width=SECOND // 2)
    assert [(b.bin_start - NOON) * 2 // SECOND for b in bins] == [1, 2, 3]


def test_truncated_competing_and_cut_intervals(spark):
    rows = [own(-2 * SECOND, 5 * SECOND), own(5 * SECOND, 10 * SECOND, "OPEN_ADDITIONAL_BUY", 2), own(10 * SECOND, 14 * SECOND, None, 3, tail=True), own(10 * SECOND, 99 * SECOND, "UNLOCK_TO_SELL", 4), own(2 * SECOND, 2 * SECOND + 5, "UNLOCK_TO_BUY", 5), own(2 * SECOND, 9 * SECOND, "CLOSE_TO_FLAT", 6, state="FLAT")]
    bins, audit = bins_of(spark, rows, NOON, NOON + 14 * SECOND)
    assert {b.interval_id for b in bins} == {2, 3, 4}
    assert {k: (a.censor_reason, a.exclusion_reason, a.targets, a.competing) for k, a in audit.items()} == {
        1: (None, "left_truncated", 0, 0), 2: ("competing_endpoint", None, 0, 1), 3: ("synthetic_right_censor", None, 0, 0), 4: ("coverage_right_censor", None, 0, 0), 5: (None, "no_complete_bin", 0, 0), 6: (None, "ineligible_state", 0, 0),
    }
    assert [b.following for b in bins if b.interval_id == 2] == [None] * 4 + ["OPEN_ADDITIONAL_BUY"]


def test_an_interval_of_both_parts_is_in_neither(spark):
    midnight = NOON + 12 * HOUR
    split = lambda us: F.when(us < midnight, "development").otherwise("holdout")
    rows = [(1, 1, midnight - 2 * SECOND, midnight + 2 * SECOND, "HEDGED_1X1", "REHEDGE_SELL", "UNLOCK_TO_BUY", False), (1, 2, midnight - 4 * SECOND, midnight - 2 * SECOND, "ONE_BUY", "x", "REHEDGE_SELL", False)]
    bins, audit = bins_of(spark, rows, midnight - 9 * SECOND, midnight + 9 * SECOND, split=split)
    assert [(b.interval_id, b.split, b.is_cross_split, b.is_eligible, b.is_common) for b in bins] == [(1, "development", True, False, True)] * 2 + [(1, "holdout", True, False, False)] * 2 + [(2, "development", False, True, True)] * 2
    assert (audit[1].exclusion_reason, audit[2].exclusion_reason) == ("cross_development_holdout", None)


def test_the_gap_clock_at_its_edges(spark):
    gaps = spark.createDataFrame([(10, 20), (50, 55), (3 * DAY, 4 * DAY)], "gap_start long, gap_end long")
    points = [(a, b) for a in (0, 10, 15, 20, 52, 60, 3 * DAY, 5 * DAY) for b in (0, 10, 15, 20, 52, 60, 3 * DAY, 5 * DAY) if a <= b]
    found = I.lost_to_gaps(spark.createDataFrame(points, "a long, b long"), gaps, "a", "b").collect()
    spans = [(10, 20), (50, 55), (3 * DAY, 4 * DAY)]
    assert {(r.a, r.b, r.lost_us) for r in found} == {(a, b, sum(max(0, min(b, y) - max(a, x)) for x, y in spans)) for a, b in points}


def test_extremes_are_the_last_of_ranges():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 9, 200).astype(float)
    start = rng.integers(0, 200, 500)
    end = np.minimum(200, start + rng.integers(0, 70, 500))
    high, low = anchors.extremes(values, start, end)
    for a, b, h, l in zip(start, end, high, low):
        expected = (max(range(a, b), key=lambda k: (values[k], k)), max(range(a, b), key=lambda k: (-values[k], k))) if a < b else (-1, -1)
        assert (h, l) == expected


def test_the_first_value_that_reaches_a_bound():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 64, 197):
        values = rng.random(n)
        start = rng.integers(0, n + 1, 400)
        end = np.minimum(n, start + rng.integers(0, n + 1, 400))
        bound = np.where(rng.random(400) < 0.1, np.nan, rng.random(400) * 1.1)
        found = anchors.first_reaching(values, start, end, bound)
        assert found.tolist() == [next((k for k in range(a, b) if values[k] >= x), -1) for a, b, x in zip(start, end, bound)]
    assert anchors.first_reaching(np.array([]), np.array([0]), np.array([0]), np.array([0.5])).tolist() == [-1]


MIDS = [100.0, 100.1, 100.2, 100.4, 100.3, 100.2, 100.5, 100.7, 100.6, 100.4, 100.3, 100.2, 100.4, 100.8, 101.0, 100.9, 100.7, 100.6, 100.5, 100.4, 100.6, 100.8, 101.1, 101.3, 101.2, 101.0, 100.9, 100.8, 100.7, 100.6, 100.5]


def features(spark, rows, gaps=None):
    """Rows (name, endpoint, anchor second, start second) with their features; ticks come every half second."""
    ticks = spark.createDataFrame([(NOON + k * SECOND // 2, k, m, 0.2) for k, m in enumerate(MIDS)], "us long, seq long, mid double, spread double")
    gaps = None if gaps is None else spark.createDataFrame(gaps, "gap_start long, gap_end long")
    bins = spark.createDataFrame([(n, e, NOON + int(a * SECOND), NOON + int(s * SECOND)) for n, e, a, s in rows], "name string, endpoint string, bin_start long, interval_start long")
    times = bins.select(F.col("bin_start").alias("us")).distinct().withColumn("seq", F.lit(0).cast("long"))
    at = anchors.look_back(times, ticks, [], [k * SECOND for k in (2, 5, 10)], gaps, bucket=4 * SECOND).drop("seq").withColumnRenamed("us", "bin_start")
    starts = anchors.state_reference(bins.select(F.col("interval_start").alias("us")).distinct(), ticks, [], gaps).withColumnRenamed("us", "interval_start")
    found = bins.join(at, "bin_start", "left").join(starts, "interval_start", "left")
    return {r["name"]: r for r in anchors.signed_features(found, {k: f"w{k * SECOND}" for k in (2, 5, 10)}, "reference").collect()}


def test_features_are_signed_by_their_endpoint_and_touch_before_the_anchor(spark):
    f = features(spark, [("sell", "rehedge_sell_occurrence", 15, 2), ("buy", "rehedge_buy_occurrence", 15, 2), ("unlock", "unlock_occurrence", 15, 2)])
    assert all(r.all_features_valid for r in f.values())
    assert f["sell"].signed_change_2 == -f["buy"].signed_change_2 == pytest.approx(100.5 - 100.9)
    assert f["unlock"].absolute_change_2 == abs(f["sell"].signed_change_2) and f["unlock"].signed_change_2 is None
    assert f["sell"].spread == 0.2 and f["sell"].absolute_displacement == pytest.approx(0.2) and f["unlock"].either_touch_2 == 1.0
    assert f["sell"].side_touch_5 == 1.0 and f["buy"].side_touch_5 == 0.0  # 101.3 above all of [5 s, 10 s); 100.6 is no new low
    assert f["sell"].proximity_2 == 0.0 and f["buy"].proximity_2 == pytest.approx(1.0) and f["sell"].volatility_10 == pytest.approx(np.sqrt((np.diff(MIDS[10:]) ** 2).sum()))


def test_a_gap_makes_windows_and_the_reference_invalid(spark):
    f = features(spark, [("x", "unlock_occurrence", 15, 10), ("before", "unlock_occurrence", 7, 7), ("early", "unlock_occurrence", 9, 0)], [(NOON + 7 * SECOND, NOON + 12 * SECOND)])
    assert not (f["x"].window_10_valid or f["x"].all_features_valid) and f["x"].window_2_valid
    assert f["before"].window_5_valid and f["before"].reference_valid  # a gap that begins at the anchor isn't in its window
    assert not f["early"].window_10_valid and f["early"].reference_valid


def test_look_back_is_the_plain_version_at_any_bucket(spark):
    rng = random.Random(4)
    ticks = sorted((rng.randrange(3000), k, round(rng.random(), 3)) for k in range(150))
    points = [(rng.randrange(3200), k) for k in range(60)] + [(ticks[9][0], 60), (ticks[0][0], 61)]
    gaps = [(a[0], b[0]) for a, b in zip(ticks, ticks[1:]) if b[0] - a[0] > 60]
    frames = spark.createDataFrame([(1, t, s, m, m / 9) for t, s, m in ticks], "k long, us long, seq long, mid double, spread double"), spark.createDataFrame([(1, a, b) for a, b in gaps], "k long, gap_start long, gap_end long")
    for bucket in (70, 100_000):
        found = anchors.look_back(spark.createDataFrame([(1, t, s) for t, s in points], "k long, us long, seq long"), frames[0], ["k"], [50, 200], frames[1], bucket=bucket).collect()
        assert len(found) == len(points)
        for r in found:
            for w in (50, 200):
                got, inside = r[f"w{w}"], [x for x in ticks if r.us - w <= x[0] <= r.us]
                prior, before = [x for x in ticks if r.us - 2 * w <= x[0] < r.us - w], [x for x in inside if x[0] < r.us]
                crossed = lambda a: any(x < r.us and y > a for x, y in gaps)  # noqa: E731, B023
                assert got.n == len(inside) and got.prior_n == len(prior)
                assert got.valid == (len(inside) >= 2 and r.us - w >= ticks[0][0] and not crossed(r.us - w))
                assert got.touch_valid == (len(inside) >= 2 and len(prior) >= 2 and r.us - 2 * w >= ticks[0][0] and not crossed(r.us - 2 * w))
                moves = [b[2] - a[2] for a, b in zip(inside, inside[1:])]
                assert (got.ups, got.downs) == (sum(m > 0 for m in moves), sum(m < 0 for m in moves)) and got.squares == pytest.approx(sum(m * m for m in moves))
                pick = lambda rows, f: f(x[2] for x in rows) if rows else None
                assert (got.high, got.low, got.prior_high, got.prior_low, got.before_high, got.before_low) == (pick(inside, max), pick(inside, min), pick(prior, max), pick(prior, min), pick(before, max), pick(before, min))
                for side, sign in (("high", 1), ("low", -1)):
                    end = max((sign * x[2] for x in prior), default=None)
                    since = next((inside[k:] for k, x in enumerate(inside) if end is not None and sign * x[2] >= end), None)
                    assert got[f"{side}_touch_us"] == (since[0][0] if since else None)
                    assert got[f"{side}_back"] == (pytest.approx(max(sign * x[2] for x in since) - sign * since[-1][2]) if since else None)
                if inside:
                    assert (got.first, got.last, got.last_us) == (inside[0][2], inside[-1][2], inside[-1][0])
                    assert got.high_us == max(x[0] for x in inside if x[2] == got.high)


def test_a_second_unlock_and_a_missing_feature_are_errors(spark):
    columns = "acct long, interval_id long, endpoint string, target int, following string, is_common boolean, is_cross_split boolean"
    row = (1, 1, "unlock_occurrence", 1, "UNLOCK_TO_BUY", True, False)
    assert causes.unlock_events(spark.createDataFrame([row], columns), ["acct"], 7).first().cause == 1
    for rows, message in (([row, row], "twice"), ([(*row[:4], "CLOSE_TO_FLAT", True, False)], "another event"), ([(*row[:5], False, False)], "outside"), ([(*row[:6], True)], "outside")):
        with pytest.raises(Exception, match=message):
            causes.unlock_events(spark.createDataFrame(rows, columns), ["acct"], 7).collect()
    audit = spark.createDataFrame([(True, None), (False, None)], "a_valid boolean, feature double")
    assert causes.audited(audit.filter("NOT a_valid"), {}, ["a_valid"], ["feature"]).first().reason == "a"
    with pytest.raises(Exception, match="lacks a feature"):
        causes.audited(audit, {}, ["a_valid"], ["feature"]).collect()


def newton(x, y, offset, penalty, intercept):
    x = np.column_stack([np.ones(len(x)), x]) if intercept else x
    weights = np.full(x.shape[1], penalty)
    weights[: int(intercept)] = 0
    theta = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-(offset + x @ theta)))
        theta = theta - np.linalg.lstsq((x.T * (p * (1 - p))) @ x / len(y) + np.diag(weights), x.T @ (p - y) / len(y) + weights * theta, rcond=None)[0]
    return theta


def test_many_fits_at_once_are_those_of_numpy(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 132))
    y = (rng.random(600) < 1 / (1 + np.exp(-x[:, 0] + 0.5 * x[:, 1]))).astype(float)
    offset, part = rng.normal(size=600), rng.random(600) < 0.6
    names = [f"x{k}" for k in range(132)]
    rows = spark.createDataFrame([(*map(float, r), float(a), float(b), bool(c)) for r, a, b, c in zip(x, y, offset, part)], ", ".join(f"{n} double" for n in names) + ", y double, o double, part boolean").repartition(5).cache()
    own = [models.Model(f"wide {p}", tuple(names), penalty=p) for p in (0.01, 0.1, 1.0)] + [models.Model("part", ("x0", "x1"), "part", "o", False), models.Model("level", (), "part", "o")]
    fits = models.fit_many(rows, own, "y")
    for p in (0.01, 0.1, 1.0):
        assert np.allclose(fits[f"wide {p}"].theta, newton(x, y, 0, p, True), atol=1e-7)
    assert np.allclose(fits["part"].theta, newton(x[part][:, :2], y[part], offset[part], 0, False), atol=1e-7)
    assert np.allclose(fits["level"].theta, newton(x[part][:, :0], y[part], offset[part], 0, True), atol=1e-7)
    found = rows.select(fits["part"].predict().alias("p"), "x0", "x1", "o").collect()
    assert all(abs(r.p - 1 / (1 + np.exp(-(r.o + r.x0 * fits["part"].theta[0] + r.x1 * fits["part"].theta[1])))) < 1e-9 for r in found)
    with pytest.raises(Exception, match="isn't finite"):
        models.fit_many(rows.withColumn("x0", F.lit(float("nan"))), own[:1], "y")
    with pytest.raises(ValueError, match="no rows"):
        models.fit_many(rows.filter("false"), own[3:], "y")


def test_scales_are_those_of_the_fitted_rows(spark):
    rows = spark.createDataFrame([("a", True, 1.0, 5.0), ("a", True, 3.0, 5.0), ("a", False, 9.0, 6.0), ("b", True, 1.0, None)], "key string, fit boolean, x double, y double")
    found = models.scaled_by(rows, "key", F.col("fit"), {"a": ["x", "y"], "b": ["x"]}).collect()
    assert [(r.x_z, r.y_z) for r in found] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 1.0), (0.0, None)]


def test_resampled_intervals_are_near_those_of_drawing(spark):
    rng = np.random.default_rng(5)
    values = rng.normal(0.3, 1, 400)
    units = spark.createDataFrame([("a", k, float(v)) for k, v in enumerate(values)] + [("b", 0, 2.0)], "key string, unit long, v double")
    found = {r.key: r for r in models.resampled(units, ["key"], "v", ["unit"], 800, "s", 0.05).collect()}
    drawn = values[rng.integers(0, 400, (4000, 400))].mean(axis=1)
    a = found["a"]
    assert a.units == 400 and a.mean == pytest.approx(values.mean()) and a.draws == 800
    assert abs(a.low - np.quantile(drawn, 0.025)) < 0.02 and abs(a.high - np.quantile(drawn, 0.975)) < 0.02 and abs(a.one_sided_low - np.quantile(drawn, 0.05)) < 0.02
    assert found["b"].low == found["b"].high == 2.0 and found["b"].draws < 800  # a draw without the only unit has no mean


def test_neighbouring_windows_decide_together(spark):
    def verdict(*signs, n=30):
        spans = {1: (0.1, 0.2), -1: (-0.2, -0.1), 0: (-0.1, 0.1), None: (None, None)}
        rows = [("x", k, n, *spans[s]) for k, s in enumerate(signs)]
        return models.agreeing_runs(spark.createDataFrame(rows, "key string, w long, units long, low double, high double"), ["key"], "w").first().verdict

    assert [verdict(1, 1, 0), verdict(-1, -1), verdict(1, 1, 0, -1, -1), verdict(1, 0, 1), verdict(0, None), verdict(1, 1, n=29)] == ["supported", "rejected", "mixed", "weak", "inconclusive", "inconclusive"]


def test_only_an_independent_whole_replica_is_evidence(spark):
    start = 20000 * DAY + 30 * 60 * SECOND

    def run(name, cut=0, move=0.0, step=600 * SECOND):
        times = [start + k * step for k in range(141) if k not in range(60, 66)]
        return [(name, t, k, 1.0 + (move if k == 59 else 0), 1.5) for k, t in enumerate(times) if t >= start + cut]

    ticks = spark.createDataFrame(run("p") + run("same") + run("cut", cut=2 * HOUR) + run("moved", move=0.1), "run string, us long, seq long, bid double, ask double")
    gaps = intake.signed_gaps(ticks, ["run"], 30 * 60 * SECOND)
    sessions = intake.session_coverage(ticks, gaps, ["run"], HOUR, 23 * HOUR)
    assert {r.run: (r.starts_on_time, r.ends_on_time, r.gaps, r.status) for r in sessions.collect()} == {"p": (True, True, 1, "FAIL"), "same": (True, True, 1, "FAIL"), "cut": (False, True, 1, "FAIL"), "moved": (True, True, 1, "FAIL")}
    own = gaps.filter("run = 'p'").withColumn("class", F.lit("unknown_coverage_gap"))
    evidence = lambda runs, longest=DAY: intake.with_evidence(own, gaps.filter(F.col("run").isin(*runs)), sessions, longest).first()
    assert evidence(["p", "cut", "moved"]).accepted is False
    found = evidence(["p", "cut", "moved", "same"])
    assert (found.accepted, found.evidence, found["class"]) == (True, "same", "replicated_coverage_gap")
    assert evidence(["same"], longest=HOUR)["class"] == "excessive_coverage_gap"


def test_coverage_and_repeats_of_overlapping_files(spark):
    rows = [("a", t, float(t)) for t in (0, 5, 10, 10)] + [("b", t, float(t)) for t in (10, 12)] + [("b", 5, 9.0)] + [("c", 40, 1.0), ("c", 50, 1.0)]
    ticks = spark.createDataFrame([("r", f, t, v) for f, t, v in rows], "run string, file string, us long, bid double")
    spans = intake.file_spans(ticks, ["run", "file"])
    assert {(r.file, r.rows, r.first_us, r.last_us, r.repeated) for r in spans.collect()} == {("a", 4, 0, 10, 2), ("b", 3, 5, 12, 0), ("c", 2, 40, 50, 0)}
    assert sorted((r.start_us, r.end_us, r.files) for r in intake.covered(spans, ["run"]).collect()) == [(0, 12, 2), (40, 50, 1)]
    assert tuple(intake.repeated_across(ticks, ["run"], ["us", "bid"], "file").first())[1:] == (1, 2)


def test_a_digest_is_of_rows_in_order_not_of_partitions(spark):
    rows = [(k, f"v{k % 7}", None if k % 5 == 0 else 1.5) for k in range(300)]
    digest = lambda r, n, **k: digests.table_digest(spark.createDataFrame(r, "k long, v string, x double").repartition(n), ["k"], block=8, **k)
    whole = digest(rows, 1)
    assert whole == digest(rows[::-1], 7) == digest(rows, 3)
    swapped = [*rows]
    swapped[10], swapped[11] = (10, *rows[11][1:]), (11, *rows[10][1:])
    assert len({whole, digest(swapped, 3), digest(rows[:-1], 3), digest(rows, 3, columns=["k", "x"]), digest([], 1), digest([(0, "-", None)], 1), digest([(0, None, None)], 1)}) == 7


def test_a_cohort_needs_each_pinned_file_once(spark, tmp_path):
    for name, text in (("a", "1"), ("b", "2"), ("c", "2")):
        (tmp_path / f"{name}.csv").write_text(f"time_utc,bid,ask\n2026-07-2{text} 12:00:00,1.5,1.6\n")
    from ledgerloom.sources import ticks

    of = {r.path[-5:-4]: r.sha256 for r in digests.file_digests(spark, str(tmp_path)).collect()}
    read = lambda days, pins: digests.read_cohort(spark, str(tmp_path), days, pins, ticks.read_archive)
    assert [r.session for r in read(["2026-07-21"], [of["a"]]).collect()] == ["2026-07-21"]
    for days, pins, message in ((["2026-07-21"], [of["a"], of["a"]], "twice"), (["2026-07-22"], [of["b"]], "exactly one"), (["2026-07-21"], ["0" * 64], "exactly one"), (["2026-07-25"], [of["a"]], "registered days")):
        with pytest.raises(ValueError, match=message):
            read(days, pins)


def test_model_queries_are_numpy_over_the_same_design(spark):
    from ledgerloom.functions import EPSILON
    from ledgerloom.plans import model_queries as Q

    d = "/root/testdata/sf0.01"
    rows = Q.design_of(spark, d).toPandas()
    found = Q.model_deltas(spark, d).toPandas()
    seen = sorted(e for e, g in rows[rows.role == "development"].groupby("endpoint") if g.target.sum() > 0)
    assert seen and sorted(found.endpoint.unique()) == seen
    logit = lambda p: np.log(p) - np.log1p(-p)
    for e in seen:
        own = rows[rows.endpoint == e].reset_index(drop=True)
        fit = (own.role == "development").to_numpy()
        y, common, dev = own.target.to_numpy(float), own.p_a_common.to_numpy(), own.p_a_dev.to_numpy()
        raw = {name: own[list(columns[e])].to_numpy(float) for name, columns in (("all", Q.COLUMNS), ("shape", Q.SHAPE))}
        scaled = {}
        for name, x in raw.items():
            scale = x[fit].std(axis=0)
            scaled[name] = (x - x[fit].mean(axis=0)) / np.where(scale < 1e-12, 1, scale)  # numpy has rounding left of a constant
        hour = (own.bin_start.to_numpy() % DAY) // HOUR
        blocks = np.column_stack([(hour >= a) & (hour < a + 4) for a in (12, 16, 20)]).astype(float)
        p = {"a_common": common, "a_dev": dev}

        def add(name, x, offset, penalty, intercept=False):
            theta = newton(x[fit], y[fit], offset[fit], penalty, intercept)
            z = offset + (np.column_stack([np.ones(len(x)), x]) if intercept else x) @ theta
            p[name] = np.clip(1 / (1 + np.exp(-z)), EPSILON, 1 - EPSILON)

        add("a_level", np.zeros((len(own), 0)), logit(common), 0, True)
        add("a_session", blocks, logit(dev), 1e-3)
        add("b", scaled["all"], np.zeros(len(own)), Q.PENALTY, True)
        add("c_dev", scaled["all"], logit(dev), Q.PENALTY)
        add("c_session", scaled["all"], logit(p["a_session"]), Q.PENALTY)
        add("c_shape", scaled["shape"], logit(p["a_session"]), Q.PENALTY)
        for name, value in p.items():
            own[f"ll_{name}"] = y * np.log(value) + (1 - y) * np.log1p(-value)
        expected = own.groupby(["role", "acct", "interval_id"])[[f"ll_{m}" for m in Q.MODELS]].sum()
        got = found[found.endpoint == e].set_index(["role", "acct", "interval_id"])
        assert len(got) == len(expected)
        for m in Q.MODELS:
            assert np.allclose(got[f"ll_{m}"], expected.loc[got.index, f"ll_{m}"], atol=1e-6), m
        for a, b in Q.DELTAS:
            assert np.allclose(got[f"{a}_minus_{b}"], got[f"ll_{a}"] - got[f"ll_{b}"], atol=1e-12)


def test_session_effects_are_numpy_over_the_same_bins(spark):
    from ledgerloom.plans import hazard_queries as Q

    d = "/root/testdata/sf0.01"
    effects = {r.block: r.effect for r in Q.session_baseline(spark, d).collect()}
    p = Q.predicted(spark, d).filter("split = 'development'").toPandas()
    hour = (p.bin_start.to_numpy() % DAY) // HOUR
    x = np.column_stack([(hour >= a) & (hour < a + 4) for a in (12, 16, 20)]).astype(float)[hour >= 12]
    p = p[hour >= 12]
    theta = newton(x, p.target.to_numpy(float), (np.log(p.p_age) - np.log1p(-p.p_age)).to_numpy(), 1e-3, False)
    assert np.allclose([effects[b] for b in ("block_12_16", "block_16_20", "block_20_24")], theta, atol=1e-6)


def test_one_registered_gap_is_accepted_and_no_other(spark):
    def verdict(gaps, others="PASS", registered=(10, 20), days=(0, 1)):
        sessions = spark.createDataFrame([("x", d, "FAIL" if d == 0 else others) for d in days], "key string, day long, status string")
        frame = lambda rows: spark.createDataFrame([("x", *g) for g in rows], "key string, gap_start long, gap_end long")
        found = intake.amended(sessions, frame(gaps), frame([registered]), ["key"]).collect()
        return found[0].verdict, sorted(r.status for r in found)

    accepted = ["PASS", "PASS_WITH_REGISTERED_GAP"]
    assert verdict([(10, 20)]) == ("accepted", accepted)
    assert verdict([(10, 20), (DAY + 1, DAY + 9), (DAY - 5, DAY + 5)]) == ("accepted", accepted)  # only gaps within the gap's own day are counted
    assert verdict([(10, 20), (30, 40)]) == ("gap_count", ["FAIL", "PASS"])
    assert verdict([]) == ("gap_count", ["FAIL", "PASS"])
    assert verdict([(10, 21)]) == ("gap_changed", ["FAIL", "PASS"])
    assert verdict([(10, 20)], others="INCOMPLETE")[0] == "unexpected_failure"
    assert verdict([(10, 20)], days=(1, 2))[0] == "session_missing"


def test_a_manifest_names_each_registered_file_once_as_it_is(spark):
    lines = [("a", "incoming/a", "1"), ("b", "incoming/b", "1"), ("b", "incoming/b", "1"), ("c", "incoming/../c", "1"), ("d", "incoming/d", "2"), ("e", "incoming/e", "1"), ("f", "incoming/f", "1"), ("h", None, "1")]
    manifest = spark.createDataFrame(lines, "alias string, relative_path string, sha256 string")
    files = spark.createDataFrame([(x, "1") for x in "abcdfghi"], "alias string, sha256 string")
    found = digests.manifest_status(manifest, files, spark.createDataFrame([(x,) for x in "abcdegh"], "alias string"))
    assert {r.alias: r.status for r in found.collect()} == {
        "a": "verified", "b": "repeated_alias", "c": "wrong_path", "d": "changed", "e": "missing_file", "f": "not_registered", "g": "not_listed", "h": "wrong_path", "i": "not_registered",
    }


def test_breaks_end_after_their_start(spark):
    rows = spark.createDataFrame([(5, 9, None), (5, 9, "unknown_coverage_gap"), (1, 2, "x")], "gap_start long, gap_end long, reason string")
    assert sorted(tuple(r) for r in I.checked_breaks(rows, []).collect()) == [(1, 2, "x"), (5, 9, "unknown_coverage_gap")]
    assert sorted(tuple(r) for r in I.checked_breaks(rows.drop("reason"), []).collect()) == [(1, 2, "unknown_coverage_gap"), (5, 9, "unknown_coverage_gap")]
    with pytest.raises(Exception, match="a break must end after its start"):
        I.checked_breaks(spark.createDataFrame([(5, 5)], "gap_start long, gap_end long"), []).collect()


def test_a_rule_sees_the_prefix_of_its_ticks(spark):
    rng = random.Random(11)
    minute = 60 * SECOND
    times = sorted(rng.sample(range(0, 20 * minute, SECOND // 2), 60))
    ticks = [(1, t, k, 100 + round(rng.random(), 2)) for k, t in enumerate(times)]
    frame = spark.createDataFrame([(*t, t[3] - 0.1, t[3] + 0.1) for t in ticks], "k int, us long, seq long, mid double, bid double, ask double")
    decisions = [(1, n, rng.randrange(0, 22 * minute), s) for n, s in enumerate(["ONE_BUY", "ONE_SELL", "HEDGED"] * 20)] + [(1, 60, times[0], "ONE_BUY"), (1, 61, times[0] - 1, "ONE_BUY"), (2, 62, times[9], "ONE_BUY")]
    found = {r.decision_id: r for r in X.rule_snapshot(spark.createDataFrame(decisions, "k int, decision_id int, us long, state string"), frame, ["k"], minute, bucket=3 * minute).collect()}
    assert len(found) == len(decisions)
    for k, n, us, state in decisions:
        r, past = found[n], [t for t in ticks if t[0] == k and t[1] <= us]
        if not past:
            assert (r.spread, r.quote_gap, r.rate, r.session, r.increment, r.adverse) == (None,) * 6
            continue
        assert r.spread == pytest.approx(20) and r.quote_gap == (past[-1][1] - past[-2][1] if len(past) > 1 else 0) and r.session == "asia"
        assert r.rate == pytest.approx(sum(t[1] >= us - minute for t in past) / 60)
        anchor = max((i for i, t in enumerate(past) if t[1] <= us - minute), default=None)
        if anchor is None:
            assert r.increment is None and r.adverse is None
            continue
        window = [t[3] for t in past[anchor:]]
        assert r.increment == pytest.approx(window[-1] - window[0])
        adverse = {"ONE_BUY": window[0] - min(window), "ONE_SELL": max(window) - window[0]}.get(state)
        assert r.adverse == (None if adverse is None else pytest.approx(adverse))
