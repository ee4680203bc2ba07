"""Steps that must not list what lies near a moment, however many ticks there are."""

from __future__ import annotations

import random
from decimal import Decimal

from ledgerloom.operators import align
from ledgerloom.operators import features as X
from ledgerloom.plans import control_queries
from ledgerloom.sources.shared import written

TICKS = "k string, seq long, us long, bid double, ask double, valid boolean, duplicate boolean"


def plain_snapshot(ticks, us, width, gap, lookback):
    """snapshot() for one decision, by its prefix."""
    t = sorted((x for x in ticks if us - lookback <= x[2] <= us), key=lambda x: (x[2], x[1]))
    if any(not x[5] for x in t):
        return ("invalid_row", *summary(t, us, width))
    if not t:
        return ("empty_prefix", 0, None)
    early = [k for k, x in enumerate(t) if x[2] <= us - width]
    repeats = [bool(x[6]) or any(y[2] == x[2] and y[1] < x[1] for y in t) for x in t]
    if not early:
        return ("duplicate_timestamp" if any(repeats) else "no_anchor", *summary(t, us, width))
    own = t[early[-1] :]
    longest = max([b[2] - a[2] for a, b in zip(own, own[1:])] + [us - t[-1][2]])
    if any(repeats[early[-1] :]):
        return ("duplicate_timestamp", *summary(t, us, width))
    if longest > gap:
        return ("quote_gap", *summary(t, us, width))
    mids = [(Decimal(str(x[3])) + Decimal(str(x[4]))) / 2 for x in own]
    return ("supported", *summary(t, us, width), float((mids[-1] - mids[0]) * 100), float((mids[0] - min(mids)) * 100), float((max(mids) - mids[0]) * 100))


def summary(t, us, width):
    return (sum(x[2] >= us - width for x in t),)


def test_a_snapshot_is_that_of_its_prefix(spark):
    rng = random.Random(7)
    ticks = [("ab"[k % 2], k, rng.randrange(0, 3000), round(rng.uniform(5, 9), 2), round(rng.uniform(9, 12), 2), rng.random() > 0.004, rng.random() < 0.01) for k in range(600)]
    ticks += [(None, 1000, 50, 1.0, 2.0, True, False), ("a", 1001, None, 1.0, 2.0, True, False)]
    decisions = [(rng.choice(["a", "b", "c", None]), k, rng.randrange(-50, 3300)) for k in range(800)] + [("a", 900, None)]
    frame, asked = spark.createDataFrame(ticks, TICKS), spark.createDataFrame(decisions, "k string, decision_id long, us long")
    seen = set()
    for bucket in (40, 700, 100_000):
        found = {r.decision_id: r for r in X.snapshot(asked, frame, ["k"], 30, 25, 90, bucket).collect()}
        assert len(found) == len(decisions)
        for k, i, us in decisions:
            r = found[i]
            want = plain_snapshot([x for x in ticks if x[0] == k and k is not None and x[2] is not None], us, 30, 25, 90) if us is not None else ("empty_prefix", 0, None)
            assert r.us == us and (r.support, r.n) == want[:2]
            if r.support == "supported":
                assert (float(r.increment), float(r.buy_adverse), float(r.sell_adverse)) == want[2:]
            seen.add(r.support)
    assert seen == {"invalid_row", "empty_prefix", "duplicate_timestamp", "no_anchor", "quote_gap", "supported"}


def test_a_snapshot_joins_no_ticks_to_decisions(spark):
    frame, asked = spark.createDataFrame([("a", 1, 1, 1.0, 2.0, True, False)], TICKS), spark.createDataFrame([("a", 1, 5)], "k string, decision_id long, us long")
    assert "Join" not in X.snapshot(asked, frame, ["k"], 3, 2, 9)._jdf.queryExecution().toString()


def test_best_candidates_are_shuffled_once(spark):
    """Events and ticks meet in buckets; the best of an event's candidates needs no window over events."""
    e = spark.createDataFrame([(1, 60, "OPEN", "buy", 1.0)], "event_id long, us long, type string, side string, price double")
    t = spark.createDataFrame([(61, 1, 1.0, 1.2), (62, 2, 1.0, 1.2)], "us long, seq long, bid double, ask double")
    best = align.best_candidates(e, t, [], 10)
    assert best.collect()[0].tick_seq == 1
    plan = best._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan


def test_controls_write_no_pool(spark, monkeypatch):
    """What is written grows with events and samples, not with the candidates, a row for each unit of each interval."""
    rows = {}

    def counted(df, label):
        out = written(df, label)
        rows[label] = out.count()
        return out

    monkeypatch.setattr(control_queries, "written", counted)
    small = "/root/testdata/sf0.001"
    assert control_queries.matched_controls(spark, small).count() > 0
    assert sum(rows.values()) < control_queries.control_pool(spark, small).count()
