"""The best candidate of each event without the list of all its ticks."""

from __future__ import annotations

import random

from ledgerloom.operators import align
from ledgerloom.plans import tick_queries
from ledgerloom.sources import digests
from ledgerloom.sources.shared import written

TICKS = "us long, seq long, bid double, ask double"
EVENTS = "event_id long, us long, type string, side string, price double"


def test_best_candidates_are_the_first_of_all(spark):
    """Prices on a grid, so that errors tie on both sides and at several times; some prices and quotes are null, some events have no ticks."""
    rng = random.Random(17)
    price = lambda: None if rng.random() < 0.1 else round(rng.randrange(40) * 0.1, 2)
    quotes = [(rng.randrange(0, 4000, rng.choice((1, 10))), k, price(), price()) for k in range(900)]
    events = [(k, rng.choice((rng.randrange(0, 8000, 10), rng.randrange(8000))), rng.choice(("OPEN", "CLOSE")), rng.choice(("buy", "sell")), price()) for k in range(600)]
    e, t = spark.createDataFrame(events, EVENTS), spark.createDataFrame(quotes, TICKS)
    columns = ["event_id", "tick_us", "tick_seq", "quote", "delta", "error", "tier", "as_good"]
    all_of = align.candidates(e, t, [], 10).filter("rank = 1").select(*columns).collect()
    assert len(all_of) == 600 and any(r.as_good > 1 for r in all_of) and any(r.tick_us is None for r in all_of)
    assert sorted(map(repr, align.best_candidates(e, t, [], 10).select(*columns).collect())) == sorted(map(repr, all_of))


def test_many_ticks_of_one_time_are_not_listed(spark, monkeypatch):
    """300 events meet 3,000 ticks of their unit: a row an event goes on, not 900,000."""
    e = spark.createDataFrame([(k, 60, "OPEN", "buy", 1.0) for k in range(300)], EVENTS)
    t = spark.createDataFrame([(61, k, 1.0, 1.2) for k in range(3000)], TICKS)
    sizes, nearest = spark.sparkContext.accumulator(0), align._nearest

    def counted(*args):
        run = nearest(*args)

        def own(rows):
            out = run(rows)
            sizes.add(out.num_rows)
            return out

        return own

    monkeypatch.setattr(align, "_nearest", counted)
    rows = align.best_candidates(e, t, [], 10).collect()
    assert len(rows) == 300 and {r.as_good for r in rows} == {3000} and sizes.value == 300


def test_digests_of_a_fixed_number_of_levels(spark):
    """Twenty rows by blocks of two: two levels leave five digests, whatever their number would need; one row has two levels too."""
    rows = spark.createDataFrame([(k, str(k)) for k in range(20)], "k long, v string")
    count = lambda df: digests.block_digests(df, ["k"], block=2, levels=2)[1].count()
    assert count(rows) == 5 and count(rows.filter("k = 0")) == 1
    one = digests.block_digests(rows.filter("k = 0"), ["k"], block=2, levels=2)[1].first().digest
    assert one != digests.block_digests(rows.filter("k = 0"), ["k"], block=2)[1].first().digest


def test_forward_window_lists_no_windows(spark, con_path="/root/testdata/sf0.001"):
    plan = tick_queries.Q["asof_forward_window"](spark, con_path)._jdf.queryExecution().toString()
    assert "_from" not in plan and "_to" not in plan


def test_candidates_are_those_of_listed_pairs(spark, monkeypatch):
    """Ranked within their buckets, in small parts, as the list of pairs ranked by event_id; events that share an id are ranked together."""
    rng = random.Random(23)
    monkeypatch.setattr(align, "PAIRS", 64)
    price = lambda: None if rng.random() < 0.1 else float("nan") if rng.random() < 0.05 else rng.choice((round(rng.randrange(40) * 0.1, 2), rng.random() * 4, rng.randrange(9) / 2 + 5e-10, 1e17))
    quotes = [(rng.randrange(0, 4000, rng.choice((1, 10))), k, price(), price()) for k in range(900)]
    events = [(k if k > 20 else k // 2, rng.choice((None, rng.randrange(0, 8000, 10), rng.randrange(4000))), rng.choice(("OPEN", "CLOSE")), rng.choice(("buy", "sell")), price()) for k in range(500)]
    e, t = spark.createDataFrame(events, EVENTS), spark.createDataFrame(quotes, TICKS)
    kept = ["event_id", "us", "type", "side", "price"]
    expected = sorted(map(repr, align._listed(e, t, [], 10, kept).collect()))
    assert len(expected) > 2000 and sorted(map(repr, align.candidates(e, t, [], 10).collect())) == expected


def test_listing_candidates_shuffles_no_pairs(spark):
    """30 events meet 3,000 ticks: 90,000 pairs go on, and nothing is shuffled after the buckets."""
    e = written(spark.createDataFrame([(k, 60, "OPEN", "buy", 1.0) for k in range(30)], EVENTS), "events")
    t = written(spark.createDataFrame([(60 + k % 5, k, float(k), float(k)) for k in range(3000)], TICKS), "ticks")
    found = align.candidates(e, t, [], 10, keep=["event_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.columns == ["event_id", *align.RANKED] and found.count() == 90_000
    above = plan[: plan.index("FlatMapGroupsInArrow")]
    assert "Exchange" not in above and "Window" not in above and "Join" not in plan
