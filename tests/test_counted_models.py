"""Models are fitted over counted cells, and intervals of the same bins share their sums."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import hazard as H
from ledgerloom.operators import models as M
from ledgerloom.plans import model_queries as Q


def test_weighted_steps_are_those_of_repeated_rows(spark):
    rng = random.Random(11)
    cells = [(rng.choice("ab"), rng.random() < 0.4, rng.gauss(0, 2), rng.choice((None, 1.0, 2.5)), 0.1, rng.randrange(90) / 2, rng.randrange(1, 6)) for _ in range(300)]
    cells = spark.createDataFrame([(k, int(y), x, z, c, age, n) for k, y, x, z, c, age, n in cells], "endpoint string, target int, x double, z double, c double, age double, n long")
    rows = cells.withColumn("_", F.explode(F.sequence(F.lit(1), "n"))).drop("_", "n")
    columns = {"a": ["x", "z", "c"], "b": ["x", "c"]}
    plain = lambda df: sorted([str(None if v is None else round(v, 9) if isinstance(v, float) else v) for v in r] for r in df.distinct().collect())
    scaled = lambda df, **w: M.scaled_by(df, "endpoint", F.col("x") > -1, columns, **w).drop("n")
    assert plain(scaled(cells, weight="n")) == plain(scaled(rows))
    assert scaled(cells, weight="n").filter("abs(c_z) > 1e-12").isEmpty()
    models = [M.Model("one", ("x", "c"), penalty=0.01), M.Model("two", ("x",), intercept=False)]
    weighted, repeated = (M.fit_many(df, models, "target", **w) for df, w in ((cells, {"weight": "n"}), (rows, {})))
    assert [weighted[m.name].theta for m in models] == [pytest.approx(repeated[m.name].theta, abs=1e-8) for m in models]
    assert plain(H.hazard_table(cells, weight="n")) == plain(H.hazard_table(rows))
    p = F.round(F.abs("x") / 10, 1).alias("p")
    assert plain(H.scores(cells.select("*", p), ["endpoint"], "p", weight="n")) == plain(H.scores(rows.select("*", p), ["endpoint"], "p"))


def test_intervals_of_the_same_bins_have_the_same_sums(spark):
    """Bins without a prediction don't count, nor do intervals that have no other; one interval is longer than another, and one has two bins of a cell."""
    predictions = spark.createDataFrame([("e", s, b, int(b == 3), 0.1 * (b + 1) + 0.01 * s, 0.3) for s in range(2) for b in range(4)], "endpoint string, start long, bin long, target int, p_a double, p_b double")
    intervals = {("x", 1): (0, [0, 1, 2]), ("y", 1): (0, [2, 1, 0]), ("x", 2): (0, [0, 1, 3]), ("y", 2): (1, [0, 1, 2]), ("y", 3): (1, [7, 8]), (None, 4): (1, [1, 9]), ("z", 5): (1, [1, 1])}
    bins = spark.createDataFrame([("e", a, i, s, b, int(b == 3)) for (a, i), (s, own) in intervals.items() for b in own], "endpoint string, acct string, id long, start long, bin long, target int")
    found = M.model_deltas(bins, predictions, ["endpoint", "acct", "id"], ["endpoint", "start", "bin", "target"], ["a", "b"], [("a", "b")]).collect()
    ll = lambda b, p: math.log(p if b == 3 else 1 - p)
    expected = {}
    for key, (s, own) in intervals.items():
        own = [b for b in own if b < 4]
        if own:
            a, b = sum(ll(x, 0.1 * (x + 1) + 0.01 * s) for x in own), sum(ll(x, 0.3) for x in own)
            expected[key] = (round(a, 9), round(b, 9), own.count(3), len(own), round(a - b, 9))
    assert {(r.acct, r.id): (round(r.ll_a, 9), round(r.ll_b, 9), r.targets, r.bins, round(r.a_minus_b, 9)) for r in found} == expected


def test_fits_read_cells_not_bins(spark, tmp_path, monkeypatch):
    """Accounts repeated with the same times have as many cells to fit, and more bins to score."""
    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    rows, scores, deltas, fit_many = [], [], [], M.fit_many
    monkeypatch.setattr(Q.M, "fit_many", lambda own, *a, **k: rows.append(own.count()) or fit_many(own, *a, **k))
    for copies in (2, 4):  # a window needs two ticks
        d = f"{tmp_path}/{copies}"
        repeated = e.crossJoin(spark.range(copies).select((F.col("id") * 1_000_000).alias("_r")))
        repeated.withColumns({"event_id": F.col("event_id") + F.col("_r"), "user_id": F.col("user_id") + F.col("_r")}).drop("_r").write.parquet(f"{d}/events.parquet")
        found = Q.predictions_of(spark, d)
        held = found[1].filter("role <> 'development'")
        scores.append({r.endpoint: (r.n / copies, r.events / copies) for r in H.scores(held, ["endpoint"], "p_c_session", weight="n").collect()})
        deltas.append(M.model_deltas(*found, Q.KEYS, Q.CELL, Q.MODELS, Q.DELTAS).groupBy(F.pmod("acct", F.lit(1_000_000)).alias("acct"), "endpoint", "role", "interval_id").agg(F.min("bins"), F.max("bins")).count())
    assert rows[:2] == rows[2:] and rows[0] > 0
    assert scores[0] == scores[1] and scores[0] and deltas[0] == deltas[1] > 0
