"""Scores of hypotheses stay in a row an event, and units are resampled once for all their values."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.operators import hypotheses as Y
from ledgerloom.operators import models as M
from ledgerloom.plans import hypothesis_queries

N = len(Y.SCORES)


def test_values_of_a_unit_are_resampled_as_rows_of_their_own(spark):
    rng = random.Random(7)
    units = [(u, rng.choice("ab"), [None if rng.random() < 0.3 else rng.gauss(0.1, 1) for _ in range(3)] + [None]) for u in range(400)]
    found = M.resampled_places(spark.createDataFrame(units, "unit long, split string, v array<double>").repartition(3), ["split"], "v", ["unit"], 50, "s")
    rows = spark.createDataFrame([(u, s, p, x) for u, s, v in units for p, x in enumerate(v) if x is not None], "unit long, split string, place int, v double")
    expected = M.resampled(rows, ["split", "place"], "v", ["unit"], 50, "s", 0.05).join(rows.groupBy("split", "place").agg(F.avg((F.col("v") > 0).cast("int")).alias("separated")), ["split", "place"])
    names = ("units", "mean", "separated", "low", "high")
    plain = lambda df: {(r.split, r.place): [round(r[c], 9) for c in names] for r in df.collect()}
    assert len(plain(found)) == 6 and plain(found) == plain(expected)


def test_differences_are_of_whole_events_however_they_are_cut_into_batches():
    """Two windows; events of one row, without controls or without own rows; the cap is on the first window alone."""
    rng, shifts, caps = random.Random(9), (0, 5), [0.5, None]
    rows = [(e, shift, [None if rng.random() < 0.3 else rng.random() for _ in range(2 * N)]) for e in range(40) for shift in rng.sample([0, 5, None, None, None], rng.randrange(1, 6))]
    table = pa.table({"event_id": [r[0] for r in rows], "split": ["s"] * len(rows), "shift": pa.array([r[1] for r in rows], pa.int64()), "scores": pa.array([r[2] for r in rows], pa.list_(pa.float64()))})
    expected = {}
    for e in {r[0] for r in rows}:
        scores = lambda shift: [[v[w * N + k] if k < N else v[w * N + 2] if v[w * N + 2] is None or caps[w] is None else min(v[w * N + 2], caps[w]) for w in range(2) for k in range(N + 1)] for i, s, v in rows if i == e and s == shift]
        of_controls = [[x for x in column if x is not None] for column in zip(*scores(None))] or [[]] * 2 * (N + 1)
        own = [x for s in shifts for x in (scores(s) or [[None] * 2 * (N + 1)])[0]]
        expected[e] = [None if x is None or not c else round(x - np.mean(c), 9) for x, c in zip(own, of_controls * len(shifts))]
    for size in (1, 3, 1000):
        out = [r for b in Y._differences(shifts, caps)(iter(table.to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert {r["event_id"]: [None if x is None else round(x, 9) for x in r["differences"]] for r in out} == expected and len(out) == len(expected)
    assert [h for h, w, s in Y.places((15, 30), shifts)][: N + 1] == [*Y.SCORES, Y.CAPPED]


def test_moments_are_scored_once_and_scores_are_never_rows(spark, tmp_path, monkeypatch):
    """Accounts repeated with the same times have as many moments to score, and no table of a row for each score."""
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rows: list[dict] = []

    def counted(df, label, written=Y.written):
        out = written(df, label)
        rows[-1][label] = out.count()
        return out

    monkeypatch.setattr(Y, "written", counted)
    monkeypatch.setattr(hypothesis_queries, "written", counted)
    for copies in (1, 3):
        rows.append({})
        d = f"{tmp_path}/{copies}"
        repeated = e.crossJoin(spark.range(copies).select((F.col("id") * 1_000_000).alias("_r")))
        repeated.withColumns({"event_id": F.col("event_id") + F.col("_r"), "user_id": F.col("user_id") + F.col("_r")}).drop("_r").write.parquet(f"{d}/events.parquet")
        hypothesis_queries.effects_of(spark, d).collect()
    assert set(rows[0]) == {"hypothesis-controls", "hypothesis-moments", "hypothesis-scores"}
    # The controls dealt out depend on the account, so the moments are all but the same.
    assert rows[1]["hypothesis-moments"] < 2 * rows[0]["hypothesis-moments"] and rows[1]["hypothesis-scores"] <= rows[1]["hypothesis-moments"]
