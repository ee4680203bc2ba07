"""Many logistic fits at once, their predictions by interval, and resampled means.

A step of all fits is one job: each task turns its rows into the sums that every model needs (of the
gradient, the second derivatives and the objective), and the tasks' sums are added up in two levels.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import EPSILON, expit, log_likelihood, logit
from ..sources.shared import written
from .hazard import linear


@dataclass(frozen=True)
class Model:
    """A logistic regression of the label on columns over the rows in which ``where`` (a boolean column) holds.

    offset: a column of log odds that are added. The penalty is on all coefficients but the intercept.
    """

    name: str
    columns: tuple[str, ...]
    where: str | None = None
    offset: str | None = None
    intercept: bool = True
    penalty: float = 0.0

    @property
    def size(self) -> int:
        return len(self.columns) + self.intercept


@dataclass(frozen=True)
class Fit:
    model: Model
    theta: tuple[float, ...]
    steps: int

    @property
    def intercept(self) -> float:
        return self.theta[0] if self.model.intercept else 0.0

    @property
    def coefficients(self) -> tuple[float, ...]:
        return self.theta[int(self.model.intercept) :]

    def predict(self) -> Column:
        """The probability of a row."""
        own = linear(self.model.columns, self.coefficients, self.intercept)
        return expit(own + F.col(self.model.offset) if self.model.offset else own)


SUMS = "model int, part int, sums array<double>"


def gram_sums(models: Sequence[Model], thetas: Sequence[np.ndarray], label: str, weight: str | None = None) -> Callable:
    """For each model a task's rows, log likelihood, gradient and second derivatives at its theta, as one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        totals = [np.zeros(2 + m.size + m.size**2) for m in models]
        for batch in batches:
            value = {c: batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in batch.schema.names}
            for m, theta, total in zip(models, thetas, totals):
                rows = np.flatnonzero(value[m.where] == 1) if m.where else np.arange(batch.num_rows)
                x = np.ones((len(rows), m.size))
                for k, c in enumerate(m.columns, int(m.intercept)):
                    x[:, k] = value[c][rows]
                y, offset = value[label][rows], value[m.offset][rows] if m.offset else 0.0
                n = value[weight][rows] if weight else np.ones(len(rows))
                if not (np.isfinite(x).all() and np.isfinite(y).all() and np.isfinite(offset).all()):
                    raise ValueError(f"{m.name}: a value that isn't finite")
                z = offset + x @ theta
                p = np.clip(np.exp(-np.logaddexp(0, -z)), EPSILON, 1 - EPSILON)
                total[0] += n.sum()
                total[1] += (n * (y * np.log(p) + (1 - y) * np.log1p(-p))).sum()
                total[2 : 2 + m.size] += x.T @ (n * (p - y))
                total[2 + m.size :] += ((x * (n * p * (1 - p))[:, None]).T @ x).ravel()
        part = TaskContext.get().partitionId() % 16
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(models), dtype=np.int32)), pa.array(np.full(len(models), part, np.int32)), pa.array([t.tolist() for t in totals], pa.list_(pa.float64()))], names=["model", "part", "sums"])

    return run


def add_up(rows: pa.Table) -> pa.Table:
    """One row for a group, its arrays added."""
    total = np.sum([r.values.to_numpy() for chunk in rows["sums"].chunks for r in chunk], axis=0)
    return pa.table({"model": rows["model"].slice(0, 1), "part": rows["part"].slice(0, 1), "sums": pa.array([total.tolist()], pa.list_(pa.float64()))})


def fit_many(rows: DataFrame, models: Sequence[Model], label: str, rounds: int = 100, tolerance: float = 1e-9, weight: str | None = None) -> dict[str, Fit]:
    """Penalized logistic regressions by damped Newton steps, one job a step for all of them.

    The objective is the mean of the negative log likelihood plus half the penalty; a step that doesn't
    lower it is halved, for that model alone. rows should be a written table: each step reads it. What
    reaches the driver is a model's second derivatives, the square of its columns. A model without rows,
    a value that isn't finite, and a fit that doesn't converge are errors. ``weight``: how many rows a row stands for.
    """
    columns = sorted({c for m in models for c in (*m.columns, m.where, m.offset, label, weight) if c})
    own = rows.select(*[F.col(c).cast("double").alias(c) for c in columns])
    state: dict[str, dict] = {m.name: {"theta": np.zeros(m.size), "step": np.zeros(m.size), "n": 0} for m in models}
    done: dict[str, Fit] = {}
    for _ in range(rounds * 2):
        open_ = [m for m in models if m.name not in done]
        if not open_:
            return done
        trial = [state[m.name]["theta"] - state[m.name]["step"] for m in open_]
        sums = own.mapInArrow(gram_sums(open_, trial, label, weight), SUMS)
        sums = sums.groupBy("model", "part").applyInArrow(add_up, SUMS).groupBy("model").applyInArrow(add_up, SUMS)
        gathered = sums.collect()
        if not gathered:
            raise ValueError(f"{open_[0].name}: no rows to fit")
        for r in gathered:
            m, at = open_[r.model], state[open_[r.model].name]
            total, penalty = np.array(r.sums), np.full(m.size, m.penalty)
            penalty[: int(m.intercept)] = 0.0
            n, theta = total[0], trial[r.model]
            if not n:
                raise ValueError(f"{m.name}: no rows to fit")
            objective = -total[1] / n + 0.5 * float(penalty * theta @ theta)
            if at["n"] and objective > at["objective"] + 1e-14:
                at["step"], at["halved"] = at["step"] / 2, at["halved"] + 1
                if at["halved"] > 30:
                    if np.abs(at["gradient"]).max() > 1e-7:
                        raise ValueError(f"{m.name}: the fit doesn't converge")
                    done[m.name] = Fit(m, tuple(at["theta"].tolist()), at["n"])
                continue
            gradient = total[2 : 2 + m.size] / n + penalty * theta
            step = np.linalg.lstsq(total[2 + m.size :].reshape(m.size, m.size) / n + np.diag(penalty), gradient, rcond=None)[0]
            at |= {"theta": theta, "objective": objective, "gradient": gradient, "step": step, "halved": 0, "n": at["n"] + 1}
            if np.abs(step).max(initial=0.0) <= tolerance:
                done[m.name] = Fit(m, tuple(theta.tolist()), at["n"])
    raise ValueError("the fits don't converge")


def scaled_by(rows: DataFrame, key: str, fitted: Column, columns: dict[str, Sequence[str]], suffix: str = "_z", weight: str | None = None) -> DataFrame:
    """rows with each key's columns less their mean and over their population deviation (1 where it is 0) among the fitted rows, as new columns; null for other keys.

    One grouped sum, or two where ``weight`` says how many rows a row stands for; a row a key comes to the driver.
    """
    names = sorted({c for own in columns.values() for c in own})
    own, spread = rows.filter(fitted), {c: F.stddev_pop(c) for c in names}
    mean = {c: F.avg(c) for c in names}
    if weight:
        share = lambda x: F.sum(F.col(weight) * x) / F.sum(F.when(x.isNotNull(), F.col(weight)))
        mean = {c: share(F.col(c)) for c in names}
        means = {r[key]: r for r in own.groupBy(key).agg(*[mean[c].alias(c) for c in names]).collect()}
        middle = lambda c: F.coalesce(*[F.when(F.col(key) == k, F.lit(r[c])) for k, r in means.items()], F.lit(None).cast("double"))
        # A constant's mean has rounding left, its deviation must not.
        spread = {c: F.when(F.min(c) == F.max(c), 0.0).otherwise(F.sqrt(share((F.col(c) - middle(c)) * (F.col(c) - middle(c))))) for c in names}
    stats = own.groupBy(key).agg(*[x for c in names for x in (mean[c].alias(f"m_{c}"), spread[c].alias(f"s_{c}"))]).collect()
    by = {r[key]: r for r in stats}
    out = {}
    for c in names:
        chain = F.lit(None).cast("double")
        for k, own in columns.items():
            if c in own and k in by and by[k][f"m_{c}"] is not None:
                chain = F.when(F.col(key) == k, (F.col(c) - by[k][f"m_{c}"]) / (by[k][f"s_{c}"] or 1.0)).otherwise(chain)
        out[f"{c}{suffix}"] = chain
    return rows.withColumns(out)


def model_deltas(bins: DataFrame, predictions: DataFrame, keys: Sequence[str], cell: Sequence[str], models: Sequence[str], deltas: Sequence[tuple[str, str]]) -> DataFrame:
    """Log likelihoods of an interval's bins by each model (columns p_<model>), all over the same rows, and the differences of pairs of models.

    bins: keys and the columns of ``cell``, which name a row of predictions; bins without one, and intervals without
    such a bin, don't count. Intervals of the same bins have the same sums, which are found once for each set of bins.
    """
    common, inner = [k for k in keys if k in cell], [c for c in cell if c not in keys]
    names = [*[f"ll_{m}" for m in models], "targets", "bins"]
    found = predictions.select(*cell, *[log_likelihood(F.col("target"), F.col(f"p_{m}")).alias(f"ll_{m}") for m in models])
    own = bins.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*inner))).alias("_bins"))
    own = written(own.withColumn("_digest", F.xxhash64("_bins")), "interval-bins")
    alike = ["_digest", *common, "_bins"]
    sets = written(own.select(*alike).distinct().withColumn("_set", F.monotonically_increasing_id()), "bin-sets")
    each = sets.select("_set", *common, F.inline("_bins")).join(found.hint("merge"), list(cell))
    sums = each.groupBy("_set").agg(*[F.sum(f"ll_{m}").alias(f"ll_{m}") for m in models], F.sum("target").alias("targets"), F.count(F.lit(1)).alias("bins"))
    sums = sets.join(sums.hint("merge"), "_set").select(*alike, *names)
    out = own.join(sums.hint("merge"), alike).select(*keys, *names)
    return out.withColumns({f"{a}_minus_{b}": F.col(f"ll_{a}") - F.col(f"ll_{b}") for a, b in deltas})


def offset_of(p: str | Column) -> Column:
    """The log odds of a probability, as an offset."""
    return logit(F.col(p) if isinstance(p, str) else p)


def poisson_bounds(digits: int = 8) -> list[int]:
    """From which number of so many hexadecimal digits on a Poisson count of mean 1 is at least 1, 2, and so on."""
    out, total, k = [], 0.0, 0
    while True:
        total += math.exp(-1) / math.factorial(k)
        bound = round(total * 16**digits)
        if bound >= 16**digits:
            return out
        out.append(bound)
        k += 1


def resampled(units: DataFrame, keys: Sequence[str], value: str, unit: Sequence[str], draws: int, seed: str, one_sided: float) -> DataFrame:
    """Of each key's units the mean of a value, and percentile intervals of it when units are drawn with replacement.

    Nothing is drawn by position: how often a unit is in a draw is a Poisson number of mean 1 from a
    digest of seed, unit and draw, so a draw's sums are sums over rows, combined in each task before they
    are shuffled: a row for each key and draw. A draw's mean is its values' sum over its units' count.
    """
    digest = F.md5(F.concat_ws("|", F.lit(seed), *[F.col(u).cast("string") for u in unit], F.col("block").cast("string")))
    rows = units.select(*keys, *[u for u in unit if u not in keys], F.col(value).cast("double").alias("_v")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws - 1) // 4))))
    rows = rows.withColumn("_digest", digest).withColumn("k", F.explode(F.array(*[F.lit(k) for k in range(4)])))
    number = F.conv(F.substring(F.col("_digest"), F.col("k") * 8 + 1, F.lit(8)), 16, 10).cast("bigint")
    times = F.lit(0)
    for bound in poisson_bounds():
        times = times + (number >= bound).cast("int")
    rows = rows.withColumns({"draw": F.col("block") * 4 + F.col("k"), "_times": times}).filter(F.col("draw") < draws)
    sums = rows.groupBy(*keys, "draw").agg(F.sum("_times").alias("n"), F.sum(F.col("_times") * F.col("_v")).alias("s")).filter("n > 0")
    found = sums.groupBy(*keys).agg(*[F.percentile(F.col("s") / F.col("n"), q).alias(name) for name, q in (("low", 0.025), ("high", 0.975), ("one_sided_low", one_sided))], F.count(F.lit(1)).alias("draws"))
    means = units.groupBy(*keys).agg(F.count(F.lit(1)).alias("units"), F.avg(value).alias("mean"))
    matching = F.lit(True)
    for k in keys:
        matching = matching & F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}"))
    return means.alias("m").join(found.alias("f"), matching).select("m.*", "f.low", "f.high", "f.one_sided_low", "f.draws")


def _draw_sums(keys: Sequence[str], values: str, draws: int) -> Callable:
    """For each key and place a task's units, sum and number above 0 (draw -1), and the units and sums of each draw."""
    bounds = np.array(poisson_bounds())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, np.ndarray] = {}
        for batch in batches:
            flat = batch.column(values).flatten()
            if not len(flat):
                continue
            known = ~flat.is_null().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            value = np.where(known, flat.to_numpy(zero_copy_only=False).reshape(known.shape), 0.0)
            digests = b"".join(md5(f"{u}|{block}".encode(), usedforsecurity=False).digest() for u in batch.column("_unit").to_pylist() for block in range((draws - 1) // 4 + 1))
            times = np.searchsorted(bounds, np.frombuffer(digests, ">u4").reshape(batch.num_rows, -1)[:, :draws].astype(np.int64), "right").astype(float)
            weights = np.hstack([np.ones((batch.num_rows, 1)), times])
            own = list(zip(*[batch.column(k).to_pylist() for k in keys])) if keys else [()] * batch.num_rows
            for key in set(own):
                at = np.array([k == key for k in own])
                n, s = known[at].T.astype(float) @ weights[at], value[at].T @ weights[at]
                above = np.zeros_like(n)
                above[:, 0] = (known[at] & ~(value[at] <= 0)).sum(axis=0)
                totals[key] = totals.get(key, 0) + np.stack([n, s, above])
        for key, (n, s, above) in totals.items():
            place, draw = (x.ravel() for x in np.indices(n.shape))
            fields = [pa.array([k] * len(place)) for k in key] + [pa.array(place.astype(np.int32)), pa.array(draw.astype(np.int32) - 1), pa.array(n.ravel().astype(np.int64)), pa.array(s.ravel()), pa.array(above.ravel().astype(np.int64))]
            yield pa.RecordBatch.from_arrays(fields, names=[*keys, "place", "draw", "n", "s", "above"])

    return run


def resampled_places(units: DataFrame, keys: Sequence[str], values: str, unit: Sequence[str], draws: int, seed: str) -> DataFrame:
    """resampled() for units with many values each: an array, whose places are groups of their own; null where a unit isn't in one.

    (keys, place, units, mean, separated, low, high); separated is the share of values above 0. keys are strings. All arrays have one
    length. A unit's numbers in the draws are found once for all its places, and a task sums up its units' products with them.
    """
    own = units.select(*keys, values, F.concat_ws("|", F.lit(seed), *[F.col(u).cast("string") for u in unit]).alias("_unit"))
    shape = "".join(f"`{k}` string, " for k in keys) + "place int, draw int, n bigint, s double, above bigint"
    sums = own.mapInArrow(_draw_sums(keys, values, draws), shape).groupBy(*keys, "place", "draw").agg(*[F.sum(c).alias(c) for c in ("n", "s", "above")]).filter("n > 0")
    drawn, all_ = F.col("draw") >= 0, lambda c: F.max(F.when(F.col("draw") < 0, c))
    mean = F.col("s") / F.col("n")
    out = sums.groupBy(*keys, "place").agg(
        all_(F.col("n")).alias("units"), all_(mean).alias("mean"), all_(F.col("above") / F.col("n")).alias("separated"),
        *[F.percentile(F.when(drawn, mean), q).alias(name) for name, q in (("low", 0.025), ("high", 0.975))], F.count_if(drawn).alias("_draws"),
    )
    return out.filter("_draws > 0").drop("_draws")


def agreeing_runs(windows: DataFrame, keys: Sequence[str], order: str, least: int = 30) -> DataFrame:
    """For each key a verdict over neighbouring windows, from pairs, low and high of each.

    A window's sign is that of its interval if that doesn't hold 0 and ``least`` pairs support it. Two
    neighbours or more above 0 are supported, below 0 rejected, both mixed; a single sign is weak,
    none inconclusive.
    """
    from pyspark.sql import Window as W

    sign = F.when((F.col("units") < least) | F.col("low").isNull(), 0).when(F.col("low") > 0, 1).when(F.col("high") < 0, -1).otherwise(0)
    rows = windows.withColumn("sign", sign).withColumn("before", F.lag(sign).over(W.partitionBy(*keys).orderBy(order)))
    pair = lambda s: F.coalesce(F.bool_or((F.col("sign") == s) & (F.col("before") == s)), F.lit(False))
    out = rows.groupBy(*keys).agg(pair(1).alias("up"), pair(-1).alias("down"), F.bool_or(F.col("sign") != 0).alias("any"), F.count(F.lit(1)).alias("windows"))
    verdict = F.when(F.col("up") & F.col("down"), "mixed").when(F.col("up"), "supported").when(F.col("down"), "rejected").when(F.col("any"), "weak").otherwise("inconclusive")
    return out.select(*keys, "windows", verdict.alias("verdict"))
