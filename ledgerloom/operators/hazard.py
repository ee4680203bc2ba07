"""Hazards by age: tables of rates, their predictions, likelihoods and scores, and logistic fits by sums over all rows."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import bucket_label, clipped, expit, log_likelihood, logit, smoothed_rate
from ..sources.shared import written

# The buckets of a state's age in seconds, and the coarser ones of causes.
AGE_BOUNDS = (0, 1, 2, 3, 5, 6, 8, 10, 20, 30, 60)
AGE_LABELS = ("age_0_1", "age_1_2", "age_2_3", "age_3_5", "age_5_6", "age_6_8", "age_8_10", "age_10_20", "age_20_30", "age_30_60", "age_60_inf")
CAUSE_BOUNDS = (5, 6, 8, 10, 20, 30, 60)
CAUSE_LABELS = AGE_LABELS[4:]
# Blocks of server hours.
SESSION_BLOCKS = (("block_12_16", 12, 16), ("block_16_20", 16, 20), ("block_20_24", 20, 24))


def age_bucket(age: Column) -> Column:
    return bucket_label(age, AGE_BOUNDS, AGE_LABELS)


def cause_bucket(age: Column) -> Column:
    return bucket_label(age, CAUSE_BOUNDS, CAUSE_LABELS)


def one_hot(value: Column, labels: Sequence[str]) -> dict[str, Column]:
    """A 0/1 column for each label."""
    return {f"bucket__{label}": F.coalesce((value == label).cast("int"), F.lit(0)) for label in labels}


def session_blocks(hour: Column) -> dict[str, Column]:
    """A 0/1 column for each block; an hour outside them is an error when read."""
    inside = hour.between(SESSION_BLOCKS[0][1], SESSION_BLOCKS[-1][2] - 1)
    bad = F.raise_error(F.lit("an hour outside the session blocks")).cast("int")
    return {name: F.when(inside, ((hour >= a) & (hour < b)).cast("int")).otherwise(bad) for name, a, b in SESSION_BLOCKS}


def hazard_table(bins: DataFrame, alpha: float = 0.5, weight: str | None = None) -> DataFrame:
    """For each endpoint and age bucket (all buckets, seen or not) exposure, events and smoothed rate, and the endpoint's own.

    bins: endpoint, target, age; one row a bin, or ``weight`` alike. One grouped sum, written; the rest is a table of cells.
    """
    n = F.col(weight) if weight else F.lit(1).cast("bigint")
    cells = bins.groupBy("endpoint", age_bucket(F.col("age")).alias("bucket")).agg(F.sum(n).alias("exposure"), F.sum(F.col("target") * n).alias("events"))
    cells = written(cells, "hazard-cells")
    universe = cells.select("endpoint").distinct().withColumn("bucket", F.explode(F.array(*[F.lit(x) for x in AGE_LABELS])))
    full = universe.join(cells, ["endpoint", "bucket"], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("exposure", "events")})
    own = W.partitionBy("endpoint")
    full = full.withColumns({"all_exposure": F.sum("exposure").over(own), "all_events": F.sum("events").over(own)})
    p, constant = smoothed_rate(F.col("events"), F.col("exposure"), alpha), smoothed_rate(F.col("all_events"), F.col("all_exposure"), alpha)
    return full.select(
        "endpoint", "bucket", "exposure", "events", p.alias("p"), ((F.col("exposure") > 0) & (F.col("events") == 0)).alias("no_events"), (F.col("exposure") == 0).alias("no_exposure"), constant.alias("p_const")
    )


def predict_hazard(bins: DataFrame, table: DataFrame, strict: bool = False) -> DataFrame:
    """bins with p_const, p_age and fallback; an empty bucket has the endpoint's rate, or is an error if strict.

    The table has a row for each endpoint and bucket and is broadcast. An endpoint it lacks is an error.
    """
    cells = F.broadcast(table.select("endpoint", "bucket", "p", F.col("p_const").alias("_const")))
    out = bins.withColumn("bucket", age_bucket(F.col("age"))).join(cells, ["endpoint", "bucket"], "left")
    missing = F.raise_error(F.lit("an endpoint without rates")).cast("double")
    empty = F.raise_error(F.lit("a bucket without a rate")).cast("double") if strict else F.col("_const")
    const = F.coalesce("_const", missing)
    return out.withColumns({"p_const": clipped(const), "p_age": clipped(F.coalesce("p", empty)), "fallback": F.col("p").isNull()}).drop("p", "_const")


def interval_likelihoods(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Log likelihoods of each interval's bins by the constant and by age, and what age adds."""
    y = F.col("target")
    out = predictions.groupBy(*keys).agg(
        F.sum(log_likelihood(y, F.col("p_const"))).alias("ll_const"), F.sum(log_likelihood(y, F.col("p_age"))).alias("ll_age"), F.sum("target").alias("targets"), F.count(F.lit(1)).alias("bins")
    )
    return out.withColumn("delta", F.col("ll_age") - F.col("ll_const"))


def conditional_timing(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """For intervals with one event: its bin's share of the odds of all bins, against a uniform one, and its rank.

    Sums by interval only: log-sum-exp from the largest log odds, and a count of the bins above the event's.
    """
    own = W.partitionBy(*keys)
    z = predictions.withColumn("z", logit(F.col("p_age")))
    z = z.withColumns({"events": F.sum("target").over(own), "top": F.max("z").over(own), "event_z": F.max(F.when(F.col("target") == 1, F.col("z"))).over(own), "event_p": F.max(F.when(F.col("target") == 1, clipped(F.col("p_age")))).over(own)})
    out = z.filter("events = 1").groupBy(*keys).agg(
        F.max("event_z").alias("event_z"), F.max("top").alias("top"), F.sum(F.exp(F.col("z") - F.col("top"))).alias("odds"), F.count_if(clipped(F.col("p_age")) > F.col("event_p")).alias("above"), F.count(F.lit(1)).alias("bins")
    )
    log_p, uniform = F.col("event_z") - F.col("top") - F.ln("odds"), -F.ln("bins")
    return out.select(*keys, log_p.alias("log_p"), uniform.alias("uniform"), (log_p - uniform).alias("gain"), F.exp(log_p).alias("p"), (F.col("above") + 1).alias("rank"), "bins")


def scores(predictions: DataFrame, keys: Sequence[str], p: str, weight: str | None = None) -> DataFrame:
    """Events, AUC (ties at their average rank), Brier score, accuracy and confusion at one half.

    Rows are summed by probability first, so the ranks are over distinct probabilities, of which a
    table of rates has as many as cells. The AUC is null where one class is missing. ``weight``: how many rows a row stands for.
    """
    n = F.col(weight) if weight else F.lit(1).cast("bigint")
    cells = predictions.groupBy(*keys, F.col(p).alias("p")).agg(F.sum(n).alias("n"), F.sum(F.col("target") * n).cast("bigint").alias("pos"))
    below = W.partitionBy(*keys).orderBy("p").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.withColumn("rank", F.coalesce(F.sum("n").over(below), F.lit(0)) + (F.col("n") + 1) / 2)
    neg, yes = F.col("n") - F.col("pos"), F.col("p") >= 0.5
    pick = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    out = cells.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.sum("pos").alias("events"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"), F.sum(F.col("pos") * (1 - F.col("p")) * (1 - F.col("p")) + neg * F.col("p") * F.col("p")).alias("squares"),
        pick(~yes, neg).alias("true_negative"), pick(yes, neg).alias("false_positive"), pick(~yes, F.col("pos")).alias("false_negative"), pick(yes, F.col("pos")).alias("true_positive"),
    )
    e, m = F.col("events"), F.col("n") - F.col("events")
    auc = F.when((e > 0) & (m > 0), (F.col("ranks") - e * (e + 1) / 2) / (e * m))
    return out.select(*keys, "n", "events", auc.alias("auc"), (F.col("squares") / F.col("n")).alias("brier"), ((F.col("true_positive") + F.col("true_negative")) / F.col("n")).alias("accuracy"), "true_negative", "false_positive", "false_negative", "true_positive")


def calibration(predictions: DataFrame, keys: Sequence[str], p: str, bins: int = 10) -> DataFrame:
    """Mean prediction and share of events in equal bins of probability; the last one has both ends."""
    place = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")
    return predictions.groupBy(*keys, place).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg("target").alias("observed"))


def correlation(a: str, b: str) -> Column:
    """Pearson's, null where one of the columns doesn't vary."""
    varies = (F.stddev_pop(a) > 0) & (F.stddev_pop(b) > 0)
    return F.when(varies, F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))


def shifted(p: Column, by: float) -> Column:
    """A probability whose log odds are shifted, as under another base rate."""
    return expit(logit(p) + by)


def fit_scaler(rows: DataFrame, columns: Sequence[str], unscaled: Sequence[str] = ()) -> dict[str, tuple[float, float]]:
    """Mean and population deviation (1 where it is 0) of each column, one sum over all rows; a value that isn't finite is an error. Unscaled ones get (0, 1)."""
    scaled = [c for c in columns if c not in unscaled]
    finite = lambda c: F.coalesce(F.col(c).cast("double") - F.col(c).cast("double") == 0, F.lit(False))
    aggs = [x for c in scaled for x in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]
    row = rows.agg(*[F.count_if(~finite(c)).alias(f"bad_{c}") for c in columns], *aggs).first()
    bad = [c for c in columns if row[f"bad_{c}"]]
    if bad:
        raise ValueError(f"values that aren't finite: {', '.join(bad)}")
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) if c in scaled else (0.0, 1.0) for c in columns}


def scale(scaler: dict[str, tuple[float, float]]) -> dict[str, Column]:
    return {c: (F.col(c) - m) / s for c, (m, s) in scaler.items()}


def linear(columns: Sequence[str], theta: Sequence[float], intercept: float = 0.0) -> Column:
    out = F.lit(float(intercept))
    for c, t in zip(columns, theta):
        out = out + F.col(c) * F.lit(float(t))
    return out


def fit_logistic(
    rows: DataFrame, columns: Sequence[str], label: str, regularization: float = 0.0, offset: str | None = None, intercept: bool = True, weight: str | None = None, rounds: int = 100, tolerance: float = 1e-9
) -> tuple[float, list[float]]:
    """(intercept, coefficients) of a logistic regression with a quadratic penalty on all but the intercept.

    Damped Newton steps: each is one sum over all rows of the gradient, the second derivatives and the
    objective, a few numbers per column, so nothing but those reaches the driver. The objective is the
    mean of the negative log likelihood plus half the penalty. A step that doesn't lower it is halved.
    ``weight``: how many rows a row stands for.
    """
    x = ["_one", *columns] if intercept else list(columns)
    rows = rows.withColumn("_one", F.lit(1.0)).withColumn("_offset", F.col(offset) if offset else F.lit(0.0)).withColumn("_w", F.col(weight) if weight else F.lit(1))
    penalty = np.full(len(x), float(regularization))
    penalty[: int(intercept)] = 0.0
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        p = expit(F.col("_offset") + linear(x, theta))
        own = rows.withColumns({"_p": p, "_y": F.col(label).cast("double")})
        row = own.agg(
            F.sum("_w").alias("n"), F.sum(F.col("_w") * log_likelihood(F.col("_y"), F.col("_p"))).alias("ll"),
            *[F.sum(F.col("_w") * (F.col("_p") - F.col("_y")) * F.col(c)).alias(f"g{i}") for i, c in enumerate(x)],
            *[F.sum(F.col("_w") * F.col("_p") * (1 - F.col("_p")) * F.col(x[i]) * F.col(x[j])).alias(f"h{i}_{j}") for i, j in pairs],
        ).first()
        if not row["n"]:
            raise ValueError("no rows to fit")
        gradient = np.array([row[f"g{i}"] for i in range(len(x))]) / row["n"] + penalty * theta
        hessian = np.zeros((len(x), len(x)))
        for i, j in pairs:
            hessian[i, j] = hessian[j, i] = row[f"h{i}_{j}"] / row["n"]
        return -row["ll"] / row["n"] + 0.5 * float(penalty * theta @ theta), gradient, hessian + np.diag(penalty)

    theta = np.zeros(len(x))
    objective, gradient, hessian = sums(theta)
    for _ in range(rounds):
        step = np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        if np.abs(step).max() <= tolerance:
            break
        for _ in range(30):
            found = sums(theta - step)
            if found[0] <= objective + 1e-14:
                break
            step = step / 2
        else:
            if np.abs(gradient).max() <= 1e-7:
                break
            raise ValueError("the fit doesn't converge")
        theta, (objective, gradient, hessian) = theta - step, found
    else:
        raise ValueError("the fit doesn't converge")
    values = [float(t) for t in theta]
    return (values[0], values[1:]) if intercept else (0.0, values)


def fit_offset_intercept(rows: DataFrame, label: str, p: str) -> float:
    """What to add to the log odds of p so that the mean prediction is the share of events."""
    return fit_logistic(rows.withColumn("_logit", logit(F.col(p))), [], label, offset="_logit", tolerance=1e-10)[0]
