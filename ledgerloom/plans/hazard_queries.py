"""Hazards by tradeable age over eligible bins; ages are counted in bins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import age_stratum, logit, smoothed_rate
from ..operators import hazard as H
from ..operators.order import DAY, HOUR
from ..schema import allow_only
from ..sources.shared import written
from .interval_queries import SUPPORT_SQL, WIDTH, support_of

Q, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def bucket_sql(bounds, labels, age="age") -> str:
    return "CASE " + " ".join(f"WHEN {age} >= {b} THEN '{x}'" for b, x in reversed(list(zip(bounds, labels)))) + " END"


AGES_SQL = f"{SUPPORT_SQL}, ages AS (SELECT acct, interval_id, endpoint, bin_start, target, age_us / {float(WIDTH)} AS age, split FROM support WHERE is_eligible)"


def ages(spark, d, support=None):
    b = (support_of(spark, d) if support is None else support).filter("is_eligible")
    return b.select("acct", "interval_id", "endpoint", "bin_start", "target", (F.col("age_us") / float(WIDTH)).alias("age"), "split")


@query(
    "age_bucket_counts",
    f"""WITH {AGES_SQL} SELECT endpoint, {bucket_sql(H.AGE_BOUNDS, H.AGE_LABELS)} AS bucket, {bucket_sql(H.CAUSE_BOUNDS, H.CAUSE_LABELS)} AS cause_bucket,
  CASE WHEN age <= 6 THEN '0-6s' WHEN age <= 10 THEN '7-10s' WHEN age <= 30 THEN '10-30s' WHEN age <= 60 THEN '30-60s' ELSE '>60s' END AS stratum, count(*) AS n FROM ages GROUP BY ALL""",
)
def age_bucket_counts(spark, d):
    age = F.col("age")
    return ages(spark, d).groupBy("endpoint", H.age_bucket(age).alias("bucket"), H.cause_bucket(age).alias("cause_bucket"), age_stratum(age).alias("stratum")).agg(F.count(F.lit(1)).alias("n"))


@query("age_design", f"WITH {AGES_SQL} SELECT endpoint, " + ", ".join(f"count(*) FILTER ({bucket_sql(H.AGE_BOUNDS, H.AGE_LABELS)} = '{x}') AS bucket__{x}" for x in H.AGE_LABELS) + ", count(*) AS n FROM ages GROUP BY endpoint")
def age_design(spark, d):
    """The sums of the one-hot columns; exactly one is set in each row."""
    a = ages(spark, d).withColumns(H.one_hot(H.age_bucket(F.col("age")), H.AGE_LABELS))
    return a.groupBy("endpoint").agg(*[F.sum(f"bucket__{x}").alias(f"bucket__{x}") for x in H.AGE_LABELS], F.count(F.lit(1)).alias("n"))


TABLE_SQL = f"""{AGES_SQL}, cells AS (SELECT endpoint, {bucket_sql(H.AGE_BOUNDS, H.AGE_LABELS)} AS bucket, count(*) AS exposure, sum(target) AS events FROM ages WHERE split = 'development' GROUP BY ALL),
rates AS (SELECT e.endpoint, l.bucket, coalesce(exposure, 0) AS exposure, CAST(coalesce(events, 0) AS BIGINT) AS events, CASE WHEN exposure > 0 THEN (events + 0.5) / (exposure + 1.0) END AS p,
  coalesce(exposure, 0) > 0 AND coalesce(events, 0) = 0 AS no_events, exposure IS NULL AS no_exposure, (sum(coalesce(events, 0)) OVER w + 0.5) / (sum(coalesce(exposure, 0)) OVER w + 1.0) AS p_const
  FROM (SELECT DISTINCT endpoint FROM cells) e CROSS JOIN (SELECT unnest({list(H.AGE_LABELS)}) AS bucket) l LEFT JOIN cells c ON c.endpoint = e.endpoint AND c.bucket = l.bucket WINDOW w AS (PARTITION BY e.endpoint))"""


@query("age_hazard_table", f"WITH {TABLE_SQL} SELECT endpoint, bucket, exposure, events, round(p, 12) AS p, no_events, no_exposure, round(p_const, 12) AS p_const FROM rates")
def age_hazard_table(spark, d):
    """Fitted on the development days."""
    t = H.hazard_table(ages(spark, d).filter("split = 'development'"))
    return t.withColumns({c: F.round(c, 12) for c in ("p", "p_const")})


PREDICTED_SQL = f"""{TABLE_SQL}, clip AS (SELECT endpoint, bucket, least(greatest(coalesce(p, p_const), 1e-12), 1 - 1e-12) AS p_age, least(greatest(p_const, 1e-12), 1 - 1e-12) AS p_const, p IS NULL AS fallback FROM rates),
predicted AS (SELECT a.*, p_age, p_const, fallback FROM ages a JOIN clip c ON c.endpoint = a.endpoint AND c.bucket = {bucket_sql(H.AGE_BOUNDS, H.AGE_LABELS)})"""


def predicted(spark, d):
    a = written(ages(spark, d), "ages")
    return H.predict_hazard(a, H.hazard_table(a.filter("split = 'development'")))


@query("age_hazard_predictions", f"WITH {PREDICTED_SQL} SELECT acct, interval_id, endpoint, split, bin_start, target, round(p_const, 12) AS p_const, round(p_age, 12) AS p_age, fallback FROM predicted")
def age_hazard_predictions(spark, d):
    return predicted(spark, d).select("acct", "interval_id", "endpoint", "split", "bin_start", "target", F.round("p_const", 12).alias("p_const"), F.round("p_age", 12).alias("p_age"), "fallback")


LL_SQL = f"""{PREDICTED_SQL}, ll AS (SELECT endpoint, split, acct, interval_id, sum(target * ln(p_const) + (1 - target) * ln(1 - p_const)) AS ll_const, sum(target * ln(p_age) + (1 - target) * ln(1 - p_age)) AS ll_age,
  CAST(sum(target) AS BIGINT) AS targets, count(*) AS bins FROM predicted GROUP BY ALL)"""


def likelihoods(spark, d):
    return H.interval_likelihoods(predicted(spark, d), ["endpoint", "split", "acct", "interval_id"])


@query("interval_likelihoods", f"WITH {LL_SQL} SELECT endpoint, acct, interval_id, round(ll_const, 8) AS ll_const, round(ll_age, 8) AS ll_age, round(ll_age - ll_const, 8) AS delta, targets, bins FROM ll")
def interval_likelihoods(spark, d):
    return likelihoods(spark, d).select("endpoint", "acct", "interval_id", *[F.round(c, 8).alias(c) for c in ("ll_const", "ll_age", "delta")], "targets", "bins")


@query("mean_interval_likelihood", f"WITH {LL_SQL} SELECT endpoint, split, count(*) AS intervals, round(avg(ll_const), 8) AS ll_const, round(avg(ll_age), 8) AS ll_age, round(avg(ll_age - ll_const), 8) AS delta FROM ll GROUP BY ALL")
def mean_interval_likelihood(spark, d):
    return likelihoods(spark, d).groupBy("endpoint", "split").agg(F.count(F.lit(1)).alias("intervals"), *[F.round(F.avg(c), 8).alias(c) for c in ("ll_const", "ll_age", "delta")])


@query(
    "conditional_timing",
    f"""WITH {PREDICTED_SQL}, z AS (SELECT *, ln(p_age) - ln(1 - p_age) AS z, sum(target) OVER w AS events, max(CASE WHEN target = 1 THEN p_age END) OVER w AS event_p FROM predicted WINDOW w AS (PARTITION BY endpoint, acct, interval_id)),
g AS (SELECT endpoint, acct, interval_id, max(CASE WHEN target = 1 THEN z END) - ln(sum(exp(z))) AS log_p, -ln(count(*)) AS uniform, count(*) FILTER (p_age > event_p) + 1 AS rank, count(*) AS bins FROM z WHERE events = 1 GROUP BY ALL)
SELECT endpoint, acct, interval_id, round(log_p, 8) AS log_p, round(uniform, 8) AS uniform, round(log_p - uniform, 8) AS gain, round(exp(log_p), 8) AS p, rank, bins FROM g""",
)
def conditional_timing(spark, d):
    t = H.conditional_timing(predicted(spark, d), ["endpoint", "acct", "interval_id"])
    return t.withColumns({c: F.round(c, 8) for c in ("log_p", "uniform", "gain", "p")})


@query(
    "hazard_scores",
    f"""WITH {PREDICTED_SQL}, r AS (SELECT *, rank() OVER w + (count(*) OVER (PARTITION BY endpoint, split, p_age) - 1) / 2.0 AS rk FROM predicted WINDOW w AS (PARTITION BY endpoint, split ORDER BY p_age)),
g AS (SELECT endpoint, split, count(*) AS n, sum(target) AS e, sum(rk * target) AS ranks, avg((p_age - target) * (p_age - target)) AS brier, count(*) FILTER (target = 0 AND p_age < 0.5) AS true_negative, count(*) FILTER (target = 0 AND p_age >= 0.5) AS false_positive,
  count(*) FILTER (target = 1 AND p_age < 0.5) AS false_negative, count(*) FILTER (target = 1 AND p_age >= 0.5) AS true_positive FROM r GROUP BY ALL)
SELECT endpoint, split, n, CAST(e AS BIGINT) AS events, CASE WHEN e > 0 AND e < n THEN round((ranks - e * (e + 1) / 2.0) / (e * (n - e)), 9) END AS auc, round(brier, 9) AS brier, round((true_positive + true_negative) / n, 9) AS accuracy, true_negative, false_positive, false_negative, true_positive FROM g""",
)
def hazard_scores(spark, d):
    s = H.scores(predicted(spark, d), ["endpoint", "split"], "p_age")
    return s.withColumns({c: F.round(c, 9) for c in ("auc", "brier", "accuracy")})


@query("hazard_calibration", f"WITH {PREDICTED_SQL} SELECT endpoint, CAST(least(floor(p_age * 10), 9) AS INT) AS bin, count(*) AS n, round(avg(p_age), 9) AS mean_p, round(avg(target), 9) AS observed FROM predicted GROUP BY ALL")
def hazard_calibration(spark, d):
    c = H.calibration(predicted(spark, d), ["endpoint"], "p_age")
    return c.withColumns({x: F.round(x, 9) for x in ("mean_p", "observed")})


SHIFT = -math.log(2.1)


@query("base_rate_shift", f"WITH {PREDICTED_SQL} SELECT endpoint, round(avg(p_age), 9) AS mean_p, round(avg(1 / (1 + exp(-(ln(p_age) - ln(1 - p_age) + {SHIFT!r})))), 9) AS shifted FROM predicted GROUP BY endpoint")
def base_rate_shift(spark, d):
    """Mean predictions, and under a base rate with odds smaller by 2.1."""
    return predicted(spark, d).groupBy("endpoint").agg(F.round(F.avg("p_age"), 9).alias("mean_p"), F.round(F.avg(H.shifted(F.col("p_age"), SHIFT)), 9).alias("shifted"))


@query(
    "session_hazard",
    f"""WITH {AGES_SQL}, c AS (SELECT *, bin_start // {DAY} AS day, bin_start % {DAY} // {HOUR} AS hour FROM ages)
SELECT day, endpoint, count(*) AS risk_bins, CAST(sum(target) AS BIGINT) AS events, round(1000.0 * sum(target) / count(*), 9) AS per_1000, count(*) FILTER (hour < 16) AS block_12_16, count(*) FILTER (hour >= 16 AND hour < 20) AS block_16_20, count(*) FILTER (hour >= 20) AS block_20_24
FROM c WHERE hour >= 12 GROUP BY ALL""",
)
def session_hazard(spark, d):
    """Per day and endpoint over the common hours, 12 to 24."""
    a = ages(spark, d).withColumns({"day": F.floor(F.col("bin_start") / DAY), "hour": F.floor(F.pmod("bin_start", F.lit(DAY)) / HOUR)}).filter("hour >= 12")
    a = a.withColumns(H.session_blocks(F.col("hour")))
    blocks = [F.sum(name).alias(name) for name, _, _ in H.SESSION_BLOCKS]
    return a.groupBy("day", "endpoint").agg(F.count(F.lit(1)).alias("risk_bins"), F.sum("target").alias("events"), F.round(1000.0 * F.sum("target") / F.count(F.lit(1)), 9).alias("per_1000"), *blocks)


@query("split_rates", f"WITH {AGES_SQL} SELECT endpoint, split, count(DISTINCT (acct, interval_id)) AS intervals, count(*) AS bins, CAST(sum(target) AS BIGINT) AS events, round((sum(target) + 0.5) / (count(*) + 1.0), 12) AS rate FROM ages GROUP BY ALL")
def split_rates(spark, d):
    g = ages(spark, d).groupBy("endpoint", "split").agg(F.count_distinct("acct", "interval_id").alias("intervals"), F.count(F.lit(1)).alias("bins"), F.sum("target").alias("events"))
    return g.withColumn("rate", F.round(smoothed_rate(F.col("events"), F.col("bins"), 0.5), 12))


@query(
    "timer_floor",
    f"""WITH {AGES_SQL} SELECT bin_start // {DAY} AS day, endpoint, count(*) AS events, count(*) FILTER (age < 6) AS below, round(count(*) FILTER (age < 6) / count(*), 9) AS share, round(min(age), 9) AS youngest FROM ages WHERE target = 1 GROUP BY ALL""",
)
def timer_floor(spark, d):
    """How many events come before the age of six, by day."""
    e = ages(spark, d).filter("target = 1")
    return e.groupBy(F.floor(F.col("bin_start") / DAY).alias("day"), "endpoint").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("age") < 6).alias("below"), F.round(F.count_if(F.col("age") < 6) / F.count(F.lit(1)), 9).alias("share"), F.round(F.min("age"), 9).alias("youngest")
    )


@query("age_moments", f"WITH {AGES_SQL} SELECT endpoint, count(*) AS n, round(avg(age), 6) AS mean, round(stddev_pop(age), 6) AS deviation, round(CASE WHEN stddev_pop(age) > 0 AND stddev_pop(target) > 0 THEN corr(age, target) END, 6) AS correlation FROM ages GROUP BY endpoint")
def age_moments(spark, d):
    return ages(spark, d).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("age"), 6).alias("mean"), F.round(F.stddev_pop("age"), 6).alias("deviation"), F.round(H.correlation("age", "target"), 6).alias("correlation"))


@query("session_baseline")
def session_baseline(spark, d):
    """Three block effects over the age table's log odds, by Newton steps over all bins of the common hours, a little regularized as a block may have no event; no SQL, tests compare with numpy."""
    p = predicted(spark, d).filter("split = 'development'").withColumn("hour", F.floor(F.pmod("bin_start", F.lit(DAY)) / HOUR)).filter("hour >= 12")
    blocks = [name for name, _, _ in H.SESSION_BLOCKS]
    p = allow_only(p.withColumns({**H.session_blocks(F.col("hour")), "offset": logit(F.col("p_age"))}), [*blocks, "offset", "target"], forbidden=["interval_end", "following"])
    p = written(p.groupBy(*blocks, "offset", "target").agg(F.count(F.lit(1)).alias("n")), "session-cells")
    _, effects = H.fit_logistic(p, blocks, "target", offset="offset", intercept=False, weight="n", regularization=1e-3)
    return spark.createDataFrame(list(zip(blocks, effects)), "block string, effect double")
