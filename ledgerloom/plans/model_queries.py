"""Models of risk bins on their features, what each adds by interval, and resampled means of that."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hazard as H
from ..operators import models as M
from ..operators.order import DAY, HOUR
from ..sources.shared import written
from ..operators import causes as U
from .feature_queries import FLAGS, candidates_of, signed_of
from .hazard_queries import LL_SQL, likelihoods
from .interval_queries import WIDTH, gaps_of, support_of

Q, SQL = {}, {}
ENDPOINTS = ("unlock_occurrence", "rehedge_sell_occurrence", "rehedge_buy_occurrence")
SHARED = ("volatility_10", "spread", "absolute_displacement")
REHEDGE = (*(f"{x}_{k}" for x in ("signed_change", "signed_imbalance", "proximity", "side_touch") for k in (2, 5)), *SHARED, "signed_displacement")
UNLOCK = (*(f"{x}_{k}" for x in ("absolute_change", "absolute_imbalance", "width", "either_touch") for k in (2, 5)), *SHARED, "width_10")
COLUMNS = {e: UNLOCK if e == "unlock_occurrence" else REHEDGE for e in ENDPOINTS}
#: Features of the path alone, without the level of volatility and spread.
SHAPE = {e: tuple(c for c in own if c not in ("volatility_10", "spread")) for e, own in COLUMNS.items()}
PENALTY = 0.01
MODELS = ("a_common", "a_level", "a_dev", "a_session", "b", "c_dev", "c_session", "c_shape")
DELTAS = (("c_dev", "a_dev"), ("c_dev", "b"), ("a_session", "a_dev"), ("c_session", "a_session"), ("c_session", "b"), ("c_shape", "a_session"), ("a_level", "a_common"), ("a_dev", "a_level"))


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


#: What all that is said of a bin depends on: bins that agree in it are a cell of the design.
CELL = ["endpoint", "role", "interval_start", "bin_start", "age_us", "target"]


def cells_of(spark, d):
    """All candidate bins by cell, and the cells that are joint-valid with their number of bins, features and rates of the age tables: of all eligible development bins (common), of the design's own (dev).

    Bins are counted by cell before they meet features, tables and fits; there are as many cells as pairs of times that occur, however many intervals share them.
    """
    gaps = written(gaps_of(spark, d), "gaps")
    own = ["endpoint", "interval_start", "bin_start", "age_us", "target", "split", "is_common", "is_cross_split", "is_eligible"]
    support = written(support_of(spark, d, gaps).filter("is_common AND NOT is_cross_split").select("acct", "interval_id", *own), "common-bins")
    counted = written(support.groupBy(*own).agg(F.count(F.lit(1)).alias("n")), "counted-bins")
    age = (F.col("age_us") / float(WIDTH)).alias("age")
    audit = U.audited(signed_of(spark, d, candidates_of(spark, d, counted), gaps), {"below_floor": F.col("below_floor")}, FLAGS).filter("is_joint_valid")
    rows = written(audit.select(*CELL, "n", age, *sorted({*REHEDGE, *UNLOCK})), "design")
    common = H.hazard_table(counted.filter("is_eligible AND split = 'development'").select("endpoint", "target", age, "n"), weight="n")
    dev = H.hazard_table(rows.filter("role = 'development'"), weight="n")
    for name, table in (("a_common", common), ("a_dev", dev)):
        rows = H.predict_hazard(rows, table).withColumnRenamed("p_age", f"p_{name}").drop("p_const", "fallback", "bucket")
    hour = F.floor(F.pmod("bin_start", F.lit(DAY)) / HOUR)
    rows = rows.withColumns(H.session_blocks(hour) | {"o_common": M.offset_of("p_a_common"), "o_dev": M.offset_of("p_a_dev")})
    rows = M.scaled_by(rows, "endpoint", F.col("role") == "development", COLUMNS, weight="n")
    rows = written(rows.withColumns({f"fit_{e}": (F.col("role") == "development") & (F.col("endpoint") == e) for e in ENDPOINTS}), "scaled-design")
    return candidates_of(spark, d, support).select("acct", "interval_id", *CELL), rows


def design_of(spark, d):
    """Joint-valid bins, a row each, with all that cells_of() says of their cell."""
    bins, cells = cells_of(spark, d)
    return bins.join(cells.drop("n").hint("merge"), CELL)


def first_models(endpoints):
    blocks = tuple(name for name, _, _ in H.SESSION_BLOCKS)
    for e in endpoints:
        z = tuple(f"{c}_z" for c in COLUMNS[e])
        yield M.Model(f"a_level {e}", (), f"fit_{e}", "o_common", penalty=0.0)
        yield M.Model(f"a_session {e}", blocks, f"fit_{e}", "o_dev", intercept=False, penalty=1e-3)
        yield M.Model(f"b {e}", z, f"fit_{e}", penalty=PENALTY)
        yield M.Model(f"c_dev {e}", z, f"fit_{e}", "o_dev", intercept=False, penalty=PENALTY)


def later_models(endpoints):
    for e in endpoints:
        for name, own in (("c_session", COLUMNS), ("c_shape", SHAPE)):
            yield M.Model(f"{name} {e}", tuple(f"{c}_z" for c in own[e]), f"fit_{e}", "o_session", intercept=False, penalty=PENALTY)


def by_endpoint(fits, name):
    out = F.lit(None).cast("double")
    for full, fit in fits.items():
        own, e = full.split()
        if own == name:
            out = F.when(F.col("endpoint") == e, fit.predict()).otherwise(out)
    return out


def predictions_of(spark, d):
    """All candidate bins by cell, and the eight probabilities of each joint-valid cell; an endpoint without development rows or events has no models and goes."""
    bins, rows = cells_of(spark, d)
    seen = [r.endpoint for r in rows.filter("role = 'development'").groupBy("endpoint").agg(F.sum("target").alias("n")).filter("n > 0").orderBy("endpoint").collect()]
    rows = rows.filter(F.col("endpoint").isin(*seen))
    if not seen:
        return bins, rows.withColumns({f"p_{m}": F.lit(None).cast("double") for m in MODELS})
    fits = M.fit_many(rows, list(first_models(seen)), "target", weight="n")
    rows = rows.withColumns({f"p_{m}": by_endpoint(fits, m) for m in ("a_level", "a_session", "b", "c_dev")})
    rows = written(rows.withColumn("o_session", M.offset_of("p_a_session")), "session-design")
    fits = M.fit_many(rows, list(later_models(seen)), "target", weight="n")
    return bins, rows.withColumns({f"p_{m}": by_endpoint(fits, m) for m in ("c_session", "c_shape")})


KEYS = ["endpoint", "role", "acct", "interval_id"]


@query("model_deltas")
def model_deltas(spark, d):
    """Eight models' log likelihoods by interval and what one adds to another, over the same joint-valid bins. No SQL, as the fits are iterative; tests compare with numpy."""
    return M.model_deltas(*predictions_of(spark, d), KEYS, CELL, MODELS, DELTAS)


@query("model_scores")
def model_scores(spark, d):
    """Events, AUC, Brier score and confusion of the full model on bins that weren't fitted, by endpoint."""
    held = predictions_of(spark, d)[1].filter("role <> 'development'")
    return H.scores(held.withColumn("p", F.col("p_c_session")), ["endpoint"], "p", weight="n")


DRAWS, SEED = 200, "5003"
BOUNDS = M.poisson_bounds()
ALPHA = 1 / 60


def _resampled_sql(source: str, keys: str, unit: str, value: str) -> str:
    times = " + ".join(f"CAST(x >= {b} AS INT)" for b in BOUNDS)
    return f"""blocks AS (SELECT unnest(range(0, {(DRAWS - 1) // 4 + 1})) AS block), ks AS (SELECT unnest(range(0, 4)) AS k),
dg AS (SELECT u.*, block, md5(concat_ws('|', '{SEED}', {unit}, block)) AS h FROM {source} u, blocks), nm AS (SELECT *, block * 4 + k AS draw, CAST('0x' || substr(h, k * 8 + 1, 8) AS BIGINT) AS x FROM dg, ks WHERE block * 4 + k < {DRAWS}),
sums AS (SELECT {keys}, draw, sum({times}) AS n, sum(({times}) * {value}) AS s FROM nm GROUP BY ALL HAVING sum({times}) > 0),
found AS (SELECT {keys}, quantile_cont(s / n, 0.025) AS low, quantile_cont(s / n, 0.975) AS high, quantile_cont(s / n, {ALPHA!r}) AS one_sided_low, count(*) AS draws FROM sums GROUP BY ALL),
means AS (SELECT {keys}, count(*) AS units, avg({value}) AS mean FROM {source} GROUP BY ALL)"""


@query(
    "resampled_deltas",
    f"WITH {LL_SQL}, ld AS (SELECT *, ll_age - ll_const AS delta FROM ll), {_resampled_sql('ld', 'endpoint, split', 'acct, interval_id', 'delta')} SELECT endpoint, split, units, round(mean, 8) AS mean, round(low, 8) AS low, round(high, 8) AS high, round(one_sided_low, 8) AS one_sided_low, draws FROM means JOIN found USING (endpoint, split)",
)
def resampled_deltas(spark, d):
    """What age adds to the mean interval, with percentile intervals over resampled intervals."""
    r = M.resampled(written(likelihoods(spark, d), "likelihoods"), ["endpoint", "split"], "delta", ["acct", "interval_id"], DRAWS, SEED, ALPHA)
    return r.withColumns({c: F.round(c, 8) for c in ("mean", "low", "high", "one_sided_low")})
