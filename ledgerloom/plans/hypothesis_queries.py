"""Hypotheses on the price before events against matched controls: effects by window and shift, verdicts, and whether they are stable."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import hypotheses as Y
from ..operators import models as M
from ..operators.order import DAY, HOUR, MINUTE
from ..sources.shared import written
from .control_queries import CONTROLS_SQL, all_of, controls_of
from .feature_queries import ticks_of
from .model_queries import BOUNDS

Q, SQL = {}, {}
WIDTHS = (15 * MINUTE, 30 * MINUTE, 60 * MINUTE)
SHIFTS = (-10 * MINUTE, 0, 5 * MINUTE, 20 * MINUTE)
DRAWS, SEED, LEAST = 64, "20260725", 30


def query(name: str, sql: str | None = None):
    def register(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return register


def _look_sql(w: int) -> str:
    own, prior, before = f"q.us >= a.us - {w}", f"q.us < a.us - {w}", f"q.us >= a.us - {w} AND q.us < a.us"
    return f"""SELECT a.us, {w} AS win, count(*) FILTER ({own}) >= 2 AND a.us - {w} >= f.first_us AS valid, count(*) FILTER ({own}) >= 2 AND count(*) FILTER ({prior}) >= 2 AND a.us - {2 * w} >= f.first_us AS touch_valid,
  arg_min(q.mid, (q.us, q.seq)) FILTER ({own}) AS first, arg_max(q.mid, (q.us, q.seq)) FILTER ({own}) AS last, max(q.mid) FILTER ({own}) AS high, min(q.mid) FILTER ({own}) AS low,
  max(q.mid) FILTER ({prior}) AS prior_high, min(q.mid) FILTER ({prior}) AS prior_low, max(q.mid) FILTER ({before}) AS before_high, min(q.mid) FILTER ({before}) AS before_low
  FROM moments a CROSS JOIN first_tick f LEFT JOIN quotes q ON q.us >= a.us - {2 * w} AND q.us <= a.us GROUP BY a.us, f.first_us"""


def _way_sql(side: str, reach: str, best: str) -> str:
    """When a window first reaches an end of the earlier part, and its farthest price since."""
    touch = f"SELECT l.us, l.win, min(q.us) AS {side}_touch_us FROM looks l JOIN quotes q ON q.us >= l.us - l.win AND q.us <= l.us AND q.mid {reach} l.prior_{side} GROUP BY l.us, l.win"
    return f"{side}_touch AS ({touch}), {side}_way AS (SELECT t.us, t.win, t.{side}_touch_us, {best}(q.mid) AS {side}_farthest FROM {side}_touch t JOIN quotes q ON q.us >= t.{side}_touch_us AND q.us <= t.us GROUP BY ALL)"


TIMES = " + ".join(f"CAST(x >= {b} AS INT)" for b in BOUNDS)
EFFECTS_SQL = f"""{CONTROLS_SQL}, events_of AS (SELECT event_id, behavior, sample_us FROM support WHERE support = 'supported'),
rows_of AS (SELECT event_id, behavior, shift, sample_us + shift AS us FROM events_of, (SELECT unnest({list(SHIFTS)}) AS shift) UNION ALL SELECT c.event_id, e.behavior, NULL, c.sample_us FROM controls c JOIN events_of e USING (event_id)),
moments AS (SELECT DISTINCT us FROM rows_of), first_tick AS (SELECT min(us) AS first_us FROM quotes), looks AS ({" UNION ALL ".join(_look_sql(w) for w in WIDTHS)}),
{_way_sql('high', '>=', 'max')}, {_way_sql('low', '<=', 'min')},
placed AS (SELECT r.event_id, r.behavior, r.shift, l.*, touch_valid AND coalesce(prior_high > prior_low, false) AS two, prior_high - prior_low AS prior_range, coalesce(CASE WHEN behavior = 'REHEDGE_SELL' THEN high_touch_us ELSE low_touch_us END < l.us, false) AS touched,
  greatest(CASE WHEN behavior = 'REHEDGE_SELL' THEN high_farthest - last ELSE last - low_farthest END, 0) AS way, CASE WHEN high > low THEN (last - low) / (high - low) ELSE 0.5 END AS place, CASE WHEN first <> 0 THEN last / first END - 1 AS change FROM rows_of r JOIN looks l ON l.us = r.us LEFT JOIN high_way h ON h.us = l.us AND h.win = l.win LEFT JOIN low_way o ON o.us = l.us AND o.win = l.win),
unclipped AS (SELECT event_id, shift, 'h1' AS hypothesis, win, CASE WHEN behavior = 'REHEDGE_SELL' THEN place ELSE 1 - place END AS score FROM placed WHERE valid AND behavior LIKE 'REHEDGE%'
  UNION ALL SELECT event_id, shift, 'h2_touch', win, CAST(touched AS DOUBLE) FROM placed WHERE two AND behavior LIKE 'REHEDGE%'
  UNION ALL SELECT event_id, shift, 'h2_retracement_raw', win, CASE WHEN touched THEN way ELSE 0 END / prior_range FROM placed WHERE two AND behavior LIKE 'REHEDGE%'
  UNION ALL SELECT event_id, shift, 'h2', win, CAST(touched AND way > 0 AS DOUBLE) FROM placed WHERE two AND behavior LIKE 'REHEDGE%'
  UNION ALL SELECT event_id, shift, 'h3', win, CASE WHEN behavior = 'UNLOCK_TO_BUY' THEN change ELSE -change END FROM placed WHERE valid AND behavior NOT LIKE 'REHEDGE%'),
caps AS (SELECT win, quantile_cont(score, 0.99) AS cap FROM unclipped u JOIN events_of e ON e.event_id = u.event_id WHERE hypothesis = 'h2_retracement_raw' AND shift = 0 AND e.sample_us // {DAY} % 3 <> 0 GROUP BY win),
scored AS (SELECT * FROM unclipped UNION ALL SELECT event_id, shift, 'h2_retracement', u.win, least(score, coalesce(cap, score)) FROM unclipped u LEFT JOIN caps c ON c.win = u.win WHERE hypothesis = 'h2_retracement_raw'),
means_of AS (SELECT event_id, hypothesis, win, avg(score) AS of_controls FROM scored WHERE shift IS NULL AND score IS NOT NULL GROUP BY ALL),
pairs AS (SELECT s.event_id, s.hypothesis, s.win, s.shift, score - of_controls AS difference, CASE WHEN e.sample_us // {DAY} % 3 = 0 THEN 'holdout' ELSE 'development' END AS split
  FROM scored s JOIN means_of m ON m.event_id = s.event_id AND m.hypothesis = s.hypothesis AND m.win = s.win JOIN events_of e ON e.event_id = s.event_id WHERE s.shift IS NOT NULL AND s.score IS NOT NULL),
dg AS (SELECT p.*, block, md5(concat_ws('|', '{SEED}', event_id, block)) AS h FROM pairs p, (SELECT unnest(range(0, {(DRAWS - 1) // 4 + 1})) AS block)), nm AS (SELECT *, block * 4 + k AS draw, CAST('0x' || substr(h, k * 8 + 1, 8) AS BIGINT) AS x FROM dg, (SELECT unnest(range(0, 4)) AS k)),
sums AS (SELECT hypothesis, split, shift, win, draw, sum({TIMES}) AS n, sum(({TIMES}) * difference) AS s FROM nm GROUP BY ALL HAVING sum({TIMES}) > 0),
spread AS (SELECT hypothesis, split, shift, win, quantile_cont(s / n, 0.025) AS low, quantile_cont(s / n, 0.975) AS high FROM sums GROUP BY ALL),
effects AS (SELECT p.hypothesis, p.split, p.shift, p.win, count(*) AS units, avg(difference) AS mean, avg(CAST(difference > 0 AS INT)) AS separated, any_value(low) AS low, any_value(high) AS high
  FROM pairs p JOIN spread s ON s.hypothesis = p.hypothesis AND s.split = p.split AND s.shift = p.shift AND s.win = p.win GROUP BY p.hypothesis, p.split, p.shift, p.win)"""


def effects_of(spark, d):
    samples, times = all_of(spark, d)
    controls = written(controls_of(samples, times).select("event_id", "sample_us"), "hypothesis-controls")
    split = F.when(F.floor(F.col("sample_us") / DAY) % 3 == 0, "holdout").otherwise("development").alias("split")
    own = samples.filter("support = 'supported'").select("event_id", "behavior", "sample_us", split)
    pairs = Y.paired_scores(own, controls, ticks_of(spark, d), WIDTHS, SHIFTS, 6 * HOUR)
    found = M.resampled_places(pairs, ["split"], "differences", ["event_id"], DRAWS, SEED)
    named = F.array(*[F.struct(F.lit(h).alias("hypothesis"), F.lit(s).cast("bigint").alias("shift"), F.lit(w).cast("bigint").alias("window")) for h, w, s in Y.places(WIDTHS, SHIFTS)])
    return found.withColumn("_place", F.element_at(named, F.col("place") + 1)).select("split", "_place.*", "units", "mean", "separated", "low", "high")


@query("hypothesis_effects", f"WITH {EFFECTS_SQL} SELECT hypothesis, split, shift, CAST(win AS BIGINT) AS \"window\", units, round(mean, 8) AS mean, round(separated, 8) AS separated, round(low, 8) AS low, round(high, 8) AS high FROM effects")
def hypothesis_effects(spark, d):
    """How far events lie above their controls in what a hypothesis expects, with intervals over resampled events."""
    e = effects_of(spark, d)
    return e.select("hypothesis", "split", "shift", "window", "units", *[F.round(c, 8).alias(c) for c in ("mean", "separated", "low", "high")])


VERDICTS_SQL = f"""{EFFECTS_SQL}, sg AS (SELECT *, CASE WHEN units < {LEAST} THEN 0 WHEN low > 0 THEN 1 WHEN high < 0 THEN -1 ELSE 0 END AS sign FROM effects), bf AS (SELECT *, lag(sign) OVER (PARTITION BY hypothesis, split, shift ORDER BY win) AS before FROM sg),
verdicts AS (SELECT hypothesis, split, shift, count(*) AS windows, CASE WHEN coalesce(bool_or(sign = 1 AND before = 1), false) AND coalesce(bool_or(sign = -1 AND before = -1), false) THEN 'mixed' WHEN coalesce(bool_or(sign = 1 AND before = 1), false) THEN 'supported'
  WHEN coalesce(bool_or(sign = -1 AND before = -1), false) THEN 'rejected' WHEN bool_or(sign <> 0) THEN 'weak' ELSE 'inconclusive' END AS verdict FROM bf GROUP BY ALL)"""


@query("hypothesis_verdicts", f"WITH {VERDICTS_SQL} SELECT * FROM verdicts")
def hypothesis_verdicts(spark, d):
    return M.agreeing_runs(effects_of(spark, d), ["hypothesis", "split", "shift"], "window", LEAST)


KIND = "CASE WHEN {0} IN ('supported', 'rejected', 'mixed') THEN {0} ELSE 'unresolved' END"


@query(
    "hypothesis_stability",
    f"""WITH {VERDICTS_SQL}, st AS (SELECT hypothesis, split, max(CASE WHEN shift = 0 THEN verdict END) AS at_event, max(CASE WHEN shift = {SHIFTS[0]} THEN verdict END) AS before_event FROM verdicts GROUP BY ALL)
SELECT *, coalesce({KIND.format('at_event')} = {KIND.format('before_event')}, false) AS stable FROM st""",
)
def hypothesis_stability(spark, d):
    """Whether a verdict is the same ten minutes before the event."""
    return Y.stability(M.agreeing_runs(effects_of(spark, d), ["hypothesis", "split", "shift"], "window", LEAST), ["hypothesis", "split"], SHIFTS[0])
