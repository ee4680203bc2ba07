"""Quality and toxicity by hierarchical empirical Bayes: a document classifier, and what its host and path are like."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, without, written
from .words import LOWER, Lookup, chunks, word_bounds, word_hashes

#: Measures of a text beside its words.
MEASURES = 8
#: A word is a feature if the share of positive examples that have it differs by so many standard deviations.
SIGNIFICANT = 4.0
TARGETS = ("quality", "toxic")
ADDED = ("p_quality", "p_toxic", "rejected")

_UPPER, _MARK, _DIGIT, _SPACE, _LETTER = (np.zeros(256, bool) for _ in range(5))
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True
_DIGIT[48:58] = True
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MARK[33:127] = True
_MARK &= ~(_LETTER | _DIGIT)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' hashes, each text's first word, and the texts' measures."""
    starts, ends, first = word_bounds(data, offsets)
    size = np.maximum(np.diff(offsets), 1)

    def share(of: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(of[data])])
        return np.diff(sums[offsets]) / size

    words = np.diff(first)
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    mean = np.diff(letters[first]) / np.maximum(words, 1)
    h = word_hashes(LOWER[data], starts, ends)
    of_text = np.repeat(np.arange(len(words)), words) << 16
    distinct = np.bincount(np.unique(of_text | (h >> np.uint64(48)).astype(np.int64)) >> 16, minlength=len(words)) / np.maximum(words, 1)
    columns = [share(_UPPER), share(_MARK), share(_DIGIT), share(_SPACE), np.log1p(words) / 10, mean / 20, distinct, distinct * np.log1p(words) / 10]
    return h, first, np.stack(columns, axis=1)


def example_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as their distinct words' hashes and measures."""
    for batch in batches:
        words, measured = [], []
        for _, data, offsets in chunks(batch.column("text")):
            h, first, measures = features(data, offsets)
            words += [np.unique(h[a:b]).view(np.int64) for a, b in zip(first[:-1], first[1:])]
            measured += list(measures)
        yield pa.RecordBatch.from_arrays(
            [batch.column("quality"), batch.column("toxic"), pa.array(words, pa.list_(pa.int64())), pa.array(measured, pa.list_(pa.float64()))],
            ["quality", "toxic", "words", "measures"],
        )


def regression(text: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int, y: np.ndarray, width: int, rounds: int, decay: float) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression with a quadratic penalty, by adaptive gradients over all examples."""
    w, square, b = np.zeros(width), np.full(width, 1e-8), 0.0
    b = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for k in range(rounds):
        z = np.bincount(text, value * w[feature], minlength=n) + b
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(feature, value * error[text], minlength=width) / n + decay * w
        square += g * g
        w -= 0.5 / np.sqrt(1 + k / 20) * g / np.sqrt(square)
        b -= 0.5 * error.mean()
    return w, b


def fit(words: list[np.ndarray], measures: np.ndarray, y: np.ndarray, rounds: int, decay: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Chosen words' hashes, the weights of them and of the measures, and the intercept."""
    text = np.repeat(np.arange(len(y)), [len(w) for w in words])
    known, feature = np.unique(np.concatenate(words), return_inverse=True)
    positive, n = y.sum(), len(y)
    have = np.bincount(feature, minlength=len(known))
    have_positive = np.bincount(feature, y[text], minlength=len(known))
    rate = have / n
    gap = have_positive / positive - (have - have_positive) / (n - positive)
    chosen = np.flatnonzero((have >= 3) & (np.abs(gap) >= SIGNIFICANT * np.sqrt(rate * (1 - rate) * (1 / positive + 1 / (n - positive))) ) & (rate < 1))
    at = np.full(len(known), -1)
    at[chosen] = np.arange(len(chosen))
    used = at[feature] >= 0
    width = len(chosen) + MEASURES
    text = np.concatenate([text[used], np.repeat(np.arange(n), MEASURES)])
    value = np.concatenate([np.ones(used.sum()), (measures * 10).ravel()])
    column = np.concatenate([at[feature[used]], np.tile(np.arange(len(chosen), width), n)])
    w, b = regression(text, column, value, n, y, width, rounds, decay)
    w[len(chosen) :] *= 10
    return known[chosen], w, b


def train(batches: Iterator[pa.RecordBatch], rounds: int, decay: float) -> Iterator[pa.RecordBatch]:
    """The classifier of each target with examples of both kinds, from one task's bounded examples."""
    rows = [r for batch in batches for r in batch.to_pylist()]
    out: dict[str, list] = {"target": [], "words": [], "weights": [], "intercept": [], "rate": []}
    for target in TARGETS:
        # Copies count once, else the words of one large group of copies look significant.
        own = list({tuple(r["words"]): r for r in rows if r[target] is not None}.values())
        y = np.array([r[target] for r in own])
        if not len(y) or y.min() == y.max():
            continue
        words, weights, intercept = fit([np.array(r["words"], np.int64) for r in own], np.array([r["measures"] for r in own]), y, rounds, decay)
        for key, x in zip(out, (target, words, weights, intercept, float(y.mean()))):
            out[key].append(x)
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.float64(), pa.float64()]
    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds)], list(out))


class Classifier:
    """Log odds of a target by the words and measures of a text, less the log odds of the examples: its evidence."""

    def __init__(self, words: list[int], weights: list[float], intercept: float, rate: float):
        keys = np.array(words, np.int64).view(np.uint64)
        order = np.argsort(keys)
        self.words, self.of_word = Lookup(keys[order]), np.array(weights[: len(words)])[order]
        self.of_measure = np.array(weights[len(words) :])
        self.intercept = intercept - float(np.log(rate / (1 - rate)))
        self.rate = rate

    def evidence(self, h: np.ndarray, first: np.ndarray, measures: np.ndarray) -> np.ndarray:
        z = measures @ self.of_measure + self.intercept
        place, at = self.words.find(h)
        text = np.searchsorted(first, place, side="right") - 1
        seen = np.unique(text * max(len(self.of_word), 1) + at)
        width = max(len(self.of_word), 1)
        return z + np.bincount(seen // width, self.of_word[seen % width], minlength=len(z))[: len(z)]


def scored(batches: Iterator[pa.RecordBatch], model: dict[str, Classifier], text_col: str, keep: list[str], names: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: list[list[np.ndarray]] = [[np.zeros(0)] for _ in TARGETS]
        for _, data, offsets in chunks(batch.column(text_col)):
            own = features(data, offsets)
            for k, target in enumerate(TARGETS):
                out[k].append(model[target].evidence(*own) if target in model else np.zeros(len(offsets) - 1))
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(np.concatenate(x), pa.float64()) for x in out)], [*keep, *names])


def logit(p: Column) -> Column:
    return F.ln(p) - F.ln(1 - p)


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))


#: Bounds of a prior's weight in documents; it is the upper one where sites don't differ, or there is but one.
LEAST_WEIGHT, MOST_WEIGHT = 1.0, 1e6


def prior_weight(within: float, within_df: float, between: float, between_df: float, sites: float) -> float:
    """The spread within sites over that between them, by moments; sites: documents of a site, a mean."""
    if between_df <= 0 or within_df <= 0 or sites <= 0:
        return MOST_WEIGHT
    noise = within / within_df
    signal = (between / between_df - noise) / sites
    return min(max(noise / signal, LEAST_WEIGHT), MOST_WEIGHT) if signal > 0 else MOST_WEIGHT


def spread(sums: DataFrame, hosts: DataFrame, target: str) -> tuple[float, float, float]:
    """The mean of a target over all documents, and the weights of the hosts' and of the paths' priors."""
    paths = sums.join(hosts.select("host", "host_n"), "host").agg(
        *[F.coalesce(x, F.lit(0.0)).cast("double") for x in (F.sum("n"), F.count(F.lit(1)), F.sum(target), F.sum(f"square_{target}"), F.sum(F.col(target) * F.col(target) / F.col("n")), F.sum(F.col("n") * F.col("n") / F.col("host_n")))]
    )
    own = hosts.agg(*[F.coalesce(x, F.lit(0.0)).cast("double") for x in (F.count(F.lit(1)), F.sum(F.col(f"host_{target}") * F.col(f"host_{target}") / F.col("host_n")), F.sum(F.col("host_n") * F.col("host_n")))])
    n, n_paths, total, squares, of_paths, path_sizes = paths.first()
    n_hosts, of_hosts, host_sizes = own.first()
    if not n:
        return 0.5, MOST_WEIGHT, MOST_WEIGHT
    host_weight = prior_weight(squares - of_hosts, n - n_hosts, of_hosts - total * total / n, n_hosts - 1, (n - host_sizes / n) / max(n_hosts - 1, 1))
    path_weight = prior_weight(squares - of_paths, n - n_paths, of_paths - of_hosts, n_paths - n_hosts, (n - path_sizes) / max(n_paths - n_hosts, 1))
    return total / n, host_weight, path_weight


def classify(
    docs: DataFrame,
    labels: DataFrame,
    host: Column | None = None,
    path: Column | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: list[str] | None = None,
    examples: int = 12_000,
    strength: float | None = None,
    least_quality: float = 0.5,
    most_toxic: float = 0.3,
    rounds: int = 800,
    decay: float = 1e-6,
    broadcast_sites: int = 50_000,
) -> DataFrame:
    """The probabilities that documents are good and that they are toxic, from their texts and their sites.

    The classifiers are fitted on at most ``examples`` labelled rows, the first by a hash of their id;
    a row's label is the mean of its non-null labels, from one half up positive. All else covers all
    documents. A document's evidence is the log odds by its classifier less those of the examples.
    Sites are a hierarchy: all documents, ``host``, and ``path`` within the host (columns; null is a
    value like any other; by default the columns source and lang). The mean probability of all
    documents is the prior of the hosts, each host's posterior mean that of its paths. A prior weighs
    as many documents as the spread of documents within sites is times that between sites (both of a
    level, from sums over all documents; ``strength`` sets it instead), so a site with few documents is
    like the level above, and all are where sites don't differ. A path's posterior, without the
    document itself, is the prior that its evidence is added to.

    Returns docs (columns ``keep``, all by default) with p_quality, p_toxic and rejected (p_quality
    under ``least_quality`` or p_toxic over ``most_toxic``); input columns of these names give way.
    Null and empty texts have no words and are judged by their measures and site. Where labels of
    one kind are missing the evidence is 0 and the mean one half, so nothing is rejected for it.
    Repeated rows are answered alike, and of rows of one id the first by text is an example; equal
    hashes of ids come by id. An empty table gives no rows. Texts are read whole, of any length.

    Hosts and paths are grouped sums, combined before their shuffle, so a site with a third of all
    rows is one row per map task. The posteriors of up to ``broadcast_sites`` sites are broadcast;
    more are joined by site, where Spark splits large ones.
    """
    keep = list(docs.columns) if keep is None else keep
    docs = without(docs, *ADDED)
    keep = [c for c in keep if c in docs.columns]
    spark = docs.sparkSession
    n = fresh(docs, "host", "path", "quality", "toxic")
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path

    known = labels.select(F.col(id_col).alias("id"), *[F.col(t).cast("double").alias(t) for t in TARGETS]).filter("id IS NOT NULL")
    known = known.groupBy("id").agg(*[F.when(F.avg(t).isNotNull(), (F.avg(t) >= 0.5).cast("double")).alias(t) for t in TARGETS])
    known = known.orderBy(F.xxhash64("id"), "id").limit(examples)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(known), "id").groupBy("id").agg(F.min("text").alias("text"), *[F.first(t).alias(t) for t in TARGETS])
    rows = rows.select("text", *TARGETS).mapInArrow(example_rows, "quality double, toxic double, words array<long>, measures array<double>")
    kinds = "target string, words array<long>, weights array<double>, intercept double, rate double"
    fitted = written(rows, "quality-examples").coalesce(1).mapInArrow(lambda b: train(b, rounds, decay), kinds)
    model = spark.sparkContext.broadcast({r["target"]: Classifier(r["words"], r["weights"], r["intercept"], r["rate"]) for r in fitted.collect()})

    passed = list(dict.fromkeys([*keep, n["host"], n["path"]]))
    df = docs.withColumns({n["host"]: F.xxhash64(F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))), n["path"]: F.xxhash64(F.coalesce(F.concat(F.lit("="), path.cast("string")), F.lit("")))})
    df = df.select(*dict.fromkeys([*passed, text_col]))
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([kinds[c] for c in passed])
    for t in TARGETS:
        schema = schema.add(n[t], T.DoubleType())
    df = written(df.mapInArrow(lambda b: scored(b, model.value, text_col, passed, [n[t] for t in TARGETS]), schema), "quality-evidence")

    rate = {t: F.lit(model.value[t].rate if t in model.value else 0.5) for t in TARGETS}
    p = {t: sigmoid(F.col(n[t]) + logit(rate[t])) for t in TARGETS}
    sums = df.groupBy(F.col(n["host"]).alias("host"), F.col(n["path"]).alias("path")).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(p[t]).alias(t) for t in TARGETS], *[F.sum(p[t] * p[t]).alias(f"square_{t}") for t in TARGETS]
    )
    sums = written(sums, "quality-sites")
    hosts = sums.groupBy("host").agg(F.sum("n").alias("host_n"), *[F.sum(t).alias(f"host_{t}") for t in TARGETS])
    spreads = {t: spread(sums, hosts, t) for t in TARGETS}
    mean = {t: F.lit(spreads[t][0]) for t in TARGETS}
    weight = {t: [F.lit(float(w if strength is None else strength)) for w in spreads[t][1:]] for t in TARGETS}
    sites = sums.join(hosts, "host").select(
        F.col("host").alias(n["host"]), F.col("path").alias(n["path"]), F.col("n").alias("site_n"), "host_n", *[F.col(t).alias(f"site_{t}") for t in TARGETS], *[f"host_{t}" for t in TARGETS]
    )
    if sites.count() <= broadcast_sites:
        sites = F.broadcast(sites)
    df = df.join(sites, [n["host"], n["path"]])

    def posterior(t: str) -> Column:
        own = p[t]
        host_weight, path_weight = weight[t]
        of_host = (F.col(f"host_{t}") - own + host_weight * mean[t]) / (F.col("host_n") - 1 + host_weight)
        of_path = (F.col(f"site_{t}") - own + path_weight * of_host) / (F.col("site_n") - 1 + path_weight)
        prior = F.greatest(F.least(of_path, F.lit(1 - 1e-6)), F.lit(1e-6))
        return sigmoid(F.col(n[t]) + logit(prior))

    df = df.select(*keep, posterior("quality").alias("p_quality"), posterior("toxic").alias("p_toxic"))
    poor = F.col("p_quality") < least_quality if "quality" in model.value else F.lit(False)
    toxic = F.col("p_toxic") > most_toxic if "toxic" in model.value else F.lit(False)
    return df.withColumn("rejected", poor | toxic)
