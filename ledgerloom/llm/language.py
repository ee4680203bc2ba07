"""Language identification by mixtures: n-gram likelihoods, expectation-maximisation, penalised choice of languages."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, text_of, without
from .words import chunks

#: N-grams are three bytes of text, hashed to this many features.
FEATURES = 1 << 16
#: Languages that a task counts before it sends their counts on.
COUNTED = 64
UNKNOWN = "und"
ADDED = ("lang_pred", "score", "languages")

#: A-Z lowered, other ASCII beside letters as a space.
FOLD = np.full(256, 32, np.uint8)
FOLD[97:123] = np.arange(97, 123)
FOLD[65:91] = np.arange(97, 123)
FOLD[128:] = np.arange(128, 256)


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of all three-byte runs within texts that aren't white space only."""
    data = FOLD[data]
    if len(data) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = data[:-2].astype(np.uint32) << np.uint32(16) | data[1:-1].astype(np.uint32) << np.uint32(8) | data[2:]
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = (text[:-2] == text[2:]) & (code != np.uint32(0x202020))
    feature = (code[inside] * np.uint32(0x9E3779B1)) >> np.uint32(16)
    return text[:-2][inside], feature.astype(np.int64)


def count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, feature, n) of the labelled texts of a partition."""
    counts: dict[str, np.ndarray] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, n in counts.items():
            seen = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(seen), pa.string()), "feature": pa.array(seen, pa.int64()), "n": pa.array(n[seen])})
        counts.clear()

    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), dtype=object)
        for row, data, offsets in chunks(batch.column("text")):
            text, feature = trigrams(data, offsets)
            of_text = langs[row : row + len(offsets) - 1]
            for lang in set(of_text.tolist()):
                own = np.flatnonzero(of_text == lang)
                mine = np.zeros(len(of_text), bool)
                mine[own] = True
                if lang not in counts:
                    counts[lang] = np.zeros(FEATURES, np.int64)
                counts[lang] += np.bincount(feature[mine[text]], minlength=FEATURES)
                if len(counts) > COUNTED:
                    yield from sent()
    yield from sent()


class Model:
    """Languages and their smoothed n-gram probabilities, each relative to the mean over the languages: FEATURES numbers a language."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        p = (counts + smooth) / (counts.sum(axis=0) + smooth * FEATURES)
        self.langs, self.ratio = langs, (p / p.mean(axis=1, keepdims=True) if langs else p).astype(np.float32)


def fit(labelled: DataFrame, lang_col: str, text_col: str) -> Model:
    """N-gram counts of all rows with a language, summed by language and n-gram in Spark."""
    rows = labelled.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(count_features, "lang string, feature long, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    table = counts.toArrow()  # at most FEATURES rows a language
    langs = sorted(set(table.column("lang").to_pylist()))
    out = np.zeros((FEATURES, len(langs)))
    at = {lang: k for k, lang in enumerate(langs)}
    out[table.column("feature").to_numpy(), [at[x] for x in table.column("lang").to_pylist()]] = table.column("n").to_numpy()
    return Model(langs, out)


def mixture(ratio: np.ndarray, n: np.ndarray, sizes: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions by expectation-maximisation for many texts, and the log likelihood they reach.

    ratio: of each (text, n-gram) row by language; n: its count; sizes: each text's rows; start:
    proportions to begin with, zero for languages left out. Each text stops by itself, once no
    proportion changes by 0.001, so the result doesn't depend on the texts beside it.
    """
    share, going = start.copy(), np.arange(len(sizes))
    own_ratio, own_n, own_sizes = ratio, n, sizes
    for _ in range(rounds):
        first = np.cumsum(own_sizes) - own_sizes
        part = own_ratio * np.repeat(share[going], own_sizes, axis=0)
        part *= (own_n / part.sum(axis=1))[:, None]
        new = np.add.reduceat(part, first, axis=0) / np.add.reduceat(own_n, first)[:, None]
        more = np.abs(new - share[going]).max(axis=1) >= 1e-3
        share[going] = new
        if not more.any():
            break
        rows = np.repeat(more, own_sizes)
        going, own_ratio, own_n, own_sizes = going[more], own_ratio[rows], own_n[rows], own_sizes[more]
    first = np.cumsum(sizes) - sizes
    reached = np.add.reduceat(n * np.log((ratio * np.repeat(share, sizes, axis=0)).sum(axis=1)), first)
    return share, reached


def infer(model: Model, data: np.ndarray, offsets: np.ndarray, penalty: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's proportions of the chosen languages, and those of all languages; texts without n-grams have zeros."""
    k = len(model.langs)
    out, every = np.zeros((2, len(offsets) - 1, k))
    text, feature = trigrams(data, offsets)
    if not len(text):
        return out, every
    key, n = np.unique(text * FEATURES + feature, return_counts=True)
    text, feature = key // FEATURES, key % FEATURES
    n = n.astype(np.float64)
    texts, sizes = np.unique(text, return_counts=True)
    first = np.cumsum(sizes) - sizes
    total = np.add.reduceat(n, first)
    ratio = model.ratio[feature]
    alone = np.add.reduceat(n[:, None] * np.log(ratio), first, axis=0)
    best, value = alone.argmax(axis=1), alone.max(axis=1)
    cost = penalty * np.log(total + 1)
    out[texts, best] = every[texts, best] = 1
    if k == 1:
        return out, every
    share, reached = mixture(ratio, n, sizes, np.full((len(sizes), k), 1 / k), rounds)
    every[texts] = share
    # No set of languages can reach more than all of them, so where all don't pay for one more, none does.
    order = np.argsort(-share, axis=1, kind="stable")
    going = np.arange(len(sizes))
    for size in range(2, k + 1):
        going = going[reached[going] - value[going] - cost[going] * (size - 1) > -cost[going] * (np.count_nonzero(out[texts[going]], axis=1) - 1)]
        if not len(going):
            break
        rows = np.zeros(len(sizes), bool)
        rows[going] = True
        rows = np.repeat(rows, sizes)
        start = np.zeros((len(going), k))
        np.put_along_axis(start, order[going, :size], 1 / size, axis=1)
        own, got = mixture(ratio[rows], n[rows], sizes[going], start, rounds)
        worth = got - cost[going] * (size - 1)
        chosen = value[going] - cost[going] * (np.count_nonzero(out[texts[going]], axis=1) - 1)
        better = worth > chosen
        out[texts[going[better]]] = own[better]
        value[going[better]] = got[better]
    return out, every


def predict(batches: Iterator[pa.RecordBatch], model: Model, text_col: str, keep: list[str], names: dict[str, str], options: dict) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64()), ("of_all", pa.float64())]))
    for batch in batches:
        found: list[list[dict]] = []
        for _, data, offsets in chunks(batch.column(text_col)):
            for shares, every in zip(*infer(model, data, offsets, **options)):
                own = np.flatnonzero(shares > 0)
                own = own[np.lexsort((own, -shares[own]))]
                found.append([{"lang": model.langs[j], "share": float(shares[j]), "of_all": float(every[j])} for j in own])
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found, kind)], [*keep, names["found"]])


def identify_languages(
    docs: DataFrame,
    labelled: DataFrame,
    text_col: str = "text",
    lang_col: str = "lang",
    keep: list[str] | None = None,
    penalty: float = 3.0,
    rounds: int = 25,
) -> DataFrame:
    """The languages of whole texts and their proportions.

    The model is the n-gram counts of all rows of ``labelled`` with a language and a text; nothing else
    of documents is used. A text's n-grams are a mixture of the languages'; expectation-maximisation
    finds the proportions, and of the sets of the 1, 2 ... most frequent languages by them the one
    with the highest log likelihood less ``penalty`` times (languages - 1) times the log of the number
    of n-grams is chosen; sets grow until no larger one can be worth its penalty. Returns docs (columns
    ``keep``, all by default) with lang_pred (the language with the largest proportion, the first by
    name of equal ones), score (its proportion where all languages are allowed, so a mark of how sure
    the choice is) and languages (all chosen ones with their proportions); input columns of these
    names give way. A null text, one without a
    letter, or no model at all give "und", 0 and none; a text with letters but too short for an n-gram
    (three bytes) gets the first language and score 0. Repeated rows are answered alike; empty tables
    give no rows. A text is held whole in its task, as numbers in pieces.
    """
    keep = list(docs.columns) if keep is None else keep
    docs = without(docs, *ADDED)
    keep = [c for c in keep if c in docs.columns]
    names = fresh(docs, "found", "letter")
    model = docs.sparkSession.sparkContext.broadcast(fit(labelled, lang_col, text_col))
    first = model.value.langs[0] if model.value.langs else UNKNOWN
    options = {"penalty": penalty, "rounds": rounds}
    letter, found = F.col(names["letter"]), F.col(names["found"])
    df = docs.withColumn(names["letter"], text_of(text_col).rlike(r"\p{L}"))
    df = df.select(*dict.fromkeys([*keep, names["letter"], text_col]))
    passed = [*keep, names["letter"]]
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([kinds[c] for c in passed]).add(
        names["found"], T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("of_all", T.DoubleType())]))
    )
    if model.value.langs:
        df = df.mapInArrow(lambda batches: predict(batches, model.value, text_col, passed, names, options), schema)
    else:
        df = df.select(*passed, F.lit(None).cast(schema.fields[-1].dataType).alias(names["found"]))
    none = F.array().cast(schema.fields[-1].dataType)
    chosen = F.when(letter & found.isNotNull(), found).otherwise(none)
    top: Column = F.get(chosen, F.lit(0))
    return df.select(
        *keep,
        F.when(letter & found.isNotNull(), F.coalesce(top["lang"], F.lit(first))).otherwise(UNKNOWN).alias("lang_pred"),
        F.least(F.lit(1.0), F.coalesce(top["of_all"], F.lit(0.0))).alias("score"),
        F.transform(chosen, lambda c: c.dropFields("of_all")).alias("languages"),
    )
