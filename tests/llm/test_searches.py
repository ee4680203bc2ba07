"""Searches and divergences against plain versions, where bounds, ties and parts of a task matter."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ledgerloom.llm import bloom_search, divergence, vector_search


def words_of(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs: list[tuple], items: list[tuple], k: int) -> Counter:
    counts = [(d, Counter(words_of(t))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for d, c in counts:
            m = 50 + 50 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(words_of(text)) if c[t])
            found.append((-score, d is None, d or 0, d))
        out.update((item, rank, d, -score) for rank, (score, _, _, d) in enumerate(sorted(f for f in found if f[0] < 0)[:k], 1))
    return out


def corpus(rng: random.Random, n: int) -> list[tuple]:
    words = [f"w{k}" for k in range(300)]
    prose = lambda n: " ".join(words[min(299, int(rng.expovariate(0.02)))] for _ in range(n))
    docs = [(k, prose(int(rng.lognormvariate(4, 1)))) for k in range(n)]
    return docs + [(n + k, docs[3][1]) for k in range(40)] + [(None, docs[4][1]), (5, docs[5][1]), (n + 50, None), (n + 51, "..."), (n + 52, "w1 " * 30_000)]


def test_bloom_search_finds_what_scoring_everything_finds(spark):
    rng = random.Random(11)
    docs = corpus(rng, 600)
    items = [(k, " ".join(rng.sample([f"W{x}" for x in range(300)], 12))) for k in range(12)] + [(3, "w1 w1 w2"), (None, "w299"), (20, None), (21, "nowhere"), (22, docs[7][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    for k in (1, 50):
        found = bloom_search.search(frame, spark.createDataFrame(items, "item_id long, text string"), k).collect()
        assert Counter(map(tuple, found)) == ranked(docs, items, k)


def test_bounds_are_never_below_scores_and_exclude_most(spark):
    rng = random.Random(12)
    texts = pa.array([t for _, t in corpus(rng, 900)], pa.large_string())
    _, data, offsets = next(bloom_search.chunks(texts))
    own = bloom_search.tokens(data, offsets)
    terms = sorted(own.terms.to_pylist())[:200]
    item, term = np.repeat(np.arange(10), 12), np.concatenate([rng.sample(range(200), 12) for _ in range(10)])
    items = bloom_search.Items(terms, np.array([rng.randrange(1, 9000) for _ in terms]), item, term, 10, int((own.words > 0).sum()), int(own.words.sum()))
    rows = {(r["item"], r["id"]): r["score"] for b in bloom_search.rescored(items, np.zeros(10, np.int64), 10**6)(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), texts], names=["id", "text"])])) for r in b.to_pylist()}
    hashes, seen, excluded = bloom_search.term_hashes(pa.array(terms, pa.large_string())), 0, 0
    least = {i: sorted(v for (j, _), v in rows.items() if j == i)[-10] for i in range(10)}
    for ids, n, slices, n_slices in bloom_search.signatures(own, pa.array(range(len(own.words)))):
        upper = bloom_search.bounds(items, items.matrix(), hashes, slices, n_slices, n)
        for column, d in enumerate(ids.to_pylist()):
            for i in range(10):
                assert upper[i, column] >= rows.get((i, d), 0)
                seen, excluded = seen + 1, excluded + (upper[i, column] < least[i])
    assert excluded > 0.8 * seen


def neighbours(rows: list[tuple], k: int) -> Counter:
    whole = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows]
    out = Counter()
    for a, (q, v) in enumerate(whole):
        if q is not None and q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(v, w)), i is None, i or 0, i) for b, (i, w) in enumerate(whole) if a != b)
            out.update((q, rank, i, -s) for rank, (s, _, _, i) in enumerate(scores[:k], 1))
    return out


def test_histograms_find_the_best_in_parts_with_ties(spark, monkeypatch):
    monkeypatch.setattr(vector_search, "BLOCK", 40)
    rng = np.random.default_rng(13)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=8)]) for k in range(400)] + [(400 + k, [0.5] * 8) for k in range(700)] + [(50, [0.5] * 8)] * 3 + [(None, [0.5] * 8)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)
    for k in (1, 5):
        found = vector_search.search(frame, F.col("vec_id") % 50 == 0, k).collect()
        assert Counter(map(tuple, found)) == neighbours(rows, k)
    few = spark.createDataFrame(rows[:3], "vec_id long, embedding array<double>")
    assert Counter(map(tuple, vector_search.search(few, F.col("vec_id") % 50 == 0, 5).collect())) == neighbours(rows[:3], 5)


def test_scores_beyond_doubles_are_whole(spark):
    rows = [(0, [2.0**22 + 0.5, 3.0]), (1, [2.0**22, 1.0 / 256]), (2, [2.0**22, 2.0 / 256])]
    found = vector_search.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, 2).collect()
    assert Counter(map(tuple, found)) == neighbours(rows, 2)


def test_billionths_are_exact_for_counts_beyond_billions():
    rng = random.Random(14)
    pairs = [(c, t) for t in (3, 10**9 + 7, 8 * 10**15) for c in (0, t // 3, t - 2, rng.randrange(t))]
    found = divergence.per_unit(np.array([c for c, _ in pairs]), np.array([t for _, t in pairs]))
    assert found.tolist() == [1 + 10**9 * (c + 1) // t for c, t in pairs]


def test_divergences_of_parts_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(divergence, "CELLS", 7)
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 20)
    monkeypatch.setattr(divergence, "SHARD", 9)
    rng = random.Random(15)
    docs = [(" ".join(rng.choice(["Äpfel", "b", "C", "d", "日本", f"r{k}"]) for _ in range(rng.randrange(9))), rng.choice("xy"), rng.choice("stu")) for k in range(80)] + [(None, "only", None), ("a a", None, "s"), ("a", None, "t"), ("a", "", "t")]
    found = divergence.source_divergences(spark.createDataFrame(docs, "text string, lang string, source string"), top=2).collect()
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        own = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)})))
        groups[lang or "", source or ""].update(own)
        df[lang or ""].update(own.keys())
    out = Counter()
    for (lang, source) in groups:
        kept = [t for t, n in df[lang].items() if n >= 3]
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[u] for u in kept) + len(kept)) for t in kept} for (l, s), c in groups.items() if l == lang}
        all_of = sum((c for (l, _), c in groups.items() if l == lang), Counter())
        q = {t: 1 + 10**9 * (all_of[t] + 1) // (sum(all_of[u] for u in kept) + len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        pairs = sorted((-sum(f(p[source][t], p[o][t]) for t in kept), o.encode()) for o in p if o != source)
        terms = sorted((-f(p[source][t], q[t]), t.encode()) for t in kept if groups[lang, source][t] and p[source][t] > q[t])[:2]
        for part, values in (("pair", pairs), ("term", terms)):
            out.update((lang, source, part, item.decode(), -v, rank) for rank, (v, item) in enumerate(values, 1))
    assert Counter(map(tuple, found)) == out
