"""The text operators on small tables with every odd row, against DuckDB SQL or brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import __spark_entry__ as entry_module
import corpus_pipeline
from ledgerloom.llm import bloom_search, decontaminate, divergence, exact_dedup, html_text, language, lm_scores, mixing, pii, quality, queries, simhash, token_counts, vector_search

from .spec import linked_components, main_texts, pipeline as expected_pipeline, simhash as spec_simhash, site_pages

SCHEMAS = {
    "documents": pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("n_chars", pa.int64())] + [(c, pa.string()) for c in ("pii", "size", "row", "keep_id", "rejected", "score", "items", "N_Words")]),
    "benchmark": pa.schema([("item_id", pa.int64()), ("text", pa.string())]),
    "labels": pa.schema([("doc_id", pa.int64()), ("quality", pa.int64()), ("toxic", pa.int64())]),
    "embeddings": pa.schema([("vec_id", pa.int64()), ("embedding", pa.list_(pa.float32())), ("label", pa.int32()), ("score", pa.string()), ("q", pa.string()), ("ID", pa.int64())]),
    "pages": pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("text", pa.string())]),
}


def rows() -> dict[str, list[tuple]]:
    rng = random.Random(7)
    words = ["lorem", "Ipsum", "dolor", "sit", "amet", "über", "naïve", "x1", "foo-bar", "a@b.example", "日本", "the", "the", "the"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    item = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", " \t\n", "!!!", "a", "Ä", "the the", "Copy of a text", "Copy  of\na text", "copy of a text", "Copy of a text", item, f"Before {item.upper()} after", "short item here", "x short item y"]
    texts += ["mail Me.x+1@a-b.example.org or 10.0.0.256 and 192.168.1.1, card 4111 1111 1111 1111 or 4111111111111112", "call +44 (20) 7946-0958 iban account GB82 WEST 1234 5698 7654 32", "1.2.3.4.5.6.7.8 @@ a@b.c_d@e.f + +1 +12345678901234567"]
    texts += [prose(rng.randrange(1, 120)) for _ in range(60)]
    base = prose(400)
    texts += [base, f"{base} tail", base.replace("lorem", "LOREM"), prose(2_000), "z" * 200_000, "<|endoftext|> the <|startoftext|>"]
    docs = [(k, t, rng.choice(["en", "de", None]), rng.choice(["a", "a", "a", "b", "B", None, "c"]), len(t or ""), *["clash"] * 8) for k, t in enumerate(texts)]
    docs += [docs[7], docs[7], docs[0], (None, "no id", None, None, None, *[None] * 8), (None, "no id", "en", "a", 1, *[None] * 8), (None, None, None, None, None, *[None] * 8)]
    labels = [(k, k % 2, (k // 2) % 2) for k in range(0, 60)] + [(3, 1, None), (None, 1, 1), (4, None, 0), (4, 1, 0)]
    page = "<html><head><title>t</title></head><body><div class='box'><p>Same on all pages</p></div><article><h1>Head {k}</h1><p>A &amp; B {k}<br>more</p></article></body></html>"
    pages = [(k, f"http://www.host.example/p{k}", page.replace("{k}", str(k)), "clash") for k in range(30)]
    pages += [(90, None, None, None), (91, "::bad::[", "", "x"), (None, "", "plain <b>bold</b> text", None), pages[0], pages[0], (92, "http://x", "<p>one<p>two<script>var a = '<p>no';</script><div class='sidebar'>no</div>", None)]
    vectors = [(k, [rng.choice([-0.5, 0.25, 0.1, 1.5]) for _ in range(4)], 0) for k in range(120)]
    vectors += [(k, [0.25, 0.1, -0.5, 1.5], 1) for k in range(120, 420)]  # most score alike
    vectors += [vectors[0], vectors[0], vectors[50], (50, [0.1, 0.1, 0.1, 0.1], 2), (50, [0.1001, 0.1, 0.1, 0.1], 2), (None, [9.0, 9.0, 9.0, 9.0], 3), (None, None, 3), (100, None, 3), (150, [], 3), (600, [1.0, None], 3), (650, [float("nan")], 3)]
    vectors += [(700, [float("inf"), 1.0], 3), (750, [2.0], 3), (751, [1.0] * 9, 3), (800, [-1.0] * 9, 3)]
    vectors = [(*v, "clash", None, 1) for v in vectors]
    return {"embeddings": vectors, "documents": docs, "benchmark": [(1, item), (2, "Short item"), (3, None), (4, ""), (None, "short ITEM"), (1, item), (22, f"{item} thirteen")], "labels": labels, "pages": pages}


def write(folder, tables: dict[str, list[tuple]]) -> str:
    for name, schema in SCHEMAS.items():
        columns = [[r[k] for r in tables.get(name, [])] for k in range(len(schema))]
        pq.write_table(pa.table([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema), f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def odd(tmp_path_factory) -> str:
    return write(tmp_path_factory.mktemp("odd"), rows())


def rounded(row) -> tuple:
    return tuple(round(x, 5) if isinstance(x, float) else x for x in row)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, odd, name):
    con = duckdb.connect()
    for table in SCHEMAS:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{odd}/{table}.parquet'")
    expected = con.execute(queries.ORACLE_SQL[name])
    order = sorted(c[0] for c in expected.description)
    at = [[c[0] for c in expected.description].index(c) for c in order]
    expected = Counter(rounded(r[k] for k in at) for r in expected.fetchall())
    found = queries.QUERIES[name](spark, odd)
    assert sorted(found.columns) == order
    assert Counter(rounded(r) for r in found.select(*order).collect()) == expected


def test_empty_tables_give_no_rows(spark, tmp_path):
    empty = write(tmp_path, {})
    for name, query in queries.QUERIES.items():
        assert query(spark, empty).collect() == [], name
    assert corpus_pipeline.run(spark, empty).collect() == []


def test_simhash_is_the_brute_force_result(spark, odd):
    docs = [r for r in rows()["documents"]]
    prints = {r[0]: spec_simhash(r[1]) for r in docs if r[0] is not None}
    expected = linked_components(list(prints.items()))
    found = queries.QUERIES["op3_simhash"](spark, odd).collect()
    assert len(found) == len(docs)
    for r in found:
        if r.doc_id is not None:
            assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", expected[r.doc_id])


def test_simhash_tiles_lose_no_link(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    prints = sorted({s ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for s in seeds for _ in range(30)} | {rng.getrandbits(64) for _ in range(200)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, p) for p in signed], "print long, node long")
    found = simhash.units(nodes, 3, 8, len(prints)).repartition("unit").sortWithinPartitions("unit", "ones").select("unit", "print", "node").mapInArrow(lambda b: simhash.links(b, 3), "a long, b long")
    component = {r.node: r.component for r in simhash.components(found).collect()}
    expected = linked_components(list(zip(signed, prints)))
    groups = lambda of: {frozenset(k for k in signed if of(k) == g) for g in {of(k) for k in signed}}
    assert groups(lambda k: component.get(k, k)) == groups(expected.__getitem__)


def test_simhash_compares_tiles_and_skips_those_too_far_apart():
    rng = np.random.default_rng(5)
    prints = np.unique(rng.integers(0, 1 << 20, 3000, dtype=np.uint64) | np.uint64(rng.integers(0, 2**63)) << np.uint64(20))
    prints = prints[np.argsort(np.bitwise_count(prints), kind="stable")]
    ones = np.bitwise_count(prints).astype(np.int64)
    pairs, skipped = simhash.tile_pairs(np.zeros(len(prints), np.int64), ones, 1, 64)
    tiles = -(-len(prints) // 64)
    assert len(pairs) + skipped == tiles * (tiles + 1) // 2 and skipped > tiles
    units = np.repeat(np.arange(-(-len(prints) // 8)), 8)[: len(prints)]
    assert len(simhash.tile_pairs(units, ones, 1, 64)[0]) == tiles  # whole units in each tile: only tiles with themselves
    i, j = simhash.tile_links(np.zeros(len(prints), np.int64), prints, 1, 64)
    label = simhash.forest(len(prints), i, j)
    all_i, all_j = simhash.near(prints, prints, 1)
    assert (label == simhash.forest(len(prints), all_i, all_j)).all()


def test_token_counts_by_piece_are_those_of_whole_texts(spark, odd):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rng = random.Random(5)
    pieces = ["a", "'s", "é", "́", "Ünï", " ", "　", "​", "\x1c", "\x85", " ", "<|endoftext|>", "<|startoftext|>", "1 2", "日本語", "😀", "\t", "\n\n", "...", "DON'T", "﻿", "ﬁ"]
    texts = ["".join(rng.choice(pieces) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 12))) for _ in range(20_000)]
    count = token_counts.counter(path)
    whole = count(texts)
    batch = pa.RecordBatch.from_pydict({"digest": pa.array([b""] * len(texts)), "t": pa.array(texts)})
    by_piece = next(token_counts.encoded(iter([batch]), path, "t", True)).column("n_tokens").to_pylist()
    assert [t for t, a, b in zip(texts, whole, by_piece) if a != b] == []
    texts = {r[0]: r[1] or "" for r in rows()["documents"] if r[0] is not None}
    for r in queries.QUERIES["op7_token_counts"](spark, odd).filter("doc_id IS NOT NULL").collect():
        n = count([texts[r.doc_id]])[0]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_token_cache_is_used_and_appended_to(spark, odd, tmp_path):
    import public_tokenizers

    path, cache = public_tokenizers.path("word_bpe_49k.json"), str(tmp_path / "cache")
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    first = token_counts.token_counts(docs.filter("doc_id < 40"), path, cache).select("doc_id", "n_tokens").collect()
    held = lambda: token_counts.cached_counts(spark, cache, token_counts.version(path)).count()
    before = held()
    again = token_counts.token_counts(docs, path, cache)
    assert held() > before
    assert set(first) <= set(again.select("doc_id", "n_tokens").collect())
    assert {"pii", "n_bytes", "n_tokens"} <= set(again.columns)


def test_languages_of_held_out_documents(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = queries.QUERIES["op2_language"](spark, "/root/testdata/sf0.01").join(docs, "doc_id").filter("held_out AND lang IS NOT NULL")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.97
    for r in queries.QUERIES["op2_language"](spark, odd).collect():
        assert r.lang_pred in ("en", "de", "und") and 0 <= r.score <= 1
        if r.doc_id in (0, 1, 2, 3):
            assert (r.lang_pred, r.score) == ("und", 0.0)


def brute_force_languages(model, text: str, penalty: float) -> tuple[list[float], list[float]]:
    """Proportions of the chosen languages and of all, by loops."""
    data = np.frombuffer(text.encode(), np.uint8)
    n = Counter(language.trigrams(data, np.array([0, len(data)]))[1].tolist())
    k, total = len(model.langs), sum(n.values())
    ratio = {f: [float(x) for x in model.ratio[f]] for f in n}

    def em(langs):
        share = [1 / len(langs) if j in langs else 0.0 for j in range(k)]
        for _ in range(25):
            new = [0.0] * k
            for f, c in n.items():
                whole = sum(ratio[f][j] * share[j] for j in langs)
                for j in langs:
                    new[j] += c * ratio[f][j] * share[j] / whole / total
            share, change = new, max(abs(a - b) for a, b in zip(share, new))
            if change < 1e-3:
                break
        return share, sum(c * math.log(sum(ratio[f][j] * share[j] for j in langs)) for f, c in n.items())

    every, _ = em(range(k))
    order = sorted(range(k), key=lambda j: -every[j])
    cost = penalty * math.log(total + 1)
    first = max(range(k), key=lambda j: sum(c * math.log(ratio[f][j]) for f, c in n.items()))
    sets = [[first], *(order[:size] for size in range(2, k + 1))]
    return max((em(s) for s in sets), key=lambda x: x[1] - cost * (sum(y > 0 for y in x[0]) - 1))[0], every


def test_mixtures_are_the_brute_force_result():
    rng = random.Random(8)
    alphabets = ["abcde", "defgh", "ghijk", "jklma", "mnopq", "xyzab"]
    prose = lambda a, n: " ".join("".join(rng.choice(a) for _ in range(rng.randrange(2, 6))) for _ in range(n))
    counts = np.zeros((language.FEATURES, len(alphabets)))
    for j, a in enumerate(alphabets):
        data = np.frombuffer(prose(a, 2000).encode(), np.uint8)
        np.add.at(counts[:, j], language.trigrams(data, np.array([0, len(data)]))[1], 1)
    model = language.Model([f"l{j}" for j in range(len(alphabets))], counts)
    texts = [" ".join(prose(a, rng.randrange(5, 60)) for a in rng.sample(alphabets, size)) for size in (1, 1, 2, 3, 4, 5, 6) for _ in range(3)]
    whole = np.frombuffer("".join(texts).encode(), np.uint8)
    chosen, every = language.infer(model, whole, np.concatenate([[0], np.cumsum([len(t) for t in texts])]), 3.0, 25)
    for t, own, all_ in zip(texts, chosen, every):
        expected = brute_force_languages(model, t, 3.0)
        assert own == pytest.approx(expected[0], abs=1e-5) and all_ == pytest.approx(expected[1], abs=1e-5)
    assert max(np.count_nonzero(chosen, axis=1)) > 3


def test_tied_and_many_languages(spark):
    labelled = spark.createDataFrame([("aaa bbb", "x"), ("aaa bbb", "y"), *((f"{chr(945 + k // 20)}{chr(1072 + k % 20)} " * 9, f"l{k:03}") for k in range(300))], "text string, lang string")
    docs = spark.createDataFrame([(0, "aaa bbb"), (1, f"{chr(945)}{chr(1079)} {chr(945)}{chr(1079)}"), (2, "12"), (3, None), (0, "aaa bbb")], "doc_id long, text string")
    found = [(r.doc_id, r.lang_pred) for r in language.identify_languages(docs, labelled, keep=["doc_id"]).collect()]
    assert sorted(found) == [(0, "x"), (0, "x"), (1, "l007"), (2, "und"), (3, "und")]


def test_quality_of_labels_that_were_not_learned(spark, odd):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    part = F.col("doc_id") % 2
    judged = quality.classify(docs, labels.filter(part == 0)).join(labels.filter(part == 1), "doc_id").select("quality", "toxic", "rejected").collect()
    clean = [r.rejected for r in judged if r.quality == 1 and r.toxic == 0]
    bad = [r.rejected for r in judged if r.quality == 0 or r.toxic == 1]
    assert sum(clean) <= 0.05 * len(clean) and sum(bad) >= 0.7 * len(bad)
    assert queries.QUERIES["op6_quality"](spark, odd).count() == len(rows()["documents"])
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, none).filter("rejected").count() == 0


def test_weights_of_priors_are_the_brute_force_result(spark):
    """Sites' means and spreads in numpy."""
    rng = np.random.default_rng(4)
    rows = [(k, f"t{k}", f"h{h}", f"p{p}") for k, (h, p) in enumerate((h, p) for h in range(6) for p in range(1 + h % 3) for _ in range(1 + (7 * h + 3 * p) % 11))]
    rows += [rows[0], (None, None, None, None), (900, "t900", "h1", None)]
    evidence = {r[1]: float(x) for r, x in zip(rows, rng.normal(0, 1.5, len(rows)) + [0.8 * len(r[2] or "") * ((r[2] or "h0") > "h2") for r in rows])}
    table = pd.DataFrame([(r[2] or "", r[3] or "", 1 / (1 + np.exp(-evidence[r[1]]))) for r in rows], columns=["host", "path", "p"])
    sums = table.assign(square=table.p**2).groupby(["host", "path"]).agg(n=("p", "size"), quality=("p", "sum"), square_quality=("square", "sum")).reset_index()
    hosts = sums.groupby("host").agg(host_n=("n", "sum"), host_quality=("quality", "sum")).reset_index()
    found = quality.spread(spark.createDataFrame(sums), spark.createDataFrame(hosts), "quality")
    n, (h, s) = len(table), (table.groupby("host").p, table.groupby(["host", "path"]).p)
    within_host, within_path = ((table.p - g.transform("mean")) ** 2 for g in (h, s))
    between_host, between_path = (h.transform("mean") - table.p.mean()) ** 2, (s.transform("mean") - h.transform("mean")) ** 2
    k, m = h.ngroups, s.ngroups
    noise = within_host.sum() / (n - k)
    signal = (between_host.sum() / (k - 1) - noise) / ((n - (h.size() ** 2).sum() / n) / (k - 1))
    assert found[0] == pytest.approx(table.p.mean()) and found[1] == pytest.approx(min(max(noise / signal, 1), 1e6) if signal > 0 else 1e6)
    noise = within_path.sum() / (n - m)
    sizes = n - (s.size() ** 2 / s.size().groupby("host").transform("sum")).sum()
    signal = (between_path.sum() / (m - k) - noise) / (sizes / (m - k))
    assert found[2] == pytest.approx(min(max(noise / signal, 1), 1e6) if signal > 0 else 1e6)


def test_posteriors_and_rejections_are_the_brute_force_result(spark):
    """The trained classifiers' evidence, and all sums over sites, in plain numpy over every document but the judged one."""
    rng = random.Random(21)
    good, bad, foul = "clear fine helpful sound".split(), "spam click cheap deal".split(), "vile nasty".split()
    docs, labels = [], []
    for k in range(240):
        host, path = rng.choice(["a", "a", "a", "b", "c", None]), rng.choice(["x", "y", None])
        poor, toxic = rng.random() < (0.7 if host == "b" else 0.25), rng.random() < (0.4 if path == "y" else 0.1)
        words = [rng.choice((bad if poor else good) + ["the", "of", f"n{k}"]) for _ in range(rng.randrange(4, 30))] + [rng.choice(foul)] * toxic
        docs.append((k, " ".join(words) if k % 40 else None, host, path))
        if k % 2:
            labels.append((k, int(not poor), int(toxic)))
    docs += [docs[5], docs[5]]
    found = quality.classify(spark.createDataFrame(docs, "doc_id long, text string, source string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    of = {k: (q, t) for k, q, t in labels}
    own = sorted({d for d in docs if d[0] in of})
    batch = pa.RecordBatch.from_arrays([pa.array([float(of[d[0]][0]) for d in own]), pa.array([float(of[d[0]][1]) for d in own]), pa.array([d[1] for d in own])], ["quality", "toxic", "text"])
    models = next(quality.train(quality.example_rows(iter([batch])), 800, 1e-6)).to_pylist()
    assert {m["target"] for m in models} == {"quality", "toxic"}
    expected = {}
    for m in models:
        model = quality.Classifier(m["words"], m["weights"], m["intercept"], m["rate"])
        _, data, offsets = next(quality.chunks(pa.array([d[1] for d in docs])))
        z = model.evidence(*quality.features(data, offsets))
        base = math.log(m["rate"] / (1 - m["rate"]))
        p = 1 / (1 + np.exp(-(z + base)))
        hosts, sites = [d[2] for d in docs], [(d[2], d[3]) for d in docs]
        mean_of = lambda group: {g: p[[x == g for x in group]].mean() for g in set(group)}  # noqa: E731, B023
        n, of_host, of_site, sizes, site_sizes = len(p), mean_of(hosts), mean_of(sites), Counter(hosts), Counter(sites)
        within = [sum((x - mean[g]) ** 2 for x, g in zip(p, group)) for mean, group in ((of_host, hosts), (of_site, sites))]
        between = [sum((of_host[h] - p.mean()) ** 2 for h in hosts), sum((of_site[s] - of_host[s[0]]) ** 2 for s in sites)]
        counts = [(n - sum(c * c for c in sizes.values()) / n) / (len(sizes) - 1), (n - sum(c * c / sizes[g[0]] for g, c in site_sizes.items())) / (len(site_sizes) - len(sizes))]
        degrees = [(n - len(sizes), len(sizes) - 1), (n - len(site_sizes), len(site_sizes) - len(sizes))]
        weights = []
        for w, b, c, (dw, db) in zip(within, between, counts, degrees):
            noise, signal = w / dw, (b / db - w / dw) / c
            weights.append(min(max(noise / signal, 1.0), 1e6) if signal > 0 else 1e6)
        for k, d in enumerate(docs):
            other_host = sum(x for j, x in enumerate(p) if hosts[j] == hosts[k] and j != k)
            other_site = sum(x for j, x in enumerate(p) if sites[j] == sites[k] and j != k)
            host = (other_host + weights[0] * p.mean()) / (sizes[hosts[k]] - 1 + weights[0])
            site = (other_site + weights[1] * host) / (site_sizes[sites[k]] - 1 + weights[1])
            expected[d[0], m["target"]] = 1 / (1 + math.exp(-(z[k] + math.log(site / (1 - site)))))
    assert len(found) == len(docs)
    for r in found:
        assert (r.p_quality, r.p_toxic) == (pytest.approx(expected[r.doc_id, "quality"], abs=1e-5), pytest.approx(expected[r.doc_id, "toxic"], abs=1e-5))
        assert r.rejected == (r.p_quality < 0.5 or r.p_toxic > 0.3)
    assert {r.rejected for r in found} == {True, False}


def test_site_posterior_shrinks_small_sites(spark):
    docs = spark.createDataFrame([(k, "same words here", "big", "p") for k in range(50)] + [(99, "same words here", "small", "p")], "doc_id long, text string, source string, lang string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {round(r.p_quality, 6) for r in quality.classify(docs, none).collect()} == {0.5}
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(3, 1, 0)], "doc_id long, quality int, toxic int")
    rows = [(k, f"{'good fine' if k % 2 else 'bad poor'} words {k}", "a" if k < 30 else "b", None) for k in range(40)]
    rows += [rows[3]] * 30 + [(None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    by_text = [{(r.text, r.p_quality, r.rejected) for r in quality.classify(docs, labels, strength=w).collect()} for w in (None, 20.0)]
    assert all(len({t for t, _, _ in found}) == len(found) == 41 for found in by_text)  # repeated rows are answered alike


def test_html_text_without_the_site_template(spark, odd):
    found = {(r.page_id, r.text) for r in queries.QUERIES["op4_html_text"](spark, odd).collect()}
    assert (5, "Head 5\n\nA & B 5 more") in found
    assert {(90, ""), (91, ""), (92, "one\n\ntwo"), (None, "plain bold text")} <= found
    pages = spark.createDataFrame(
        [(k, f"http://h.example/{k}", f"<div>Menu of the site</div><div><p>Page {k} has its own words</p></div>") for k in range(30)] + [(77, "http://o.example/1", "<div>Menu of the site</div>")],
        "page_id long, url string, html string",
    )
    found = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert found[3] == "Page 3 has its own words" and found[77] == "Menu of the site"


def test_html_template_of_small_hosts_and_of_sections(spark):
    own = lambda host, k, menu: (1000 * len(host) + k, f"http://{host}/{k}", f"<div class='wrap no-sidebar'><ul>{menu}</ul><div><p>Own words {host} {k}</p></div></div>")
    pages = [own("five", k, "<li>Menu of five</li>") for k in range(5)] + [own("sections", k, f"<li>Section {k % 2}</li><li>News</li>") for k in range(40)] + [own("two", k, "<li>Menu of two</li>") for k in range(2)]
    found = {r.page_id: (r.text, r.n_template) for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert found[4003] == ("Own words five 3", 1) and found[8007] == ("Own words sections 7", 2)
    assert found[3001] == ("Menu of two\n\nOwn words two 1", 0)  # two pages are no site


def test_html_text_is_the_brute_force_result(spark):
    pages = site_pages(random.Random(11))
    expected = main_texts([(url, source) for _, url, source in pages])
    found = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [found[k] for k in range(len(pages))] == expected and len(set(expected)) > 50


@pytest.mark.parametrize(
    ("source", "blocks"),
    [
        ('<article><p>x</p><section id="related-work"><p>y</p></section></article>', ["x", "y"]),
        ('<article><p>one <span class="ad">promo <b>t</b></span> two</p><p>three</p></article>', ["one two", "three"]),
        ('<article><p><span class="ad">promo</p><p>three</p></article>', ["three"]),
        ("<article><span class=ad>promo <p>a</p><p>b</p></article>", ["a", "b"]),
        ("<article><span class=ad>promo <div>a</div></span><p>b</p></article>", ["b"]),
        ("<form><nav>m</nav><article><p>t</p></article></form>", ["t"]),
        ("<nav>m<article><p>t</p></article>", ["t"]),
        ("<aside>teaser<article>no</article></aside><p>main</p>", ["main"]),
        ('<article><p>t</p><div id="comments"><p>c</p></div></article>', ["t"]),
        (f'<span class="ad">{"x" * 30_000}</span>rest', ["rest"]),
        ("<div>a" * 20_000 + "</div>" * 20_000, ["a"] * 20_000),
        ("<p>word &amp; " + "long " * 200_000, ["word & " + "long " * 199_999 + "long"]),
    ],
)
def test_blocks_of_single_pages(source, blocks):
    page = html_text.Page(source)
    assert [t for t, m in zip(page.blocks, page.main) if m] == blocks


LONG = "the main text of this page goes on for a while " * 8
LONG = LONG.strip()


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>intro</p><article><p>short</p></article><p>long main text</p>", "intro\n\nshort\n\nlong main text"),
        (f"<article><p>teaser card</p></article><div>{LONG}</div>", f"teaser card\n\n{LONG}"),
        (f"<p>We sell tea.</p><article><p>{LONG}</p></article><p>One line of the site</p>", LONG),
        (f"<body class='has-sidebar with-comments'><div class='page no-ads'><p>{LONG}</p></div></body>", LONG),
        (f"<div><a href=x>one</a></div><div><a href=y>two</a></div><div><a href=z>three</a></div><p>{LONG} <a href=q>link</a></p>", f"{LONG} link"),
        ("<p><a href=x>one</a></p><p><a href=y>two</a></p><p><a href=z>three</a></p>", "one\n\ntwo\n\nthree"),
        (f"<article><header class='entry-header'><h1>Head</h1></header><p>{LONG}</p></article>", f"Head\n\n{LONG}"),
        *[(f"<p>{LONG}</p><div {mark}>no</div>", LONG) for mark in ("class=comment", "class='reader-comments'", "class=notice", "class='x cookie-bar'", "class='sidebar-left'", "class=ad-banner", "class=adsbygoogle", "class=header", "class='footer-links'", "id='nav-menu'", "class=siteHeader", "class=CookieNotice")],
    ],
)
def test_main_text_of_single_pages(spark, source, text):
    page = html_text.Page(source)
    packed = html_text.packed(["" if not x else ("a" if page.has_article and m else "b") + t for t, x, m in zip(page.blocks, page.left, page.main)])
    batch = pa.RecordBatch.from_arrays([pa.array([packed]), pa.array([None], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], names=["blocks", "gone"])
    found = next(html_text.joined_blocks(iter([batch]), {"blocks": "blocks", "gone": "gone", "text": "text", "n": "n"}, []))
    assert found["text"][0].as_py() == text


def test_context_words_decide(spark):
    number, secret = "1234567890", "a1b2c3d4e5f6a7b8c9d0e1f2"
    texts = [f"account {number}", f"order {number}", f"token = {secret}", f"commit {secret}", f"example token {secret}", "ssn 123-45-6789", "part 123-45-6789", "GB82 WEST 1234 5698 7654 32", "sample GB82 WEST 1234 5698 7654 32", "example me@x.example"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: [(s.kind, s.score) for s in r.pii] for r in pii.find_pii(docs).collect()}
    assert found == {0: [("account", 0.6)], 1: [], 2: [("secret", 0.7)], 3: [], 4: [], 5: [("ssn", 0.7)], 6: [], 7: [("iban", 0.6)], 8: [], 9: [("email", 0.6)]}


def test_digests_that_collide_do_not_merge_texts(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "ab"), (3, "c"), (4, "d"), (5, " d ")], "doc_id long, text string")
    found = exact_dedup.exact_dedup(docs, digest=lambda norm: F.lit("same"))
    assert {(r.doc_id, r.keep_id, r.group_size) for r in found.collect()} == {(1, 1, 2), (2, 1, 2), (3, 3, 1), (4, 5, 2), (5, 5, 2)}
    assert {r.doc_id for r in exact_dedup.kept_documents(docs).collect()} == {1, 3, 5}


def test_mixing_takes_the_budget_whatever_the_buckets(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    results = [Counter((r.doc_id, r.source, r.taken) for r in mixing.mix_sources(docs, buckets=b).collect()) for b in (1, 64, 1024)]
    assert results[0] == results[1] == results[2]
    mixed = mixing.mix_sources(docs)
    for r in mixed.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect():
        assert r.taken == int(r.target)
    assert mixed.filter("taken > 3 * size").isEmpty()


def test_redaction_names_the_kinds(spark):
    docs = spark.createDataFrame([("write to a@b.example now",), (None,), ("",)], "text string")
    assert [r.text for r in pii.redact(docs).collect()] == ["write to [email] now", "", ""]
    spans = pii.find_pii(docs).first().pii
    assert [(s.kind, s.start, s.end) for s in spans] == [("email", 9, 20)] and spans[0].score == 1.0


def brute_force_scores(texts, corpus, least=1, alpha=0.4):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if c < "\x7f" else c for c in t or ""))
    one, two = Counter(), Counter()
    for own in map(words, corpus):
        one.update([*own, *[""] * bool(own)])
        two.update(zip(["", *own], own))
    total = sum(n for w, n in one.items() if w)
    score = lambda a, b: two[a, b] / one[a] if two[a, b] >= least else alpha * max(one[b], 1) / max(total, 1)
    return [round(sum(math.log(score(a, b)) for a, b in zip(["", *own], own)), 4) for own in map(words, texts)]


@pytest.mark.parametrize("least", [1, 2])
@pytest.mark.parametrize("share", [1 / 1000, 1 / 10, 1 / 100_000])
def test_scores_are_the_brute_force_result(spark, monkeypatch, least, share):
    monkeypatch.setattr(lm_scores, "SHARE", share)
    monkeypatch.setattr(lm_scores, "PENDING", 500)
    rng = random.Random(2)
    texts = [None, "", "one", "ONE two", *(" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randrange(60))) for _ in range(80))]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    found = {r.doc_id: round(r.log_score, 4) for r in lm_scores.score_documents(docs, least=least).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx(brute_force_scores(texts, texts, least), abs=2e-4)
    half = docs.filter("doc_id % 2 = 0")
    found = {r.doc_id: round(r.log_score, 4) for r in lm_scores.score_documents(docs, least=least, corpus=half).collect()}
    assert [found[k] for k in range(len(texts))] == pytest.approx(brute_force_scores(texts, texts[::2], least), abs=2e-4)


def test_pipeline_stages(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        assert out.columns[: len(docs.columns)] == docs.columns or name == corpus_pipeline.STAGES[-1][0]
        rows_out = out.collect()
        assert len(rows_out) <= docs.count()
        docs = spark.createDataFrame(rows_out, out.schema)
    assert "pipeline" in entry_module.queries()


def test_pipeline_by_brute_force(spark, tmp_path):
    """Without labels nothing is rejected, so all that the pipeline leaves can be told from the texts alone."""
    rng = random.Random(12)
    vocabulary = [f"w{k}" for k in range(300)]
    item = " ".join(f"item{k}" for k in range(14))
    docs = [(0, None), (1, ""), (2, "a b"), (3, "a  b"), (4, f"before {item} after"), (5, item.upper()), (6, "short question"), (7, "a short question here")]
    while len(docs) < 110:
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 150))]
        for _ in range(rng.choice((1, 1, 1, 2, 4))):
            docs.append((len(docs), " ".join(words) + " " * rng.randrange(2)))
            words = list(words)
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
    docs = [(k, t, rng.choice(["a", "a", "a", "b", "c", "d", None])) for k, t in docs]
    pad = [None] * (len(SCHEMAS["documents"]) - 5)
    items = [item, "short question", None]
    folder = write(tmp_path, {"documents": [(k, t, "en", s, len(t or ""), *pad) for k, t, s in docs], "benchmark": list(enumerate(items))})
    assert {r.doc_id: r.taken for r in corpus_pipeline.run(spark, folder).collect()} == expected_pipeline(docs, items)


def test_several_blocks_of_windows_find_the_same(spark, odd):
    docs, items = (spark.read.parquet(f"{odd}/{t}.parquet") for t in ("documents", "benchmark"))
    many = items.unionByName(spark.createDataFrame([(1000 + k, "one two three four five six seven eight nine ten") for k in range(500)], "item_id long, text string"))
    found = [sorted((str(r.doc_id), r.n_hit, tuple(r["items"])) for r in decontaminate.decontaminate(docs, many, keep=["doc_id"], **options).collect()) for options in ({}, {"block_windows": 3}, {"block_bytes": 2000})]
    assert found[0] == found[1] == found[2] and max(len(r[2]) for r in found[0]) > 500


def test_long_words_and_texts_are_read_whole(spark):
    docs = spark.createDataFrame([(1, "w " * 300_000 + "a@b.example", None)], "doc_id long, text string, source string")
    assert mixing.mix_sources(docs).first()["size"] == 300_001
    assert pii.find_pii(docs).first().pii[0].start == 600_000
