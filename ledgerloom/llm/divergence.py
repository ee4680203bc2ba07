"""How the words of sources differ within a language: counts of terms by source, and divergences between them.

Texts are split, encoded and counted by Arrow's own kernels in each task; what tasks have counted is
merged in shards of whole terms, and the shards' kept terms are turned into divergences with numpy.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: What stands between terms: terms are runs of A-Z, a-z and of what is beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once, counts that a task holds, cells (terms times sources) that are compared at once.
PIECE, HELD, CELLS = 4 << 20, 1 << 20, 1 << 21
#: Counted terms that are merged in one task.
SHARD = 1 << 21
#: Probabilities are whole billionths.
UNIT = 1_000_000_000


def pieces(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Slices of about PIECE bytes of text; a longer text is alone."""
    size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    ends, a = np.cumsum(size), 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + PIECE, side="right")))
        yield batch.take(pa.array(np.arange(a, b)))  # a copy: ascii_lower misreads slices
        a = b


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of the rows a task has seen, in parts: occurrences of a term in a group and the documents with it."""
    held: list[pa.Table] = []
    keys = ["lang", "source", "term"]

    def merged() -> pa.Table:
        table = pa.concat_tables(held).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return table.rename_columns({"n_sum": "n", "docs_sum": "docs"}).select([*keys, "n", "docs"])

    for batch in batches:
        for piece in pieces(batch):
            words = pc.split_pattern_regex(pc.ascii_lower(piece.column("text").cast(pa.large_string())), BETWEEN)
            doc, word = pc.list_parent_indices(words), pc.list_flatten(words)
            there = pc.not_equal(word, "")
            term = word.filter(there).dictionary_encode()
            own = pa.table({"doc": doc.filter(there), "term": term.indices}).group_by(["doc", "term"]).aggregate([([], "count_all")])
            own = pa.table({"lang": piece.column("lang").cast(pa.string()).take(own["doc"]), "source": piece.column("source").cast(pa.string()).take(own["doc"]), "code": own["term"], "c": own["count_all"]})
            own = own.group_by(["lang", "source", "code"]).aggregate([("c", "sum"), ("c", "count")])
            held.append(pa.table({"lang": own["lang"], "source": own["source"], "term": term.dictionary.cast(pa.string()).take(own["code"]), "n": own["c_sum"], "docs": own["c_count"]}))
        if len(held) > 1 and sum(t.num_rows for t in held) > HELD:
            held = [merged()]
            if held[0].num_rows > HELD // 2:
                yield from held.pop().to_batches()
    if held:
        yield from merged().to_batches()


def per_unit(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / total) for count < total, in 64 bits: long division by three digits at a time."""
    rest = count + 1
    out = rest // total
    rest = rest - out * total
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def merge_shard(least: int) -> Callable:
    """All counts of some terms, merged: a row for each kept term with its sources and counts; a row without a term says how many terms of a language there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not parts:
            return
        rows = pa.concat_tables(parts).group_by(["lang", "term", "source"]).aggregate([("n", "sum"), ("docs", "sum")])
        terms = rows.group_by(["lang", "term"]).aggregate([("docs_sum", "sum"), ("source", "list"), ("n_sum", "list")])
        terms = terms.filter(pc.greater_equal(terms["docs_sum_sum"], least)).select(["lang", "term", "source_list", "n_sum_list"]).rename_columns(["lang", "term", "sources", "counts"])
        found = terms.append_column("terms", pa.nulls(terms.num_rows, pa.int64()))
        size = terms.group_by("lang").aggregate([("term", "count")])
        none = [pa.nulls(size.num_rows, terms.schema.field(c).type) for c in ("term", "sources", "counts")]
        yield from found.to_batches()
        yield from pa.table([size["lang"], *none, size["term_count"]], names=found.column_names).to_batches()

    return run


def compare(groups: dict[str, list[tuple[str, int]]], terms: dict[str, tuple[int, int]], top: int) -> Callable:
    """Over rows of kept terms: parts of the sums between sources, and each source's terms that may be among its top.

    groups: a language's sources with their counts over kept terms; terms: how many terms it keeps and their count.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {lang: np.zeros((len(own), len(own)), np.int64) for lang, own in groups.items()}
        best: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for lang in pc.unique(batch["lang"]).to_pylist():
                rows = pa.Table.from_batches([batch.filter(pc.equal(batch["lang"], lang))]).combine_chunks()
                own, (kept, total) = groups[lang], terms[lang]
                bases = np.array([n for _, n in own], np.int64) + kept
                names = pa.array([s for s, _ in own], pa.string())
                step = max(1, CELLS // len(own))
                for a in range(0, rows.num_rows, step):
                    part = rows.slice(a, step)
                    lists = part["sources"].combine_chunks()
                    counts = np.zeros((part.num_rows, len(own)), np.int64)
                    counts[pc.list_parent_indices(lists).to_numpy(), pc.index_in(pc.list_flatten(lists), names).to_numpy()] = pc.list_flatten(part["counts"].combine_chunks()).to_numpy()
                    p, q = per_unit(counts, bases[None, :]), per_unit(counts.sum(1), np.int64(total + kept))
                    for k in range(len(own)):
                        sums[lang][k] += differences(p[:, k : k + 1], p).sum(0)
                        at = np.flatnonzero((counts[:, k] > 0) & (p[:, k] > q))
                        value = differences(p[at, k], q[at])
                        if len(value) > top:
                            large = value >= np.partition(value, len(value) - top)[len(value) - top]
                            at, value = at[large], value[large]
                        words = np.array([w.encode() for w in part["term"].take(pa.array(at)).to_pylist()], dtype=object)
                        if (lang, k) in best:
                            value, words = np.concatenate([value, best[lang, k][0]]), np.concatenate([words, best[lang, k][1]])
                        order = sorted(range(len(value)), key=lambda i: (-value[i], words[i]))[:top]
                        best[lang, k] = value[order], words[order]
        out = [(lang, own[k][0], "pair", own[o][0], int(sums[lang][k, o])) for lang, own in groups.items() for k in range(len(own)) for o in range(len(own)) if k != o and sums[lang][k, o]]
        out += [(lang, groups[lang][k][0], "term", w.decode(), int(v)) for (lang, k), (value, words) in best.items() for v, w in zip(value, words)]
        columns = list(zip(*out)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, [pa.string()] * 4 + [pa.int64()])], ["lang", "source", "part", "item", "value"])

    return run


def source_divergences(docs: DataFrame, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): how far a source's words are from those of the language's other sources, and which words set it apart.

    Terms are compared by their billionths p = 1 + floor(1e9 (count + 1) / (N + V)) over the V terms that
    at least ``least`` documents of the language have. A part ``pair`` sums (p - q)^2 div q over all of
    them, with q of the other source; a part ``term`` has it for single terms against the language's own
    q, the ``top`` largest of those the source has more of. All in 64-bit integers, exact for counts
    that add up to less than 2^53 (rather than 2^63, for the long division). Null text, lang and source
    are ''; documents without terms still make their group; other columns are ignored, repeated rows
    count as often as they stand, an empty table gives no rows. The groups' totals come to the driver:
    one row each, and the result has the square of a language's.
    """
    spark = docs.sparkSession
    d = docs.select(*[F.coalesce(c, F.lit("")).alias(c) for c in ("text", "lang", "source")])
    groups = written(d.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), "groups")
    counts = written(d.mapInArrow(count_terms, "lang string, source string, term string, n long, docs long"), "term-counts")
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), counts.count() // SHARD)
    kept = counts.repartition(shards, "lang", "term").mapInArrow(merge_shard(least), "lang string, term string, sources array<string>, counts array<bigint>, terms long")
    kept = written(kept, "kept-terms")
    size = {r.lang: r.n for r in kept.filter("term IS NULL").groupBy("lang").agg(F.sum("terms").alias("n")).collect()}
    kept = kept.filter("term IS NOT NULL").drop("terms")
    of_source = kept.select("lang", F.explode(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("n"))).alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    totals = groups.join(of_source, ["lang", "source"], "left").select("lang", "source", F.coalesce("n", F.lit(0)).alias("n"))
    own: dict[str, list[tuple[str, int]]] = {}
    for r in totals.orderBy("lang", "source").collect():
        own.setdefault(r.lang, []).append((r.source, r.n))
    if not own:
        return spark.createDataFrame([], "lang string, source string, part string, item string, value long, rank int")
    terms = {lang: (size.get(lang, 0), sum(n for _, n in sources)) for lang, sources in own.items()}
    found = kept.mapInArrow(compare(own, terms, top), "lang string, source string, part string, item string, value long")
    # Each pair stands once with nothing, so that languages without kept terms and equal sources have theirs.
    sources = groups.select("lang", "source")
    empty = sources.join(sources.select("lang", F.col("source").alias("item")), "lang").filter("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    found = found.unionByName(empty).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    best = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    return found.withColumn("rank", F.row_number().over(best)).filter((F.col("part") == "pair") | (F.col("rank") <= top)).select("lang", "source", "part", "item", "value", "rank")
