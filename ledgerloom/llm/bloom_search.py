"""Ranked search over bit-sliced signatures of documents, exactly rescored.

The index is built once from the texts: how often terms stand in how many documents, and for blocks of
documents a Bloom filter each, held by slices: row s of a block says in a bit per document whether
anything in it hashes to s. A document puts in (term, level) for each level that its count of the term
reaches, so the slices tell how often it has the term, never too low. A search sums the slices' bits by
weights to an upper bound of each document's score, rescores the few with the highest bounds, and then
all documents whose bound isn't below the k-th score found so.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .words import ALNUM, LOWER, chunks, mix, word_bounds, word_hashes

#: Slices for each entry of the fullest document in a block, and slices that an entry sets.
SLICES, SETS = 8, 2
#: Documents and bytes of a block's slices.
BLOCK_DOCS, BLOCK_BYTES = 1024, 4 << 20
#: Counts whose reaching a signature tells. Between two levels the upper bound is one below the next.
LEVELS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, 24, 28, 32, 40, 48, 64, 96, 128, 256, 512, 1024, 4096, 16384, 65536])
#: Items and bytes of their terms in a block, and terms whose bits are summed at once.
BLOCK_ITEMS, ITEM_BYTES, SLAB = 256, 256 << 10, 4096
#: Candidate documents up to which their ids, 16 bytes each, are broadcast; beyond it they meet the texts by a shuffle.
BROADCAST_IDS = 500_000

SIGNATURES = "ids array<bigint>, n array<bigint>, slices binary, n_slices int"
INDEX = f"kind string, term string, docs long, words long, {SIGNATURES}"


class Tokens(NamedTuple):
    """Terms of some texts: the distinct ones, and (text, term, count) for each pair that occurs, ordered by text."""

    terms: pa.LargeStringArray
    doc: np.ndarray
    term: np.ndarray
    count: np.ndarray
    words: np.ndarray  # of each text


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    """Runs of letters, digits and what is beyond ASCII, only A-Z lower-cased."""
    starts, ends, first = word_bounds(data, offsets, ALNUM)
    words = np.diff(first)
    inside = np.ascontiguousarray(LOWER[data[ALNUM[data]]])
    ends = np.concatenate([[0], np.cumsum(ends - starts)])
    all_words = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(inside)).dictionary_encode()
    size = max(1, len(all_words.dictionary))
    pairs, count = np.unique(np.repeat(np.arange(len(words)), words) * size + all_words.indices.to_numpy(), return_counts=True)
    return Tokens(all_words.dictionary, pairs // size, pairs % size, count, words)


def term_hashes(terms: pa.LargeStringArray) -> np.ndarray:
    """64 bits for each term, from its bytes alone."""
    if not len(terms):
        return np.zeros(0, np.uint64)
    _, offsets, data = terms.buffers()
    offsets = np.frombuffer(offsets, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    return word_hashes(np.frombuffer(data, np.uint8), offsets[:-1], offsets[1:])


def slices_of(term: np.ndarray, level: np.ndarray | int, n_slices: int) -> list[np.ndarray]:
    """The slices that an entry sets."""
    h = mix(term + np.uint64(0x9E3779B97F4A7C15) * (np.atleast_1d(level).astype(np.uint64) + np.uint64(1)))
    return [((h if k == 0 else mix(h + np.uint64(k))) % np.uint64(n_slices)).astype(np.int64) for k in range(SETS)]


def signatures(own: Tokens, ids: pa.Array) -> Iterator[tuple[pa.Array, np.ndarray, bytes, int]]:
    """Blocks (ids, words, slices, how many) of the texts that have terms; within one the fullest has at most about twice the entries of the emptiest."""
    hashes = term_hashes(own.terms)
    levels = np.searchsorted(LEVELS, own.count, side="right")
    entries = np.bincount(own.doc, levels, len(own.words)).astype(np.int64)
    order = np.flatnonzero(own.words)
    order = order[np.argsort(entries[order], kind="stable")]
    a = 0
    while a < len(order):
        b = min(a + BLOCK_DOCS, int(np.searchsorted(entries[order], 2 * entries[order[a]] + 32, side="right")))
        while b > a + 1 and (b - a + 7) // 8 * SLICES * int(entries[order[b - 1]]) > BLOCK_BYTES:
            b = a + (b - a + 1) // 2
        docs, n_slices = order[a:b], SLICES * int(entries[order[b - 1]])
        column = np.full(len(own.words), -1)
        column[docs] = np.arange(len(docs))
        pairs = np.flatnonzero(column[own.doc] >= 0)
        repeat = levels[pairs]
        level = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        bits = np.zeros((n_slices, -(-len(docs) // 8) * 8), bool)
        for s in slices_of(np.repeat(hashes[own.term[pairs]], repeat), level, n_slices):
            bits[s, np.repeat(column[own.doc[pairs]], repeat)] = True
        yield ids.take(pa.array(docs)), own.words[docs], np.packbits(bits, axis=1).tobytes(), n_slices
        a = b


def lists(parts: list[pa.Array]) -> pa.Array:
    """One list for each part."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.concat_arrays([pa.array([], pa.int64()), *parts]))


def index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (id, text): a row for each distinct term of some texts with how many have it, and one for each block of signatures."""
    names = ["kind", "term", "docs", "words", *[f.split()[0] for f in SIGNATURES.split(", ")]]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.int32()]
    for batch in batches:
        for row, data, offsets in chunks(batch.column(1)):
            own = tokens(data, offsets)
            k, blocks = len(own.terms), list(signatures(own, batch.column(0).slice(row, len(own.words))))
            if k:
                docs = pa.array(np.bincount(own.term, minlength=k).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(["term"] * k), own.terms.cast(pa.string()), docs, *[pa.nulls(k, t) for t in types[3:]]], names=names)
            if blocks:
                of, n, slices, how_many = zip(*blocks)
                size = [pa.array([int(x.sum()) for x in n], pa.int64()), lists(list(of)), lists([pa.array(x.astype(np.int64)) for x in n])]
                yield pa.RecordBatch.from_arrays([pa.array(["block"] * len(n)), pa.nulls(len(n), pa.string()), pa.array([len(x) for x in n], pa.int64()), *size, pa.array(slices, pa.binary()), pa.array(how_many, pa.int32())], names=names)


class Index(NamedTuple):
    terms: DataFrame  # term, df
    blocks: DataFrame  # SIGNATURES
    documents: int  # with a term
    words: int


def build_index(docs: DataFrame) -> Index:
    """Signatures and term statistics of (id, text), in one pass over the texts."""
    rows = written(docs.mapInArrow(index_rows, INDEX), "search-index")
    blocks = rows.filter("kind = 'block'")
    total = blocks.agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")).first()
    terms = rows.filter("kind = 'term'").groupBy("term").agg(F.sum("docs").alias("df"))
    return Index(terms, blocks.select("ids", "n", "slices", "n_slices"), total["docs"] or 0, total["words"] or 0)


class Items(NamedTuple):
    """A block of items: their distinct terms with weights, and which item (rows) has which term (columns)."""

    terms: list[str]
    weights: np.ndarray
    item: np.ndarray
    term: np.ndarray
    n: int
    documents: int
    words: int

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """What documents of n words set against counts."""
        return 50 + 50 * n.astype(np.int64) * self.documents // self.words

    def matrix(self) -> np.ndarray:
        out = np.zeros((self.n, len(self.terms)))
        out[self.item, self.term] = self.weights[self.term]
        return out


def part_of(count: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a term's count adds for each unit of its weight; grows with the count."""
    return 1_000_000_000 * count // (1000 * count + 20 * m)


def bounds(items: Items, weights: np.ndarray, hashes: np.ndarray, slices: bytes, n_slices: int, n: np.ndarray) -> np.ndarray:
    """Upper bounds of the scores of items (rows) and a block's documents (columns): bits of each level times weights, summed."""
    rows = np.frombuffer(slices, np.uint8).reshape(n_slices, -1)
    m = items.lengths(n)
    most = np.append(LEVELS[1:] - 1, np.iinfo(np.int32).max)
    out = np.zeros((items.n, len(n)))
    alive, bits, before = np.arange(len(hashes)), None, np.zeros(len(n), np.int64)
    for level in range(len(LEVELS)):
        found = np.bitwise_and.reduce([rows[s] for s in slices_of(hashes[alive], level, n_slices)])
        bits = found if bits is None else found & bits
        some = bits.any(1)
        alive, bits = alive[some], bits[some]
        if not len(alive):
            break
        here = part_of(np.minimum(most[level], n), m)
        for a in range(0, len(alive), SLAB):
            own = np.unpackbits(bits[a : a + SLAB], axis=1)[:, : len(n)].astype(np.float64)
            out += (weights[:, alive[a : a + SLAB]] @ own) * np.maximum(here - before, 0)
        before = here
    return out * (1 + 1e-12)  # never below, where sums are beyond what doubles hold


def bounded(items: Items, least: np.ndarray | None, k: int) -> Callable:
    """Over signatures: without least the k documents with the highest bounds of each item, (item, id); with it the ids whose bound reaches it for any item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, hashes = items.matrix(), term_hashes(pa.array(items.terms, pa.large_string()))
        best, owner, ids = np.zeros((items.n, 0)), np.zeros((items.n, 0), np.int64), []
        for batch in batches:
            for r in range(batch.num_rows):
                own, n, slices, n_slices = (batch.column(c)[r] for c in range(4))
                own, n = own.values, n.values.to_numpy()
                upper = bounds(items, weights, hashes, slices.as_buffer(), n_slices.as_py(), n)
                if least is not None:
                    reach = own.take(pa.array(np.flatnonzero((upper >= least[:, None]).any(0))))
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(reach), np.int32)), reach, pa.array(np.zeros(len(reach)))], names=["item", "id", "bound"])
                    continue
                owner = np.concatenate([owner, np.broadcast_to(np.arange(len(ids), len(ids) + upper.shape[1]), upper.shape)], axis=1)
                best, ids = np.concatenate([best, upper], axis=1), ids + own.to_pylist()
                if best.shape[1] > k:
                    top = np.argpartition(-best, k - 1, axis=1)[:, :k]
                    best, owner = np.take_along_axis(best, top, 1), np.take_along_axis(owner, top, 1)
                    used, place = np.unique(owner, return_inverse=True)
                    ids, owner = [ids[u] for u in used], place.reshape(owner.shape)
        if least is None:
            item, at = np.nonzero(best > 0)
            yield pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array([ids[o] for o in owner[item, at]], pa.int64()), pa.array(best[item, at])], names=["item", "id", "bound"])

    return run


def rescored(items: Items, least: np.ndarray, k: int) -> Callable:
    """From (id, text): exact scores (item, id, score) that reach the item's least; of some texts seen together only an item's k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(items.terms, pa.large_string())
        order = np.argsort(items.term, kind="stable")
        of_term = np.searchsorted(items.term[order], np.arange(len(items.terms) + 1))
        for batch in batches:
            ids = batch.column(0)
            for row, data, offsets in chunks(batch.column(1)):
                own = tokens(data, offsets)
                term = pc.fill_null(pc.index_in(own.terms, wanted), -1).to_numpy(zero_copy_only=False)[own.term]
                hit = term >= 0
                term, doc, count = term[hit], own.doc[hit], own.count[hit].astype(np.int64)
                value = items.weights[term] * part_of(count, items.lengths(own.words)[doc])
                uses = of_term[term + 1] - of_term[term]
                at = np.repeat(of_term[term], uses) + np.arange(uses.sum()) - np.repeat(np.cumsum(uses) - uses, uses)
                scores = np.zeros((items.n, len(own.words)), np.int64)
                np.add.at(scores, (items.item[order][at], np.repeat(doc, uses)), np.repeat(value, uses))
                item, d = np.nonzero(scores >= np.maximum(least, 1)[:, None])
                own_ids = pc.take(ids, pa.array(d + row))
                number, there = pc.fill_null(own_ids, 0).to_numpy(zero_copy_only=False), pc.is_valid(own_ids).to_numpy(zero_copy_only=False)
                by = np.lexsort((number, ~there, -scores[item, d], item))
                keep = by[np.arange(len(by)) - np.searchsorted(item[by], item[by]) < k]
                yield pa.RecordBatch.from_arrays([pa.array(item[keep].astype(np.int32)), own_ids.take(pa.array(keep)), pa.array(scores[item[keep], d[keep]])], names=["item", "id", "score"])

    return run


def best_of(rows: DataFrame, k: int) -> DataFrame:
    best = W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, index: Index, items: Items, k: int) -> DataFrame:
    """(item, id, score, rank) of the k best documents of each item of the block."""
    spark, score = docs.sparkSession, "item int, id long, score long"
    none = np.zeros(items.n, np.int64)
    high = index.blocks.mapInArrow(bounded(items, None, k), "item int, id long, bound double")
    first = W.partitionBy("item").orderBy(F.desc("bound"), F.asc_nulls_last("id"))
    seeds = written(high.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= k).select("id").distinct(), "search-seeds")
    some = docs.join(F.broadcast(seeds), docs["id"].eqNullSafe(seeds["id"]), "left_semi")  # k a item at most
    found = best_of(some.mapInArrow(rescored(items, none, k), score), k).filter(F.col("rank") == k).select("item", "score").collect()
    least = none.copy()
    for r in found:
        least[r["item"]] = r["score"]
    candidates = index.blocks.mapInArrow(bounded(items, np.maximum(least, 1), k), "item int, id long, bound double").select("id").distinct()
    candidates = written(candidates, "search-candidates")
    if candidates.count() <= BROADCAST_IDS:
        candidates = F.broadcast(candidates)
    left = docs.join(candidates, docs["id"].eqNullSafe(candidates["id"]), "left_semi")
    return best_of(left.mapInArrow(rescored(items, least, k), score), k)


def search(docs: DataFrame, items: DataFrame, k: int, id_column: str = "doc_id", item_column: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): for each item the k documents with the highest scores above 0, ties to the smaller id, null ids last.

    A score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms, with w =
    floor(1000 ln((2 N + 2) / (2 df + 1))) and m = 50 + (50 n N) div L. Items go in blocks of a bounded
    size of terms; the index is built once. Null texts have no terms; an item without terms, or whose
    terms no document has, finds nothing. Items that repeat, or have no id, are items of their own;
    documents that repeat are found as often as they stand. Other columns are ignored; without
    documents or items there are no rows. However many documents the bounds leave, all are rescored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text).alias("text"))
    index = build_index(docs)
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = F.array_distinct(F.regexp_extract_all(low, F.lit(r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"), F.lit(1)))
    own = items.select(F.col(item_column).alias("item_id"), terms.alias("terms")).filter(F.size("terms") > 0)
    own = written(own.withColumn("row", F.monotonically_increasing_id()), "items")
    out = None
    if index.words:
        total = own.agg(F.sum(F.aggregate("terms", F.lit(0).cast("long"), lambda a, t: a + F.octet_length(t) + 8))).first()[0] or 0
        blocks = max(-(-total // ITEM_BYTES), -(-own.count() // BLOCK_ITEMS))
        place = F.pmod(F.xxhash64("row"), F.lit(max(1, blocks)))
        df = (2.0 * F.col("df") + 1.0)
        weight = F.floor(1000 * F.log((2.0 * index.documents + 2.0) / df)).alias("w")
        used = own.select(place.alias("block"), "row", F.explode("terms").alias("term")).join(index.terms, "term").select("block", "row", "term", weight)
        used = written(used, "item-terms")
        for block in range(blocks):
            rows = used.filter(F.col("block") == block).toArrow()
            if not rows.num_rows:
                continue
            row, term = (rows[c].combine_chunks().dictionary_encode() for c in ("row", "term"))
            code = term.indices.to_numpy()
            weights = np.zeros(len(term.dictionary), np.int64)
            weights[code] = rows["w"].to_numpy()
            part = Items(term.dictionary.to_pylist(), weights, row.indices.to_numpy().astype(np.int64), code.astype(np.int64), len(row.dictionary), index.documents, index.words)
            names = spark.createDataFrame([(i, r) for i, r in enumerate(row.dictionary.to_pylist())], "item int, row long")
            found = search_block(docs, index, part, k).join(names, "item").join(own.select("row", "item_id"), "row")
            found = written(found.select("item_id", "rank", F.col("id").alias("doc_id"), "score"), "search-results")
            out = found if out is None else out.unionByName(found)
    if out is None:
        kind = items.schema[item_column].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    return out
