"""Exact search for the rows with the largest inner products, by histograms of scores that are refined.

No row is sorted by score and no list of scores is kept. Every row is scored against a block of
queries; tasks count scores by bins, the counts are summed over all tasks, and the bin that holds a
query's k-th score is cut into finer bins in the next pass, until its scores are one value or exactly
the rows still wanted. A last pass keeps what reaches that score.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Components of a block of queries, and scores that are held at once; a longer vector is a block of its own.
BLOCK, SCORES = 1 << 20, 1 << 21
#: Bins of a pass.
BINS = 2048
#: Integers up to here are exact in doubles.
EXACT = 1 << 53


class Queries(NamedTuple):
    """A block of queries: ids, a padded row of whole components each, how long they are, how many rows of the table each stands for."""

    ids: np.ndarray
    vectors: np.ndarray
    lengths: np.ndarray
    copies: np.ndarray


def usable(embedding: str) -> Column:
    """Neither null nor with a component that is null or not finite."""
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: F.coalesce(odd(x), F.lit(True)))


def padded(vectors: pa.Array, width: int, factor: float) -> np.ndarray:
    """floor(factor x) of each component, as whole doubles; zeros after a vector's end, nothing beyond the width."""
    lengths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = np.floor(factor * pc.list_flatten(vectors).to_numpy(zero_copy_only=False).astype(np.float64))
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    inside = at < width
    out[row[inside], at[inside]] = flat[inside]
    return out


def products(queries: Queries, rows: np.ndarray, largest: float) -> np.ndarray:
    """Scores of each query (rows) and vector (columns). Doubles hold them where the largest possible sum is exact, else 64-bit integers."""
    if float(np.abs(queries.vectors).sum(1).max(initial=0)) * largest < EXACT:
        return queries.vectors @ rows.T
    return queries.vectors.astype(np.int64) @ rows.astype(np.int64).T


def scored(batches: Iterator[pa.RecordBatch], queries: Queries, largest: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, whether an id is there, scores, whether a pair isn't a query with its own row or a repeat of it) of a few rows at a time."""
    width, step = queries.vectors.shape[1], max(1, SCORES // max(1, len(queries.ids)))
    for batch in batches:
        for a in range(0, batch.num_rows, step):
            part = batch.slice(a, step)
            ids = pc.fill_null(part.column(0), 0).to_numpy(zero_copy_only=False)
            there = pc.is_valid(part.column(0)).to_numpy(zero_copy_only=False)
            rows = padded(part.column(1), width, 256.0)
            other = np.ones((len(queries.ids), len(ids)), bool)
            lengths = pc.list_value_length(part.column(1)).to_numpy(zero_copy_only=False)
            q, r = np.nonzero((queries.ids[:, None] == ids[None, :]) & there[None, :])
            same = np.fromiter((lengths[j] == queries.lengths[i] and np.array_equal(queries.vectors[i], rows[j]) for i, j in zip(q, r)), bool, len(q))
            other[q[same], r[same]] = False
            yield ids, there, products(queries, rows, largest), other


def kth_of(scores: np.ndarray, other: np.ndarray, k: int, least: np.ndarray) -> np.ndarray:
    """For each query the k-th largest of these scores, or least where that is more: a lower bound of the k-th of all."""
    if scores.shape[1] < k + 1:
        return least
    own = np.where(other, scores, np.iinfo(np.int64).min)
    return np.maximum(least, np.partition(own, own.shape[1] - k, axis=1)[:, -k])


def counted(queries: Queries, low: np.ndarray, width: np.ndarray, high: np.ndarray, open_: np.ndarray, k: int, largest: float) -> Callable:
    """Counts (query, bin, n) of scores in [low, high) by bins of the query's width, and as bin -1 those from high on.

    What lies below the k-th score of the rows that a task has seen can't be the k-th of all and isn't counted.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        floor = low
        for _, _, scores, other in scored(batches, queries, largest):
            floor = kth_of(scores, other, k, floor)
            q, r = np.nonzero((scores >= floor[:, None]) & other & open_[:, None])
            s = scores[q, r].astype(np.int64)
            place = np.where(s >= high[q], -1, (s - low[q]) // width[q])
            pairs, n = np.unique(np.stack([q, place]), axis=1, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0].astype(np.int32)), pa.array(pairs[1].astype(np.int32)), pa.array(n.astype(np.int64))], ["q", "bin", "n"])

    return count


def reaching(queries: Queries, least: np.ndarray, k: int, largest: float) -> Callable:
    """(query, id, score) of what reaches the least score; of rows with exactly that score only the k smallest ids of those seen together."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, there, scores, other in scored(batches, queries, largest):
            q, r = np.nonzero((scores >= least[:, None]) & other)
            s = scores[q, r].astype(np.int64)
            order = np.lexsort((ids[r], ~there[r], -s, q))
            q, r, s = q[order], r[order], s[order]
            first = np.searchsorted(q, q)
            kept = np.arange(len(q)) - first < k
            q, r, s = q[kept], r[kept], s[kept]
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(ids[r].astype(np.int64), mask=~there[r]), pa.array(s)], ["q", "id", "score"])

    return keep


def located(counts: DataFrame, low: np.ndarray, width: np.ndarray, high: np.ndarray, queries: Queries, own: np.ndarray, wanted: int) -> dict[int, tuple[int, int, int]]:
    """For each query (its bin of the wanted-th score, how many scores lie above it, how many in it); none where there are fewer scores.

    A query's repeats have its own score; they aren't counted by tasks and are added here. One row a query comes to the driver.
    """
    more = [(i, int(-1 if own[i] >= high[i] else (own[i] - low[i]) // width[i]), int(queries.copies[i] - 1)) for i in range(len(own)) if queries.copies[i] > 1 and own[i] >= low[i]]
    if more:
        counts = counts.unionByName(counts.sparkSession.createDataFrame(more, "q int, bin int, n long"))
    counts = counts.groupBy("q", "bin").agg(F.sum("n").alias("n"))
    order = F.when(F.col("bin") < 0, F.lit(-(1 << 31))).otherwise(-F.col("bin"))
    above = W.partitionBy("q").orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    at = counts.withColumn("upto", F.sum("n").over(above)).filter(F.col("upto") >= wanted)
    first = at.groupBy("q").agg(F.min_by(F.struct("bin", (F.col("upto") - F.col("n")).alias("above"), "n"), "upto").alias("at"))
    return {r.q: (r["at"]["bin"], r["at"]["above"], r["at"]["n"]) for r in first.collect()}


def search_block(rows: DataFrame, queries: Queries, k: int, largest: float) -> DataFrame:
    """(q, id, score): for each query of the block at least its k best rows, and few others."""
    reach = np.ceil(np.abs(queries.vectors).sum(1) * largest)
    if reach.max() >= 1 << 62:
        raise ArithmeticError("scores beyond 62 bits")
    reach = reach.astype(np.int64)
    own = (queries.vectors.astype(np.int64) ** 2).sum(1)
    low, high = -reach, reach + 1
    width = -(-(high - low) // BINS)
    open_ = np.ones(len(own), bool)
    while open_.any():
        counts = rows.mapInArrow(counted(queries, low, width, high, open_, k, largest), "q int, bin int, n long")
        found = located(counts, low, width, high, queries, own, k)
        for q in np.flatnonzero(open_):
            if q not in found:  # fewer rows than wanted: all of them
                open_[q] = False
                continue
            place, above, n = found[q]
            bottom = int(low[q] + place * width[q])
            open_[q] = width[q] > 1 and above + n > k
            low[q], high[q] = bottom, bottom + int(width[q])
            width[q] = -(-(high[q] - low[q]) // BINS)
    out = rows.mapInArrow(reaching(queries, low, k, largest), "q int, id long, score long")
    more = [(i, int(queries.ids[i]), int(own[i])) for i in range(len(own)) for _ in range(int(min(queries.copies[i] - 1, k))) if own[i] >= low[i]]
    return out.unionByName(rows.sparkSession.createDataFrame(more, "q int, id long, score long")) if more else out


def search(vectors: DataFrame, is_query: Column, k: int, id_column: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best rows by the integer inner product of floor(256 x), its own row left out.

    Queries are the rows with is_query, in blocks of so many components that a block fits any task;
    all rows are scored against each block in its scan, without a shuffle. Ties go to the smaller id,
    null ids last. Null vectors and those with a component that is null or not finite take no part. A
    shorter vector counts as zero beyond its end, so an empty one scores zero. Repeated rows are rows
    of their own: each is a query and is found by the others. Other columns are ignored, an empty
    table gives no rows. Scores beyond 62 bits are an error.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v"), is_query.alias("is_query")).filter(usable("v"))
    whole = F.transform("v", lambda x: F.floor(x * 256.0).cast("double"))
    queries = rows.filter("is_query AND id IS NOT NULL").groupBy("id", whole.alias("v")).agg(F.count(F.lit(1)).alias("copies"))
    largest = float(rows.agg(F.max(F.array_max(F.transform(whole, F.abs)))).first()[0] or 0)
    queries = written(queries.withColumn("size", F.greatest(F.size("v"), F.lit(1)).cast("long")), "queries")
    total = queries.agg(F.sum("size")).first()[0]
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    blocks = -(-total // BLOCK)
    queries = queries.withColumn("block", F.pmod(F.xxhash64("id", "v"), F.lit(blocks)))
    plain, out = rows.select("id", "v"), None
    for block in range(blocks):
        own = queries.filter(F.col("block") == block).select("id", "v", "copies").toArrow()
        if not own.num_rows:
            continue
        lengths = pc.list_value_length(own["v"]).to_numpy()
        q = Queries(own["id"].to_numpy(), padded(own["v"].combine_chunks(), max(1, lengths.max()), 1.0), lengths, own["copies"].to_numpy())
        names = spark.createDataFrame([(i, int(n), int(c)) for i, (n, c) in enumerate(zip(q.ids, q.copies))], "q int, query_id long, copies long")
        best = W.partitionBy("q").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        found = search_block(plain, q, k, largest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
        found = found.join(names, "q").select("query_id", "rank", F.col("id").alias("vec_id"), "score", "copies")
        part = written(found, "neighbours")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("query_id", "rank", "vec_id", "score")
