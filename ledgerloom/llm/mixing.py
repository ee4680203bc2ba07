"""Mixing sources to target weights by hash order and distributed prefix sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, fresh, text_of, without

ADDED = ("size", "source_size", "target", "taken")
#: The fewest buckets of a source's hash range, and the rows that one has at most on average.
LEAST_BUCKETS, BUCKET_ROWS = 1024, 50_000


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeat: int) -> DataFrame:
    """Targets of sources from (no_source, source, source_size), one row per source.

    All sizes together are shared by weight; no target exceeds max_repeat times its source's size
    and what is above is reshared by weight among the rest. In the order of cap over weight, a
    source is at its cap exactly if an equal share by weight of what the earlier ones leave exceeds
    it, so one pass finds all. Whole numbers up to the last division keep the result exact.
    This table has a row per source, not per document.
    """
    big = "decimal(38,0)"
    by_name = W.orderBy("no_source", "source")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights) + 1)
    everything = W.orderBy("ratio", "no_source", "source").rowsBetween
    before, after = everything(W.unboundedPreceding, -1), everything(0, W.unboundedFollowing)
    whole = everything(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        sizes.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * max_repeat)
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(whole))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("capped", F.col("left").cast(big) * F.col("weight") > F.col("cap").cast(big) * F.col("weights_left"))
    )
    free = ~F.col("capped")
    rest = F.col("total") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(whole), F.lit(0))
    rest_weight = F.sum(F.when(free, F.col("weight"))).over(whole)
    share = (F.col("weight") * rest).cast("double") / rest_weight
    return ranked.select(
        "no_source",
        "source",
        "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def mix_sources(
    docs: DataFrame,
    weights: Sequence[int] = (5, 2, 1),
    max_repeat: int = 3,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    seed: str = "mix-1",
    buckets: int | None = None,
) -> DataFrame:
    """How many words of each document a mix with the given weights of sources takes.

    Sources in code point order (null is a source of its own, the last) have the weights in turn.
    Each source's documents are ordered by a seeded hash of their id (of their text where that is
    null), which is a random but repeatable order; equal ids come by size, and rows equal in both are
    interchangeable. A source's
    budget is the whole part of its target. It takes all documents as often as whole epochs fit,
    then the documents up to the budget in hash order; the last one is cut, so each source takes
    exactly its budget and no document more than max_repeat times its size. Documents without words
    (null, empty or blank text) take 0. Returns the rows of docs with size, source_size, target and
    taken; input columns of these names give way. An empty table gives no rows.

    The prefix sums are distributed: a source's hash range is cut into equal buckets, each bucket's
    words are summed before any shuffle, the sums of the buckets before it (at most ``buckets`` rows
    a source) give its offset, and documents are sorted only within their bucket. A source with a
    third of all rows is as many buckets as any other. By default there are LEAST_BUCKETS, and more
    where they would have over BUCKET_ROWS of all rows each; their number doesn't change the result.
    """
    docs = without(docs, *ADDED)
    if buckets is None:
        buckets = LEAST_BUCKETS
        rows = docs.count()
        while rows > buckets * BUCKET_ROWS:
            buckets *= 2
    n = fresh(docs, "no_source", "source", "key", "bucket", "offset", "before", "size")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    words = F.regexp_count(text_of(text_col), F.lit(WORD)).cast("bigint") if size is None else size.cast("bigint")
    digits = len(f"{buckets - 1:x}")
    if buckets != 16**digits and buckets & (buckets - 1):
        raise ValueError("buckets must be a power of two")
    name = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("-"), F.col(text_col).cast("string")), F.lit("-"))
    key = F.substring(F.md5(F.concat(name, F.lit(f":{seed}"))), 1, 16)
    rows = docs.select(
        *columns,
        F.col(source_col).isNull().alias(n["no_source"]),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias(n["source"]),
        key.alias(n["key"]),
        F.coalesce(words, F.lit(0)).alias(n["size"]),
    )
    bucket = F.floor(F.conv(F.substring(F.col(n["key"]), 1, digits), 16, 10).cast("int") * buckets / 16**digits).cast("int")
    rows = rows.withColumn(n["bucket"], bucket)

    group = [n["no_source"], n["source"], n["bucket"]]
    sums = rows.groupBy(*group).agg(F.sum(n["size"]).alias(n["offset"]))
    sums = sums.select(F.col(group[0]).alias("no_source"), F.col(group[1]).alias("source"), F.col(group[2]).alias("bucket"), F.col(n["offset"]).alias("words"))
    sizes = sums.groupBy("no_source", "source").agg(F.sum("words").alias("source_size"))
    earlier = W.partitionBy("no_source", "source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        sums.withColumn("offset", F.coalesce(F.sum("words").over(earlier), F.lit(0)))
        .join(source_targets(sizes, weights, max_repeat), ["no_source", "source"])
        .select(
            F.col("no_source").alias(group[0]),
            F.col("source").alias(group[1]),
            F.col("bucket").alias(group[2]),
            F.col("offset").alias(n["offset"]),
            "source_size",
            "target",
        )
    )
    within = W.partitionBy(*group).orderBy(n["key"], F.col(id_col).asc_nulls_last(), n["size"]).rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumn(n["before"], F.coalesce(F.sum(n["size"]).over(within), F.lit(0))).join(offsets, group)
    budget = F.floor(F.col("target")).cast("bigint")
    epochs = F.when(F.col("source_size") > 0, F.expr(f"cast(floor(target) as bigint) div nullif(source_size, 0)")).otherwise(F.lit(0))
    left = budget - epochs * F.col("source_size") - F.col(n["offset"]) - F.col(n["before"])
    taken = F.col(n["size"]) * epochs + F.least(F.col(n["size"]), F.greatest(F.lit(0), left))
    return placed.select(*columns, F.col(n["size"]).alias("size"), "source_size", "target", taken.cast("bigint").alias("taken"))
