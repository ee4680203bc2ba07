"""Order without one long partition: prefix sums, predecessors, as-of and range joins by time buckets.

A window over one key (an instrument, an account) is one task, however many rows it has. Here time
is cut into buckets; rows are ordered only within (keys, bucket), and what a bucket needs from the
earlier ones comes from a table with one row per key and bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SECOND = 1_000_000
MINUTE = 60 * SECOND
HOUR = 60 * MINUTE
DAY = 24 * HOUR


def to_us(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone."""
    return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.col(ts) if isinstance(ts, str) else ts)


def from_us(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def bucket_of(us: Column | str, width: int) -> Column:
    return F.floor((F.col(us) if isinstance(us, str) else us) / F.lit(width)).cast("bigint")


def _matching(keys: Sequence[str], left: str, right: str) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}"))
    return out


def running_sums(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], sums: dict[str, str], bucket: int = 30 * DAY) -> DataFrame:
    """Add inclusive running sums of columns, {new name: column}, in the order of time and ties within keys."""
    df = df.withColumn("_bucket", bucket_of(time, bucket))
    totals = df.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = totals.select(*keys, "_bucket", *[F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in sums])
    within = W.partitionBy(*keys, "_bucket").orderBy(time, *ties).rowsBetween(W.unboundedPreceding, 0)
    local = df.withColumns({f"_own_{n}": F.sum(c).over(within) for n, c in sums.items()})
    joined = local.alias("l").join(carry.alias("c"), _matching([*keys, "_bucket"], "l", "c"))
    return joined.select("l.*", *[(F.col(f"c._carry_{n}") + F.col(f"l._own_{n}")).alias(n) for n in sums]).drop("_bucket", *[f"_own_{n}" for n in sums])


def with_previous(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], values: dict[str, str], bucket: int = DAY) -> DataFrame:
    """Add the value that columns, {new name: column}, have in the row before, in the order of time and ties within keys."""
    df = df.withColumn("_bucket", bucket_of(time, bucket))
    order = F.struct(time, *ties)
    last = df.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(*[F.col(c).alias(n) for n, c in values.items()]), order).alias("_last"))
    carry = last.withColumn("_last", F.lag("_last").over(W.partitionBy(*keys).orderBy("_bucket")))
    within = W.partitionBy(*keys, "_bucket").orderBy(time, *ties)
    local = df.withColumn("_first", F.row_number().over(within) == 1).withColumns({f"_own_{n}": F.lag(c).over(within) for n, c in values.items()})
    joined = local.alias("l").join(carry.alias("c"), _matching([*keys, "_bucket"], "l", "c"))
    out = [F.when(F.col("l._first"), F.col(f"c._last.{n}")).otherwise(F.col(f"l._own_{n}")).alias(n) for n in values]
    return joined.select("l.*", *out).drop("_bucket", "_first", *[f"_own_{n}" for n in values])


def asof_backward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_ties: Sequence[str], values: dict[str, str], strict: bool = False, bucket: int = DAY
) -> DataFrame:
    """left with, {new name: right column}, the values of the last right row at or before it (before it, if strict).

    Of right rows of the same time the last one by right_ties counts. Left rows without one get nulls.
    """
    hit = F.struct(*[F.col(c).alias(n) for n, c in values.items()], F.lit(True).alias("_hit"))
    r = right.select(*keys, F.col(right_time).alias("_t"), F.struct(*right_ties).alias("_tie"), hit.alias("_r"))
    rows = left.withColumn("_left", F.struct(*left.columns)).select(*keys, F.col(left_time).alias("_t"), "_left")
    both = rows.select(*keys, "_t", F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_tie"].dataType).alias("_tie"), F.lit(None).cast(r.schema["_r"].dataType).alias("_r"), "_left").unionByName(
        r.select(*keys, "_t", F.lit(1 if strict else 0).alias("_side"), "_tie", "_r", F.lit(None).cast(rows.schema["_left"].dataType).alias("_left"))
    )
    both = both.withColumn("_bucket", bucket_of("_t", bucket))
    last = both.groupBy(*keys, "_bucket").agg(F.max_by("_r", F.when(F.col("_r").isNotNull(), F.struct("_t", "_tie"))).alias("_last"))
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*keys, "_bucket", F.last("_last", ignorenulls=True).over(earlier).alias("_carry"))
    within = W.partitionBy(*keys, "_bucket").orderBy("_t", "_side", "_tie").rowsBetween(W.unboundedPreceding, 0)
    own = both.withColumn("_own", F.last("_r", ignorenulls=True).over(within)).filter(F.col("_left").isNotNull())
    joined = own.alias("l").join(carry.alias("c"), _matching([*keys, "_bucket"], "l", "c"))
    found = F.coalesce(F.col("l._own"), F.col("c._carry"))
    return joined.select("l._left.*", *[found[n].alias(n) for n in values])


def asof_forward(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_time: str, right_time: str, right_ties: Sequence[str], values: dict[str, str], bucket: int = DAY
) -> DataFrame:
    """left with the values of the first right row at or after it: the backward join with time turned round."""
    l = left.withColumn("_negative", -F.col(left_time))
    turned = [f"_minus_{t}" for t in right_ties]
    r = right.withColumn("_negative", -F.col(right_time)).withColumns({n: -F.col(t) for n, t in zip(turned, right_ties)})
    return asof_backward(l, r, keys, "_negative", "_negative", turned, values, bucket=bucket).drop("_negative")


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_from: Column, left_to: Column, right_time: str, width: int) -> DataFrame:
    """Rows of left with each right row whose time lies in [from, to), as columns l and r; an equi-join on buckets of time.

    ``width`` should be about the length of the left windows: each is in as many buckets as it touches.
    """
    l = left.select(F.struct(*left.columns).alias("l"), *keys, left_from.alias("_from"), left_to.alias("_to"))
    l = l.filter(F.col("_from") < F.col("_to")).withColumn("_bucket", F.explode(F.sequence(bucket_of("_from", width), bucket_of(F.col("_to") - 1, width))))
    r = right.select(F.struct(*right.columns).alias("r"), *keys, F.col(right_time).alias("_t"), bucket_of(right_time, width).alias("_bucket"))
    joined = l.join(r, [*keys, "_bucket"])
    return joined.filter((F.col("_t") >= F.col("_from")) & (F.col("_t") < F.col("_to"))).select("l", "r")


def overlap_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = DAY) -> DataFrame:
    """Pairs (l, r) of half-open spans that overlap: by the buckets that both touch, each pair in the first common one."""

    def cut(df: DataFrame, name: str, span: tuple[str, str]) -> DataFrame:
        df = df.select(F.struct(*df.columns).alias(name), *keys, F.col(span[0]).alias(f"_{name}0"), F.col(span[1]).alias(f"_{name}1")).filter(F.col(f"_{name}0") < F.col(f"_{name}1"))
        return df.withColumn("_bucket", F.explode(F.sequence(bucket_of(f"_{name}0", width), bucket_of(F.col(f"_{name}1") - 1, width))))

    joined = cut(left, "l", left_span).join(cut(right, "r", right_span), [*keys, "_bucket"])
    joined = joined.filter((F.col("_l0") < F.col("_r1")) & (F.col("_r0") < F.col("_l1")))
    return joined.filter(F.col("_bucket") == bucket_of(F.greatest("_l0", "_r0"), width)).select("l", "r")

