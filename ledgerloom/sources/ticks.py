"""Quote files: tab-separated exports with holes, and comma-separated archives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed8, report_time
from ..operators.order import DAY, bucket_of, from_us, to_us, with_previous


def fill_forward(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str], columns: Sequence[str], bucket: int = DAY) -> DataFrame:
    """Nulls of each column take its last earlier value within keys, in the order of time and ties."""
    keys = list(keys)
    df = df.withColumn("_bucket", bucket_of(time, bucket))
    order = F.struct(time, *ties)
    last = df.groupBy(*keys, "_bucket").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), order)).alias(c) for c in columns])
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    carry = last.select(*keys, "_bucket", *[F.last(c, ignorenulls=True).over(earlier).alias(f"_carry_{c}") for c in columns])
    within = W.partitionBy(*keys, "_bucket").orderBy(time, *ties).rowsBetween(W.unboundedPreceding, 0)
    own = df.withColumns({f"_own_{c}": F.last(c, ignorenulls=True).over(within) for c in columns})
    joined = own.join(carry, [*keys, "_bucket"])
    rest = [c for c in df.columns if c not in columns and c != "_bucket"]
    return joined.select(*rest, *[F.coalesce(f"_own_{c}", f"_carry_{c}").alias(c) for c in columns])


def header_name(name: str) -> str:
    """A column name of a quote file: without brackets and spaces, in lower case."""
    return name.strip().strip("<>").strip().lower()


def read_rows(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """All columns as text under their clean names, with file and row, which order the rows as they are in the files.

    A row's number comes from its file's start and a counter of the scan, taken on the scan itself.
    """
    df = spark.read.option("header", True).option("sep", sep).option("mode", "PERMISSIVE").csv(path)
    df = df.select("*", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return df.select(*[F.col(f"`{c}`").alias(header_name(c)) for c in df.columns])


def checked(df: DataFrame, bad: Column, what: str) -> DataFrame:
    """df, with an error when a row for which ``bad`` holds is read."""
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit(what)).isNull()).otherwise(True))


def read_export(spark: SparkSession, path: str, crossed: str = "error") -> DataFrame:
    """A tab-separated export: date, time, bid, ask, last, volume, flags; a side that didn't change is empty.

    Sides are filled forward separately. A row before a side's first value, a time before the row
    above, a price not above 0 or an ask below the bid is an error; crossed="drop" leaves the last out.
    """
    raw = read_rows(spark, path, "\t")
    stamp = report_time(F.concat_ws(" ", "date", "time"))
    number = lambda c: F.col(c).try_cast("double")
    df = raw.select("file", "block", "row", stamp.alias("timestamp"), *[number(c).alias(c) for c in ("bid", "ask", "last", "volume")], F.col("flags").try_cast("bigint").alias("flags"))
    df = df.withColumns({"us": to_us("timestamp"), "bid_missing": F.col("bid").isNull(), "ask_missing": F.col("ask").isNull()})
    df = with_previous(df, ["file"], "row", [], {"us_before": "us"}, bucket=1 << 20)
    df = fill_forward(df, ["file"], "row", [], ["bid", "ask"], bucket=1 << 20)
    df = checked(df, F.col("us").isNull(), "a time can't be read")
    df = checked(df, F.col("us") < F.col("us_before"), "times go back")
    df = checked(df, F.col("bid").isNull() | F.col("ask").isNull(), "a side has no first value")
    df = checked(df, (F.col("bid") <= 0) | (F.col("ask") <= 0), "a price isn't above 0")
    df = df.filter("ask >= bid") if crossed == "drop" else checked(df, F.col("ask") < F.col("bid"), "an ask is below its bid")
    return df.select("file", "row", "timestamp", "us", "bid", "ask", ((F.col("bid") + F.col("ask")) / 2).alias("mid"), (F.col("ask") - F.col("bid")).alias("spread"), "last", "volume", "flags", "bid_missing", "ask_missing")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """A comma-separated archive: every row with exact prices, invalid_reason and whether its time repeats the one before."""
    raw = read_rows(spark, path, ",")
    df = raw.select("file", "row", to_us(F.col("time_utc").try_cast("timestamp_ntz")).alias("us"), fixed8(F.col("bid")).alias("bid"), fixed8(F.col("ask")).alias("ask"))
    df = with_previous(df, ["file"], "row", [], {"us_before": "us"}, bucket=1 << 20)
    reason = (
        F.when(F.col("us").isNull(), "invalid_timestamp")
        .when(F.col("bid").isNull() | F.col("ask").isNull(), "invalid_price")
        .when((F.col("bid") <= 0) | (F.col("ask") <= 0), "not_positive")
        .when(F.col("ask") < F.col("bid"), "crossed")
    )
    return df.select("file", "row", "us", "bid", "ask", reason.alias("invalid_reason"), F.coalesce(F.col("us") == F.col("us_before"), F.lit(False)).alias("duplicate"), F.coalesce(F.col("us") < F.col("us_before"), F.lit(False)).alias("out_of_order"))


def read_both(spark: SparkSession, export: str, archive: str, crossed: str = "error") -> DataFrame:
    """Quotes of both dialects with one schema."""
    a = read_export(spark, export, crossed).select("file", "row", "us", F.col("bid").cast("decimal(16,8)").alias("bid"), F.col("ask").cast("decimal(16,8)").alias("ask"), F.lit("export").alias("dialect"))
    b = read_archive(spark, archive).filter("invalid_reason IS NULL").select("file", "row", "us", "bid", "ask", F.lit("archive").alias("dialect"))
    return a.unionByName(b)


def between(quotes: DataFrame, start: int, end: int) -> DataFrame:
    """Quotes of [start, end]; the bounds reach the scan."""
    return quotes.filter((F.col("us") >= start) & (F.col("us") <= end))


def write_by_week(quotes: DataFrame, path: str) -> None:
    """Quotes partitioned by the Monday of their week, which readers prune by."""
    week = F.date_trunc("week", from_us(F.col("us"))).cast("date")
    quotes.withColumn("week", week).repartition("week").sortWithinPartitions("us").write.mode("overwrite").partitionBy("week").parquet(path)


def read_weeks(spark: SparkSession, path: str, start: int, end: int) -> DataFrame:
    """Quotes of [start, end] from write_by_week's folders; the bounds on week prune the folders."""
    week = lambda us: F.date_trunc("week", from_us(F.lit(us))).cast("date")
    return between(spark.read.parquet(path).filter((F.col("week") >= week(start)) & (F.col("week") <= week(end))), start, end)


def audit(rows: DataFrame) -> DataFrame:
    """Rows, first and last time, repeated times, zero quotes and crossed quotes of each file of read_archive."""
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("us").alias("first_us"),
        F.max("us").alias("last_us"),
        F.count_if("duplicate").alias("repeated"),
        F.count_if((F.col("bid") == 0) | (F.col("ask") == 0)).alias("zero"),
        F.count_if(F.col("ask") < F.col("bid")).alias("crossed"),
    )
