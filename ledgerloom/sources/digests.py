"""Digests: of files, of a table's rows in their order whatever its partitions, and cohorts read only by pinned digests."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import from_us
from .shared import written

#: Rows, and then digests, that one digest stands for.
BLOCK = 1024


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of each file under a path; a file of up to 2 GB is read whole by one task."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def row_digest(columns: Sequence[str]) -> Column:
    """Of a row's values as texts, each with its length before it, so that neither nulls nor borders are mistaken."""
    text = lambda c: F.coalesce(F.concat(F.octet_length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-"))
    return F.sha2(F.concat(*[text(c) for c in columns]), 256)


def table_digest(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, block: int = BLOCK) -> str:
    """A digest of a table's columns, types and rows in a total order; the same however df is partitioned: the last one of block_digests."""
    schema, top = block_digests(df, order, columns, block)
    top = top.first()
    return df.sparkSession.range(1).select(F.sha2(F.lit(schema + ";" + (top.digest if top else "")), 256)).first()[0]


def block_digests(df: DataFrame, order: Sequence[str], columns: Sequence[str] | None = None, block: int = BLOCK, levels: int | None = None) -> tuple[str, DataFrame]:
    """The columns with their types, and (number, digest) of the last level or, if given, after so many levels.

    Rows are sorted by ranges and numbered over all of them; ``block`` digests in a row make one, level
    by level, until one is left. Equal rows at the same place in the order don't matter, so the order
    need only tell different rows apart. Nothing but counts of partitions and the last digest is
    gathered: no level has a task with more than its blocks.
    """
    columns = list(df.columns) if columns is None else list(columns)
    schema = ",".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in columns)
    rows = df.select(row_digest(columns).alias("digest"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)])
    keys = [f"_o{k}" for k in range(len(order))]
    rows = rows.repartitionByRange(*keys, "digest").sortWithinPartitions(*keys, "digest").select("digest", F.monotonically_increasing_id().alias("at"))
    level = written(rows, "row-digests")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = level.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    level = level.withColumn("part", part).join(F.broadcast(sizes.select("part", before.alias("before"))), "part").select((F.col("before") + place).alias("number"), "digest")
    n, done = level.count(), 0
    while done < levels if levels is not None else n > 1:
        level = level.groupBy(F.floor(F.col("number") / block).alias("number")).agg(F.array_sort(F.collect_list(F.struct("number", "digest"))).alias("own"))
        level = written(level.select("number", F.sha2(F.array_join(F.transform("own", lambda x: x["digest"]), ""), 256).alias("digest")), "block-digests")
        n, done = -(-n // block), done + 1
    return schema, level


def manifest_status(manifest: DataFrame, files: DataFrame, registered: DataFrame, folder: str = "incoming") -> DataFrame:
    """(alias, status) of everything that a manifest, the files or the registered aliases name.

    manifest: alias, relative_path, sha256; files: alias, sha256; registered: alias. The first that holds:
    repeated_alias, not_registered, not_listed (registered, but not in the manifest), wrong_path (not
    ``folder``/alias), missing_file, changed, else verified. A manifest may be used if all are verified.
    """
    listed = manifest.groupBy("alias").agg(F.count(F.lit(1)).alias("n"), F.min("relative_path").alias("relative_path"), F.min("sha256").alias("expected"))
    there = files.groupBy("alias").agg(F.min("sha256").alias("low"), F.max("sha256").alias("high"))
    known = registered.select("alias").distinct().withColumn("known", F.lit(True))
    all_of = listed.join(there, "alias", "full").join(known, "alias", "full")
    status = (
        F.when(F.col("n") > 1, "repeated_alias")
        .when(F.col("known").isNull(), "not_registered")
        .when(F.col("n").isNull(), "not_listed")
        .when(~F.coalesce(F.col("relative_path") == F.concat(F.lit(folder + "/"), "alias"), F.lit(False)), "wrong_path")
        .when(F.col("low").isNull(), "missing_file")
        .when(~F.coalesce((F.col("low") == F.col("expected")) & (F.col("high") == F.col("expected")), F.lit(False)), "changed")
        .otherwise("verified")
    )
    return all_of.select("alias", status.alias("status"))


def pinned(spark: SparkSession, path: str, expected: Sequence[str]) -> list[str]:
    """The files under a path that have the expected digests, in that order. A digest that is named twice, that no file has, or that several have, is an error."""
    if len(set(expected)) != len(expected):
        raise ValueError("a pinned digest is named twice")
    found: dict[str, list[str]] = {digest: [] for digest in expected}
    for r in file_digests(spark, path).filter(F.col("sha256").isin(list(expected))).collect():
        found[r.sha256].append(r.path)
    wrong = {digest: len(paths) for digest, paths in found.items() if len(paths) != 1}
    if wrong:
        raise ValueError(f"a pinned digest must be that of exactly one file: {wrong}")
    return [found[digest][0] for digest in expected]


def read_cohort(spark: SparkSession, path: str, sessions: Sequence[str], expected: Sequence[str], read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    """Rows on the registered days (yyyy-MM-dd) of the pinned files, all repeats kept. A day without rows is an error.

    read: a reader of one path that gives us. Files that aren't pinned are hashed, not parsed.
    """
    rows = None
    for file in pinned(spark, path, expected):
        own = read(spark, file)
        rows = own if rows is None else rows.unionByName(own)
    rows = rows.withColumn("session", F.date_format(from_us(F.col("us")), "yyyy-MM-dd")).filter(F.col("session").isin(list(sessions)))
    rows = written(rows, "cohort")
    missing = set(sessions) - {r.session for r in rows.select("session").distinct().collect()}
    if missing:
        raise ValueError(f"no rows on registered days: {sorted(missing)}")
    return rows
