"""Exact deduplication by salted digest groups, native DataFrame operations only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, fresh, join_skewed, text_of, without, written

ADDED = ("keep_id", "group_size", "kept", "text_sha256")


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    salts: int = 16,
    digest: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Mark which row of each group of equal texts stays.

    Texts are equal when they are identical without ASCII white space. The row with the most code
    points in its original text stays, then the smallest id (an integer; null comes last), then the
    row that was read first. Returns the rows of docs with keep_id, group_size, kept and
    text_sha256; input columns with these names give way. Repeated rows, ids included, are members
    like any other: one of them stays. Null texts are empty texts. An empty table gives no rows.

    Three stages, each grouping by the digest *and* the whole normalised text, so two texts never
    meet by digest alone: the map side of the first shuffle combines within a task, the first
    shuffle combines within a salt of the digest, the second combines the salts' winners. So a text
    that a third of all rows share reaches any task as one row per map task and salt. Rows learn of
    their group by its digest where only one text has it, as that was just compared, else by digest
    and text; the groups of very frequent digests are broadcast for that (join_skewed). ``digest`` is a parameter for tests of that second case.
    """
    sha256 = lambda norm: F.sha2(norm, 256)
    docs = without(docs, *ADDED)
    n = fresh(docs, "norm", "digest", "rank", "salt", "size", "best", "texts", "row", "sha", "rows")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    norm, dig, rank, salt, size, best, texts, sha = (n[k] for k in ("norm", "digest", "rank", "salt", "size", "best", "texts", "sha"))

    identity = F.col(id_col).cast("bigint")
    row = F.lit(0).cast("bigint")
    if not docs.groupBy(identity.alias("id")).count().filter("count > 1").isEmpty():
        # Only rows with the same id can tie. Then a number tells them apart, fixed by writing it once.
        docs = written(docs.withColumn(n["row"], F.monotonically_increasing_id()), "dedup-numbered")
        row = F.col(n["row"])
    rows = (
        docs.withColumn(norm, normalised(F.col(text_col)))
        .withColumn(sha, sha256(F.col(norm)))
        .withColumn(dig, digest(F.col(norm)) if digest else F.col(sha))
        # The largest rank stays; bitwise not turns the order of integers round without overflow.
        .withColumn(
            rank,
            F.struct(
                F.length(text_of(text_col)).alias("points"),
                identity.isNotNull().alias("has_id"),
                F.bitwise_not(F.coalesce(identity, F.lit(0))).alias("id"),
                F.bitwise_not(row).alias("row"),
            ),
        )
    )
    salted = (
        rows.select(dig, norm, rank, F.pmod(F.xxhash64(rank), F.lit(salts)).alias(salt))
        .groupBy(dig, salt, norm)
        .agg(F.max(rank).alias(best), F.count(F.lit(1)).alias(size))
    )
    groups = salted.groupBy(dig, norm).agg(F.max(best).alias(best), F.sum(size).alias(size))
    by_digest = written(
        groups.groupBy(dig).agg(F.max(best).alias(best), F.sum(size).alias(size), F.sum(size).alias(n["rows"]), F.count(F.lit(1)).alias(texts)),
        "dedup-groups",
    )

    def marked(joined: DataFrame) -> DataFrame:
        chosen = F.when(F.col(f"{best}.has_id"), F.bitwise_not(F.col(f"{best}.id")))
        return joined.select(
            *columns,
            chosen.alias("keep_id"),
            F.col(size).alias("group_size"),
            (F.col(rank) == F.col(best)).alias("kept"),
            F.col(sha).alias("text_sha256"),
        )

    single = by_digest.filter(F.col(texts) == 1).drop(texts)
    found = marked(join_skewed(rows, single, dig, n["rows"]).filter(F.col(best).isNotNull()))
    if by_digest.filter(F.col(texts) > 1).isEmpty():
        return found
    several = by_digest.filter(F.col(texts) > 1).select(dig)
    by_text = written(groups.join(several, dig, "left_semi"), "dedup-collisions")
    return found.unionByName(marked(rows.join(by_text, [dig, norm])))


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of docs: one of each group of equal texts, also among null texts and repeated or null ids."""
    return exact_dedup(docs, id_col, text_col).filter("kept").select(*[F.col(f"`{c}`") for c in docs.columns])
