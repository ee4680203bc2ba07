"""Shared pieces: reading tables, writing intermediate tables, small column helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import new_path, shared_dir, written

__all__ = ["HOT", "SPACE", "WORD", "fresh", "join_skewed", "new_path", "shared_dir", "table", "text_of", "without", "written"]

#: ASCII white space as the contracts spell it, for Java regular expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name a column name that df doesn't have (in any case), so that helper columns can't clash."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        candidate, k = f"__{name}", 0
        while candidate.lower() in taken:
            k += 1
            candidate = f"__{name}_{k}"
        taken.add(candidate.lower())
        out[name] = candidate
    return out


def without(df: DataFrame, *names: str) -> DataFrame:
    """df without columns that an operator is about to add, so that an input column of the same name gives way."""
    lower = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in lower])


#: A key is hot if it has more than this share of the rows; there are no more than its inverse of them.
HOT = 1 / 1000


def join_skewed(rows: DataFrame, table: DataFrame, key: str, n: str) -> DataFrame:
    """rows with the other columns of table (null where their key isn't in it), whatever share of rows a key has.

    table has each key once, and in ``n`` how many rows have it; it is read three times. Keys of over HOT
    of the rows, so 1 / HOT keys at most, are broadcast; in the shuffle for the others their rows are
    dealt out by number. Keys are strings, binary or long, never null.
    """
    names = fresh(rows, "hot", "rest", "key", "place")
    values = [c for c in table.columns if c not in (key, n)]
    total = table.agg(F.sum(n)).first()[0] or 0
    row = F.struct(*[F.col(f"`{c}`") for c in values])
    is_hot = F.col(n) > total * HOT
    hot = table.filter(is_hot).select(F.col(key).alias(names["key"]), row.alias(names["hot"]))
    rest = table.filter(~is_hot).select(F.col(key).alias(names["place"]), row.alias(names["rest"]))
    number = F.monotonically_increasing_id()
    if rows.schema[key].dataType.typeName() != "long":
        number = number.cast("string").cast(rows.schema[key].dataType)
    out = rows.join(F.broadcast(hot), rows[key] == hot[names["key"]], "left")
    out = out.withColumn(names["place"], F.when(F.col(names["hot"]).isNull(), F.col(f"`{key}`")).otherwise(number)).join(rest, names["place"], "left")
    found = F.coalesce(names["hot"], names["rest"])
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[found[v].alias(v) for v in values])


def text_of(col: str | Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))
