"""Trade reports as HTML pages: their rows, sections, the four tables in them and the totals."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed8, number, report_time, requested_and_filled

# The sections of a report; the first three must be there.
SECTIONS = ("positions", "orders", "deals", "open positions")
NET_PROFIT, DATE = "Total Net Profit:", "Date:"


class Rows(HTMLParser):
    """The cells of each table row, white space collapsed."""

    def __init__(self, source: str):
        super().__init__()
        self.rows: list[list[str]] = []
        self._cell: list[str] | None = None
        self.feed(source)
        self.close()
        self._end()

    def _end(self) -> None:
        if self._cell is not None and self.rows:
            self.rows[-1].append(" ".join("".join(self._cell).split()))
        self._cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "tr":
            self._end()
            self.rows.append([])
        elif tag in ("td", "th"):
            self._end()
            self._cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr", "table"):
            self._end()

    def handle_data(self, data):
        if self._cell is not None:
            self._cell.append(data)


def decoded(raw: bytes) -> str:
    """UTF-16 if a byte order mark says so, else UTF-8."""
    return raw.decode("utf-16") if raw.startswith((b"\xff\xfe", b"\xfe\xff")) else raw.decode("utf-8")


#: Whole tags of tables and text between them, without references.
PLAIN = re.compile(r"""(?:[^<&]++|</?(?:html|body|table|thead|tbody|tfoot|tr|td|th|div|span|b|i|p|br)(?:\s++[a-z]++=(?:'[^'<>&]*+'|"[^"<>&]*+"))*+>)*+""", re.IGNORECASE)


def table_rows(source: str) -> list[list[str]]:
    """What Rows finds. Rows written as ``<tr><td>..</td>..</tr>`` are split, which is many times as fast; only plain markup may stand around them, else Rows reads the page."""
    out = []
    for k, part in enumerate(source.split("<tr>") if "&" not in source else ()):
        body, end, rest = part.rpartition("</tr>")
        cells = body[4:-5].split("</td><td>")
        if k and end and "<" not in rest and body.startswith("<td>") and body.endswith("</td>") and body.count("<") == 2 * len(cells):
            out.append([" ".join(c.split()) for c in cells])
        elif PLAIN.fullmatch(part):
            out += Rows("<tr>" * bool(k) + part).rows
        else:
            break
    else:
        if "&" not in source:
            return out
    return Rows(source).rows


def report_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, raw in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
            rows = table_rows(decoded(raw))
            cells = pa.array(rows, pa.list_(pa.string()))
            title = pc.utf8_lower(pc.utf8_trim(pc.binary_join(cells, " "), " "))
            title = pc.if_else(pc.is_in(title, pa.array(SECTIONS)), title, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_pydict({"path": pa.repeat(pa.scalar(path, pa.string()), len(rows)), "row": pa.array(range(len(rows)), pa.int64()), "cells": cells, "title": title, "section": pc.fill_null_forward(title)})


def read_rows(spark: SparkSession, path: str, report_id: Column | None = None) -> DataFrame:
    """(report_id, row, cells, section): the rows of all reports under a path, each with the section it is in.

    The id is the file's name without its ending, unless a column over ``path`` says otherwise. A
    file is read whole by one task; a row in no section has none.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    rows = files.mapInArrow(report_rows, "path string, row long, cells array<string>, title string, section string")
    name = report_id if report_id is not None else F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return rows.select(name.alias("report_id"), "row", "cells", "title", "section")


def check_sections(rows: DataFrame) -> DataFrame:
    """rows, or an error that names a report without one of the first three sections."""
    seen = rows.groupBy("report_id").agg(F.collect_set("title").alias("seen"))
    bad = seen.filter(~F.forall(F.array(*[F.lit(s) for s in SECTIONS[:3]]), lambda s: F.array_contains("seen", s))).select("report_id").first()
    if bad:
        raise ValueError(f"{bad[0]}: a required section is missing")
    return rows


def _dated(rows: DataFrame, section: str, least: int) -> DataFrame:
    return rows.filter((F.col("section") == section) & F.col("title").isNull() & (F.size("cells") >= least) & F.get("cells", F.lit(0)).rlike(r"^\d{4}\.\d{2}"))


def _text(k: int) -> Column:
    return F.get("cells", F.lit(k))


def positions(rows: DataFrame) -> DataFrame:
    """Closed positions; volume_text keeps the volume as it is written, volume_exact is its decimal, null for other spellings. A fifth empty cell of fourteen is a spacer."""
    own = _dated(rows, "positions", 13)
    spacer = (F.size("cells") == 14) & (_text(4) == "")
    own = own.withColumn("cells", F.when(spacer, F.concat(F.slice("cells", 1, 4), F.slice("cells", 6, 9))).otherwise(F.col("cells")))
    numbers = {"open_price": 5, "stop_loss": 6, "take_profit": 7, "close_price": 9, "commission": 10, "swap": 11, "profit": 12}
    return own.select(
        "report_id", "row", _text(1).alias("position_id"), _text(2).alias("symbol"), F.lower(_text(3)).alias("side"), number(_text(4)).alias("volume"), _text(4).alias("volume_text"), fixed8(_text(4)).cast("decimal(12,8)").alias("volume_exact"),
        report_time(_text(0)).alias("open_time"), report_time(_text(8)).alias("close_time"), *[number(_text(k)).alias(c) for c, k in numbers.items()],
    )


def open_positions(rows: DataFrame) -> DataFrame:
    """Snapshots of what was open, with no close."""
    numbers = {"open_price": 5, "stop_loss": 6, "take_profit": 7, "swap": 9, "profit": 10}
    return _dated(rows, "open positions", 12).select(
        "report_id", "row", _text(1).alias("position_id"), _text(2).alias("symbol"), F.lower(_text(3)).alias("side"), number(_text(4)).alias("volume"), _text(4).alias("volume_text"),
        report_time(_text(0)).alias("open_time"), *[number(_text(k)).alias(c) for c, k in numbers.items()],
    )


def orders(rows: DataFrame) -> DataFrame:
    requested, filled = requested_and_filled(_text(4))
    numbers = {"price": 5, "stop_loss": 6, "take_profit": 7}
    return _dated(rows, "orders", 11).select(
        "report_id", "row", _text(1).alias("order_id"), report_time(_text(0)).alias("open_time"), _text(2).alias("symbol"), F.lower(_text(3)).alias("order_type"), requested.alias("volume_requested"), filled.alias("volume_filled"),
        *[number(_text(k)).alias(c) for c, k in numbers.items()], report_time(_text(8)).alias("completion_time"), F.lower(_text(9)).alias("state"), _text(10).alias("comment"),
    )


def deals(rows: DataFrame) -> DataFrame:
    numbers = {"volume": 5, "price": 6, "commission": 9, "fee": 10, "swap": 11, "profit": 12, "balance": 13}
    return _dated(rows, "deals", 15).select(
        "report_id", "row", _text(1).alias("deal_id"), report_time(_text(0)).alias("time"), _text(2).alias("symbol"), F.lower(_text(3)).alias("deal_type"), F.lower(_text(4)).alias("direction"), _text(7).alias("order_id"),
        *[number(_text(k)).alias(c) for c, k in numbers.items()], _text(14).alias("comment"),
    )


def totals(rows: DataFrame) -> DataFrame:
    """Each report's time and net profit, both from the last row that has them; a report without a net profit is an error when read."""
    pick = lambda label: F.max_by(F.when((_text(0) == label) & (F.size("cells") > 1), _text(1)), F.when((_text(0) == label) & (F.size("cells") > 1), F.col("row")))
    found = rows.groupBy("report_id").agg(pick(NET_PROFIT).alias("net"), pick(DATE).alias("generated"))
    missing = F.raise_error(F.concat("report_id", F.lit(": the total net profit is missing"))).cast("double")
    return found.select("report_id", report_time(F.col("generated")).alias("generated_at"), F.coalesce(number(F.col("net")), missing).alias("net_profit"))


def reconciled(own: DataFrame, totals: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """Profit, swap and commission of each report's positions against its net profit."""
    sums = own.groupBy("report_id").agg(*[F.sum(c).alias(c) for c in ("profit", "swap", "commission")])
    out = totals.join(sums, "report_id", "left").withColumn("calculated", sum((F.coalesce(c, F.lit(0.0)) for c in ("profit", "swap", "commission")), F.lit(0.0)))
    delta = F.round(F.col("calculated") - F.col("net_profit"), 9)
    return out.select("report_id", "profit", "swap", "commission", "calculated", "net_profit", delta.alias("delta"), F.when(F.abs(delta) <= tolerance, "PASS").otherwise("FAIL").alias("status"))
