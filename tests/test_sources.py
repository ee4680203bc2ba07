"""Readers of quote files and trade reports on small files."""

from __future__ import annotations

import random
from datetime import datetime

import pytest

from ledgerloom.sources import reports, ticks

TICKS = "<DATE>\t<TIME>\t<BID>\t<ASK>\t<LAST>\t<VOLUME>\t<FLAGS>\n2026.07.23\t12:00:00.046\t4000.00\t4000.20\t\t\t6\n2026.07.23\t12:00:00.047\t4000.10\t\t\t\t2\n2026.07.23\t12:00:00.048\t\t4000.30\t\t\t4\n"


def row(*cells: str, tag: str = "td") -> str:
    return "<tr>" + "".join(f"<{tag}>{c}</{tag}>" for c in cells) + "</tr>"


AT, LATER = "2026.07.23 12:00:00", "2026.07.23 12:00:02"
REPORT = "<html><body><table>" + "".join([
    row("Positions", tag="th"), row(*["Time"] * 13, tag="th"), row(AT, "1001", "GOLD", "BUY", "0.3", "4 000.00", "", "", LATER, "4000.20", "0.00", "-0.10", "6.00"),
    row("2026.07.23 12:00:01", "1002", "GOLD", "sell", "", "1.0", "4000.10", "", "", "", "", "0.00", "0.00", "0.00"), row("Orders", tag="th"), row(*["Time"] * 11, tag="th"),
    row(AT, "2001", "GOLD", "buy", "0.3 / 0.2", "market", "", "", AT, "filled", ""), row("Deals", tag="th"), row(AT, "3001", "GOLD", "buy", "in", "0.3", "4000.00", "2001", "", "0.00", "0.00", "0.00", "0.00", "1 000.00", ""),
    row("Open Positions", tag="th"), row("2026.07.23 12:00:01", "1002", "GOLD", "sell", "1.0", "4000.10", "", "", "4000.00", "0.00", "10.00", ""), row("Date:", "2026.07.24 00:00:00"), row("Total Net Profit:", "5.90"),
]) + "</table></body></html>"


def test_export_is_filled_and_checked(spark, tmp_path):
    (tmp_path / "a.tsv").write_text(TICKS)
    found = ticks.read_export(spark, str(tmp_path / "a.tsv")).orderBy("us").collect()
    assert [(r.bid, r.ask, round(r.mid, 2), r.bid_missing, r.ask_missing, r.flags) for r in found] == [(4000.0, 4000.2, 4000.1, False, False, 6), (4000.1, 4000.2, 4000.15, False, True, 2), (4000.1, 4000.3, 4000.2, True, False, 4)]
    assert found[0].timestamp == datetime(2026, 7, 23, 12, 0, 0, 46000)
    for broken, message in ((TICKS.replace("12:00:00.048", "11:00:00.000"), "back"), (TICKS.replace("4000.00\t4000.20", "\t4000.20"), "first value"), (TICKS.replace("4000.00\t", "-1\t"), "above 0"), (TICKS.replace("4000.10", "4000.90"), "below its bid"), (TICKS.replace("2026.07.23\t12:00:00.046", "x\ty"), "can't be read")):
        (tmp_path / "b.tsv").write_text(broken)
        with pytest.raises(Exception, match=message):
            ticks.read_export(spark, str(tmp_path / "b.tsv")).collect()


def test_files_of_one_name_are_apart(spark, tmp_path):
    for k, name in enumerate(("x", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "q.csv").write_text(f"time_utc,bid,ask\n2026-07-23 12:00:0{1 - k},1.5,1.6\n2026-07-23 12:00:0{1 - k},1.50000000,-1\n")
    found = ticks.read_archive(spark, f"{tmp_path}/*").collect()
    assert [(r.duplicate, r.out_of_order, r.invalid_reason) for r in sorted(found, key=lambda r: (r.file, r.row))] == [(False, False, None), (True, False, "invalid_price")] * 2
    assert {(r.n, r.repeated) for r in ticks.audit(ticks.read_archive(spark, f"{tmp_path}/*")).collect()} == {(2, 1)}


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16"])
def test_report_tables(spark, tmp_path, encoding):
    (tmp_path / "r1.html").write_bytes(REPORT.encode(encoding))
    rows = reports.check_sections(reports.read_rows(spark, str(tmp_path)))
    p = reports.positions(rows).orderBy("row").collect()
    assert [(r.report_id, r.position_id, r.side, r.volume, r.volume_text, r.open_price, r.close_price, r.swap, r.profit) for r in p] == [("r1", "1001", "buy", 0.3, "0.3", 4000.0, 4000.2, -0.1, 6.0), ("r1", "1002", "sell", 1.0, "1.0", 4000.1, None, 0.0, 0.0)]
    assert (p[0].open_time, p[0].close_time, p[1].close_time) == (datetime(2026, 7, 23, 12), datetime(2026, 7, 23, 12, 0, 2), None)
    o, d, s = (f(rows).first() for f in (reports.orders, reports.deals, reports.open_positions))
    assert (o.volume_requested, o.volume_filled, o.price, d.balance, d.order_id, s.position_id, s.profit) == (0.3, 0.2, None, 1000.0, "2001", "1002", 10.0)
    t = reports.totals(rows).first()
    assert (t.net_profit, t.generated_at) == (5.9, datetime(2026, 7, 24))
    assert reports.reconciled(reports.positions(rows), reports.totals(rows)).first().status == "PASS"


def test_incomplete_reports_are_refused(spark, tmp_path):
    (tmp_path / "bad.html").write_text(REPORT.replace("<th>Deals</th>", "<th>Other</th>").replace("Total Net Profit:", "Total"))
    rows = reports.read_rows(spark, str(tmp_path))
    with pytest.raises(ValueError, match="bad"):
        reports.check_sections(rows)
    with pytest.raises(Exception, match="net profit is missing"):
        reports.totals(rows).collect()


def test_plain_pages_are_split_as_the_parser_reads_them(monkeypatch):
    rng = random.Random(11)
    bits = ["<tr>", "</tr>", "<td>", "</td>", "<td></td>", "</td><td>", "<TR>", "<th colspan='14'>", "</th>", "<td title='<tr><td>'>", "<table>", "</table>", "a", " b\n c ", ">", "<", "&amp;", "<!-- <tr> -->", "<script>", "</script>", "<br/>", "<td", "'", '"']
    whole = "<html><body><table><tr><th colspan='2'>Deals</th></tr>" + "<tr><td>1  2</td><td></td></tr>\n<tr><td>x > y</td></tr>" * 3 + "</table></body></html>"
    pages = ["".join(rng.choices(bits[:13] if k % 2 else bits, k=rng.randrange(1, 25))) for k in range(6000)]
    pages += [whole, whole + "<tr><td>1 < 2</td></tr>", whole.replace("<table>", "<table><td title='"), "", "<tr><td>a<tr><td>b", "<td>a</td><tr><td>b</td></tr>"]
    for page in pages:
        assert reports.table_rows(page) == reports.Rows(page).rows, page
    read = []
    monkeypatch.setattr(reports, "Rows", lambda part, own=reports.Rows: read.append(part) or own(part))
    assert len(reports.table_rows(whole)) == 7 and not any("1  2" in part for part in read)
