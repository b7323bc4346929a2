"""CSV ingest (A1-A7) and the incremental stream (A8/D2) on hand-made files."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tillpoint.functions import fixed
from tillpoint.sources.pos_csv import load_quality, read_sales_csv, skipped_files
from tillpoint.streaming.ingest import incremental_ingest

HEAD = list(fixed.COLUMN_MAP.keys())


def _row(receipt, product, when, rev, deals=""):
    vals = {h: "" for h in HEAD}
    vals.update({"Receipt ID": receipt, "Order Type": "Walk-In", "Sold By": "Ann", "Completed At": when,
                 "Customer ID": "c1", "Customer Name": "Cee", "Store": "Downtown - RD12", "Product": product,
                 "Variant Type": "Pre-Rolls", "Brand": " Acme ", "Quantity Sold": "2",
                 "Pre-Discount, Pre-Tax Total": f"${rev}", "Discounts": "$0.00",
                 "Post-Discount, Pre-Tax Total": f"${rev}", "Net Profit": "$1.00", "Cost": "$1,000.00",
                 "Cost Per Item": "$0.50", "Deals Used": deals})
    return ",".join('"' + vals[h] + '"' for h in HEAD)


def _write(d, name, rows):
    with open(os.path.join(d, name), "w") as f:
        f.write(",".join('"' + h + '"' for h in HEAD) + "\n")
        f.write("\n".join(rows) + "\n")


def test_csv_and_stream(spark):
    d = tempfile.mkdtemp(prefix="run-inbox-", dir="/tmp")
    _write(d, "margin report 2025-01-01 2025-01-31.csv",
           [_row("r1", "Gummy", "01/05/2025 03:04:05 PM", "10.00"), _row("r2", "Cart", "bad date", "5.00")])
    _write(d, "margin report 2025-02-01 2025-02-28.csv",
           [_row("r1", "Gummy", "01/05/2025 03:04:05 PM", "12.00"), _row("r3", "Cart", "02/01/2025 10:00:00 AM", "7.00")])
    _write(d, "unrelated.csv", [_row("r9", "X", "01/05/2025 03:04:05 PM", "1.00")])
    raw = read_sales_csv(spark, d)
    assert raw.count() == 4  # unrelated.csv excluded by keyword
    q = {r.file_name: (r.rows_read, r.refused_date) for r in load_quality(raw).collect()}
    assert q["margin report 2025-01-01 2025-01-31.csv"] == (2, 1)
    table = tempfile.mkdtemp(prefix="run-table-", dir="/tmp")
    ck = tempfile.mkdtemp(prefix="run-ck-", dir="/tmp")
    out = incremental_ingest(spark, d, table + "/sales", ck)
    rows = {(r.receipt_id, r.actual_revenue) for r in out.collect()}
    # r1 appears in both files: the later file (Feb end date) wins; the bad date row is dropped
    assert rows == {("r1", 12.0), ("r3", 7.0)}
    assert {r.category_clean for r in out.collect()} == {"PRE ROLL"}
    assert out.where(F.col("store_clean") == "Downtown").count() == 2


def test_columns_are_bound_by_name(spark):
    d = tempfile.mkdtemp(prefix="run-inbox-", dir="/tmp")
    order = ["Store", "Extra", *[h for h in reversed(HEAD) if h not in ("Store", "Brand")]]
    vals = dict(zip(HEAD, next(__import__("csv").reader([_row("r1", "Gummy", "01/05/2025 03:04:05 PM", "10.00", "A, B")]))))
    vals["Extra"] = "X"
    with __import__("gzip").open(os.path.join(d, "margin report 2025-01-01 2025-01-31.csv.gz"), "wt") as f:
        f.write(",".join(f'"{h}"' for h in order) + "\n" + ",".join(f'"{vals[h]}"' for h in order) + "\n")
    with open(os.path.join(d, "margin report broken.csv.gz"), "wb") as f:
        f.write(b"\x1f\x8bnot a gzip file")
    raw = read_sales_csv(spark, d)
    r, = raw.collect()
    assert (r.receipt_id, r.product, r.category, r.brand, r.quantity, r.actual_revenue) == ("r1", "Gummy", "Pre-Rolls", None, 2, 10.0)
    assert r.refused is None
    assert [x.file_name for x in skipped_files(spark, d, raw).collect()] == ["margin report broken.csv.gz"]


def test_later_corrected_and_late_files(spark):
    d, table, ck = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(3))
    _write(d, "margin report 2025-01-01 2025-01-31.csv",
           [_row("r1", "Gummy", "01/05/2025 03:04:05 PM", "10.00"), _row("r2", "Cart", "01/06/2025 03:04:05 PM", "5.00")])
    first = incremental_ingest(spark, d, table + "/sales", ck)
    assert first.count() == 2
    _write(d, "margin report 2025-01-01 2025-02-28.csv", [_row("r1", "Gummy", "01/05/2025 03:04:05 PM", "12.00")])
    _write(d, "margin report 2024-01-01 2024-01-31.csv", [_row("r0", "Cart", "01/06/2024 03:04:05 PM", "3.00")])
    rows = incremental_ingest(spark, d, table + "/sales", ck).collect()
    assert {(r.receipt_id, r.actual_revenue) for r in rows} == {("r1", 12.0), ("r2", 5.0), ("r0", 3.0)}
    assert {(r.category_clean, r.brand_clean) for r in rows} == {("PRE ROLL", "Acme")}


def test_columns_past_the_128th(spark, tmp_path):
    """A wanted column far to the right is read, and wider rows than the header are refused; there is no most."""
    from tillpoint.sources.pos_csv import read_csv_files

    names = ["Alpha", "Beta", "Gamma"]
    pad = [f"p{i}" for i in range(3000)]
    (tmp_path / "sales wide 2025-01-01 2025-01-31.csv").write_text(
        "\n".join([",".join(["Alpha", "Beta", *pad, "Gamma"]), ",".join(["1", "2", *[""] * 3000, "3"]), ",".join(["1", "2", *[""] * 3000, "3", "4"])]) + "\n")
    (tmp_path / "sales slim 2025-01-01 2025-01-31.csv").write_text("Gamma,Beta,Alpha\n6,5,4\n")
    got = sorted((tuple(r) for r in read_csv_files(spark, str(tmp_path), names).select(*names, "refused").collect()), key=repr)
    assert got == [("1", "2", "3", "width"), ("1", "2", "3", None), ("4", "5", "6", None)]


def test_cells(spark, tmp_path):
    """Quoted commas, doubled quotes, empty cells at either end, blanks, line ends, a byte order mark, unpaired quotes."""
    from tillpoint.sources.pos_csv import read_csv_files

    names = ["Alpha", "Beta", "Gamma"]
    lines = ['\ufeffAlpha,Beta,Gamma', 'a,"b, ""c""",d', ',,', '" x ",,', '', '   ', '"", "",""', 'short', '"open,b,c', 'a"b,c,d', f'"{"long " * 20000}",b,c']
    (tmp_path / "x.csv").write_bytes("\r\n".join(lines).encode())
    (tmp_path / "headless.csv").write_text("1,2,3\n")
    got = read_csv_files(spark, str(tmp_path), names).collect()
    rows = {r.line[:20]: (r.Alpha, r.Beta, r.Gamma, r.refused) for r in got}
    assert rows['a,"b, ""c""",d'] == ("a", 'b, "c"', "d", None) and rows[",,"] == (None, None, None, None)
    assert rows['" x ",,'] == (" x ", None, None, None) and rows["short"] == ("short", None, None, None)
    assert rows['"open,b,c'][3] == rows['a"b,c,d'][3] == "quotes" and rows["1,2,3"][3] == "header"
    assert [r.Alpha for r in got if r.refused is None and r.Alpha and len(r.Alpha) > 99] == ["long " * 20000]
    assert len(got) == 9


def _broken_inbox():
    d = tempfile.mkdtemp(prefix="run-inbox-", dir="/tmp")
    good = [_row(f"r{i}", "Gummy", f"01/0{i}/2025 03:04:05 PM", f"{i}.00") for i in range(1, 6)]
    _write(d, "margin report 2025-01-01 2025-01-31.csv", [*good, _row("x1", "Cart", "bad date", "5.00"), good[0] + ',"more"', '"' + good[1]])
    _write(d, "margin report 2025-02-01 2025-02-28.csv", [_row("r1", "Gummy", "01/01/2025 03:04:05 PM", "12.00"), _row("r9", "Cart", "02/01/2025 10:00:00 AM", "7.00")])
    return d


WANT = {("r1", 12.0), ("r2", 2.0), ("r3", 3.0), ("r4", 4.0), ("r5", 5.0), ("r9", 7.0)}


def test_refused_lines_reconcile(spark):
    from tillpoint.sources.pos_csv import refused_lines

    parsed = read_sales_csv(spark, _broken_inbox())
    q = {r.file_name[14:24]: r for r in load_quality(parsed).collect()}
    jan = q["2025-01-01"]
    assert (jan.rows_read, jan.rows_kept, jan.rows_refused, jan.refused_date, jan.refused_width, jan.refused_quotes) == (8, 5, 3, 1, 1, 1)
    assert all(r.rows_read == r.rows_kept + r.rows_refused for r in q.values())
    assert sorted(r.reason for r in refused_lines(parsed).collect()) == ["date", "quotes", "width"]


@pytest.mark.parametrize("when", ["before", "after"])
def test_a_batch_that_dies_counts_once(spark, monkeypatch, when):
    """Ended before or after its log entry is written, a batch is in the table once, and its raw lines too."""
    from tillpoint.streaming import ingest

    d = _broken_inbox()
    root, ck = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    real, died = ingest._commit, []

    def commit(spark, table, batch, entry):
        if when == "after":
            real(spark, table, batch, entry)
        if len(died) < 2 and batch not in died:
            died.append(batch)
            raise RuntimeError("the driver is gone")
        if when == "before":
            real(spark, table, batch, entry)

    monkeypatch.setattr(ingest, "_commit", commit)
    for _ in range(2):
        with pytest.raises(Exception):
            ingest.incremental_ingest(spark, d, root, ck, files_per_batch=1)
        rows = {(r.receipt_id, r.actual_revenue) for r in ingest.read_ingested(spark, root).collect()}
        assert rows <= WANT | {("r1", 1.0)}  # whole batches only
    out = ingest.incremental_ingest(spark, d, root, ck, files_per_batch=1)
    assert {(r.receipt_id, r.actual_revenue) for r in out.collect()} == WANT and out.count() == 6
    assert ingest.read_raw(spark, root).count() == 7 and ingest.read_raw(spark, root, "refused").count() == 3
    assert len(died) == 2


def test_unreadable_file_does_not_stop_the_stream(spark):
    d = _broken_inbox()
    with open(os.path.join(d, "margin report broken.csv.gz"), "wb") as f:
        f.write(b"\x1f\x8bnot a gzip file")
    root, ck = (tempfile.mkdtemp(prefix="run-", dir="/tmp") for _ in range(2))
    assert {(r.receipt_id, r.actual_revenue) for r in incremental_ingest(spark, d, root, ck).collect()} == WANT
