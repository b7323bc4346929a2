"""Steps that failed or grew too fast on large tables, on small rows of their own."""
import datetime
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF
from tillpoint.functions import fixed
from tillpoint.operators import deals, products
from tillpoint.plans import rollup
from tillpoint.plans.curate import curate, load_sales
from tillpoint.plans.dedup import MonthParts, ReceiptParts, dedup_latest_file
from tillpoint.sources import inbox, pos_csv, testmodel
from tillpoint.streaming.ingest import incremental_ingest


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_split_sums_beyond_64_bits(spark):
    """Millionths of a cent of a large table's deals do not fit in a long."""
    lines = spark.createDataFrame(
        [(str(i), "S", "B", "C", x, x, 2, -x, -x, x, "One, Two") for i, x in enumerate([9e10, 8e10, 9e10, 0.01, 0.02])],
        "receipt_id string, store_clean string, brand_clean string, category_clean string, actual_revenue double, discounts double, quantity int, cost double, "
        "net_profit double, pre_discount_revenue double, deals_used string")
    for df in (deals.deal_summary(lines), deals.deal_summary_by_store(lines), deals.promo_effectiveness(lines)):
        for r in df.union(df.limit(0)).collect():
            assert (r.revenue, r.cost, r.units) == (pytest.approx(1.3e11 + 0.015, abs=1e-4), pytest.approx(-1.3e11 - 0.015, abs=1e-4), 5.0)


def test_lines_dealt_by_month_are_the_same_and_shuffled_once(spark):
    dealt = curate(testmodel.raw_lines(spark, SF, MonthParts(3, 5)), testmodel.TEST_CATEGORY_ALIASES)
    plain = curate(testmodel.raw_lines(spark, SF), testmodel.TEST_CATEGORY_ALIASES)
    assert dealt.exceptAll(plain).count() == plain.exceptAll(dealt).count() == 0 and plain.count() > 5000
    by = re.findall(r"Exchange (\w+\([a-z_]+)", plan(dealt))
    assert by[0] == "hashpartitioning(year"  # last: neither D1 nor the table's months shuffle again
    assert not [x for x in by if "product" in x]


def test_large_counts_get_more_partitions(spark):
    assert MonthParts.for_lines(spark, 1000) == MonthParts(1, None)
    assert MonthParts.for_lines(spark, 40_000_000) == MonthParts(6, 100)


def test_dedup_keeps_all_columns_of_the_winner(spark):
    t, d = datetime.datetime(2025, 1, 1), datetime.date
    rows = [("r1", "p", t, None, None, 1, 1.0), ("r1", "p", t, "b", d(2025, 1, 31), 2, 2.0), ("r1", "p", t, "a", d(2025, 2, 28), 9, 3.0), ("r1", "p", t, "c", d(2025, 2, 28), 1, 4.0),
            (None, None, t, "", None, 2, 5.0), (None, None, t, None, None, 1, 6.0), ("r2", "p", t, "a", None, 3, 7.0), ("r2", "p", t, "a", None, 2, 8.0), ("r3", "p", t, "", None, 1, 9.0)]
    df = spark.createDataFrame(rows, "receipt_id string, product string, completed_at timestamp_ntz, file_name string, file_end date, row_seq int, x double")
    want = {rows[2], rows[5], rows[7], rows[8]}
    assert {tuple(r) for r in dedup_latest_file(df).collect()} == want
    assert {tuple(r)[:7] for r in dedup_latest_file(MonthParts(4, None).deal(df, "receipt_id")).collect()} == want


def _files(tmp_path, spark):
    lines = [("margin report 2025-01-01 2025-01-31", i, ",".join(f'"{v}"' for v in (f"r{i}", "Gummy", f"01/0{i}/2025 03:04:05 PM", "$1.00"))) for i in (3, 1, 2)]
    lines += [("margin report 2025-02-01 2025-02-28", 1, '"r9","Cart","02/01/2025 03:04:05 PM","$2.00"')]
    head = ["Receipt ID", "Product", "Completed At", "Post-Discount, Pre-Tax Total"]
    folder = str(tmp_path / "inbox")
    inbox.write_files(spark.createDataFrame(lines, "name string, place int, line string"), inbox._header(head), folder)
    return folder


def test_files_have_their_header_first_and_lines_in_order(spark, tmp_path):
    folder = _files(tmp_path, spark)
    assert sorted(x for x in os.listdir(folder) if x.endswith(".csv")) == ["margin report 2025-01-01 2025-01-31.csv", "margin report 2025-02-01 2025-02-28.csv"]
    text = open(os.path.join(folder, "margin report 2025-01-01 2025-01-31.csv")).read().splitlines()
    assert text[0].startswith('"Receipt ID","Product"') and [x[:5] for x in text[1:]] == ['"r1",', '"r2",', '"r3",']


def test_cells_are_not_shuffled_to_their_header(spark, tmp_path):
    folder = _files(tmp_path, spark)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        named = pos_csv.read_csv_files(spark, folder, fixed.COLUMN_MAP)
        assert "SortMergeJoin" not in plan(named) and "BroadcastHashJoin" in plan(named)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_batches_are_not_kept(spark, tmp_path, monkeypatch):
    """The stream cuts its files' lines again rather than keep all cells on the executors."""
    folder = _files(tmp_path, spark)
    df = spark.range(1)
    monkeypatch.setattr(type(df), "persist", lambda *a: pytest.fail("kept"))
    got = incremental_ingest(spark, folder, str(tmp_path / "table"), str(tmp_path / "ck"))
    assert sorted((r.receipt_id, r.actual_revenue) for r in got.collect()) == [("r1", 1.0), ("r2", 1.0), ("r3", 1.0), ("r9", 2.0)]
    assert got.where(F.col("year") == 2025).count() == 4


def test_a_receipts_lines_lie_together_when_dealt(spark):
    """Parts are joined before orders, and the receipt's text is made after the deal by month."""
    text = plan(testmodel.raw_lines(spark, SF, MonthParts(3, 5)))
    by = re.findall(r"Join \[(\w+)#", text)  # outermost first
    assert by.index("l_orderkey") < by.index("l_partkey")
    assert "hashpartitioning(l_orderkey" in text and "hashpartitioning(receipt_id" not in text


def test_receipts_are_counted_without_the_sums(spark):
    """What is shuffled by receipt holds no sums."""
    lines = spark.createDataFrame(
        [("1", "S", "B", "C", 1.0, 0.5, 2, 0.5, 0.5, 1.5, "One, Two"), ("1", "S", "B", "C", 1.0, 0.5, 2, 0.5, 0.5, 1.5, "One"), (None, "S", "B", "C", 3.0, 0.5, 2, 0.5, 0.5, 1.5, "Three")],
        "receipt_id string, store_clean string, brand_clean string, category_clean string, actual_revenue double, discounts double, quantity int, cost double, "
        "net_profit double, pre_discount_revenue double, deals_used string")
    for df, uses in ((deals.deal_summary(lines), "times_used"), (deals.deal_summary_by_store(lines), "times_used"), (deals.promo_effectiveness(lines), "uses")):
        by_receipt = re.findall(r"Aggregate\(keys=\[[^\]]*receipt_id[^\]]*\], functions=\[([^\]]*)\]", plan(df))
        assert by_receipt and not any(by_receipt)
        assert sorted((r.deal_name, r[uses], r.revenue) for r in df.collect()) == [("One", 1, 1.5), ("Three", 0, 3.0), ("Two", 1, 0.5)]


def test_rollup_writes_ids_with_their_months(spark, monkeypatch):
    """Nothing by month, store, receipt and customer is written: a row a month and store, and one an id."""
    facts = spark.createDataFrame(
        [(202501, "A", "r1", "c1", 1.0, 1), (202501, "B", "r1", "c1", 2.0, 1), (202501, None, "r2", None, 3.0, None), (202502, "A", "r3", "c1", None, 1), (202502, "C", None, None, 1.0, 1)],
        "ym int, store_clean string, receipt_id string, customer_id string, actual_revenue double, quantity int").selectExpr(
        "*", "actual_revenue AS net_profit", "actual_revenue AS cost", "actual_revenue AS discounts")
    written, real = {}, rollup.materialize
    monkeypatch.setattr(rollup, "materialize", lambda s, df, name, by=None: written.setdefault(name, real(s, df, name, by)))
    up = rollup.merged(rollup.empty_rollup(spark), facts)
    assert written["rollup-base"].count() == 5 and written["rollup-numbered"].count() == up.ids.count() == 4
    got = {(r.ym, r.store): (r.transactions, r.customers) for r in rollup.exact_counts(up, ["ym", "store"]).collect()}
    assert got == {(202501, "A"): (1, 1), (202501, "B"): (1, 1), (202501, None): (1, 0), (202502, "A"): (1, 1)}
    near = {(r.ym, r.store, r.kind) for r in up.sketches.collect()}
    assert near == {(*k, kind) for k, v in got.items() for kind, n in zip(("transactions", "customers"), v) if n}


def test_product_kpis_add_up_the_facts_once(spark, monkeypatch):
    """L1, L2 and L3 from one row a product equal those from the facts; stores are counted without distinct counts."""
    d = datetime.date
    sales = spark.createDataFrame(
        [("a", "S", d(2025, 1, 1), 1.0, "B", 1), ("a", None, d(2025, 1, 2), 2.0, "A", 1), ("a", "T", d(2025, 1, 3), None, None, None), ("b", "S", d(2025, 1, 1), 4.0, "B", 2),
         ("b", "T", d(2025, 6, 1), 5.0, "C", 3), ("b", "T", d(2025, 5, 10), 5.0, "C", 9), ("c", None, d(2025, 1, 1), 6.0, "B", 1), (None, "S", d(2025, 6, 30), 1.0, "B", 1)],
        "product string, store_clean string, sale_date date, actual_revenue double, brand_clean string, quantity int").selectExpr(
        "*", "actual_revenue AS net_profit", "actual_revenue / 2 AS cost", "lower(brand_clean) AS category_clean")
    dead = products.dead_stock(sales, top_n=None)
    assert "Expand" not in plan(dead)
    assert [(r.product, r.brand, r.total_revenue, r.stores_active, r.stores_inactive) for r in dead.orderBy("rank").collect()] == [("c", "B", 6.0, 0, 0), ("a", "A", 3.0, 0, 2)]
    made = products.product_facts(sales)
    for f in (lambda p: products.abc_classification(sales, p), lambda p: products.dead_stock(sales, top_n=None, products=p), lambda p: products.velocity_trends(sales, products=p)):
        assert sorted(map(tuple, f(None).collect()), key=repr) == sorted(map(tuple, f(made).collect()), key=repr)
    asked = []
    monkeypatch.setattr(products, "product_stats", lambda *a: pytest.fail("facts added up again"))
    monkeypatch.setattr(products, "materialize", lambda s, df, *a: asked.append(a) or df)
    assert products.product_kpis(sales).first().dead_stock_count == 2 and len(asked) == 1


def test_lines_left_by_receipt_are_the_same_and_shuffled_by_part_and_receipt_alone(spark):
    """D1 and the table follow where lines met their receipts, by one sort; suppliers are not shuffled to the lines."""
    plain = curate(testmodel.raw_lines(spark, SF), testmodel.TEST_CATEGORY_ALIASES)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for parts in (ReceiptParts(None), ReceiptParts(20)):
            left = curate(testmodel.raw_lines(spark, SF, parts), testmodel.TEST_CATEGORY_ALIASES)
            text = plan(left.sortWithinPartitions("year", "month"))
            by = set(re.findall(r"Exchange hashpartitioning\(([a-z_]+)", text))
            assert by == {"l_partkey", "p_partkey", "l_orderkey", "_order", "o_custkey", "c_custkey"}
            assert len(re.findall(r"Sort \[year", text)) == 1
            assert ("hashpartitioning(l_orderkey#" in text) and (parts.partitions is None or re.search(r"l_orderkey#\d+L, 20\)", text))
            assert left.exceptAll(plain).count() == plain.exceptAll(left).count() == 0 and plain.count() > 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_partitions_by_receipt_follow_the_lines():
    assert ReceiptParts.for_lines(1000) == ReceiptParts(None)
    assert ReceiptParts.for_lines(216_000_000) == ReceiptParts(540)


def test_table_keeps_each_winner_and_is_sorted_by_month(spark, tmp_path):
    """Keys that repeat or are null, lines without part, order or supplier: the table is D1 of the plain lines, in files sorted by month."""
    t = datetime.datetime(2025, 1, 31, 20)
    tables = {
        "lineitem": ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp_ntz",
                     [(o, p, s, n, 2.0, 10.0 * o, 0.1, x, t) for o in (1, 2, 3, 9) for p, s, n, x in ((1, 1, 2, 0.1), (1, 2, 1, 0.1), (2, 1, 3, 0.1), (7, 1, 1, 0.2), (8, 1, 1, 0.1), (None, 1, 4, None), (2, None, 5, 0.1), (2, 5, 3, 0.1))]
                     + [(None, 1, 1, 1, 1.0, 1.0, 0.0, 0.0, t), (1, 1, 2, 1, 2.0, 10.0, 0.1, 0.1, t)]),
        "orders": ("o_orderkey long, o_custkey long, o_orderdate timestamp_ntz",
                   [(1, 1, datetime.datetime(2025, 3, 1)), (1, 1, datetime.datetime(2025, 2, 1)), (2, None, datetime.datetime(2025, 1, 1)), (2, 1, datetime.datetime(2025, 1, 1)), (3, 8, None), (None, 1, t)]),
        "customer": ("c_custkey long, c_name string", [(1, "C"), (1, "D"), (None, "E")]),
        "part": ("p_partkey long, p_name string, p_brand string, p_type string", [(1, "a", "X", "PROMO"), (2, "b", None, "STANDARD"), (2, None, "Y", "STANDARD"), (None, "c", "Z", "PROMO")]),
        "supplier": ("s_suppkey long, s_name string, s_nationkey long", [(1, "S", 1), (2, "T", 2), (2, "U", 1), (None, "V", 1)]),
        "nation": ("n_nationkey long, n_regionkey long", [(1, 1), (2, 2)]),
        "region": ("r_regionkey long, r_name string", [(1, "ASIA"), (2, "EUROPE")])}
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    plain = curate(testmodel.raw_lines(spark, str(tmp_path)), testmodel.TEST_CATEGORY_ALIASES)
    table = load_sales(spark, str(tmp_path))
    assert table.columns == plain.columns and table.exceptAll(plain).count() == plain.exceptAll(table).count() == 0
    assert table.count() == plain.count() == 9
    for path in table.inputFiles():  # whole files, not a folder a month
        months = [r.ym for r in spark.read.parquet(path).select("ym").coalesce(1).collect()]
        assert "month=" not in path and months == sorted(months)


def test_inbox_deals_keys_and_numbers_to_its_files(spark, tmp_path):
    """Texts are made after the shuffle by file, lines are neither held in a window nor sorted twice; the files are those of the plain lines."""
    text = plan(inbox.sales_lines(spark, SF))
    assert "Window" not in text and len(re.findall(r"hashpartitioning\(name#", text)) == 1
    above, below = text.split("Exchange hashpartitioning(name#", 1)
    assert above.count("Sort [") == 1 and "concat_ws" in above and "concat_ws" not in below
    folder = inbox.write_sales_inbox(spark, SF, early=True).removeprefix("file:")
    got = {f: open(os.path.join(folder, f)).read().splitlines() for f in os.listdir(folder) if f.endswith(".csv")}
    assert all(x[0].startswith('"Receipt ID","Order Type"') and '"Receipt ID"' not in "".join(x[1:]) for x in got.values())
    raw = testmodel.raw_lines(spark, SF).select("receipt_id", "product", F.date_format("completed_at", "MM/dd/yyyy").alias("at"), "row_seq", F.col("cost").cast("decimal(14,2)").alias("cost"),
                                                F.col("net_profit").cast("decimal(14,2)").alias("net_profit")).orderBy("row_seq").collect()
    want = {}
    for r in raw:
        want.setdefault(f"{r.at[6:]}-{r.at[:2]}-01", []).append((r.receipt_id, r.product, r.at, f"${r.net_profit}", f"${r.cost}"))
    cells = lambda lines: [(x[0], x[7], x[3][:10], x[14], x[15]) for x in __import__("csv").reader(lines)]
    months = {f[14:24]: x for f, x in got.items() if not f.endswith("-15.csv")}
    assert {k: cells(x[1:]) for k, x in months.items()} == want
    early = {f[14:24]: x for f, x in got.items() if f.endswith("-15.csv")}
    assert set(early) == {k for k in want if k[5:7] == "03"} and all(x[1:] == [y.replace("$", "$9") for y in months[k][1:]] for k, x in early.items())


def test_money_texts(spark):
    values = [0.0, -0.0, 0.07, -0.5, -0.05, 12.3, -1234.05, 99999999.99, 100.0, None]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", inbox._money("x").alias("m"), F.concat(F.lit("$"), F.col("x").cast("decimal(14,2)").cast("string")).alias("want"))
    assert all(r.m == r.want for r in df.collect())


def test_lines_are_cut_and_parsed_once_by_code_that_compiles(spark, tmp_path):
    """A time is parsed once, whatever is asked of it; no generated method is too long for the JVM to compile."""
    read = pos_csv.accepted(pos_csv.read_sales_csv(spark, _files(tmp_path, spark)))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        lines = curate(read, testmodel.TEST_CATEGORY_ALIASES)
        assert plan(lines).count("gettimestamp(") == 1
        debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", debug.codegenString(lines.select("receipt_id", "actual_revenue", "net_profit", "cost")._jdf.queryExecution().executedPlan()))
        assert sizes and max(map(int, sizes)) < 8000
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted((r.receipt_id, r.actual_revenue) for r in read.collect()) == [("r1", 1.0), ("r2", 1.0), ("r3", 1.0), ("r9", 2.0)]


def test_a_batch_looks_for_its_headers_once(spark, tmp_path, monkeypatch):
    from tillpoint.streaming import ingest

    found, real = [], ingest.header_rows
    monkeypatch.setattr(ingest, "header_rows", lambda *a: found.append(1) or real(*a))
    monkeypatch.setattr(pos_csv, "header_rows", lambda *a: pytest.fail("looked for once more"))
    got = incremental_ingest(spark, _files(tmp_path, spark), str(tmp_path / "table"), str(tmp_path / "ck"))
    assert sorted((r.receipt_id, r.actual_revenue) for r in got.collect()) == [("r1", 1.0), ("r2", 1.0), ("r3", 1.0), ("r9", 2.0)] and len(found) == 1


def test_damaged_exports_are_packed_and_reported_by_name(spark, monkeypatch):
    from tillpoint.catalog import ingest_q

    folders, real = [], inbox.write_sales_inbox
    monkeypatch.setattr(inbox, "write_sales_inbox", lambda *a, **b: folders.append(real(*a, **b)) or folders[-1])
    report = ingest_q.load_report(spark, SF).collect()
    names = [f for f in os.listdir(folders[0].removeprefix("file:")) if not f.startswith(".")]
    assert names and all(f.endswith(".csv.gz") for f in names) and {r.file_name for r in report} == {f.removesuffix(".gz") for f in names}
    assert all(r.rows_read == r.rows_kept + r.rows_refused for r in report)
