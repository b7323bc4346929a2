"""Edge cases for row-level functions and small operators (hand-made fixtures)."""
import datetime as dt

from pyspark.sql import functions as F

from tillpoint.functions import clean
from tillpoint.functions.expr import pct_change, r, safe_div
from tillpoint.operators.deals import expand_deals
from tillpoint.plans.dedup import dedup_latest_file
from tillpoint.plans.period import Period


def test_classification_priority(spark):
    rows = [("REWARD - 10 POINTS, MARKOUT", "X", 5.0), ("REWARD - 5 POINTS", "GUMMY TESTER", 5.0),
            ("", "EXIT BAG", 0.5), ("", "FLOWER", 1.0), ("", "FLOWER", 1.01), ("", "FLOWER", None),
            ("", "FLOWER", -3.0)]
    df = spark.createDataFrame(rows, "d string, p string, rev double")
    got = [x[0] for x in df.select(clean.classify_transaction("d", "p", "rev")).collect()]
    assert got == ["MARKOUT", "TESTER", "REGULAR", "COMP", "REGULAR", "COMP", "COMP"]
    legacy = [x[0] for x in df.select(clean.classify_transaction_legacy("d", "p", "rev")).collect()]
    assert legacy[:2] == ["REWARD", "REWARD"]


def test_deal_type(spark):
    rows = [("2 FOR $25", None), ("10% SENIOR", None), ("", "Employee"), ("", None), ("EIGHTHS FOR $25", None),
            ("MYSTERY", None)]
    df = spark.createDataFrame(rows, "d string, i string")
    got = [x[0] for x in df.select(clean.classify_deal_type("d", "i")).collect()]
    assert got == ["BUNDLE", "PERCENT OFF", "CUSTOMER DISCOUNT", "NO DEAL", "PRICE DEAL", "OTHER"]


def test_parsers(spark):
    df = spark.createDataFrame([("$1,234.50", "2.9", "12.5%", "1/5/2025 3:04:05 PM"),
                                ("-$5.00", "abc", "n/a", "01/05/2025 12:00:00 AM"),
                                ("", "", "", "garbage")], "m string, q string, p string, t string")
    out = df.select(clean.parse_currency("m"), clean.coerce_quantity("q"), clean.parse_percent("p"),
                    clean.parse_timestamp("t")).collect()
    assert [tuple(x) for x in out] == [
        (1234.5, 2, 12.5, dt.datetime(2025, 1, 5, 15, 4, 5)),
        (-5.0, 0, None, dt.datetime(2025, 1, 5, 0, 0, 0)),
        (None, 0, None, None)]


def test_reward_name_and_segment(spark):
    df = spark.createDataFrame([("REWARD - 100 Points - Free Pre Roll, 20% OFF", None),
                                ("Reward Bonus", "Veterans, Locals"), ("20% OFF", ""), (None, "Medical Card")],
                               "d string, g string")
    out = df.select(clean.extract_reward_name("d"), clean.customer_segment("g")).collect()
    assert [tuple(x) for x in out] == [("REWARD - 100 Points - Free Pre Roll", "Regular"),
                                       ("Reward Bonus", "Veteran"), (None, "Regular"), (None, "Medical")]


def test_store_and_slug(spark):
    df = spark.createDataFrame([("Downtown - RD123 ", "Jerome Baker!"), ("Uptown", "  ")], "s string, b string")
    out = df.select(clean.clean_store("s"), clean.brand_slug("b")).collect()
    assert [tuple(x) for x in out] == [("Downtown", "jerome-baker"), ("Uptown", "unknown")]


def test_safe_math(spark):
    df = spark.createDataFrame([(1.0, 0.0), (3.0, 2.0), (2.0, None)], "a double, b double")
    out = df.select(safe_div("a", "b"), pct_change("a", "b"), r(F.lit(45.25), 1), r(F.lit(-0.04), 1)).collect()
    assert [tuple(x) for x in out] == [(0.0, None, 45.3, -0.0), (1.5, 50.0, 45.3, -0.0), (0.0, None, 45.3, -0.0)]


def test_dedup_latest_file(spark):
    rows = [("r1", "p", dt.datetime(2025, 1, 1), "a.csv", dt.date(2025, 1, 31), 1, 10.0),
            ("r1", "p", dt.datetime(2025, 1, 1), "b.csv", dt.date(2025, 2, 28), 1, 20.0),
            ("r1", "p", dt.datetime(2025, 1, 1), "c.csv", None, 1, 30.0),
            ("r2", "p", dt.datetime(2025, 1, 1), "a.csv", dt.date(2025, 1, 31), 2, 1.0),
            ("r2", "p", dt.datetime(2025, 1, 1), "a.csv", dt.date(2025, 1, 31), 1, 2.0),
            (None, "p", dt.datetime(2025, 1, 1), "a.csv", dt.date(2025, 1, 31), 1, 3.0)]
    df = spark.createDataFrame(rows, "receipt_id string, product string, completed_at timestamp, file_name string, "
                                     "file_end date, row_seq int, v double")
    out = {(x.receipt_id, x.v) for x in dedup_latest_file(df).collect()}
    assert out == {("r1", 20.0), ("r2", 2.0), (None, 3.0)}
    assert dedup_latest_file(dedup_latest_file(df)).count() == 3


def test_expand_deals_conserves_revenue(spark):
    rows = [("A, B", 10.0), ("A,,B", 9.0), (" ", 5.0), ("A,", 4.0), ("A, A", 2.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "deals_used string, actual_revenue double").select(
        "*", F.lit("r").alias("receipt_id"), F.lit("s").alias("store_clean"), F.lit("b").alias("brand_clean"),
        F.lit("c").alias("category_clean"), F.lit(0.0).alias("discounts"), F.lit(1).alias("quantity"),
        F.lit(0.0).alias("cost"), F.lit(0.0).alias("net_profit"), F.lit(0.0).alias("pre_discount_revenue"))
    x = expand_deals(df)
    assert x.count() == 7
    assert abs(x.agg(F.sum("revenue")).first()[0] - 25.0) < 1e-9


def test_period_algebra():
    assert Period.of_month(2025, 1).previous() == Period.of_month(2024, 12)
    assert Period.of_quarter(2025, 1).previous() == Period.of_quarter(2024, 4)
    p = Period.custom(dt.date(2025, 1, 10), dt.date(2025, 1, 19)).previous()
    assert (p.start, p.end) == (dt.date(2024, 12, 31), dt.date(2025, 1, 9))
    rg = Period.of_range(2024, 11, 2025, 1).previous()
    assert (rg.start, rg.end, rg.label) == (dt.date(2024, 8, 1), dt.date(2024, 10, 31), "Aug 2024 to Oct 2024")
    assert Period.of_month(2025, 3, store="X").previous().store == "X"


def test_product_kpis_count_every_product(spark):
    """60 dead, 25 accelerating and 30 decelerating products: more than the lists of L2 and L3 show."""
    from tillpoint.operators.products import dead_stock, product_kpis, velocity_trends

    rows = [(f"dead{i:02}", "2024-01-01", 1, 10.0) for i in range(60)]
    for kind, n, units in (("up", 25, (1, 3)), ("down", 30, (3, 1))):
        rows += [(f"{kind}{i:02}", day, u, 10.0) for i in range(n) for day, u in zip(("2025-03-10", "2025-06-30"), units)]
    sales = spark.createDataFrame([(*r[:2], r[2], r[3], 4.0, 6.0, "b", "c", "s") for r in rows],
                                  "product string, day string, quantity int, actual_revenue double, cost double, net_profit double, "
                                  "brand_clean string, category_clean string, store_clean string")
    sales = sales.selectExpr("*", "cast(day as date) as sale_date").drop("day")
    k = product_kpis(sales).first()
    assert (k.total_products, k.dead_stock_count, k.dead_stock_revenue) == (115, 60, 600.0)
    assert (k.accelerating_count, k.decelerating_count) == (25, 30)
    limited = product_kpis(sales, 50, 20).first()
    assert (limited.dead_stock_count, limited.accelerating_count, limited.decelerating_count) == (50, 20, 20)
    assert sorted(r["rank"] for r in dead_stock(sales, top_n=None).collect()) == list(range(1, 61))
    assert velocity_trends(sales, top_n=None).count() == 55
