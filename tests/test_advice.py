"""Brand advice on hand-made sales, and C6."""
import datetime as dt

import pytest

from tillpoint.operators import advice as A
from tillpoint.plans.period import Period, comparison_period

COLUMNS = ("brand_clean string, store_clean string, category_clean string, product string, quantity bigint, actual_revenue double, cost double, "
           "discounts double, net_profit double, has_discount boolean, sale_date date, year int, month int")


@pytest.fixture(scope="module")
def sales(spark):
    def line(brand, store, category, product, units, revenue, cost, off=False, year=2025):
        return (brand, store, category, product, units, revenue, cost, 0.0, revenue - cost, off, dt.date(year, 3, 1), year, 3)

    return spark.createDataFrame([
        line("A", "s1", "x", "p", 2, 20.0, 15.0), line("A", "s2", "x", "p", 1, 15.0, 12.0, True), line("A", "s3", "x", "q", 1, 1.0, 0.5, True),
        line("A", "s1", "x", "p", 1, 10.0, 9.0, year=2024), line("B", "s4", "x", "z", 100, 20000.0, 2000.0), line("B", "s1", "y", "z", 1, 5.0, 1.0),
        line(None, "s1", "x", "n", 1, 1.0, 1.0), line("B", None, "x", "n", 1, 1.0, 1.0), line("C", "s1", None, None, 1, 1.0, 1.0)], COLUMNS)


def test_pricing(sales):
    rows = A.pricing_consistency(sales).collect()
    assert [(r.brand, r["product"], r.min_price, r.max_price, r.store_count, r.range_pct) for r in rows] == [
        ("A", "p", 10.0, 15.0, 2, 40.0), ("B", "z", 5.0, 200.0, 2, 190.2)]
    assert A.pricing_consistency(sales, n=None).count() == 2
    assert A.pricing_consistency(sales.limit(0)).count() == 0


def test_comparison(sales):
    got = {r.metric: (r.current, r.previous, r.change) for r in A.comparison(sales, Period.of_year(2025), comparison_period("year", year=2024)).collect()}
    assert got["Revenue"] == (36.0, 10.0, 26.0) and got["Units"] == (4.0, 1.0, 3.0) and len(got) == 5
    both = A.comparison(sales, Period.of_year(2025), comparison_period("all")).where("brand = 'A' and metric = 'Revenue'").first()
    assert (both.current, both.previous) == (36.0, 46.0)  # overlapping periods share lines
    assert A.comparison(sales, Period.of_year(2025), None).count() == 0


def test_comparison_period():
    assert comparison_period(None) is None
    assert comparison_period("quarter", year=2025, quarter=2) == Period.of_quarter(2025, 2)
    with pytest.raises(ValueError):
        comparison_period("week")


def test_recommendations_and_insight(sales):
    titles = {(r.brand, r.title) for r in A.recommendations(sales).collect()}
    assert titles == {("A", "x: BELOW CATEGORY AVERAGE"), ("A", "CATEGORY BENCHMARK GAP"), ("A", "LOW DISCOUNTED MARGIN"), ("B", "VOLUME LEVERAGE")}
    insight = {r.brand: r.insight for r in A.key_insight(sales).collect()}
    assert insight["A"].startswith("A margin (20.7%) is 69 pts BELOW x average (89.8%).")
    assert set(insight) == {"A", "B"}  # C has no category to stand in


def test_growth(sales):
    rows = {(r.brand, r.type, r.title): (r.detail, r.priority) for r in A.growth_opportunities(sales).collect()}
    assert rows["A", "distribution", "Expand to s4"] == ("Store has $20,000 in x — categories where A competes.", "high")
    assert rows["A", "sku_expansion", "Add 'p' to 1 more store(s)"] == ("Carried in 2 stores. Missing from: s3", "medium")
    assert ("A", "velocity", "Improve velocity in x") in rows
    assert rows["B", "distribution", "Expand to s2"] == ("Store has $15 in x — categories where B competes.", "medium")
