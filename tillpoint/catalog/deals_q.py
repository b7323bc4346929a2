"""Catalog: deals (G1-G6) and metadata."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import CNT, IS, ISI, MS, MSI, R, SD
from tillpoint.operators import deals as D
from tillpoint.operators import meta as E
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


_EXPANDED = """
, _lines AS (
  SELECT *, list_filter(list_transform(string_split(deals_used, ','), lambda x: trim(x)), lambda x: x <> '') AS dl
  FROM regular WHERE deals_used IS NOT NULL
), expanded AS (
  SELECT unnest(dl) AS deal_name, receipt_id, store_clean AS store, brand_clean AS brand, category_clean AS category,
    actual_revenue / len(dl) AS revenue, discounts / len(dl) AS discounts,
    CAST(quantity AS DOUBLE) / len(dl) AS quantity, cost / len(dl) AS cost, net_profit / len(dl) AS profit,
    pre_discount_revenue / len(dl) AS pre_discount_revenue
  FROM _lines WHERE len(dl) > 0
)
"""


def _disc_rate(d, rev):
    return R(SD(d, f"{rev} + {d}") + " * 100")


G1_SQL = oracle(_EXPANDED + "SELECT * FROM expanded")

G2_SQL = oracle(_EXPANDED + f"""
, g AS (
  SELECT deal_name, CAST(count(DISTINCT receipt_id) AS BIGINT) AS times_used, {R('sum(quantity)', 4)} AS units,
    {R('sum(revenue)', 4)} AS revenue, {R('sum(discounts)', 4)} AS discounts, {R('sum(cost)', 4)} AS cost,
    {R('sum(profit)', 4)} AS profit, {R('sum(pre_discount_revenue)', 4)} AS pre_discount_revenue
  FROM expanded GROUP BY deal_name
), x AS (
  SELECT *, {R(SD('revenue - cost', 'revenue') + ' * 100')} AS margin, {_disc_rate('discounts', 'revenue')} AS avg_discount,
    row_number() OVER (ORDER BY times_used DESC, deal_name) AS rank FROM g
)
SELECT * FROM x WHERE rank <= 50
""")

G3_SQL = oracle(f"""
, g AS (
  SELECT deal_type, CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions, {IS('quantity')} AS units,
    {MS('pre_discount_revenue')} AS full_price_revenue, {MS('actual_revenue')} AS actual_revenue,
    {MS('discounts')} AS discounts, {MS('cost')} AS cost, {MS('net_profit')} AS net_profit
  FROM regular WHERE deal_type IS NOT NULL GROUP BY deal_type
)
SELECT *, {_disc_rate('discounts', 'actual_revenue')} AS discount_rate,
  {R(SD('actual_revenue - cost', 'actual_revenue') + ' * 100')} AS margin FROM g
""")

G4_SQL = oracle(_EXPANDED + f"""
, g AS (
  SELECT store, deal_name, CAST(count(DISTINCT receipt_id) AS BIGINT) AS times_used, {R('sum(quantity)', 4)} AS units,
    {R('sum(revenue)', 4)} AS revenue, {R('sum(discounts)', 4)} AS discounts, {R('sum(cost)', 4)} AS cost
  FROM expanded WHERE store IS NOT NULL GROUP BY store, deal_name
), x AS (
  SELECT *, {R(SD('revenue - cost', 'revenue') + ' * 100')} AS margin,
    row_number() OVER (PARTITION BY store ORDER BY times_used DESC, deal_name) AS rank FROM g
)
SELECT * FROM x WHERE rank <= 10
""")

G5_SQL = oracle(f"""
, g AS (
  SELECT brand_clean AS brand,
    count(DISTINCT CASE WHEN NOT has_discount THEN sale_date END) AS fpd,
    count(DISTINCT CASE WHEN has_discount THEN sale_date END) AS dd,
    {ISI('NOT has_discount', 'quantity')} AS fpu, {ISI('has_discount', 'quantity')} AS du,
    {MSI('NOT has_discount', 'actual_revenue')} AS fpr, {MSI('has_discount', 'actual_revenue')} AS dr
  FROM regular WHERE brand_clean IS NOT NULL GROUP BY brand_clean
), x AS (
  SELECT *, {SD('fpu', 'CASE WHEN fpd = 0 THEN 1 ELSE fpd END')} AS fpupd,
    {SD('du', 'CASE WHEN dd = 0 THEN 1 ELSE dd END')} AS dupd FROM g
)
SELECT brand, {R('fpupd', 2)} AS fp_units_per_day, {R('dupd', 2)} AS disc_units_per_day,
  CASE WHEN fpupd > 0 THEN {R(SD('dupd - fpupd', 'fpupd') + ' * 100')} END AS lift_pct,
  {R(SD('fpr', 'fpu'), 2)} AS fp_avg_revenue_per_unit, {R(SD('dr', 'du'), 2)} AS disc_avg_revenue_per_unit
FROM x
""")

G6_SQL = oracle(_EXPANDED + f"""
, g AS (
  SELECT brand, deal_name, CAST(count(DISTINCT receipt_id) AS BIGINT) AS uses, {R('sum(revenue)', 4)} AS revenue,
    {R('sum(discounts)', 4)} AS discounts, {R('sum(quantity)', 4)} AS units, {R('sum(cost)', 4)} AS cost
  FROM expanded WHERE brand IS NOT NULL GROUP BY brand, deal_name
), x AS (
  SELECT *, {R(SD('revenue - cost', 'revenue') + ' * 100')} AS margin,
    {_disc_rate('discounts', 'revenue')} AS discount_depth,
    row_number() OVER (PARTITION BY brand ORDER BY uses DESC, deal_name) AS rank FROM g
)
SELECT * FROM x WHERE rank <= 20
""")

E1_SQL = oracle("SELECT DISTINCT store_clean AS store FROM sales WHERE store_clean IS NOT NULL")
E2_SQL = oracle("SELECT DISTINCT category_clean AS category FROM sales WHERE category_clean IS NOT NULL")
E3_SQL = oracle(f"""
, g AS (SELECT brand_clean AS brand, {MS('actual_revenue')} AS revenue FROM regular
        WHERE brand_clean IS NOT NULL GROUP BY brand_clean)
SELECT brand, revenue, row_number() OVER (ORDER BY revenue DESC, brand) AS position FROM g
""")
E4_SQL = oracle("""
SELECT DISTINCT year, month, strftime(make_date(year, month, 1), '%B %Y') AS label FROM sales
""")
E5_SQL = oracle(f"""
SELECT CAST(count(*) AS BIGINT) AS total_rows, {CNT("transaction_type = 'REGULAR'")} AS regular_rows,
  CAST(count(DISTINCT store_clean) AS BIGINT) AS stores, CAST(count(DISTINCT brand_clean) AS BIGINT) AS brands,
  CAST(count(DISTINCT (year, month)) AS BIGINT) AS periods
FROM sales
""")
E6_SQL = oracle("SELECT CAST(min(sale_date) AS VARCHAR) AS first_date, CAST(max(sale_date) AS VARCHAR) AS last_date FROM regular")

ENTRIES = {
    "G1_expand_deals": (lambda s, sf: D.expand_deals(REG(s, sf)), G1_SQL),
    "G2_deal_summary": (lambda s, sf: D.deal_summary(REG(s, sf), 50), G2_SQL),
    "G3_deal_type_summary": (lambda s, sf: D.deal_type_summary(REG(s, sf)), G3_SQL),
    "G4_deal_summary_by_store": (lambda s, sf: D.deal_summary_by_store(REG(s, sf), 10), G4_SQL),
    "G5_promo_lift": (lambda s, sf: D.promo_lift(REG(s, sf)), G5_SQL),
    "G6_promo_effectiveness": (lambda s, sf: D.promo_effectiveness(REG(s, sf), 20), G6_SQL),
    "E1_stores": (lambda s, sf: E.stores(load_sales(s, sf)), E1_SQL),
    "E2_categories": (lambda s, sf: E.categories(load_sales(s, sf)), E2_SQL),
    "E3_brands": (lambda s, sf: E.brands(REG(s, sf)), E3_SQL),
    "E4_periods_available": (lambda s, sf: E.periods_available(load_sales(s, sf)), E4_SQL),
    "E5_row_counts": (lambda s, sf: E.row_counts(load_sales(s, sf)), E5_SQL),
    "E6_date_range": (lambda s, sf: E.date_range(REG(s, sf)), E6_SQL),
}
