"""Catalog: margin marts (F1-F7) and category lookups."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import CNT, IS, ISI, MS, MSI, R, SD, SDN
from tillpoint.operators import margin as M
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


def _split_sql_aggs() -> str:
    fp, d = "NOT has_discount", "has_discount"
    return ",\n".join([
        f"{ISI(fp, 'quantity')} AS full_price_units", f"{MSI(fp, 'actual_revenue')} AS full_price_sales",
        f"{MSI(fp, 'cost')} AS full_price_cost", f"{ISI(d, 'quantity')} AS discounted_units",
        f"{MSI(d, 'actual_revenue')} AS discounted_sales", f"{MSI(d, 'cost')} AS discounted_cost",
        f"{IS('quantity')} AS total_units", f"{MS('actual_revenue')} AS total_revenue",
        f"{MS('cost')} AS total_cost", f"{MS('net_profit')} AS net_profit",
        f"{CNT(fp)} AS n_fp", f"{CNT(d)} AS n_disc",
    ])


_SPLIT_COLS = ", ".join(M.SPLIT_COLS)


def _split_sql_ratios(null_absent: bool) -> str:
    fpm = R(SD("full_price_sales - full_price_cost", "full_price_sales") + " * 100")
    dm = R(SD("discounted_sales - discounted_cost", "discounted_sales") + " * 100")
    if null_absent:
        fpm = f"CASE WHEN n_fp > 0 THEN {fpm} END"
        dm = f"CASE WHEN n_disc > 0 THEN {dm} END"
    return ",\n".join([
        R(SD("full_price_sales", "total_revenue") + " * 100") + " AS pct_full_price",
        R(SD("discounted_sales", "total_revenue") + " * 100") + " AS pct_discounted",
        f"{fpm} AS full_price_margin", f"{dm} AS discounted_margin",
        R(SD("total_revenue - total_cost", "total_revenue") + " * 100") + " AS blended_margin",
    ])


F1_SQL = oracle(f"""
, g AS (SELECT {_split_sql_aggs()} FROM regular)
SELECT {_SPLIT_COLS}, {_split_sql_ratios(True)} FROM g
""")


def f2_sql(dim: str) -> str:
    return oracle(f"""
, g AS (SELECT {dim} AS name, {_split_sql_aggs()} FROM regular WHERE {dim} IS NOT NULL GROUP BY {dim})
SELECT name, {_SPLIT_COLS}, {_split_sql_ratios(False)} FROM g
""")


F2_ALL_SQL = oracle(f"""
, g AS (
  {' UNION ALL '.join(f"SELECT '{lab}' AS dim, {c} AS name, {_split_sql_aggs()} FROM regular WHERE {c} IS NOT NULL GROUP BY {c}" for lab, c in M.MARGIN_DIMS.items())}
)
SELECT dim, name, {_SPLIT_COLS}, {_split_sql_ratios(False)} FROM g
""")

F3_SQL = oracle(f"""
, g AS (
  SELECT store_clean AS name, {_split_sql_aggs()} FROM regular WHERE store_clean IS NOT NULL GROUP BY store_clean
  UNION ALL
  SELECT 'TOTAL' AS name, {_split_sql_aggs()} FROM regular WHERE store_clean IS NOT NULL
)
SELECT name, {_SPLIT_COLS}, {_split_sql_ratios(False)} FROM g
""")

F4_SQL = oracle(f"""
, g AS (
  SELECT brand_clean AS brand, {IS('quantity')} AS total_units, {MS('actual_revenue')} AS total_revenue,
    {MS('cost')} AS total_cost, {MS('discounts')} AS total_discounts, {MS('net_profit')} AS total_profit,
    {MSI('NOT has_discount', 'actual_revenue')} AS fp_revenue, {MSI('NOT has_discount', 'cost')} AS fp_cost,
    {MSI('has_discount', 'actual_revenue')} AS disc_revenue, {MSI('has_discount', 'cost')} AS disc_cost
  FROM regular WHERE brand_clean IS NOT NULL GROUP BY brand_clean
)
SELECT brand, total_units, total_revenue, total_cost, total_discounts, total_profit, fp_revenue, disc_revenue,
  {R(SD('total_revenue - total_cost', 'total_revenue') + ' * 100')} AS overall_margin,
  {R(SD('fp_revenue - fp_cost', 'fp_revenue') + ' * 100')} AS fp_margin,
  {R(SD('disc_revenue - disc_cost', 'disc_revenue') + ' * 100')} AS disc_margin,
  {R(SD('fp_revenue', 'total_revenue') + ' * 100')} AS pct_full_price,
  {R(SD('total_discounts', 'total_revenue + total_discounts') + ' * 100')} AS avg_discount_rate
FROM g
""")

F5_SQL = oracle(f"""
, g AS (
  SELECT brand_clean AS brand, CAST(count(DISTINCT ym) AS BIGINT) AS months_count, {MS('cost')} AS c,
    {IS('quantity')} AS u, CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers
  FROM regular WHERE brand_clean IS NOT NULL GROUP BY brand_clean
)
SELECT brand, months_count, {R(SD('c', 'months_count'), 2)} AS avg_monthly_cost,
  {R(SD('c', 'u'), 2)} AS cost_per_unit, unique_customers FROM g
""")

E7_SQL = oracle(f"""
SELECT category_clean AS category,
  {R(SDN(f"{MS('actual_revenue')} - {MS('cost')}", MS('actual_revenue')) + ' * 100')} AS margin
FROM regular WHERE category_clean IS NOT NULL GROUP BY category_clean
""")

E8_SQL = oracle(f"""
, g AS (SELECT category_clean AS category, brand_clean AS brand, {MS('actual_revenue')} AS revenue
        FROM regular WHERE category_clean IS NOT NULL AND brand_clean IS NOT NULL GROUP BY 1, 2)
SELECT category, brand, revenue,
  CAST(rank() OVER (PARTITION BY category ORDER BY revenue DESC) AS BIGINT) AS rank,
  CAST(count(*) OVER (PARTITION BY category) AS BIGINT) AS total_brands
FROM g
""")

F6_SQL = oracle(f"""
, g AS (
  SELECT brand_clean AS brand, category_clean AS category, {IS('quantity')} AS units,
    {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost, {MS('net_profit')} AS profit,
    {MS('discounts')} AS discounts
  FROM regular WHERE category_clean IS NOT NULL AND brand_clean IS NOT NULL GROUP BY 1, 2
), cat AS (
  SELECT category_clean AS category, {MS('actual_revenue')} AS crev, {MS('cost')} AS ccost
  FROM regular WHERE category_clean IS NOT NULL AND brand_clean IS NOT NULL GROUP BY 1
), x AS (
  SELECT g.*, {R(SDN('revenue - cost', 'revenue') + ' * 100')} AS margin,
    {R(SDN('crev - ccost', 'crev') + ' * 100')} AS category_avg_margin,
    CAST(rank() OVER (PARTITION BY g.category ORDER BY revenue DESC) AS BIGINT) AS rank,
    CAST(count(*) OVER (PARTITION BY g.category) AS BIGINT) AS total_brands,
    row_number() OVER (PARTITION BY brand ORDER BY revenue DESC, g.category) = 1 AS is_primary
  FROM g JOIN cat ON g.category = cat.category
)
SELECT brand, category, units, revenue, cost, profit, discounts, margin, category_avg_margin, rank, total_brands,
  {R('margin - category_avg_margin')} AS vs_category, is_primary
FROM x
""")


def _f7_sql() -> str:
    from tillpoint.functions import fixed

    tiers = " UNION ALL ".join(
        f"SELECT {i} AS tier_order, '{lab}' AS tier, {'NULL' if lo is None else lo} AS lo, {hi} AS hi"
        for i, (lab, lo, hi) in enumerate(fixed.DISCOUNT_TIERS))
    return oracle(f"""
, b AS (
  SELECT brand_clean AS brand, coalesce({SDN('discounts', 'pre_discount_revenue')} * 100, 0.0) AS dp, actual_revenue
  FROM regular WHERE brand_clean IS NOT NULL
), n AS (SELECT brand, count(*) AS total FROM b GROUP BY brand),
t AS ({tiers}),
bt AS (
  SELECT b.brand, t.tier_order, b.dp, b.actual_revenue FROM b JOIN t
    ON (t.lo IS NULL AND b.dp = 0) OR (t.lo IS NOT NULL AND b.dp > t.lo AND b.dp <= t.hi)
), agg AS (
  SELECT brand, tier_order, count(*) AS cnt, {MS('actual_revenue')} AS revenue, avg(dp) AS avgdp
  FROM bt GROUP BY 1, 2
)
SELECT n.brand, t.tier_order, t.tier, CAST(coalesce(agg.cnt, 0) AS BIGINT) AS transactions,
  {R(SD('coalesce(agg.cnt, 0)', 'n.total') + ' * 100')} AS pct_of_transactions,
  coalesce(agg.revenue, 0.0) AS revenue,
  CASE WHEN coalesce(agg.cnt, 0) > 0 THEN {R('agg.avgdp')} ELSE 0.0 END AS avg_discount
FROM n CROSS JOIN t LEFT JOIN agg ON agg.brand = n.brand AND agg.tier_order = t.tier_order
""")


ENTRIES = {
    "F1_company_margin": (lambda s, sf: M.company_margin(REG(s, sf)), F1_SQL),
    "F2_margin_by_store": (lambda s, sf: M.margin_by_group(REG(s, sf), "store_clean"), f2_sql("store_clean")),
    "F2_margin_by_brand": (lambda s, sf: M.margin_by_group(REG(s, sf), "brand_clean"), f2_sql("brand_clean")),
    "F2_margin_by_category": (lambda s, sf: M.margin_by_group(REG(s, sf), "category_clean"), f2_sql("category_clean")),
    "F2_margin_by_deal_type": (lambda s, sf: M.margin_by_group(REG(s, sf), "deal_type"), f2_sql("deal_type")),
    "F2_margin_by_dims": (lambda s, sf: M.margin_by_dims(REG(s, sf)), F2_ALL_SQL),
    "F3_margin_totals_row": (lambda s, sf: M.margin_with_total(REG(s, sf), "store_clean"), F3_SQL),
    "F4_brand_margin_summary": (lambda s, sf: M.brand_margin_summary(REG(s, sf)), F4_SQL),
    "F5_brand_extras": (lambda s, sf: M.brand_extras(REG(s, sf)), F5_SQL),
    "F6_brand_category_breakdown": (lambda s, sf: M.brand_category_breakdown(REG(s, sf)), F6_SQL),
    "F7_discount_depth": (lambda s, sf: M.discount_depth(REG(s, sf)), _f7_sql()),
    "E7_category_margin": (lambda s, sf: M.category_margin(REG(s, sf)), E7_SQL),
    "E8_brand_category_rank": (lambda s, sf: M.brand_category_rank(REG(s, sf)), E8_SQL),
}
