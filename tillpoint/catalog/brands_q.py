"""Catalog: velocity and share (H1-H6), customers."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import IS, MS, PCTCHG, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import customers as I
from tillpoint.operators import velocity as H
from tillpoint.plans.curate import load_customer_attributes, load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


BC = "brand_clean IS NOT NULL AND category_clean IS NOT NULL"
CAT_CTE = f"""
, cat AS (SELECT category_clean AS category, {IS('quantity')} AS category_units, {MS('actual_revenue')} AS category_revenue,
          CAST(count(DISTINCT brand_clean) AS BIGINT) AS brands_in_category
          FROM regular WHERE category_clean IS NOT NULL GROUP BY 1),
bc AS (SELECT brand_clean AS brand, category_clean AS category, {IS('quantity')} AS brand_units,
       {MS('actual_revenue')} AS brand_revenue FROM regular WHERE {BC} GROUP BY 1, 2),
prim AS (SELECT brand, category FROM (SELECT brand, category,
         row_number() OVER (PARTITION BY brand ORDER BY brand_revenue DESC, category) AS k FROM bc) WHERE k = 1)
"""

H1_SQL = oracle(f"""
, g AS (SELECT brand_clean AS brand, greatest(datediff('day', min(sale_date), max(sale_date)) + 1, 1) AS d,
        {IS('quantity')} AS total_units, {MS('actual_revenue')} AS rev,
        CAST(count(DISTINCT receipt_id) AS BIGINT) AS total_transactions
        FROM regular WHERE brand_clean IS NOT NULL GROUP BY 1)
SELECT brand, {R(SD('total_units', 'd'), 2)} AS units_per_day, {R(SD('rev', 'd'), 2)} AS revenue_per_day,
  {R(SD('total_units', 'total_transactions'), 2)} AS avg_units_per_txn, CAST(d AS BIGINT) AS days_of_data,
  total_units, total_transactions FROM g
""")

H2_SQL = oracle(CAT_CTE + f"""
, span AS (SELECT greatest(datediff('day', min(sale_date), max(sale_date)) + 1, 1) AS d FROM regular),
x AS (SELECT bc.*, cat.category_units, cat.category_revenue, cat.brands_in_category,
      {SD('brand_units', 'span.d')} AS bupd,
      CASE WHEN brands_in_category > 0 THEN {SD(SD('category_units', 'span.d'), 'brands_in_category')} ELSE 0.0 END AS aupd
      FROM bc JOIN cat USING (category), span)
SELECT brand, category, {R('bupd', 2)} AS brand_units_per_day, {R('aupd', 2)} AS category_avg_units_per_day,
  CASE WHEN aupd > 0 THEN {R(SD('bupd', 'aupd') + ' * 100')} ELSE 0.0 END AS velocity_index,
  {R(SD('brand_revenue', 'brand_units'), 2)} AS brand_rev_per_unit,
  {R(SD('category_revenue', 'category_units'), 2)} AS category_rev_per_unit, brands_in_category
FROM x
""")

H3_SQL = oracle(CAT_CTE + f"""
SELECT brand, category, brand_revenue, category_revenue,
  {R(SD('brand_revenue', 'category_revenue') + ' * 100')} AS revenue_share_pct, brand_units, category_units,
  {R(SD('brand_units', 'category_units') + ' * 100')} AS units_share_pct
FROM bc JOIN cat USING (category)
""")

H4_SQL = oracle(f"""
, g AS (SELECT brand_clean AS brand, ym, {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost, {IS('quantity')} AS units,
        CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions, {MS('net_profit')} AS profit
        FROM regular WHERE brand_clean IS NOT NULL GROUP BY 1, 2),
x AS (SELECT *, {SD('revenue - cost', 'revenue')} * 100 AS m FROM g),
y AS (SELECT *, lag(revenue) OVER w AS pr, lag(units) OVER w AS pu, lag(m) OVER w AS pm,
      row_number() OVER w AS k FROM x WINDOW w AS (PARTITION BY brand ORDER BY ym))
SELECT brand, printf('%d-%02d', ym // 100, ym % 100) AS period, revenue, cost, {R('m')} AS margin, units,
  transactions, profit,
  CASE WHEN k > 1 THEN {R(f"coalesce({PCTCHG('revenue', 'pr')}, 0.0)")} END AS revenue_change_pct,
  CASE WHEN k > 1 THEN {R(f"coalesce({PCTCHG('units', 'pu')}, 0.0)")} END AS units_change_pct,
  CASE WHEN k > 1 THEN {R('m - pm')} END AS margin_change_pts
FROM y
""")

H5_SQL = oracle(CAT_CTE + f"""
, cm AS (SELECT category_clean AS category, ym, {MS('actual_revenue')} AS category_revenue FROM regular
         WHERE category_clean IS NOT NULL GROUP BY 1, 2),
bm AS (SELECT brand_clean AS brand, category_clean AS category, ym, {MS('actual_revenue')} AS brand_revenue
       FROM regular WHERE {BC} GROUP BY 1, 2, 3)
SELECT prim.brand, prim.category, printf('%d-%02d', cm.ym // 100, cm.ym % 100) AS period,
  coalesce(bm.brand_revenue, 0.0) AS brand_revenue, cm.category_revenue,
  {R(SD('coalesce(bm.brand_revenue, 0.0)', 'cm.category_revenue') + ' * 100')} AS share_pct
FROM prim JOIN cm ON prim.category = cm.category
LEFT JOIN bm ON bm.brand = prim.brand AND bm.category = prim.category AND bm.ym = cm.ym
""")

H6_SQL = oracle(CAT_CTE + """
, ranked AS (SELECT brand, category, row_number() OVER (PARTITION BY category ORDER BY brand_units DESC, brand) AS velocity_rank,
             count(*) OVER (PARTITION BY category) AS brands_in_category FROM bc)
SELECT brand, category, velocity_rank, brands_in_category FROM prim JOIN ranked USING (brand, category)
""")


def _segment_sql(g: str) -> str:
    parts = " ".join(f"WHEN upper({g}) LIKE '%{kw}%' THEN '{seg}'" for kw, seg in fixed.CUSTOMER_SEGMENTS)
    return f"CASE WHEN {g} IS NULL OR {g} = '' THEN 'Regular' {parts} ELSE 'Other Group' END"


def _attr_sql() -> str:
    from tillpoint.sources import testmodel

    seg = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in testmodel.SEGMENT_GROUPS.items())
    return f"""
, attrs AS (SELECT CAST(c_custkey AS VARCHAR) AS customer_id, CASE c_mktsegment {seg} END AS groups,
            CASE WHEN c_acctbal > 0 THEN 'Yes' ELSE 'No' END AS is_loyal FROM customer)
"""


CUST_CTE = _attr_sql() + f"""
, base AS (SELECT * FROM regular WHERE customer_id IS NOT NULL),
sums AS (SELECT customer_id, arg_min(customer_name, (completed_at, receipt_id)) AS customer_name,
         CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions, {MS('actual_revenue')} AS total_spent,
         {MS('discounts')} AS total_discounts, {IS('quantity')} AS total_units FROM base GROUP BY 1),
rt AS (SELECT customer_id, receipt_id, {MS('actual_revenue')} AS t FROM base GROUP BY 1, 2),
av AS (SELECT customer_id, {R(SD(MS('t'), 'count(*)'), 2)} AS avg_transaction FROM rt GROUP BY 1),
md AS (SELECT customer_id, store_clean AS primary_store FROM (
        SELECT customer_id, store_clean, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, store_clean) AS k
        FROM base WHERE store_clean IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
cust AS (
  SELECT sums.*, av.avg_transaction, coalesce(md.primary_store, 'Unknown') AS primary_store,
    {R(SD('total_discounts', 'total_spent + total_discounts') + ' * 100')} AS discount_rate,
    attrs.groups, attrs.is_loyal, {_segment_sql('attrs.groups')} AS segment
  FROM sums LEFT JOIN av USING (customer_id) LEFT JOIN md USING (customer_id) LEFT JOIN attrs USING (customer_id)
)
"""
_CUST_COLS = ", ".join(I.CUST_OUT)

I1_SQL = oracle(CUST_CTE + f"SELECT {_CUST_COLS} FROM cust")
I2_SQL = oracle(_attr_sql() + f"""
, g AS (SELECT {MS('actual_revenue')} AS total_revenue, {MS('discounts')} AS total_discounts,
        CAST(count(DISTINCT receipt_id) AS BIGINT) AS total_transactions,
        CAST(count(DISTINCT customer_id) AS BIGINT) AS total_customers FROM regular),
l AS (SELECT count(*) AS loyal FROM (SELECT DISTINCT customer_id FROM regular WHERE customer_id IS NOT NULL) c
      WHERE customer_id IN (SELECT customer_id FROM attrs WHERE is_loyal = 'Yes'))
SELECT total_customers, total_revenue, {R(SD('total_revenue', 'total_customers'), 2)} AS revenue_per_customer,
  {R(SD('loyal', 'total_customers') + ' * 100')} AS loyalty_rate, total_transactions,
  {R(SD('total_revenue', 'total_transactions'), 2)} AS avg_transaction, total_discounts,
  {R(SD('total_discounts', 'total_revenue + total_discounts') + ' * 100')} AS discount_rate
FROM g, l
""")
I3_SQL = oracle(CUST_CTE + f"""
, tr AS (SELECT {MS('actual_revenue')} AS tr FROM regular), tc AS (SELECT count(*) AS tc FROM cust),
g AS (SELECT segment, CAST(count(*) AS BIGINT) AS customers, {MS('total_spent')} AS total_revenue,
      {MS('total_discounts')} AS total_discounts FROM cust GROUP BY 1)
SELECT segment, customers, total_revenue, total_discounts, {R('total_revenue / customers', 2)} AS rev_per_cust,
  {R(SD('total_discounts', 'total_revenue + total_discounts') + ' * 100')} AS discount_rate,
  {R('customers / tc * 100')} AS pct_of_cust,
  CASE WHEN tr > 0 THEN {R('total_revenue / tr * 100')} ELSE 0.0 END AS pct_of_rev
FROM g, tr, tc
""")
I4_SQL = oracle(CUST_CTE + f"""
SELECT * FROM (SELECT {_CUST_COLS}, row_number() OVER (ORDER BY total_spent DESC, customer_id) AS rank FROM cust)
WHERE rank <= 50
""")
I5_SQL = oracle(CUST_CTE + f"""
SELECT * FROM (SELECT {_CUST_COLS}, row_number() OVER (PARTITION BY primary_store ORDER BY total_spent DESC, customer_id)
  AS rank FROM cust WHERE primary_store <> 'Unknown') WHERE rank <= 50
""")


def _cust(s, sf):
    return I.customer_metrics(REG(s, sf), load_customer_attributes(s, sf))


ENTRIES = {
    "H1_velocity_metrics": (lambda s, sf: H.velocity_metrics(REG(s, sf)), H1_SQL),
    "H2_velocity_by_category": (lambda s, sf: H.velocity_by_category(REG(s, sf)), H2_SQL),
    "H3_share_of_category": (lambda s, sf: H.share_of_category(REG(s, sf)), H3_SQL),
    "H4_brand_monthly_trend": (lambda s, sf: H.brand_monthly_trend(REG(s, sf)), H4_SQL),
    "H5_share_trend": (lambda s, sf: H.share_trend(REG(s, sf)), H5_SQL),
    "H6_velocity_rank": (lambda s, sf: H.velocity_rank(REG(s, sf)), H6_SQL),
    "I1_customer_metrics": (lambda s, sf: _cust(s, sf).select(*I.CUST_OUT), I1_SQL),
    "I2_customer_summary": (lambda s, sf: I.customer_summary(REG(s, sf), load_customer_attributes(s, sf)), I2_SQL),
    "I3_segment_summary": (lambda s, sf: I.segment_summary(_cust(s, sf), REG(s, sf)), I3_SQL),
    "I4_top_customers": (lambda s, sf: I.top_customers(_cust(s, sf), 50), I4_SQL),
    "I5_top_customers_by_store": (lambda s, sf: I.top_customers_by_store(_cust(s, sf), 50), I5_SQL),
}
