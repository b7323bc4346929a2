"""Catalog: staff scoring (P1-P5) and rewards (Q1-Q4)."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import IS, MS, MSI, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import staff as P
from tillpoint.plans.curate import load_sales, regular

STAFF = f"""
, staff AS (
  SELECT budtender, store, num_transactions, units_sold, total_sales,
    {R(SD('total_sales', 'num_transactions'), 2)} AS avg_cart_value,
    {R(SD('units_sold', 'num_transactions'), 2)} AS avg_units_per_cart,
    {R(SD('d', 'total_sales') + ' * 100')} AS pct_sales_discounted,
    CAST(regexp_extract(budtender, '(\\d+)$', 1) AS BIGINT) % 17 AS loyalty_enrollments
  FROM (SELECT sold_by AS budtender, store_clean AS store, CAST(count(DISTINCT receipt_id) AS BIGINT) AS num_transactions,
        {IS('quantity')} AS units_sold, {MS('actual_revenue')} AS total_sales, {MSI('has_discount', 'actual_revenue')} AS d
        FROM sales WHERE sold_by IS NOT NULL GROUP BY 1, 2)
), f2f AS (
  SELECT sold_by AS budtender,
    avg(CASE WHEN regexp_matches(upper(coalesce(order_type, '')), '{fixed.F2F_PATTERN}') THEN 1.0 ELSE 0.0 END) * 100 AS f
  FROM sales WHERE sold_by IS NOT NULL GROUP BY 1
), st AS (SELECT staff.*, coalesce(f2f.f, 0.0) AS face_to_face_pct FROM staff LEFT JOIN f2f USING (budtender)),
el AS (SELECT * FROM st),
mm AS (SELECT min(avg_cart_value) AS cmin, max(avg_cart_value) AS cmax, min(avg_units_per_cart) AS umin,
       max(avg_units_per_cart) AS umax, max(loyalty_enrollments) AS lmax, count(*) AS n FROM el),
scored AS (
  SELECT st.*, CASE WHEN mm.n > 0 THEN round_even(
      (avg_cart_value - cmin) / (cmax - cmin + 0.01) * {fixed.BT_WEIGHT_CART}
      + (avg_units_per_cart - umin) / (umax - umin + 0.01) * {fixed.BT_WEIGHT_UNITS}
      + (100 - pct_sales_discounted) / 100 * {fixed.BT_WEIGHT_DISCOUNT}
      + CASE WHEN lmax > 0 THEN loyalty_enrollments / lmax * {fixed.BT_WEIGHT_LOYALTY} ELSE 0.0 END
      + face_to_face_pct / 100 * {fixed.BT_WEIGHT_F2F}, 0) ELSE 0.0 END AS sales_score
  FROM st, mm
), tiered AS (
  SELECT * EXCLUDE (face_to_face_pct), {R('face_to_face_pct', 4)} AS face_to_face_pct,
    CASE WHEN sales_score >= {fixed.BT_TIER_TOP} THEN 'Top Performer' WHEN sales_score >= {fixed.BT_TIER_SOLID} THEN 'Solid'
         WHEN sales_score >= {fixed.BT_TIER_DEVELOPING} THEN 'Developing' ELSE 'Needs Coaching' END AS tier
  FROM scored
)
"""

P1_SQL = oracle(STAFF + "SELECT budtender, f AS face_to_face_pct FROM f2f")
P2_SQL = oracle(STAFF + "SELECT * FROM tiered")
P4_SQL = oracle(STAFF + f"""
SELECT CAST(count(*) AS BIGINT) AS total_budtenders, {R('avg(sales_score)')} AS avg_sales_score,
  CAST(count(CASE WHEN tier = 'Top Performer' THEN 1 END) AS BIGINT) AS top_performers,
  CAST(count(CASE WHEN tier = 'Needs Coaching' THEN 1 END) AS BIGINT) AS needs_coaching FROM tiered
""")
P5_SQL = oracle(STAFF + """
SELECT store, budtender, sales_score, tier,
  row_number() OVER (PARTITION BY store ORDER BY sales_score DESC, budtender) AS store_rank FROM tiered
""")

Q1_SQL = oracle(f"""
, g AS (SELECT
  round(coalesce(sum(CASE WHEN transaction_type = 'REWARD' THEN cost END), 0), 2)
    - round(coalesce(sum(CASE WHEN transaction_type = 'REWARD' THEN actual_revenue END), 0), 2) AS rn0,
  round(coalesce(sum(CASE WHEN transaction_type = 'MARKOUT' THEN cost END), 0), 2)
    - round(coalesce(sum(CASE WHEN transaction_type = 'MARKOUT' THEN actual_revenue END), 0), 2) AS mn0,
  greatest(datediff('day', min(sale_date), max(sale_date)) + 1, 1) AS days,
  CAST(count(CASE WHEN transaction_type = 'REWARD' THEN 1 END) AS BIGINT) AS reward_redemptions,
  CAST(count(DISTINCT CASE WHEN transaction_type = 'REWARD' THEN customer_id END) AS BIGINT) AS unique_reward_customers,
  CAST(count(CASE WHEN transaction_type = 'MARKOUT' THEN 1 END) AS BIGINT) AS markout_transactions,
  CAST(count(DISTINCT CASE WHEN transaction_type = 'MARKOUT' THEN customer_name END) AS BIGINT) AS employees_using_markouts
  FROM sales), h AS (SELECT *, round(rn0 * 100) / 100 AS rn, round(mn0 * 100) / 100 AS mn FROM g)
SELECT rn AS rewards_net_cost, mn AS markouts_net_cost, {R('rn + mn', 2)} AS total_net_cost,
  {R('(rn + mn) / days * 30', 2)} AS monthly_projection, reward_redemptions, unique_reward_customers,
  markout_transactions, employees_using_markouts FROM h
""")

REWARD_NAME = r"""
CASE WHEN deals_used IS NULL THEN NULL
     WHEN trim(regexp_extract(deals_used, '(?i)(REWARD\s*-\s*\d+\s*Points?\s*-\s*[^,]+)', 1)) <> ''
       THEN trim(regexp_extract(deals_used, '(?i)(REWARD\s*-\s*\d+\s*Points?\s*-\s*[^,]+)', 1))
     WHEN upper(deals_used) LIKE '%REWARD%' THEN trim(deals_used) END
"""
RAGG = f"""CAST(count(*) AS BIGINT) AS redemptions, {IS('quantity')} AS units, {MS('pre_discount_revenue')} AS retail_value,
  {MS('cost')} AS cost, {MS('actual_revenue')} AS collected"""
Q2_SQL = oracle(f"""
, rl AS (SELECT *, {REWARD_NAME} AS reward_name FROM sales WHERE transaction_type = 'REWARD'),
tot AS (SELECT round(sum(cost), 2) - round(sum(actual_revenue), 2) AS t0 FROM rl),
g AS (SELECT reward_name, {RAGG} FROM rl WHERE reward_name IS NOT NULL GROUP BY 1)
SELECT g.*, round((cost - collected) * 100) / 100 AS net_cost,
  CASE WHEN round(t0 * 100) / 100 > 0 THEN {R('(round((cost - collected) * 100) / 100) / (round(t0 * 100) / 100) * 100')}
       ELSE 0.0 END AS pct
FROM g, tot
""")
Q3_SQL = oracle(f"""
, rl AS (SELECT *, {REWARD_NAME} AS reward_name FROM sales WHERE transaction_type = 'REWARD')
SELECT store_clean AS store, reward_name, {RAGG}, round((round(sum(cost), 2) - round(sum(actual_revenue), 2)) * 100) / 100 AS net_cost
FROM rl WHERE reward_name IS NOT NULL AND store_clean IS NOT NULL GROUP BY 1, 2
""")
Q4_SQL = oracle(f"""
, mk AS (SELECT * FROM sales WHERE transaction_type = 'MARKOUT' AND customer_name IS NOT NULL),
g AS (SELECT customer_name, CAST(count(*) AS BIGINT) AS redemptions, {IS('quantity')} AS units, {MS('cost')} AS cost,
      count(DISTINCT product) AS np FROM mk GROUP BY 1),
ps AS (SELECT customer_name, store_clean AS primary_store FROM (
       SELECT customer_name, store_clean, row_number() OVER (PARTITION BY customer_name ORDER BY count(*) DESC, store_clean) AS k
       FROM mk WHERE store_clean IS NOT NULL GROUP BY 1, 2) WHERE k = 1),
pr AS (SELECT customer_name, string_agg(product, ', ' ORDER BY product) AS p3 FROM (
       SELECT customer_name, product, row_number() OVER (PARTITION BY customer_name ORDER BY product) AS k
       FROM (SELECT DISTINCT customer_name, product FROM mk WHERE product IS NOT NULL)) WHERE k <= 3 GROUP BY 1)
SELECT g.customer_name, redemptions, units, cost, primary_store,
  coalesce(p3, '') || CASE WHEN np > 3 THEN '...' ELSE '' END AS products,
  row_number() OVER (ORDER BY cost DESC, g.customer_name) AS rank
FROM g LEFT JOIN ps USING (customer_name) LEFT JOIN pr USING (customer_name)
""")


def S(spark, sf):
    return load_sales(spark, sf)


def _scored(s, sf):
    sales = S(s, sf)
    return P.sales_scores(P.staff_table(sales), sales)


ENTRIES = {
    "P1_face_to_face_pct": (lambda s, sf: P.face_to_face_pct(S(s, sf)), P1_SQL),
    "P2_sales_score": (lambda s, sf: _scored(s, sf), P2_SQL),
    "P4_staff_summary": (lambda s, sf: P.staff_summary(_scored(s, sf)), P4_SQL),
    "P5_staff_by_store": (lambda s, sf: P.staff_by_store(_scored(s, sf)), P5_SQL),
    "Q1_rewards_summary": (lambda s, sf: P.rewards_summary(S(s, sf)), Q1_SQL),
    "Q2_rewards_by_name": (lambda s, sf: P.rewards_by_name(S(s, sf)), Q2_SQL),
    "Q3_rewards_by_store": (lambda s, sf: P.rewards_by_store(S(s, sf)), Q3_SQL),
    "Q4_markouts_by_employee": (lambda s, sf: P.markouts_by_employee(S(s, sf)), Q4_SQL),
}
