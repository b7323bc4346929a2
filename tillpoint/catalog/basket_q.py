"""Catalog: basket (K1-K6) and product intelligence (L1-L4)."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import IS, MS, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import basket as K
from tillpoint.operators import products as L
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


BASKET = f"""
, basket AS (SELECT receipt_id, round(sum(actual_revenue), 2) AS revenue, {IS('quantity')} AS items,
             CAST(count(DISTINCT product) AS BIGINT) AS n_products, min(ym) AS ym FROM regular GROUP BY 1)
"""
K1_SQL = oracle(BASKET + "SELECT * FROM basket")
MONTHLY = BASKET + f"""
, bm AS (SELECT CAST(ym // 100 AS INTEGER) AS year, CAST(ym % 100 AS INTEGER) AS month,
         printf('%d-%02d', ym // 100, ym % 100) AS label, {R('round(sum(revenue), 2) / count(*)', 2)} AS avg_basket,
         {R('sum(items) / count(*)', 2)} AS avg_items, CAST(count(*) AS BIGINT) AS transactions FROM basket GROUP BY ym)
"""
K2_SQL = oracle(MONTHLY + "SELECT * FROM bm")
K3_SQL = oracle(MONTHLY + f"""
, k AS (SELECT *, row_number() OVER (ORDER BY year DESC, month DESC) AS k FROM bm),
tr AS (SELECT avg(CASE WHEN k <= 3 THEN avg_basket END) AS rec, avg(CASE WHEN k > 3 AND k <= 6 THEN avg_basket END) AS pri,
       count(*) AS n FROM k),
t AS (SELECT CASE WHEN n >= 6 AND pri > 0 AND (rec - pri) / pri * 100 > 5 THEN 'growing'
                  WHEN n >= 6 AND pri > 0 AND (rec - pri) / pri * 100 < -5 THEN 'shrinking' ELSE 'stable' END AS t FROM tr)
SELECT {R('round(sum(revenue), 2) / count(*)', 2)} AS avg_basket_value, {R('sum(items) / count(*)', 2)} AS avg_items_per_basket,
  max(t.t) AS basket_trend, {R(SD('count(CASE WHEN n_products >= 2 THEN 1 END)', 'count(*)') + ' * 100', 2)} AS multi_item_basket_pct,
  CAST(count(*) AS BIGINT) AS total_baskets
FROM basket, t
""")

K4_SQL = oracle(f"""
, rp AS (SELECT receipt_id, product, row_number() OVER (PARTITION BY receipt_id ORDER BY product) AS k
         FROM (SELECT DISTINCT receipt_id, product FROM regular WHERE product IS NOT NULL)),
nm AS (SELECT count(*) AS n FROM rp WHERE k = 2),
g AS (SELECT a.product AS product_a, b.product AS product_b, count(*) AS c FROM rp a JOIN rp b
      ON a.receipt_id = b.receipt_id AND a.product < b.product GROUP BY 1, 2),
t AS (SELECT *, row_number() OVER (ORDER BY c DESC, product_a, product_b) AS rank FROM g)
SELECT rank, product_a, product_b, CAST(c AS BIGINT) AS co_purchase_count,
  {R(SD('c', 'nm.n') + ' * 100', 2)} AS pct_of_multi_baskets FROM t, nm WHERE rank <= 20
""")

K5_SQL = oracle(f"""
, rc AS (SELECT DISTINCT receipt_id, category_clean AS category FROM regular WHERE category_clean IS NOT NULL),
q AS (SELECT category, count(*) AS baskets FROM rc GROUP BY 1),
rq AS (SELECT * FROM rc WHERE category IN (SELECT category FROM q)),
g AS (SELECT a.category AS category_a, b.category AS category_b, count(*) AS c FROM rq a JOIN rq b
      ON a.receipt_id = b.receipt_id AND a.category < b.category GROUP BY 1, 2)
SELECT category_a, category_b, CAST(c AS BIGINT) AS co_purchase_count,
  {R(SD('c', 'q.baskets') + ' * 100', 2)} AS co_purchase_rate FROM g JOIN q ON q.category = g.category_a
""")

PSTATS = f"""
, ps AS (SELECT product, {MS('net_profit')} AS profit, {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost,
         {IS('quantity')} AS units, min(brand_clean) AS brand, min(category_clean) AS category
         FROM regular WHERE product IS NOT NULL GROUP BY 1)
"""
ABC = PSTATS + f"""
, pc AS (SELECT *, greatest(CAST(round(profit * 100) AS BIGINT), 0) AS pos FROM ps),
tot AS (SELECT sum(pos) AS t FROM pc),
run AS (SELECT *, row_number() OVER (ORDER BY profit DESC, product) AS position,
        sum(pos) OVER (ORDER BY profit DESC, product ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS rc FROM pc),
abc AS (
  SELECT run.*, CASE WHEN tot.t > 0 THEN rc / tot.t * 100 ELSE 0.0 END AS cum,
    CASE WHEN tot.t <= 0 OR profit <= 0 THEN 'D'
         WHEN (CASE WHEN tot.t > 0 THEN rc / tot.t * 100 ELSE 0.0 END) <= {fixed.ABC_A_PCT} THEN 'A'
         WHEN (CASE WHEN tot.t > 0 THEN rc / tot.t * 100 ELSE 0.0 END) <= {fixed.ABC_B_PCT} THEN 'B'
         WHEN (CASE WHEN tot.t > 0 THEN rc / tot.t * 100 ELSE 0.0 END) <= {fixed.ABC_C_PCT} THEN 'C' ELSE 'D' END AS abc_class
  FROM run, tot
)
"""
L1_SQL = oracle(ABC + f"""
SELECT CAST(position AS BIGINT) AS position, product, brand, category, revenue, profit,
  {R(SD('profit', 'revenue') + ' * 100')} AS margin, units, abc_class, {R('cum')} AS cumulative_pct FROM abc
""")

DEAD = f"""
, mx AS (SELECT max(sale_date) AS m FROM regular),
dg AS (SELECT product, max(sale_date) AS last, {MS('actual_revenue')} AS total_revenue, min(brand_clean) AS brand,
       min(category_clean) AS category,
       count(DISTINCT CASE WHEN sale_date >= mx.m - INTERVAL {fixed.DEAD_STOCK_DAYS} DAY THEN store_clean END) AS sa,
       count(DISTINCT store_clean) AS st
       FROM regular, mx WHERE product IS NOT NULL GROUP BY product),
dead AS (SELECT *, row_number() OVER (ORDER BY total_revenue DESC, product) AS rank FROM dg, mx
         WHERE last < mx.m - INTERVAL {fixed.DEAD_STOCK_DAYS} DAY)
"""
L2_SQL = oracle(DEAD + """
SELECT rank, product, brand, category, CAST(CAST(last AS DATE) AS VARCHAR) AS last_sale_date,
  CAST(datediff('day', last, m) AS INTEGER) AS days_since_sale, round(total_revenue, 2) AS total_revenue,
  CAST(sa AS BIGINT) AS stores_active, CAST(st - sa AS BIGINT) AS stores_inactive
FROM dead WHERE rank <= 50
""")

L2_STORE_SQL = oracle(DEAD.replace("SELECT product, max", "SELECT product, store_clean, max").replace("product IS NOT NULL GROUP BY product", "product IS NOT NULL AND store_clean IS NOT NULL GROUP BY product, store_clean")
                     .replace("DESC, product)", "DESC, product, store_clean)") + """
SELECT rank, product, store_clean AS store, brand, category, CAST(CAST(last AS DATE) AS VARCHAR) AS last_sale_date,
  CAST(datediff('day', last, m) AS INTEGER) AS days_since_sale, round(total_revenue, 2) AS total_revenue,
  CAST(sa AS BIGINT) AS stores_active, CAST(st - sa AS BIGINT) AS stores_inactive
FROM dead
""")

d = fixed.VELOCITY_WINDOW_DAYS
VEL = f"""
, mx2 AS (SELECT max(sale_date) AS m FROM regular),
vg AS (SELECT product, sum(CASE WHEN sale_date >= m - INTERVAL {d} DAY THEN quantity END) AS ru,
       sum(CASE WHEN sale_date >= m - INTERVAL {2 * d} DAY AND sale_date < m - INTERVAL {d} DAY THEN quantity END) AS pu,
       min(CASE WHEN sale_date >= m - INTERVAL {d} DAY THEN brand_clean END) AS brand,
       min(CASE WHEN sale_date >= m - INTERVAL {d} DAY THEN category_clean END) AS category
       FROM regular, mx2 WHERE product IS NOT NULL AND sale_date >= m - INTERVAL {2 * d} DAY GROUP BY product),
v AS (SELECT product, brand, category, ru / {float(d)} AS rv, pu / {float(d)} AS pv,
      (ru / {float(d)} - pu / {float(d)}) / (pu / {float(d)}) * 100 AS chg
      FROM vg WHERE ru IS NOT NULL AND pu IS NOT NULL AND pu / {float(d)} > 0),
vt AS (
  SELECT 'accelerating' AS direction, row_number() OVER (ORDER BY chg DESC, product) AS rank, * FROM v WHERE chg > 0
  UNION ALL
  SELECT 'decelerating', row_number() OVER (ORDER BY chg, product), * FROM v WHERE chg < 0
)
"""
L3_SQL = oracle(VEL + f"""
SELECT direction, rank, product, brand, category, {R('rv', 3)} AS recent_velocity, {R('pv', 3)} AS prior_velocity,
  {R('chg')} AS change_pct FROM vt WHERE rank <= 20
""")
L4_SQL = oracle(ABC + DEAD + VEL + f"""
SELECT CAST(count(*) AS BIGINT) AS total_products,
  CAST(count(CASE WHEN abc_class = 'A' THEN 1 END) AS BIGINT) AS a_count,
  CAST(count(CASE WHEN abc_class = 'B' THEN 1 END) AS BIGINT) AS b_count,
  CAST(count(CASE WHEN abc_class = 'C' THEN 1 END) AS BIGINT) AS c_count,
  CAST(count(CASE WHEN abc_class = 'D' THEN 1 END) AS BIGINT) AS d_count,
  {R(SD("coalesce(sum(CASE WHEN abc_class = 'A' THEN revenue END), 0)", 'sum(revenue)') + ' * 100')} AS a_revenue_pct,
  (SELECT CAST(count(*) AS BIGINT) FROM dead) AS dead_stock_count,
  (SELECT coalesce(round(sum(round(total_revenue, 2)), 2), 0.0) FROM dead) AS dead_stock_revenue,
  (SELECT CAST(count(*) AS BIGINT) FROM vt WHERE direction = 'accelerating') AS accelerating_count,
  (SELECT CAST(count(*) AS BIGINT) FROM vt WHERE direction = 'decelerating') AS decelerating_count
FROM abc
""")

K6_SQL = K1_SQL.replace("FROM regular", "FROM regular WHERE CAST('0x' || substr(md5(coalesce(receipt_id, '') || ':42'), 1, 8) AS BIGINT) < 1073741824")

ENTRIES = {
    "K1_basket_agg": (lambda s, sf: K.basket_agg(REG(s, sf)), K1_SQL),
    "K2_basket_monthly": (lambda s, sf: K.basket_monthly(REG(s, sf)), K2_SQL),
    "K3_basket_kpis": (lambda s, sf: K.basket_kpis(REG(s, sf)), K3_SQL),
    "K4_product_pairs": (lambda s, sf: K.product_pairs(REG(s, sf)), K4_SQL),
    "K5_category_pairs": (lambda s, sf: K.category_pairs(REG(s, sf)), K5_SQL),
    "K6_receipt_sample": (lambda s, sf: K.basket_agg(K.receipt_sample(REG(s, sf), 0.25)), K6_SQL),
    "L1_abc_classification": (lambda s, sf: L.abc_classification(REG(s, sf)), L1_SQL),
    "L2_dead_stock": (lambda s, sf: L.dead_stock(REG(s, sf)), L2_SQL),
    "L2_dead_stock_by_store": (lambda s, sf: L.dead_stock(REG(s, sf), top_n=None, grain="product_store"), L2_STORE_SQL),
    "L3_velocity_trends": (lambda s, sf: L.velocity_trends(REG(s, sf)), L3_SQL),
    "L4_product_kpis": (lambda s, sf: L.product_kpis(REG(s, sf)), L4_SQL),
}
