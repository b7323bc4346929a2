"""Catalog: brand reports (R1-R8, R14), on the whole fact table."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import IS, MS, R, SD, SDN
from tillpoint.operators import brands as B
from tillpoint.plans.curate import load_sales, regular


def REGG(spark, sf):
    return regular(load_sales(spark, sf))


def G(q: str) -> str:
    return oracle(q)


BR = ", b AS (SELECT *, brand_clean AS brand FROM regular WHERE brand_clean IS NOT NULL)\n"
STORES = ", allst AS (SELECT list_sort(list(DISTINCT store_clean)) AS stores FROM regular WHERE store_clean IS NOT NULL)\n"

R1_SQL = G(BR + f"""
, g AS (SELECT brand, product, {IS('quantity')} AS units, {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost
        FROM b WHERE product IS NOT NULL GROUP BY 1, 2)
SELECT * FROM (SELECT *, {R(SD('revenue - cost', 'revenue') + ' * 100')} AS margin,
  row_number() OVER (PARTITION BY brand ORDER BY revenue DESC, product) AS rank FROM g) WHERE rank <= 25
""")
R2_SQL = G(BR + f"""
, g AS (SELECT brand, store_clean AS store, product, {IS('quantity')} AS units, {MS('actual_revenue')} AS revenue
        FROM b WHERE product IS NOT NULL AND store_clean IS NOT NULL GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY brand, store ORDER BY revenue DESC, product) AS rank FROM g)
WHERE rank <= 15
""")
R3_SQL = G(BR + f"""
, g AS (SELECT brand, store_clean AS store, {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost,
        {IS('quantity')} AS units, {MS('discounts')} AS discounts FROM b WHERE store_clean IS NOT NULL GROUP BY 1, 2)
SELECT *, {R(SD('revenue - cost', 'revenue') + ' * 100')} AS margin,
  {R(SD('discounts', 'revenue + discounts') + ' * 100')} AS discount_rate FROM g
""")
R4_SQL = G(BR + STORES + f"""
, grid AS (SELECT brand, unnest(stores) AS store FROM (SELECT DISTINCT brand FROM b), allst),
bs AS (SELECT brand, store_clean AS store, CAST(count(DISTINCT product) AS BIGINT) AS sku_count,
       {MS('actual_revenue')} AS revenue, {IS('quantity')} AS units FROM b WHERE store_clean IS NOT NULL GROUP BY 1, 2),
st AS (SELECT store_clean AS store, {MS('actual_revenue')} AS store_total_revenue FROM regular
       WHERE store_clean IS NOT NULL GROUP BY 1)
SELECT grid.brand, grid.store, bs.revenue IS NOT NULL AS carries_brand, coalesce(bs.sku_count, 0) AS sku_count,
  coalesce(bs.revenue, 0.0) AS revenue, coalesce(bs.units, 0) AS units, st.store_total_revenue,
  CASE WHEN bs.revenue IS NOT NULL THEN {R(SD('bs.revenue', 'st.store_total_revenue') + ' * 100')} ELSE 0.0 END AS brand_share_pct
FROM grid LEFT JOIN bs USING (brand, store) LEFT JOIN st USING (store)
""")
R5_SQL = G(BR + STORES + f"""
, bc AS (SELECT DISTINCT brand, category_clean AS category FROM b WHERE category_clean IS NOT NULL),
bs AS (SELECT DISTINCT brand, store_clean AS store FROM b WHERE category_clean IS NOT NULL AND store_clean IS NOT NULL),
bsc AS (SELECT DISTINCT brand, store_clean AS store, category_clean AS category FROM b
        WHERE category_clean IS NOT NULL AND store_clean IS NOT NULL),
dm AS (SELECT store_clean AS store, category_clean AS category, {MS('actual_revenue')} AS category_revenue_at_store
       FROM regular WHERE store_clean IS NOT NULL AND category_clean IS NOT NULL GROUP BY 1, 2),
grid AS (SELECT bc.brand, bc.category, unnest(allst.stores) AS store FROM bc, allst),
cand AS (SELECT g.*, EXISTS (SELECT 1 FROM bs WHERE bs.brand = g.brand AND bs.store = g.store) AS present FROM grid g
         WHERE NOT EXISTS (SELECT 1 FROM bsc WHERE bsc.brand = g.brand AND bsc.store = g.store AND bsc.category = g.category))
SELECT brand, store, category, category_revenue_at_store,
  CASE WHEN present THEN 'Category not carried at this store' ELSE 'Brand not carried' END AS opportunity
FROM cand JOIN dm USING (store, category)
WHERE (NOT present AND category_revenue_at_store > 0) OR (present AND category_revenue_at_store > 0)
""")
R5_PRODUCT_SQL = f"SELECT * RENAME (brand AS product) FROM ({R5_SQL.replace('brand_clean AS brand FROM regular WHERE brand_clean IS NOT NULL', 'product AS brand FROM regular WHERE product IS NOT NULL')})"
R6_SQL = G(BR + STORES + """
, g AS (SELECT brand, list_sort(list(DISTINCT store_clean)) AS stores_present FROM b WHERE store_clean IS NOT NULL GROUP BY 1)
SELECT brand, stores_present, list_filter(allst.stores, lambda s: NOT list_contains(stores_present, s)) AS stores_missing,
  CAST(len(stores_present) AS INTEGER) AS n_present, CAST(len(allst.stores) AS INTEGER) AS n_stores FROM g, allst
""")
PAGG = BR + f"""
, pa AS (SELECT brand, product, {IS('quantity')} AS units, {MS('actual_revenue')} AS revenue, {MS('cost')} AS cost,
         {MS('net_profit')} AS profit, CAST(count(DISTINCT store_clean) AS BIGINT) AS stores,
         CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions FROM b WHERE product IS NOT NULL GROUP BY 1, 2),
pa2 AS (SELECT *, coalesce({R(SDN('revenue - cost', 'revenue') + ' * 100')}, 0.0) AS margin,
        row_number() OVER (PARTITION BY brand ORDER BY revenue DESC, product) AS rank,
        count(*) OVER (PARTITION BY brand) AS n FROM pa)
"""
R7_SQL = G(PAGG + """
SELECT * EXCLUDE (n), 'top' AS section FROM pa2 WHERE rank <= 20
UNION ALL SELECT * EXCLUDE (n), 'bottom' FROM pa2 WHERE n > 20 AND rank > n - 10
""")
R8_SQL = G(PAGG + """
, bst AS (SELECT brand, list_sort(list(DISTINCT store_clean)) AS bs FROM b WHERE store_clean IS NOT NULL GROUP BY 1),
pst AS (SELECT brand, product, list_sort(list(DISTINCT store_clean)) AS ps FROM b
        WHERE store_clean IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2),
x AS (SELECT pa.*, bst.bs, pst.ps, row_number() OVER (PARTITION BY pa.brand ORDER BY revenue DESC, pa.product) AS rank
      FROM pa JOIN bst USING (brand) JOIN pst USING (brand, product) WHERE stores >= 2 AND stores < len(bst.bs))
SELECT brand, rank, product, stores AS current_stores, CAST(len(bs) AS INTEGER) AS total_stores,
  list_filter(bs, lambda s: NOT list_contains(ps, s)) AS missing_stores, revenue FROM x WHERE rank <= 10
""")
R14_SQL = G(BR + "SELECT brand, CAST(count(*) AS BIGINT) AS lines FROM b GROUP BY brand HAVING count(*) >= 5")

ENTRIES = {
    "R1_top_products": (lambda s, sf: B.top_products(REGG(s, sf)), R1_SQL),
    "R2_products_by_store": (lambda s, sf: B.products_by_store(REGG(s, sf)), R2_SQL),
    "R3_brand_store_summary": (lambda s, sf: B.brand_store_summary(REGG(s, sf)), R3_SQL),
    "R4_distribution_scorecard": (lambda s, sf: B.distribution_scorecard(REGG(s, sf)), R4_SQL),
    "R5_store_gaps": (lambda s, sf: B.store_gaps(REGG(s, sf)), R5_SQL),
    "R5_product_gaps": (lambda s, sf: B.store_gaps(REGG(s, sf), of="product").withColumnRenamed("brand", "product"), R5_PRODUCT_SQL),
    "R6_store_coverage": (lambda s, sf: B.store_coverage(REGG(s, sf)), R6_SQL),
    "R7_product_mix": (lambda s, sf: B.product_mix(REGG(s, sf)), R7_SQL),
    "R8_sku_expansion": (lambda s, sf: B.sku_expansion(REGG(s, sf)), R8_SQL),
    "R14_min_rows_guard": (lambda s, sf: B.min_rows_guard(REGG(s, sf)), R14_SQL),
}
