"""Catalog: cube (T1-T3) and sink sanitation (A10)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import IS, MS, R, SD
from tillpoint.plans import cube as T
from tillpoint.plans import rollup as U
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


CUBE = f"""
, c AS (
  SELECT ym, store_clean, GROUPING(ym, store_clean) AS gid, {MS('actual_revenue')} AS revenue,
    {MS('net_profit')} AS profit, {MS('cost')} AS cost, {IS('quantity')} AS units, {MS('discounts')} AS discounts,
    CAST(count(*) AS BIGINT) AS lines, CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions,
    CAST(count(DISTINCT customer_id) AS BIGINT) AS customers
  FROM regular GROUP BY GROUPING SETS ((ym, store_clean), (ym), (store_clean), ())
), cube AS (
  SELECT CASE WHEN gid & 2 = 0 THEN printf('%d-%02d', ym // 100, ym % 100) ELSE 'all' END AS period,
    CASE WHEN gid & 1 = 0 THEN store_clean ELSE 'all' END AS store,
    revenue, profit, cost, units, discounts, lines, transactions, customers,
    {R(SD('profit', 'revenue') + ' * 100')} AS margin, {R(SD('revenue', 'transactions'), 2)} AS avg_basket
  FROM c
)
"""
T1_SQL = oracle(CUBE + "SELECT * FROM cube")
T3_SQL = oracle(CUBE + "SELECT * FROM cube WHERE store = 'ASIA'")
T2_SQL = oracle(f"""
SELECT store_clean AS store, {MS('actual_revenue')} AS revenue, CAST(count(DISTINCT customer_id) AS BIGINT) AS customers
FROM regular WHERE ym BETWEEN 199801 AND 199912 GROUP BY store_clean
""")

T2_RANGES_SQL = oracle(f"""
, span AS (SELECT DISTINCT ym // 100 AS year FROM regular)
SELECT CAST(span.year AS INTEGER) AS first_year, CAST(span.year + 1 AS INTEGER) AS last_year, store_clean AS store, {MS('actual_revenue')} AS revenue,
  CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions, CAST(count(DISTINCT customer_id) AS BIGINT) AS customers
FROM span JOIN regular ON ym // 100 IN (span.year, span.year + 1) GROUP BY ALL
""")
T2_SKETCH_SQL = oracle("""
SELECT store_clean AS store, 'customers' AS kind, CAST(count(DISTINCT customer_id) AS BIGINT) AS exact, true AS within
FROM regular WHERE ym BETWEEN 199801 AND 199912 GROUP BY store_clean
UNION ALL
SELECT store_clean, 'transactions', CAST(count(DISTINCT receipt_id) AS BIGINT), true
FROM regular WHERE ym BETWEEN 199801 AND 199912 GROUP BY store_clean
""")


def _two_years(s, sf):
    """Every pair of neighbouring years, by store: ranges merged from the stored months."""
    up = U.load_rollup(s, sf)
    years = sorted({x.ym // 100 for x in up.cells.select("ym").distinct().collect()})
    parts = [U.range_by_store(up, 100 * y + 1, 100 * y + 112).select(F.lit(y).alias("first_year"), F.lit(y + 1).alias("last_year"), "*") for y in years]
    return reduce(DataFrame.union, parts)


def _sketched(s, sf):
    """The sketches' estimates against the exact counts: whether each lies within the stated error."""
    up = U.load_rollup(s, sf)
    exact = U.range_by_store(up, 199801, 199912).select("store", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("exact")) for k in U.KINDS))))
    near = F.abs(F.col("estimate") - F.col("exact")) <= F.greatest(F.col("exact") * U.SKETCH_ERROR, F.lit(1))
    return exact.join(U.range_sketched(up, 199801, 199912), ["store", "kind"]).select("store", "kind", "exact", near.alias("within"))


ENTRIES = {
    "T1_period_store_cube": (lambda s, sf: U.cube_from_rollup(U.load_rollup(s, sf)), T1_SQL),
    "T1_cube_from_facts": (lambda s, sf: T.period_store_cube(REG(s, sf)), T1_SQL),
    "T2_range_rollup": (lambda s, sf: U.range_by_store(U.load_rollup(s, sf), 199801, 199912).drop("transactions"), T2_SQL),
    "T2_ranges_of_two_years": (_two_years, T2_RANGES_SQL),
    "T2_range_sketch": (_sketched, T2_SKETCH_SQL),
    "T3_store_drilldown": (lambda s, sf: U.store_cube(U.load_rollup(s, sf), "ASIA"), T3_SQL),
    "A10_sanitize_output": (lambda s, sf: T.sanitize(T.period_store_cube(REG(s, sf))), T1_SQL),
}
