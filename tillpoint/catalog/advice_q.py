"""Catalog: brand advice (R9-R13), on the whole fact table; R10 compares two years."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.margin_q import F4_SQL, F6_SQL
from tillpoint.catalog.brands_q import H2_SQL
from tillpoint.catalog.reports_q import BR, REGG
from tillpoint.catalog.sqlh import IS, MS, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import advice as A
from tillpoint.plans.period import Period, comparison_period

YEAR, BEFORE = 2001, 2000


def text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def printf(form: str, *args: str) -> str:
    return f"printf({', '.join([text(form), *args])})" if args else text(form)


def whole(x: str) -> str:
    return f"format('{{:,}}', CAST({R(x, 0)} AS BIGINT))"


def advice(source: str, when: str, texts: tuple, title: tuple = (), detail: tuple = (), action: tuple = ()) -> str:
    severity, *forms = texts
    filled = ", ".join(f"{printf(f, *a)} AS {k}" for f, a, k in zip(forms, (title, detail, action), ("title", "detail", "action")))
    return f"SELECT brand, '{severity}' AS severity, {filled} FROM {source} WHERE {when}"


R9_SQL = oracle(BR + f"""
, st AS (SELECT brand, product, store_clean, {IS('quantity')} AS units, {MS('actual_revenue')} AS revenue FROM b
         WHERE product IS NOT NULL AND store_clean IS NOT NULL GROUP BY 1, 2, 3),
pr AS (SELECT *, CASE WHEN units > 0 THEN revenue / units ELSE 0.0 END AS price FROM st),
g AS (SELECT brand, product, min(price) AS lo, max(price) AS hi, avg(price) AS mean, stddev_samp(price) AS spread,
      CAST(count(*) AS BIGINT) AS store_count FROM pr GROUP BY 1, 2 HAVING count(*) >= 2),
x AS (SELECT *, {R(SD('hi - lo', 'mean') + ' * 100')} AS range_pct FROM g)
SELECT brand, product, {R('lo', 4)} AS min_price, {R('hi', 4)} AS max_price, {R('mean', 4)} AS avg_price, {R('spread', 4)} AS std_dev,
  store_count, {R('hi - lo', 4)} AS price_range, range_pct FROM x
QUALIFY row_number() OVER (PARTITION BY brand ORDER BY range_pct DESC, product) <= {fixed.PRICING_PRODUCTS}
""")


def _year(y: int) -> str:
    return f"""SELECT brand, {MS('actual_revenue')} AS revenue, {IS('quantity')} AS units, {MS('cost')} AS cost, {MS('net_profit')} AS profit,
      round(coalesce(sum(CASE WHEN NOT has_discount THEN actual_revenue END), 0), 2) AS fp FROM b WHERE ym // 100 = {y} GROUP BY 1"""


_METRICS = {"Revenue": "revenue", "Units": "units", "Margin %": R(SD("{0}.revenue - {0}.cost", "{0}.revenue") + " * 100"),
            "Full Price %": R(SD("{0}.fp", "{0}.revenue") + " * 100"), "Profit": "profit"}


def _metric(name: str) -> str:
    now, then = (_METRICS[name].format(t) if "{" in _METRICS[name] else f"{t}.{_METRICS[name]}" for t in ("c", "p"))
    return (f"SELECT c.brand, '{name}' AS metric, CAST({now} AS DOUBLE) AS current, CAST({then} AS DOUBLE) AS previous, "
            f"{R(f'CAST({now} AS DOUBLE) - CAST({then} AS DOUBLE)', 2)} AS change FROM cy c JOIN py p ON c.brand = p.brand")


R10_SQL = oracle(BR + f", cy AS ({_year(YEAR)}), py AS ({_year(BEFORE)})\n" + "\nUNION ALL ".join(map(_metric, _METRICS)))

STANDING = f"""
WITH f4 AS ({F4_SQL}), f6 AS ({F6_SQL}),
s AS (SELECT f4.*, f6.category AS primary_category, f6.category_avg_margin AS cat_margin, f6.rank,
      {R('f4.overall_margin - f6.category_avg_margin')} AS gap FROM f4 JOIN f6 ON f4.brand = f6.brand WHERE f6.is_primary)
"""
R11_SQL = STANDING + "\nUNION ALL ".join([
    advice("f6", f"vs_category < {fixed.REC_BELOW_CATEGORY_PTS}", fixed.ADVICE_BELOW_CATEGORY, ("category",),
           ("margin", R("-vs_category", 0), "category", "rank", "total_brands"), (R("-vs_category / 2", 0), "category")),
    advice("s", f"gap < {fixed.REC_MARGIN_VS_CAT_GAP_PTS}", fixed.ADVICE_BENCHMARK_GAP, detail=("overall_margin", "primary_category", "cat_margin", "-gap")),
    advice("s", f"pct_full_price < {fixed.REC_PROMO_DEPENDENCY_PCT}", fixed.ADVICE_PROMOTION, detail=(R("pct_full_price", 0),)),
    advice("s", f"disc_margin < {fixed.REC_LOW_DISC_MARGIN_PCT} AND disc_revenue > 0", fixed.ADVICE_DISCOUNTED, detail=("disc_margin",)),
    advice("s", f"gap >= {fixed.REC_STRONG_PTS} AND rank <= {fixed.REC_STRONG_RANK}", fixed.ADVICE_STRONG, detail=("rank", "primary_category", "gap")),
    advice("s", f"total_revenue > {fixed.REC_VOLUME_LEVERAGE_REVENUE}", fixed.ADVICE_VOLUME, detail=(whole("total_revenue"),))])

R12_SQL = oracle(BR + f"""
, wanted AS (
  SELECT bc.brand, r.store_clean AS store, {MS('r.actual_revenue')} AS revenue,
    array_to_string(list_sort(list(DISTINCT r.category_clean)), ', ') AS categories
  FROM regular r JOIN (SELECT DISTINCT brand, category_clean FROM b WHERE category_clean IS NOT NULL) bc ON r.category_clean = bc.category_clean
  WHERE r.store_clean IS NOT NULL AND NOT EXISTS (SELECT 1 FROM b WHERE b.brand = bc.brand AND b.store_clean = r.store_clean)
  GROUP BY 1, 2),
own AS (SELECT brand, list_sort(list(DISTINCT store_clean)) AS own FROM b WHERE store_clean IS NOT NULL GROUP BY 1),
sku AS (SELECT brand, product, list(DISTINCT store_clean) AS found_in FROM b WHERE store_clean IS NOT NULL AND product IS NOT NULL GROUP BY 1, 2),
lack AS (SELECT brand, product, len(found_in) AS n, list_filter(own, lambda x: NOT list_contains(found_in, x)) AS lacking
         FROM sku JOIN own USING (brand) WHERE len(found_in) >= 2 AND len(found_in) < len(own)
         QUALIFY row_number() OVER (PARTITION BY brand ORDER BY product) <= {fixed.REC_SKU_PRODUCTS}),
h2 AS ({H2_SQL})
SELECT brand, 'distribution' AS type, {printf(fixed.GROWTH_STORE[0], 'store')} AS title,
  {printf(fixed.GROWTH_STORE[1], whole('revenue'), 'categories', 'brand')} AS detail,
  CASE WHEN revenue > {fixed.REC_HIGH_PRIORITY_CATEGORY_REVENUE} THEN 'high' ELSE 'medium' END AS priority FROM wanted
UNION ALL SELECT brand, 'sku_expansion', {printf(fixed.GROWTH_SKU[0], 'product', 'len(lacking)')},
  {printf(fixed.GROWTH_SKU[1], 'n', "array_to_string(lacking, ', ')")}, 'medium' FROM lack
UNION ALL SELECT brand, 'velocity', {printf(fixed.GROWTH_VELOCITY[0], 'category')},
  {printf(fixed.GROWTH_VELOCITY[1], R('velocity_index', 0), R('brand_units_per_day'), R('category_avg_units_per_day'))}, 'medium'
  FROM h2 WHERE velocity_index < {fixed.REC_VELOCITY_INDEX}
""")

R13_SQL = STANDING + f"""
SELECT brand, CASE
  WHEN gap < {fixed.REC_BELOW_CATEGORY_PTS} THEN {printf(fixed.INSIGHT_FAR_BELOW, 'brand', 'overall_margin', R('-gap', 0), 'primary_category', 'cat_margin')}
  WHEN gap < 0 THEN {printf(fixed.INSIGHT_BELOW, 'brand', 'overall_margin', 'primary_category', 'cat_margin')}
  WHEN pct_full_price < {fixed.INSIGHT_FULL_PRICE_PCT} THEN {printf(fixed.INSIGHT_DISCOUNTS, R('pct_full_price', 0))}
  ELSE {printf(fixed.INSIGHT_WELL, 'brand', 'rank', 'primary_category', 'overall_margin', 'cat_margin')} END AS insight FROM s
"""

ENTRIES = {
    "R9_pricing_consistency": (lambda s, sf: A.pricing_consistency(REGG(s, sf)), R9_SQL),
    "R10_comparison": (lambda s, sf: A.comparison(REGG(s, sf), Period.of_year(YEAR), comparison_period("year", year=BEFORE)), R10_SQL),
    "R11_recommendations": (lambda s, sf: A.recommendations(REGG(s, sf)), R11_SQL),
    "R12_growth_opportunities": (lambda s, sf: A.growth_opportunities(REGG(s, sf)), R12_SQL),
    "R13_key_insight": (lambda s, sf: A.key_insight(REGG(s, sf)), R13_SQL),
}
