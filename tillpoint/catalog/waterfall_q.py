"""Catalog: margin waterfall."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import R, SD
from tillpoint.operators import waterfall as O
from tillpoint.plans.curate import load_sales, regular
from tillpoint.plans.period import Period

PERIOD = Period.of_month(2001, 6)


def REG(spark, sf):
    return regular(load_sales(spark, sf))


def _sides(default: bool) -> str:
    if default:
        return """
, mx AS (SELECT max(sale_date) AS m FROM regular),
x AS (SELECT r.*, CASE WHEN sale_date >= m - INTERVAL 180 DAY AND sale_date <= m THEN 'current'
                       WHEN sale_date >= m - INTERVAL 362 DAY AND sale_date <= m - INTERVAL 181 DAY THEN 'prior' END AS side
      FROM regular r, mx)
"""
    return """
, x AS (SELECT *, CASE WHEN year = 2001 AND month = 6 THEN 'current' WHEN year = 2001 AND month = 5 THEN 'prior' END AS side
        FROM regular)
"""


def _detail(default: bool) -> str:
    return _sides(default) + f"""
, x2 AS (SELECT * FROM x WHERE side IS NOT NULL),
tot AS (SELECT side, sum(CAST(round(actual_revenue * 100) AS BIGINT)) AS tc FROM x2 GROUP BY side),
g AS (SELECT side, category_clean AS category, sum(CAST(round(actual_revenue * 100) AS BIGINT)) AS rc,
      sum(CAST(round(cost * 100) AS BIGINT)) AS cc, sum(quantity) AS q, sum(CAST(round(discounts * 100) AS BIGINT)) AS dc
      FROM x2 WHERE category_clean IS NOT NULL GROUP BY 1, 2),
cs AS (SELECT g.*, CASE WHEN tc <> 0 THEN rc / tc * 100 ELSE 0.0 END AS share, {SD('rc - cc', 'rc')} * 100 AS margin,
       {SD('rc / 100', 'q')} AS rpu, {SD('cc / 100', 'q')} AS cpu FROM g JOIN tot USING (side)),
d0 AS (SELECT category,
       coalesce(max(CASE WHEN side = 'current' THEN share / 100 END), 0.0) AS cs,
       coalesce(max(CASE WHEN side = 'prior' THEN share / 100 END), 0.0) AS ps,
       coalesce(max(CASE WHEN side = 'current' THEN margin END), 0.0) AS cm,
       coalesce(max(CASE WHEN side = 'prior' THEN margin END), 0.0) AS pm,
       coalesce(max(CASE WHEN side = 'current' THEN rpu END), 0.0) AS crpu,
       coalesce(max(CASE WHEN side = 'prior' THEN rpu END), 0.0) AS prpu,
       coalesce(max(CASE WHEN side = 'current' THEN cpu END), 0.0) AS ccpu,
       coalesce(max(CASE WHEN side = 'prior' THEN cpu END), 0.0) AS pcpu
       FROM cs GROUP BY category),
d AS (SELECT *, (cs - ps) * pm AS mix, CASE WHEN crpu <> 0 THEN cs * (crpu - prpu) / crpu * cm ELSE 0.0 END AS price,
      CASE WHEN crpu <> 0 THEN cs * (pcpu - ccpu) / crpu * 100 ELSE 0.0 END AS costfx,
      cs * cm - ps * pm AS contribution FROM d0)
"""


def o4_sql(default: bool) -> str:
    return oracle(_detail(default) + f"""
SELECT category, {R('ps * 100', 2)} AS prior_share, {R('cs * 100', 2)} AS current_share, {R('pm', 2)} AS prior_margin,
  {R('cm', 2)} AS current_margin, {R('contribution', 2)} AS contribution_pts FROM d
""")


def o3_sql(default: bool) -> str:
    return oracle(_detail(default) + f"""
, t AS (SELECT sum(CASE WHEN side = 'current' THEN CAST(round(actual_revenue * 100) AS BIGINT) END) AS cr,
        sum(CASE WHEN side = 'current' THEN CAST(round(cost * 100) AS BIGINT) END) AS cc,
        sum(CASE WHEN side = 'current' THEN CAST(round(discounts * 100) AS BIGINT) END) AS cd,
        sum(CASE WHEN side = 'prior' THEN CAST(round(actual_revenue * 100) AS BIGINT) END) AS pr,
        sum(CASE WHEN side = 'prior' THEN CAST(round(cost * 100) AS BIGINT) END) AS pc,
        sum(CASE WHEN side = 'prior' THEN CAST(round(discounts * 100) AS BIGINT) END) AS pd FROM x2),
e AS (SELECT sum(mix) AS mix, sum(price) AS price, sum(costfx) AS costfx FROM d),
v AS (SELECT {SD('cr - cc', 'cr')} * 100 AS cm, {SD('pr - pc', 'pr')} * 100 AS pm,
      ({SD('cd', 'cr + cd')} * 100 - {SD('pd', 'pr + pd')} * 100) * -1 AS disc, pr FROM t),
w AS (SELECT v.*, e.* FROM v, e WHERE pr IS NOT NULL),
rows AS (
  SELECT 0 AS effect_order, 'Mix Effect' AS name, mix AS impact, * FROM w UNION ALL
  SELECT 1, 'Price Effect', price, * FROM w UNION ALL
  SELECT 2, 'Cost Effect', costfx, * FROM w UNION ALL
  SELECT 3, 'Discount Effect', disc, * FROM w)
SELECT effect_order, name, {R('impact', 2)} AS impact_pts,
  CASE WHEN impact > 0 THEN 'positive' WHEN impact < 0 THEN 'negative' ELSE 'neutral' END AS direction,
  {R('pm', 2)} AS prior_margin, {R('cm', 2)} AS current_margin, {R('cm - pm', 2)} AS total_change_pts,
  {R('(cm - pm) - (mix + price + costfx + disc)', 2)} AS residual_pts
FROM rows
""")


O1_SQL = oracle(f"""
, x AS (
  SELECT *, CASE WHEN ym = 200106 THEN 'current' ELSE 'prior' END AS side FROM regular WHERE ym IN (200105, 200106)
), t AS (SELECT side, CAST(round(sum(round(actual_revenue * 100))) AS BIGINT) AS tc FROM x GROUP BY side),
g AS (
  SELECT side, category_clean AS category, CAST(sum(round(actual_revenue * 100)) AS BIGINT) AS rc, CAST(sum(round(cost * 100)) AS BIGINT) AS cc,
    CAST(sum(quantity) AS BIGINT) AS quantity, CAST(sum(round(discounts * 100)) AS BIGINT) AS dc
  FROM x WHERE category_clean IS NOT NULL GROUP BY 1, 2
)
SELECT side, category, rc / 100 AS revenue, cc / 100 AS cost, quantity, dc / 100 AS discounts, (rc + dc) / 100 AS pre_discount_revenue,
  CASE WHEN tc <> 0 THEN rc / tc * 100 ELSE 0.0 END AS share, {SD('rc - cc', 'rc')} * 100 AS margin,
  {SD('rc / 100', 'quantity')} AS revenue_per_unit, {SD('cc / 100', 'quantity')} AS cost_per_unit, {SD('dc', 'rc + dc')} * 100 AS discount_rate
FROM g JOIN t USING (side)
""")

ENTRIES = {
    "O1_category_stats": (lambda s, sf: O.category_stats(REG(s, sf), PERIOD), O1_SQL),
    "O3_waterfall_effects": (lambda s, sf: O.waterfall_effects(REG(s, sf), PERIOD), o3_sql(False)),
    "O4_waterfall_detail": (lambda s, sf: O.waterfall_detail_view(REG(s, sf), PERIOD), o4_sql(False)),
    "O5_waterfall_default_prior": (lambda s, sf: O.waterfall_effects(REG(s, sf), None), o3_sql(True)),
    "O5_waterfall_default_detail": (lambda s, sf: O.waterfall_detail_view(REG(s, sf), None), o4_sql(True)),
}
