"""Catalog: dashboards."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import CNT, IS, ISI, MS, MSI, PCTCHG, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import dashboard as S
from tillpoint.plans.curate import load_sales, regular

YEAR_END = 2001  # partial last year of the driver data: exercises the same-months YoY rule


def REG(spark, sf):
    return regular(load_sales(spark, sf))


MONTHLY_CTE = f"""
, monthly AS (
  SELECT year * 100 + month AS ym, year, month, printf('%d-%02d', year, month) AS month_key,
    strftime(make_date(year, month, 1), '%B %Y') AS label,
    revenue, profit, cost, units, transactions, customers, discounts,
    {R(SD('profit', 'revenue') + ' * 100', 4)} AS margin,
    CASE WHEN revenue > 0 THEN {R(SD('revenue - discounts', 'revenue') + ' * 100', 4)} ELSE 0.0 END AS full_price_pct
  FROM (
    SELECT year, month, {MS('actual_revenue')} AS revenue, {MS('net_profit')} AS profit, {MS('cost')} AS cost,
      {IS('quantity')} AS units, CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions,
      CAST(count(DISTINCT customer_id) AS BIGINT) AS customers, {MS('discounts')} AS discounts
    FROM regular GROUP BY year, month
  )
)
"""

S1_SQL = oracle(MONTHLY_CTE + "SELECT * FROM monthly")

MIX_CTE = f"""
, mix0 AS (
  SELECT {MSI('NOT has_discount', 'actual_revenue')} AS full_price_revenue,
    {MSI('NOT has_discount', 'net_profit')} AS fpp, {MSI('has_discount', 'actual_revenue')} AS discounted_revenue,
    {MSI('has_discount', 'net_profit')} AS dp, {MS('actual_revenue')} AS total
  FROM regular
), mix1 AS (
  SELECT *, {SD('full_price_revenue', 'total')} * 100 AS fpct, {SD('fpp', 'full_price_revenue')} * 100 AS fpm,
    {SD('dp', 'discounted_revenue')} * 100 AS dm FROM mix0
), mix AS (
  SELECT {R('fpct')} AS full_price_pct, {R('100 - fpct')} AS discounted_pct,
    CASE WHEN fpct >= {fixed.SALES_MIX_HEALTHY_PCT} THEN 'healthy' WHEN fpct >= {fixed.SALES_MIX_WATCH_PCT} THEN 'watch'
         ELSE 'concern' END AS health,
    full_price_revenue, discounted_revenue, {R('fpm')} AS full_price_margin, {R('dm')} AS discounted_margin,
    {R('fpm - dm')} AS margin_gap_pts
  FROM mix1
)
"""
F8_SQL = oracle(MIX_CTE + "SELECT * FROM mix")

F9_SQL = oracle(f"""
SELECT transaction_type AS type, CAST(count(*) AS BIGINT) AS count, {MS('actual_revenue')} AS value,
  {IS('quantity')} AS units FROM sales WHERE transaction_type <> 'REGULAR' GROUP BY transaction_type
UNION ALL
SELECT 'TOTAL', CAST(count(*) AS BIGINT), {MS('actual_revenue')}, {IS('quantity')} FROM sales
WHERE transaction_type <> 'REGULAR'
""")

F10_SQL = oracle(f"""
, g AS (SELECT {MS('actual_revenue')} AS revenue, {MS('cost')} AS cogs, {MS('discounts')} AS total_discounts FROM regular)
SELECT revenue, cogs, round((revenue - cogs) * 100) / 100 AS gross_profit,
  {R(SD('round((revenue - cogs) * 100) / 100', 'revenue') + ' * 100')} AS gross_margin_pct,
  total_discounts, round((revenue - total_discounts) * 100) / 100 AS net_after_discounts
FROM g
""")

F11_SQL = oracle("""
SELECT false AS configured, CAST(greatest(count(DISTINCT (year, month)), 1) AS BIGINT) AS months,
  CAST(NULL AS DOUBLE) AS gross_profit, CAST(NULL AS DOUBLE) AS total_opex, CAST(NULL AS DOUBLE) AS ebit,
  CAST(NULL AS DOUBLE) AS depreciation, CAST(NULL AS DOUBLE) AS ebitda, CAST(NULL AS DOUBLE) AS ebitda_margin_pct
FROM regular
""")

S2_SQL = oracle(f"""
, g AS (
  SELECT {MS('actual_revenue')} AS total_revenue, {MS('net_profit')} AS net_profit, {IS('quantity')} AS total_units,
    CAST(count(DISTINCT receipt_id) AS BIGINT) AS total_transactions, {MS('discounts')} AS total_discounts,
    CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers,
    greatest(count(DISTINCT (year, month)), 1) AS n
  FROM regular
)
SELECT total_revenue, net_profit, {R(SD('net_profit', 'total_revenue') + ' * 100')} AS blended_margin,
  total_units, total_transactions, total_discounts,
  {R(SD('total_revenue - total_discounts', 'total_revenue') + ' * 100')} AS full_price_pct,
  {R(SD('total_revenue', 'total_transactions'), 2)} AS avg_basket, unique_customers,
  (SELECT CAST(count(DISTINCT store_clean) AS BIGINT) FROM sales) AS stores,
  (SELECT CAST(count(DISTINCT brand_clean) AS BIGINT) FROM regular) AS brands,
  {R('total_revenue / n', 0)} AS avg_monthly_revenue, {R('net_profit / n', 0)} AS avg_monthly_profit
FROM g
""")

S3_SQL = oracle(MONTHLY_CTE + """
SELECT
  (SELECT label FROM monthly ORDER BY revenue DESC, ym LIMIT 1) AS best_month,
  (SELECT revenue FROM monthly ORDER BY revenue DESC, ym LIMIT 1) AS best_revenue,
  (SELECT label FROM monthly ORDER BY revenue, ym LIMIT 1) AS worst_month,
  (SELECT revenue FROM monthly ORDER BY revenue, ym LIMIT 1) AS worst_revenue,
  (SELECT label FROM monthly ORDER BY profit DESC, ym LIMIT 1) AS best_profit_month,
  (SELECT profit FROM monthly ORDER BY profit DESC, ym LIMIT 1) AS best_profit,
  (SELECT label FROM monthly ORDER BY margin DESC, ym LIMIT 1) AS best_margin_month,
  (SELECT margin FROM monthly ORDER BY margin DESC, ym LIMIT 1) AS best_margin,
  (SELECT label FROM monthly ORDER BY profit, ym LIMIT 1) AS worst_profit_month,
  (SELECT profit FROM monthly ORDER BY profit, ym LIMIT 1) AS worst_profit
""")

S4_SQL = oracle(f"""
, g AS (SELECT category_clean AS name, {MS('actual_revenue')} AS revenue, {MS('net_profit')} AS p
        FROM regular WHERE category_clean IS NOT NULL GROUP BY 1),
t AS (SELECT {MS('actual_revenue')} AS total FROM regular),
x AS (SELECT *, row_number() OVER (ORDER BY revenue DESC, name) AS position FROM g)
SELECT position, name, revenue, {R(SD('p', 'revenue') + ' * 100')} AS margin,
  {R(SD('revenue', 'total') + ' * 100')} AS pct_of_total
FROM x, t WHERE position <= 8
""")

STORES_CTE = f"""
, st AS (
  SELECT name, revenue, {R(SD('p', 'revenue') + ' * 100')} AS margin, units,
    row_number() OVER (ORDER BY revenue DESC, name) AS position
  FROM (SELECT store_clean AS name, {MS('actual_revenue')} AS revenue, {MS('net_profit')} AS p, {IS('quantity')} AS units
        FROM regular WHERE store_clean IS NOT NULL GROUP BY 1)
)
"""
S5_SQL = oracle(STORES_CTE + "SELECT * FROM st")

S6_SQL = oracle(MONTHLY_CTE + MIX_CTE + STORES_CTE + f"""
, k AS (SELECT {R(SD(MS('net_profit'), MS('actual_revenue')) + ' * 100')} AS margin FROM regular),
l2 AS (SELECT *, row_number() OVER (ORDER BY ym DESC) AS k FROM monthly),
pair AS (
  SELECT max(CASE WHEN k = 1 THEN revenue END) AS lrev, max(CASE WHEN k = 2 THEN revenue END) AS prev,
    max(CASE WHEN k = 1 THEN margin END) AS lm, max(CASE WHEN k = 2 THEN margin END) AS pm,
    max(CASE WHEN k = 1 THEN label END) AS ll, max(CASE WHEN k = 2 THEN label END) AS pl,
    count(*) AS n FROM l2 WHERE k <= 2
), rules AS (
  SELECT 1 AS rule_order, '' AS sub, 'success' AS type, 'Strong Margins' AS title,
    printf('Blended margin of %.1f%% is excellent — well above industry norms.', margin) AS detail
  FROM k WHERE margin >= {fixed.MARGIN_EXCELLENT_PCT}
  UNION ALL SELECT 1, '', 'warning', 'Margin Pressure',
    printf('Blended margin of %.1f%% is below target. Review pricing and discount strategies.', margin)
  FROM k WHERE margin < {fixed.MARGIN_BELOW_TARGET_PCT}
  UNION ALL SELECT 2, '', 'warning', 'High Discount Dependency',
    printf('Only %.1f%% of revenue is full-price. %.1f%% of sales are discounted.', full_price_pct, discounted_pct)
  FROM mix WHERE full_price_pct < {fixed.DISCOUNT_DEPENDENCY_PCT}
  UNION ALL SELECT 2, '', 'success', 'Healthy Sales Mix',
    printf('%.1f%% of revenue is at full price, limiting margin erosion from discounts.', full_price_pct)
  FROM mix WHERE full_price_pct >= {fixed.SALES_MIX_HEALTHY_PCT + 5}
  UNION ALL SELECT 3, '', 'info', 'Significant Margin Gap',
    printf('Full-price margin is %.1f pts higher than discounted. Discounts are cutting deep into profit.', margin_gap_pts)
  FROM mix WHERE margin_gap_pts > {fixed.MARGIN_GAP_SIGNIFICANT_PTS}
  UNION ALL SELECT 4, lpad(CAST(position AS VARCHAR), 6, '0'), 'warning', name || ' Needs Attention',
    printf('Margin of %.1f%% is below %d%%. Review store operations and pricing.', margin, {fixed.MARGIN_BELOW_TARGET_PCT})
  FROM st WHERE margin < {fixed.MARGIN_BELOW_TARGET_PCT}
  UNION ALL SELECT 5, '', 'warning', 'Revenue Declining',
    printf('%s revenue dropped %.1f%% vs %s.', ll, abs({PCTCHG('lrev', 'prev')}), pl)
  FROM pair WHERE n >= 2 AND {PCTCHG('lrev', 'prev')} < -10
  UNION ALL SELECT 6, '', 'success', 'Margin Improving',
    printf('Margin increased %.1f pts from %s to %s.', lm - pm, pl, ll)
  FROM pair WHERE n >= 2 AND lm - pm > 3
), ranked AS (SELECT *, row_number() OVER (ORDER BY rule_order, sub) AS position FROM rules)
SELECT rule_order, type, title, detail, position FROM ranked
""")

S7_SQL = oracle(MONTHLY_CTE + f"""
, x AS (
  SELECT m.*, lag(revenue) OVER w AS pr, lag(profit) OVER w AS pp, lag(margin) OVER w AS pm, lag(units) OVER w AS pu
  FROM monthly m WINDOW w AS (ORDER BY ym)
)
SELECT x.ym, x.year, x.month, x.month_key, x.label, x.revenue, x.profit, x.margin, x.units, x.transactions,
  x.customers, x.full_price_pct,
  {R(PCTCHG('x.revenue', 'x.pr'), 4)} AS mom_revenue_pct, {R(PCTCHG('x.profit', 'x.pp'), 4)} AS mom_profit_pct,
  {R('x.margin - x.pm')} AS mom_margin_pts, {R(PCTCHG('x.units', 'x.pu'), 4)} AS mom_units_pct,
  {R(PCTCHG('x.revenue', 'y.revenue'), 4)} AS yoy_revenue_pct, {R(PCTCHG('x.profit', 'y.profit'), 4)} AS yoy_profit_pct,
  {R('x.margin - y.margin')} AS yoy_margin_pts
FROM x LEFT JOIN monthly y ON y.year + 1 = x.year AND y.month = x.month
""")

S8_SQL = oracle(MONTHLY_CTE + f"""
SELECT {MS('revenue')} AS revenue, {MS('profit')} AS profit, {IS('units')} AS units, {IS('transactions')} AS transactions,
  {R(SD(MS('profit'), MS('revenue')) + ' * 100')} AS avg_margin,
  CASE WHEN count(*) > 0 THEN {R('sum(full_price_pct) / count(*)')} ELSE 0.0 END AS avg_full_price_pct
FROM monthly
""")


def _s9_sql(n_years: int = 3) -> str:
    cols = []
    for k in range(1, n_years + 1):
        c = f"yr = {k}"
        cols += [f"max(CASE WHEN {c} THEN year END) AS y{k}", f"max(CASE WHEN {c} THEN revenue END) AS y{k}_revenue",
                 f"max(CASE WHEN {c} THEN profit END) AS y{k}_profit",
                 f"max(CASE WHEN {c} THEN {R('margin')} END) AS y{k}_margin",
                 f"max(CASE WHEN {c} THEN units END) AS y{k}_units",
                 f"max(CASE WHEN {c} THEN {R('full_price_pct')} END) AS y{k}_full_price_pct"]
    return oracle(MONTHLY_CTE + f"""
, yrs AS (SELECT year, row_number() OVER (ORDER BY year DESC) AS yr FROM (SELECT DISTINCT year FROM monthly)),
g AS (SELECT month AS month_num, {', '.join(cols)} FROM monthly JOIN yrs USING (year) WHERE yr <= {n_years} GROUP BY month)
SELECT *, strftime(make_date(2000, month_num, 1), '%B') AS month_label,
  {R(PCTCHG('y1_revenue', 'y2_revenue'), 4)} AS revenue_change_pct,
  {R(PCTCHG('y1_profit', 'y2_profit'), 4)} AS profit_change_pct,
  {R('y1_margin - y2_margin')} AS margin_change_pts
FROM g
""")


S10_SQL = oracle(f"""
, g AS (
  SELECT store_clean AS name, {MS('actual_revenue')} AS revenue, {MS('net_profit')} AS profit, {IS('quantity')} AS units,
    CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions,
    CAST(count(DISTINCT customer_id) AS BIGINT) AS unique_customers, {MS('discounts')} AS discounts
  FROM regular WHERE store_clean IS NOT NULL GROUP BY 1
), t AS (SELECT {MS('actual_revenue')} AS trev, {MS('net_profit')} AS tp FROM regular),
pm AS (SELECT DISTINCT year - 1 AS year, month FROM regular),
prior AS (
  SELECT store_clean AS name, {MS('actual_revenue')} AS prior_revenue FROM regular r
  WHERE (year, month) IN (SELECT (year, month) FROM pm) AND store_clean IS NOT NULL GROUP BY 1
), tb AS (
  SELECT name, top_brand FROM (
    SELECT store_clean AS name, brand_clean AS top_brand,
      row_number() OVER (PARTITION BY store_clean ORDER BY {MS('actual_revenue')} DESC, brand_clean) AS k
    FROM regular WHERE store_clean IS NOT NULL AND brand_clean IS NOT NULL GROUP BY 1, 2) WHERE k = 1
), tc AS (
  SELECT name, top_category FROM (
    SELECT store_clean AS name, category_clean AS top_category,
      row_number() OVER (PARTITION BY store_clean ORDER BY {MS('actual_revenue')} DESC, category_clean) AS k
    FROM regular WHERE store_clean IS NOT NULL AND category_clean IS NOT NULL GROUP BY 1, 2) WHERE k = 1
), x AS (
  SELECT g.*, prior.prior_revenue, tb.top_brand, tc.top_category, t.trev, t.tp,
    {SD('g.profit', 'g.revenue')} * 100 AS m, {SD('t.tp', 't.trev')} * 100 AS am
  FROM g CROSS JOIN t LEFT JOIN prior USING (name) LEFT JOIN tb USING (name) LEFT JOIN tc USING (name)
)
SELECT name, row_number() OVER (ORDER BY revenue DESC, name) AS rank, revenue,
  {R(SD('revenue', 'trev') + ' * 100')} AS share_pct, profit, {R('m')} AS margin,
  CASE WHEN m >= am + 2 THEN 'green' WHEN m <= am - 2 THEN 'red' ELSE 'yellow' END AS margin_status,
  units, transactions, {R(SD('revenue - discounts', 'revenue') + ' * 100')} AS full_price_pct, unique_customers,
  top_brand, top_category,
  CASE WHEN prior_revenue <> 0 THEN {R(PCTCHG('revenue', 'prior_revenue'))} END AS sssg, prior_revenue,
  {R('am')} AS company_avg_margin
FROM x
""")


S12_SQL = f"""
SELECT revenue, prior_revenue, CASE WHEN prior_revenue > 0 THEN {R(PCTCHG('revenue', 'prior_revenue'))} END AS company_sssg,
  top_performer, bottom_performer
FROM (SELECT {MS('revenue')} AS revenue, {MS('prior_revenue')} AS prior_revenue,
        arg_min(name, rank) AS top_performer, first(name ORDER BY margin, rank) AS bottom_performer
      FROM ({S10_SQL}) AS sp) AS t
"""


def _ye_sql(year: int) -> str:
    cm = f"month IN (SELECT DISTINCT month FROM regular WHERE year = {year})"
    return oracle(f"""
, c AS (
  SELECT {MS('actual_revenue')} AS total_revenue, {MS('net_profit')} AS total_profit, {IS('quantity')} AS total_units,
    {MS('discounts')} AS total_discounts, CAST(count(DISTINCT month) AS BIGINT) AS months,
    CAST(count(DISTINCT store_clean) AS BIGINT) AS stores, CAST(count(DISTINCT brand_clean) AS BIGINT) AS brands
  FROM regular WHERE year = {year}
), p AS (
  SELECT {MS('actual_revenue')} AS pr, {MS('net_profit')} AS pp, {IS('quantity')} AS pu, count(*) AS pn
  FROM regular WHERE year = {year - 1} AND {cm}
), x AS (
  SELECT *, {SD('total_profit', 'total_revenue')} * 100 AS m, {R(SD('pp', 'pr') + ' * 100')} AS pm,
    {SD('total_revenue', 'total_units')} AS rpu, {SD('pr', 'pu')} AS prpu, greatest(months, 1) AS n
  FROM c, p
)
SELECT {year} AS year, stores, brands, months, total_revenue, total_profit, {R('m')} AS blended_margin, total_units,
  total_discounts, {R(SD('total_revenue - total_discounts', 'total_revenue') + ' * 100')} AS full_price_pct,
  {R('total_revenue / n', 0)} AS avg_monthly_revenue, {R('total_profit / n', 0)} AS avg_monthly_profit,
  CASE WHEN pn > 0 THEN {year - 1} END AS prev_year,
  CASE WHEN pn > 0 THEN {R(PCTCHG('total_revenue', 'pr'), 4)} END AS revenue_change_pct,
  CASE WHEN pn > 0 THEN pr END AS prev_revenue,
  CASE WHEN pn > 0 THEN {R(PCTCHG('total_profit', 'pp'), 4)} END AS profit_change_pct,
  CASE WHEN pn > 0 THEN pp END AS prev_profit,
  CASE WHEN pn > 0 THEN pm END AS margin_prev,
  CASE WHEN pn > 0 THEN {R('m - pm')} END AS margin_change_pts,
  CASE WHEN pn > 0 THEN {R('total_profit - total_revenue * (pm / 100)', 0)} END AS margin_impact_dollars,
  CASE WHEN pn > 0 THEN {R('total_revenue * (pm / 100)', 0)} END AS profit_at_old_margin,
  CASE WHEN pn > 0 THEN {R(PCTCHG('rpu', 'prpu'), 4)} END AS rev_per_unit_change_pct,
  CASE WHEN pn > 0 THEN {R('rpu', 2)} END AS rev_per_unit_current,
  CASE WHEN pn > 0 THEN {R('prpu', 2)} END AS rev_per_unit_prev
FROM x
""")


#: Monthly expenses of the registered query with opex.
OPEX = {"labor": 120000.0, "rent": 45000.0, "utilities": 8000.0, "other_opex": 17000.0, "depreciation": 9000.0}

F11_OPEX_SQL = oracle(f"""
, g AS (SELECT {MS('actual_revenue')} AS revenue, {MS('cost')} AS cogs, greatest(count(DISTINCT (year, month)), 1) AS months FROM regular),
h AS (SELECT *, round((revenue - cogs) * 100) / 100 AS gp, months * {sum(OPEX[k] for k in ('labor', 'rent', 'utilities', 'other_opex'))} AS opex,
      months * {OPEX['depreciation']} AS da FROM g)
SELECT true AS configured, CAST(months AS BIGINT) AS months, gp AS gross_profit, opex AS total_opex, gp - opex AS ebit, da AS depreciation,
  gp - opex + da AS ebitda, {R(SD('gp - opex + da', 'revenue') + ' * 100')} AS ebitda_margin_pct FROM h
""")


def _s16_sql(year: int) -> str:
    one_year = f"FROM regular WHERE year = {year}"
    return oracle(MONTHLY_CTE.replace("FROM regular", one_year) + MIX_CTE.replace("FROM regular", one_year) + f"""
, fl AS (SELECT min_by(margin, ym) AS fm, min_by(label, ym) AS fl, max_by(margin, ym) AS lm, max_by(label, ym) AS ll, count(*) AS n FROM monthly),
ye AS (SELECT * FROM ({_ye_sql(year)}) WHERE prev_year IS NOT NULL)
SELECT 0 AS rule_order, CASE WHEN margin_change_pts > 0.5 THEN 'success' WHEN margin_change_pts < -0.5 THEN 'warning' ELSE 'info' END AS type,
  CASE WHEN margin_change_pts > 0.5 THEN 'Margin Up vs {year - 1}' WHEN margin_change_pts < -0.5 THEN 'Margin Down vs {year - 1}' ELSE 'Margin Flat vs {year - 1}' END AS title,
  'Blended margin ' || CAST(blended_margin AS VARCHAR) || '% vs ' || CAST(margin_prev AS VARCHAR) || '% in {year - 1} (' ||
    CASE WHEN margin_change_pts > 0.5 THEN '+' || CAST(margin_change_pts AS VARCHAR) || ' pts year-over-year'
         WHEN margin_change_pts < -0.5 THEN CAST(margin_change_pts AS VARCHAR) || ' pts year-over-year' ELSE 'unchanged' END || ')' AS detail FROM ye
UNION ALL
SELECT 1, CASE WHEN lm - fm > 1 THEN 'success' WHEN lm - fm < -1 THEN 'warning' ELSE 'info' END,
  CASE WHEN lm - fm > 1 THEN 'Margin Improved' WHEN lm - fm < -1 THEN 'Margin Declined' ELSE 'Margin Stable' END,
  CASE WHEN abs(lm - fm) > 1 THEN printf('%.1f pts from %s (%.1f%%) to %s (%.1f%%)', abs(lm - fm), fl, fm, ll, lm)
       ELSE printf('Less than 1 pt change from %s to %s', fl, ll) END FROM fl WHERE n >= 2
UNION ALL
SELECT 2, CASE WHEN full_price_pct < 30 THEN 'warning' ELSE 'info' END,
  CASE WHEN full_price_pct < 30 THEN 'Discount Dependency' ELSE 'Discount Dependency Stable' END,
  printf('%.1f%% of revenue from discounted sales', discounted_pct) FROM mix
UNION ALL
SELECT 3, CASE health WHEN 'healthy' THEN 'success' WHEN 'concern' THEN 'warning' ELSE 'info' END,
  'Sales Mix ' || CASE health WHEN 'healthy' THEN 'Healthy Mix' WHEN 'watch' THEN 'Monitor Closely' ELSE 'Action Needed' END,
  printf('%.1f%% full price, %.1f%% discounted', full_price_pct, discounted_pct) FROM mix
""")


ENTRIES = {
    "S1_monthly_groups": (lambda s, sf: S.monthly_groups(REG(s, sf)), S1_SQL),
    "F8_sales_mix": (lambda s, sf: S.sales_mix(REG(s, sf)), F8_SQL),
    "F9_excluded_breakdown": (lambda s, sf: S.excluded_breakdown(load_sales(s, sf)), F9_SQL),
    "F10_pnl": (lambda s, sf: S.pnl(REG(s, sf)), F10_SQL),
    "F11_ebitda_proxy": (lambda s, sf: S.ebitda_proxy(REG(s, sf)), F11_SQL),
    "F11_ebitda_with_opex": (lambda s, sf: S.ebitda_proxy(REG(s, sf), OPEX), F11_OPEX_SQL),
    "S2_exec_kpis": (lambda s, sf: S.exec_kpis(load_sales(s, sf), REG(s, sf)), S2_SQL),
    "S3_best_worst_month": (lambda s, sf: S.best_worst_month(S.monthly_groups(REG(s, sf))), S3_SQL),
    "S4_top_categories": (lambda s, sf: S.top_categories(REG(s, sf), 8), S4_SQL),
    "S5_top_stores": (lambda s, sf: S.store_totals(REG(s, sf)), S5_SQL),
    "S6_insights": (lambda s, sf: S.insights(REG(s, sf)), S6_SQL),
    "S7_mom_yoy": (lambda s, sf: S.mom_yoy(REG(s, sf)), S7_SQL),
    "S8_mom_totals": (lambda s, sf: S.mom_totals(REG(s, sf)), S8_SQL),
    "S9_yoy_matrix": (lambda s, sf: S.yoy_matrix(REG(s, sf), 3), _s9_sql(3)),
    "S10_store_performance": (lambda s, sf: S.store_performance(REG(s, sf)), S10_SQL),
    "S12_S13_company_growth": (lambda s, sf: S.company_sssg(REG(s, sf)), S12_SQL),
    "S14_year_end": (lambda s, sf: S.year_end(REG(s, sf), YEAR_END), _ye_sql(YEAR_END)),
    "S16_year_end_insights": (lambda s, sf: S.year_end_insights(REG(s, sf), YEAR_END), _s16_sql(YEAR_END)),
}
