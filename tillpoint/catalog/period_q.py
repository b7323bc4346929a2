"""Catalog: every period against its predecessor (C5, and R10 and O3 over all periods)."""
from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import R, SD
from tillpoint.functions.expr import cents
from tillpoint.operators import advice as A
from tillpoint.operators import waterfall as O
from tillpoint.plans import period as C
from tillpoint.plans.curate import load_sales, regular

#: Days of a span and the day they are counted from (a Monday).
WEEK, ANCHOR = 7, dt.date(1990, 1, 1)


def REG(spark, sf):
    return regular(load_sales(spark, sf))


CALENDAR = """
, cal AS (
  SELECT DISTINCT 'month' AS grain, strftime(sale_date, '%Y-%m') AS period, date_trunc('month', sale_date) AS a, INTERVAL 1 MONTH AS n FROM regular
  UNION SELECT DISTINCT 'quarter', year(sale_date) || '-Q' || quarter(sale_date), date_trunc('quarter', sale_date), INTERVAL 3 MONTH FROM regular
  UNION SELECT DISTINCT 'year', CAST(year(sale_date) AS VARCHAR), date_trunc('year', sale_date), INTERVAL 1 YEAR FROM regular
), spans AS (
  SELECT grain, period, CAST(a AS DATE) AS start, CAST(a + n - INTERVAL 1 DAY AS DATE) AS "end", CAST(a - n AS DATE) AS prev_start,
    CAST(a - INTERVAL 1 DAY AS DATE) AS prev_end FROM cal
), sided AS (
  SELECT grain, period, 'current' AS side, start AS a, "end" AS b FROM spans UNION ALL SELECT grain, period, 'previous', prev_start, prev_end FROM spans
), x AS (SELECT s.grain, s.period, s.side, r.* FROM sided s JOIN regular r ON r.sale_date BETWEEN s.a AND s.b)
"""

C5_SQL = oracle(CALENDAR + """SELECT grain, period, CAST(start AS VARCHAR) AS start, CAST("end" AS VARCHAR) AS "end",
  CAST(prev_start AS VARCHAR) AS prev_start, CAST(prev_end AS VARCHAR) AS prev_end FROM spans""")

WEEKS_SQL = oracle(f"""
, weeks AS (SELECT DISTINCT CAST(DATE '{ANCHOR}' + CAST(floor(datediff('day', DATE '{ANCHOR}', sale_date) / {WEEK}) * {WEEK} AS INTEGER) AS DATE) AS a FROM regular),
s AS (
  SELECT w.a, CAST(sum(CASE WHEN r.sale_date >= w.a THEN round(r.actual_revenue * 100) END) AS BIGINT) AS c,
    CAST(sum(CASE WHEN r.sale_date < w.a THEN round(r.actual_revenue * 100) END) AS BIGINT) AS p, count(CASE WHEN r.sale_date >= w.a THEN 1 END) AS lines
  FROM weeks w JOIN regular r ON r.sale_date BETWEEN w.a - INTERVAL {WEEK} DAY AND w.a + INTERVAL {WEEK - 1} DAY GROUP BY w.a
)
SELECT CAST(a AS VARCHAR) AS period, c / 100 AS revenue, p / 100 AS previous_revenue, CAST(lines AS BIGINT) AS lines FROM s
""")


def weeks(regular_sales):
    """Every week against the one before it, by the interval join on days."""
    x = C.in_periods(regular_sales.select("sale_date", "actual_revenue"), C.spans_of_days(regular_sales, WEEK, ANCHOR, "week"))
    now = F.col("side") == "current"
    return x.groupBy("period").agg((F.sum(F.when(now, cents("actual_revenue"))) / 100).alias("revenue"),
                                   (F.sum(F.when(~now, cents("actual_revenue"))) / 100).alias("previous_revenue"), F.count(F.when(now, 1)).alias("lines"))


_VALUES = {"Revenue": "revenue", "Units": "units", "Margin %": R(SD("revenue - cost", "revenue") + " * 100"), "Full Price %": R(SD("fp", "revenue") + " * 100"),
           "Profit": "profit"}
R10_ALL_SQL = oracle(CALENDAR + f"""
, g AS (SELECT grain, period, side, brand_clean AS brand, sum(round(actual_revenue * 100)) / 100 AS revenue, sum(quantity) AS units,
    sum(round(cost * 100)) / 100 AS cost, sum(round(net_profit * 100)) / 100 AS profit,
    coalesce(sum(CASE WHEN NOT has_discount THEN round(actual_revenue * 100) END), 0) / 100 AS fp FROM x WHERE brand_clean IS NOT NULL GROUP BY ALL),
m AS ({' UNION ALL '.join(f"SELECT grain, period, side, brand, '{k}' AS metric, CAST({v} AS DOUBLE) AS value FROM g" for k, v in _VALUES.items())})
SELECT c.grain, c.period, c.brand, c.metric, c.value AS current, p.value AS previous, {R('c.value - p.value', 2)} AS change
FROM m c JOIN m p USING (grain, period, brand, metric) WHERE c.side = 'current' AND p.side = 'previous'
""")

O3_ALL_SQL = oracle(CALENDAR + f"""
, tot AS (SELECT grain, period, side, sum(round(actual_revenue * 100)) AS rc, sum(round(cost * 100)) AS cc, sum(round(discounts * 100)) AS dc FROM x GROUP BY ALL),
g AS (SELECT grain, period, side, category_clean AS category, sum(round(actual_revenue * 100)) AS rc, sum(round(cost * 100)) AS cc, sum(quantity) AS q
      FROM x WHERE category_clean IS NOT NULL GROUP BY ALL),
cs AS (SELECT g.*, CASE WHEN t.rc <> 0 THEN g.rc / t.rc * 100 / 100 ELSE 0.0 END AS share, {SD('g.rc - g.cc', 'g.rc')} * 100 AS margin,
       {SD('g.rc / 100', 'q')} AS rpu, {SD('g.cc / 100', 'q')} AS cpu FROM g JOIN tot t USING (grain, period, side)),
d AS (SELECT grain, period, category, {', '.join(f"coalesce(max(CASE WHEN side = '{s}' THEN {c} END), 0.0) AS {s[0]}{c}" for s in ('current', 'previous') for c in ('share', 'margin', 'rpu', 'cpu'))}
      FROM cs GROUP BY ALL),
e AS (SELECT grain, period, sum((cshare - pshare) * pmargin) AS mix,
        sum(CASE WHEN crpu <> 0 THEN cshare * (crpu - prpu) / crpu * cmargin ELSE 0.0 END) AS price,
        sum(CASE WHEN crpu <> 0 THEN cshare * (pcpu - ccpu) / crpu * 100 ELSE 0.0 END) AS costfx FROM d GROUP BY ALL),
t AS (SELECT c.grain, c.period, {SD('c.rc - c.cc', 'c.rc')} * 100 AS cm, {SD('p.rc - p.cc', 'p.rc')} * 100 AS pm,
        ({SD('c.dc', 'c.rc + c.dc')} * 100 - {SD('p.dc', 'p.rc + p.dc')} * 100) * -1 AS disc
      FROM tot c JOIN tot p USING (grain, period) WHERE c.side = 'current' AND p.side = 'previous'),
w AS (SELECT t.*, coalesce(mix, 0.0) AS mix, coalesce(price, 0.0) AS price, coalesce(costfx, 0.0) AS costfx FROM t LEFT JOIN e USING (grain, period))
SELECT grain, period, {R('pm', 2)} AS prior_margin, {R('cm', 2)} AS current_margin, {R('cm - pm', 2)} AS total_change_pts, {R('mix', 2)} AS mix_pts,
  {R('price', 2)} AS price_pts, {R('costfx', 2)} AS cost_pts, {R('disc', 2)} AS discount_pts, {R('(cm - pm) - (mix + price + costfx + disc)', 2)} AS residual_pts FROM w
""")


def _text(df):
    return df.select("grain", "period", *(F.col(c).cast("string").alias(c) for c in ("start", "end", "prev_start", "prev_end")))


ENTRIES = {
    "C5_period_calendar": (lambda s, sf: _text(C.period_calendar(REG(s, sf))), C5_SQL),
    "C5_week_over_week": (lambda s, sf: weeks(REG(s, sf)), WEEKS_SQL),
    "R10_comparison_all_periods": (lambda s, sf: A.comparison_by_period(REG(s, sf)), R10_ALL_SQL),
    "O3_waterfall_all_periods": (lambda s, sf: O.effects_by_period(REG(s, sf)), O3_ALL_SQL),
}
