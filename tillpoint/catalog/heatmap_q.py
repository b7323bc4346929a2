"""Catalog: heatmap (M1-M6) and forecast."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import MS, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import forecast as N
from tillpoint.operators import heatmap as M
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


DAYS = "[" + ", ".join(f"'{d}'" for d in fixed.DAY_NAMES) + "]"


def HL(h: str) -> str:
    return (f"CASE WHEN {h} = 0 THEN '12am' WHEN {h} < 12 THEN CAST({h} AS VARCHAR) || 'am' "
            f"WHEN {h} = 12 THEN '12pm' ELSE CAST({h} - 12 AS VARCHAR) || 'pm' END")


PARTS = """
, p AS (SELECT *, CAST(isodow(completed_at) - 1 AS INTEGER) AS day, CAST(hour(completed_at) AS INTEGER) AS hour FROM regular)
"""
GRID = PARTS + f"""
, grid AS (SELECT day, {DAYS}[day + 1] AS day_name, hour, {MS('actual_revenue')} AS revenue,
           CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions FROM p GROUP BY day, hour)
"""
M1_SQL = oracle(GRID + "SELECT * FROM grid")
M2_SQL = oracle(GRID + f"""
, a AS (SELECT 'revenue' AS ranked_by, row_number() OVER (ORDER BY revenue DESC, day, hour) AS rank, * FROM grid),
b AS (SELECT 'transactions' AS ranked_by, row_number() OVER (ORDER BY transactions DESC, day, hour) AS rank, * FROM grid)
SELECT ranked_by, rank, day_name, hour, {HL('hour')} AS hour_label, revenue, transactions FROM a WHERE rank <= 5
UNION ALL
SELECT ranked_by, rank, day_name, hour, {HL('hour')} AS hour_label, revenue, transactions FROM b WHERE rank <= 5
""")
M3_SQL = oracle(PARTS + f"""
, g AS (SELECT day, {MS('actual_revenue')} AS revenue, CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions
        FROM p GROUP BY day)
SELECT day, {DAYS}[day + 1] AS day_name, revenue, transactions, {R(SD('revenue', 'transactions'), 2)} AS avg_basket FROM g
""")
M4_SQL = oracle(PARTS + f"""
SELECT store_clean AS store, day, hour, {MS('actual_revenue')} AS revenue,
  CAST(count(DISTINCT receipt_id) AS BIGINT) AS transactions
FROM p WHERE store_clean IS NOT NULL
GROUP BY store_clean, day, hour
""")
PEAK = PARTS + f"""
, cells AS (SELECT day, hour, sum(CAST(round(actual_revenue * 100) AS BIGINT)) AS c FROM p GROUP BY day, hour),
pk AS (SELECT day, hour, c FROM cells ORDER BY c DESC, day, hour LIMIT 1),
keep AS (SELECT cells.day, cells.hour, cells.hour - row_number() OVER (ORDER BY cells.hour) AS isl
         FROM cells, pk WHERE cells.day = pk.day AND cells.c >= pk.c * 0.5),
span AS (SELECT min(keep.hour) AS s, max(keep.hour) AS e, min(keep.day) AS d FROM keep
         WHERE isl = (SELECT isl FROM keep, pk WHERE keep.hour = pk.hour)),
peakw AS (SELECT CASE WHEN s = e THEN {DAYS}[d + 1] || ' ' || {HL('s')}
                      ELSE {DAYS}[d + 1] || ' ' || {HL('s')} || '-' || {HL('e')} END AS description,
          s AS start_hour, e AS end_hour FROM span)
"""
M6_SQL = oracle(PEAK + "SELECT * FROM peakw")
M5_SQL = oracle(PEAK + f"""
, d AS (SELECT day, sum(CAST(round(actual_revenue * 100) AS BIGINT)) AS c FROM p GROUP BY day),
h AS (SELECT hour, sum(CAST(round(actual_revenue * 100) AS BIGINT)) AS c FROM p GROUP BY hour),
bd AS (SELECT day FROM d ORDER BY c DESC, day LIMIT 1), qd AS (SELECT day FROM d ORDER BY c, day DESC LIMIT 1),
bh AS (SELECT hour FROM h ORDER BY c DESC, hour LIMIT 1)
SELECT {DAYS}[bd.day + 1] AS busiest_day, bh.hour AS busiest_hour, {HL('bh.hour')} AS busiest_hour_label,
  {DAYS}[qd.day + 1] AS quietest_day, peakw.description AS peak_description FROM bd, qd, bh, peakw
""")

MON = f"""
, mon AS (SELECT year, month, strftime(make_date(2000, month, 1), '%b') || ' ' || CAST(year AS VARCHAR) AS label,
          {MS('actual_revenue')} AS revenue, {MS('net_profit')} AS profit FROM regular GROUP BY year, month),
mon2 AS (SELECT *, row_number() OVER (ORDER BY year DESC, month DESC) AS k, count(*) OVER () AS n FROM mon)
"""
N1_SQL = oracle(MON + f"""
SELECT year, month, label, revenue, profit,
  {R('avg(revenue) OVER (ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS trailing_3m_revenue,
  {R('avg(profit) OVER (ORDER BY year, month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)', 2)} AS trailing_3m_profit
FROM mon
""")
N2_SQL = oracle(MON + f"""
, g AS (SELECT avg(CASE WHEN k <= 3 THEN revenue END) AS cur,
        CASE WHEN max(n) >= 6 THEN avg(CASE WHEN k > 3 AND k <= 6 THEN revenue END)
             ELSE avg(CASE WHEN k > n - greatest(n - 3, 1) THEN revenue END) END AS pri, max(n) AS n FROM mon2),
x AS (SELECT CASE WHEN n >= 3 THEN {SD('cur - pri', 'abs(pri)')} * 100 END AS rate FROM g)
SELECT {R('rate', 2)} AS growth_rate,
  CASE WHEN rate > 2.0 THEN 'accelerating' WHEN rate < -2.0 THEN 'decelerating' ELSE 'stable' END AS trajectory FROM x
""")
SEAS = MON + """
, yrs AS (SELECT year FROM mon GROUP BY year HAVING count(*) = 12),
base AS (SELECT * FROM mon WHERE (SELECT max(year) FROM yrs) IS NULL OR year = (SELECT max(year) FROM yrs)),
bavg AS (SELECT round(sum(revenue), 2) / count(*) AS a FROM base),
per AS (SELECT month, round(sum(revenue), 2) AS c FROM base GROUP BY month),
seas AS (SELECT m.month, strftime(make_date(2000, m.month, 1), '%B') AS month_name,
         CASE WHEN per.c IS NULL OR bavg.a = 0 THEN 1.0 ELSE floor(per.c / bavg.a * 10000 + 0.5) / 10000 END AS factor
         FROM (SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month) m LEFT JOIN per USING (month), bavg)
"""
N3_SQL = oracle(SEAS + "SELECT * FROM seas")
N4_SQL = oracle(SEAS + f"""
, last AS (SELECT year, month FROM mon2 WHERE k = 1),
tr AS (SELECT avg(CASE WHEN k <= 3 THEN revenue END) AS tr, avg(CASE WHEN k <= 3 THEN profit END) AS tp, max(n) AS n FROM mon2),
fwd AS (SELECT CAST((last.month + i - 1) % 12 + 1 AS INTEGER) AS month,
        CAST(last.year + (last.month + i - 1) // 12 AS INTEGER) AS year FROM last, (SELECT unnest(range(1, 4)) AS i)),
yavg AS (SELECT year, round(sum(revenue), 2) / count(*) AS yavg FROM mon GROUP BY year),
x AS (
  SELECT fwd.year, fwd.month, pm.revenue AS prev_rev, ya.yavg, seas.factor AS sfac FROM fwd
  LEFT JOIN mon pm ON pm.year = fwd.year - 1 AND pm.month = fwd.month
  LEFT JOIN yavg ya ON ya.year = fwd.year - 1
  LEFT JOIN seas ON seas.month = fwd.month
), y AS (
  SELECT *, CASE WHEN prev_rev IS NOT NULL THEN (CASE WHEN yavg > 0 THEN prev_rev / yavg ELSE 1.0 END)
                 ELSE coalesce(sfac, 1.0) END AS f FROM x
)
SELECT y.year, y.month, strftime(make_date(2000, y.month, 1), '%b') || ' ' || CAST(y.year AS VARCHAR) AS label,
  {R('tr.tr * f', 2)} AS projected_revenue, {R('tr.tp * f', 2)} AS projected_profit, {R('f', 4)} AS seasonality_factor
FROM y, tr WHERE tr.n >= 6
""")

ENTRIES = {
    "M1_traffic_grid": (lambda s, sf: M.traffic_grid(REG(s, sf)), M1_SQL),
    "M2_peak_hours": (lambda s, sf: M.peak_hours(REG(s, sf)), M2_SQL),
    "M3_daily_summary": (lambda s, sf: M.daily_summary(REG(s, sf)), M3_SQL),
    "M4_store_traffic_grid": (lambda s, sf: M.store_traffic_grid(REG(s, sf)), M4_SQL),
    "M5_traffic_kpis": (lambda s, sf: M.traffic_kpis(REG(s, sf)), M5_SQL),
    "M6_peak_window": (lambda s, sf: M.peak_window(REG(s, sf)), M6_SQL),
    "N1_monthly_revenue": (lambda s, sf: N.monthly_revenue(REG(s, sf)), N1_SQL),
    "N2_growth_trajectory": (lambda s, sf: N.growth_trajectory(REG(s, sf)), N2_SQL),
    "N3_seasonal_factors": (lambda s, sf: N.seasonal_factors(REG(s, sf)), N3_SQL),
    "N4_forecast_3m": (lambda s, sf: N.forecast_3m(REG(s, sf)), N4_SQL),
}
