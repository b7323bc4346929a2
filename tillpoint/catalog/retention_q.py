"""Catalog: retention."""
from __future__ import annotations

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.sqlh import MS, R, SD
from tillpoint.functions import fixed
from tillpoint.operators import retention as J
from tillpoint.plans.curate import load_sales, regular


def REG(spark, sf):
    return regular(load_sales(spark, sf))


ACT = """
, base AS (SELECT * FROM regular WHERE customer_id IS NOT NULL),
am AS (SELECT DISTINCT ym FROM base),
mi AS (SELECT ym, CAST(row_number() OVER (ORDER BY ym) - 1 AS INTEGER) AS idx FROM am),
cm AS (SELECT customer_id, ym, round(sum(actual_revenue), 2) AS rev FROM base GROUP BY 1, 2),
act AS (SELECT cm.*, mi.idx, min(mi.idx) OVER (PARTITION BY customer_id) AS first_idx,
        min(cm.ym) OVER (PARTITION BY customer_id) AS first_ym FROM cm JOIN mi USING (ym))
"""

J1_SQL = oracle(ACT + f"""
, g AS (SELECT ym, count(*) AS total_customers, count(CASE WHEN ym = first_ym THEN 1 END) AS new_customers,
        count(CASE WHEN ym <> first_ym THEN 1 END) AS returning_customers, round(sum(rev), 2) AS total_revenue,
        round(coalesce(sum(CASE WHEN ym = first_ym THEN rev END), 0), 2) AS new_revenue,
        round(coalesce(sum(CASE WHEN ym <> first_ym THEN rev END), 0), 2) AS returning_revenue
        FROM act GROUP BY ym)
SELECT CAST(ym // 100 AS INTEGER) AS year, CAST(ym % 100 AS INTEGER) AS month, printf('%d-%02d', ym // 100, ym % 100) AS label,
  CAST(total_customers AS BIGINT) AS total_customers, CAST(new_customers AS BIGINT) AS new_customers,
  CAST(returning_customers AS BIGINT) AS returning_customers,
  {R(SD('new_customers', 'total_customers') + ' * 100')} AS new_pct,
  {R(SD('returning_customers', 'total_customers') + ' * 100')} AS returning_pct,
  total_revenue, new_revenue, returning_revenue
FROM g
""")

J2_SQL = oracle(ACT + f"""
, t AS (SELECT ym, idx FROM mi WHERE idx >= 3),
x AS (
  SELECT t.ym, t.idx,
    (SELECT count(DISTINCT a.customer_id) FROM act a WHERE a.idx BETWEEN t.idx - 3 AND t.idx - 1) AS active_prior_3m,
    (SELECT count(*) FROM act a WHERE a.idx = t.idx) AS active_current,
    (SELECT count(DISTINCT a.customer_id) FROM act a WHERE a.idx BETWEEN t.idx - 3 AND t.idx - 1
       AND a.customer_id NOT IN (SELECT b.customer_id FROM act b WHERE b.idx = t.idx)) AS churned,
    (SELECT count(*) FROM act a WHERE a.idx = t.idx AND a.first_idx < t.idx - 3
       AND a.customer_id NOT IN (SELECT b.customer_id FROM act b WHERE b.idx BETWEEN t.idx - 3 AND t.idx - 1)) AS re
  FROM t
)
SELECT printf('%d-%02d', ym // 100, ym % 100) AS label, CAST(ym // 100 AS INTEGER) AS year,
  CAST(ym % 100 AS INTEGER) AS month, CAST(active_prior_3m AS BIGINT) AS active_prior_3m,
  CAST(active_current AS BIGINT) AS active_current, CAST(churned AS BIGINT) AS churned,
  CAST(CASE WHEN idx > 3 THEN re ELSE 0 END AS BIGINT) AS reactivated,
  {R(SD('churned', 'active_prior_3m') + ' * 100')} AS churn_rate,
  {R('100 - ' + SD('churned', 'active_prior_3m') + ' * 100')} AS retention_rate
FROM x
""")

COHORT = ACT + """
, last AS (SELECT max(idx) AS last FROM act),
sizes AS (SELECT first_idx, first_ym, count(*) AS cohort_size FROM act WHERE idx = first_idx
          GROUP BY 1, 2),
counts AS (SELECT first_idx, idx - first_idx AS month_offset, count(*) AS active FROM act GROUP BY 1, 2),
grid AS (SELECT s.*, o.month_offset FROM sizes s, last,
         LATERAL (SELECT unnest(range(0, last.last - s.first_idx + 1)) AS month_offset) o),
cohorts AS (
  SELECT printf('%d-%02d', g.first_ym // 100, g.first_ym % 100) AS cohort_label, CAST(g.cohort_size AS BIGINT) AS cohort_size,
    CAST(g.month_offset AS INTEGER) AS month_offset, CAST(coalesce(c.active, 0) AS BIGINT) AS active
  FROM grid g LEFT JOIN counts c ON c.first_idx = g.first_idx AND c.month_offset = g.month_offset
)
"""
J3_SQL = oracle(COHORT + f"SELECT *, {R(SD('active', 'cohort_size') + ' * 100')} AS retention_pct FROM cohorts")
J4_SQL = oracle(COHORT + f"""
, c2 AS (SELECT *, {R(SD('active', 'cohort_size') + ' * 100')} AS retention_pct FROM cohorts)
SELECT cohort_label AS cohort, cohort_size AS size,
  max(CASE WHEN month_offset = 1 THEN retention_pct END) AS m1, max(CASE WHEN month_offset = 3 THEN retention_pct END) AS m3,
  max(CASE WHEN month_offset = 6 THEN retention_pct END) AS m6, max(CASE WHEN month_offset = 12 THEN retention_pct END) AS m12
FROM c2 GROUP BY 1, 2
""")

LTV = f"""
, ltv AS (
  SELECT customer_id, {MS('actual_revenue')} AS total_revenue, min(completed_at) AS first_purchase,
    max(completed_at) AS last_purchase, CAST(count(DISTINCT ym) AS BIGINT) AS transaction_months
  FROM regular WHERE customer_id IS NOT NULL GROUP BY 1
), ltv2 AS (
  SELECT *, CAST(floor(epoch(last_purchase - first_purchase) / 86400) AS BIGINT) AS tenure_days,
    total_revenue / greatest(transaction_months, 1) AS monthly_value FROM ltv
)
"""
J5_SQL = oracle(LTV + f"""
SELECT CAST(count(*) AS BIGINT) AS total_unique_customers, {R('avg(total_revenue)', 2)} AS avg_ltv,
  {R('median(total_revenue)', 2)} AS median_ltv, {R('avg(tenure_days)', 0)} AS avg_tenure_days,
  {R('avg(monthly_value)', 2)} AS avg_monthly_value FROM ltv2
""")


def _j6_sql() -> str:
    cases = " ".join(
        f"WHEN tenure_days > {lo}" + (f" AND tenure_days <= {hi}" if hi is not None else "") + f" THEN {i}"
        for i, (lab, lo, hi) in enumerate(fixed.TENURE_BUCKETS))
    labels = " ".join(f"WHEN {i} THEN '{lab}'" for i, (lab, lo, hi) in enumerate(fixed.TENURE_BUCKETS))
    return oracle(LTV + f"""
, b AS (SELECT *, CASE {cases} END AS bucket_order FROM ltv2),
tot AS (SELECT count(*) AS n FROM ltv2)
SELECT bucket_order, CASE bucket_order {labels} END AS bucket, CAST(count(*) AS BIGINT) AS customers,
  {R(SD('count(*)', 'max(tot.n)') + ' * 100')} AS pct_of_total,
  {R('round(sum(total_revenue), 2) / count(*)', 2)} AS avg_revenue, round(sum(total_revenue), 2) AS total_revenue
FROM b, tot WHERE bucket_order IS NOT NULL GROUP BY bucket_order
""")


J7_SQL = oracle("""
, base AS (SELECT * FROM regular WHERE customer_id IS NOT NULL),
mi AS (SELECT ym, row_number() OVER (ORDER BY ym) - 1 AS idx FROM (SELECT DISTINCT ym FROM base)),
n AS (SELECT count(*) AS n FROM mi),
x AS (SELECT base.customer_id, base.actual_revenue, mi.idx FROM base JOIN mi USING (ym)),
g AS (
  SELECT customer_id,
    sum(CASE WHEN idx >= n - 3 THEN actual_revenue END) AS rc,
    sum(CASE WHEN idx < n - 3 AND idx >= CASE WHEN n >= 9 THEN n - 9 ELSE 0 END THEN actual_revenue END) AS pc,
    count(CASE WHEN idx < n - 3 AND idx >= CASE WHEN n >= 9 THEN n - 9 ELSE 0 END THEN 1 END) AS pn,
    max(n) AS n
  FROM x, n GROUP BY customer_id
), r AS (SELECT *, round(pc, 2) / pn AS pavg FROM g WHERE rc IS NOT NULL AND pn > 0)
SELECT CAST(count(*) AS BIGINT) AS at_risk_customers,
  CAST(floor(coalesce(sum(pavg), 0.0) + 0.5) AS DOUBLE) AS at_risk_monthly_revenue
FROM r WHERE round(rc, 2) < pavg * 0.5 AND n > 6
""")

J8_SQL = f"""
SELECT k.*, l.new_customers AS latest_new_customers, l.returning_customers AS latest_returning_customers,
  l.returning_pct AS latest_returning_pct, c.churn_rate AS latest_churn_rate, a.at_risk_customers, a.at_risk_monthly_revenue
FROM ({J5_SQL}) k, (SELECT * FROM ({J1_SQL}) ORDER BY year DESC, month DESC LIMIT 1) l,
  (SELECT * FROM ({J2_SQL}) ORDER BY year DESC, month DESC LIMIT 1) c, ({J7_SQL}) a
"""

ENTRIES = {
    "J1_new_vs_returning": (lambda s, sf: J.new_vs_returning(REG(s, sf)), J1_SQL),
    "J2_churn_3m": (lambda s, sf: J.churn_3m(REG(s, sf)), J2_SQL),
    "J3_cohort_retention": (lambda s, sf: J.cohort_retention(REG(s, sf)), J3_SQL),
    "J4_cohort_summary": (lambda s, sf: J.cohort_summary(REG(s, sf)), J4_SQL),
    "J5_customer_ltv": (lambda s, sf: J.ltv_kpis(REG(s, sf)), J5_SQL),
    "J6_ltv_by_tenure": (lambda s, sf: J.ltv_by_tenure(REG(s, sf)), _j6_sql()),
    "J7_revenue_at_risk": (lambda s, sf: J.revenue_at_risk(REG(s, sf)), J7_SQL),
    "J8_retention_kpis": (lambda s, sf: J.retention_kpis(REG(s, sf)), J8_SQL),
}
