"""DuckDB oracle: the canonical ``sales`` view written independently in SQL.

Each oracle query is ``sales_ctes() + <query>`` where the query either
starts with ``SELECT`` or with ``, name AS (...)`` to add CTEs. Tables are
the driver's pre-registered views.
"""
from __future__ import annotations

from tillpoint.functions import fixed
from tillpoint.sources import testmodel


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(vals) -> str:
    return "[" + ", ".join(_q(v) for v in vals) + "]"


def _category_case(x: str) -> str:
    aliases = dict(fixed.CATEGORY_ALIASES)
    aliases.update(testmodel.TEST_CATEGORY_ALIASES)
    whens = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in aliases.items())
    return f"CASE {x} {whens} ELSE {x} END"


def _cost_unit_sql() -> str:
    """House-brand unit cost in SQL (null = untouched)."""
    half = " OR ".join(f"upper(coalesce(product,'')) LIKE '%{k}%'" for k in fixed.FLOWER_HALF_OZ_KEYWORDS)
    cls = (f"CASE WHEN category_clean IN ({', '.join(map(_q, fixed.PRE_ROLL_CATEGORIES))}) THEN 'pre_roll' "
           f"WHEN category_clean IN ({', '.join(map(_q, fixed.CART_CATEGORIES))}) THEN 'cart' "
           f"WHEN category_clean IN ({', '.join(map(_q, fixed.DISPOSABLE_CATEGORIES))}) THEN 'disposable' "
           f"WHEN category_clean IN ({', '.join(map(_q, fixed.FLOWER_CATEGORIES))}) AND ({half}) THEN 'flower_half_oz' "
           f"WHEN category_clean IN ({', '.join(map(_q, fixed.FLOWER_CATEGORIES))}) THEN 'flower_eighth' "
           f"ELSE 'default' END")
    parts = []
    for brand, prices in fixed.INTERNAL_BRAND_COSTS.items():
        for k, v in prices.items():
            parts.append(f"WHEN upper(brand_clean) = {_q(brand)} AND ({cls}) = {_q(k)} THEN {float(v)}")
    for brand, prices in fixed.INTERNAL_BRAND_COSTS.items():
        if "default" in prices:
            parts.append(f"WHEN upper(brand_clean) = {_q(brand)} THEN {float(prices['default'])}")
    return "CASE " + " ".join(parts) + " ELSE NULL END"


def sales_ctes() -> str:
    excluded = ", ".join(_q(s) for s in fixed.EXCLUDED_STORES)
    return f"""
WITH _geo AS (
  SELECT s.s_suppkey, s.s_name, n.n_regionkey, r.r_name
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
), _li AS (
  SELECT l.*, o.o_custkey, o.o_orderdate, c.c_name, p.p_partkey, p.p_name, p.p_brand, p.p_type,
         g.s_name, g.r_name,
         CAST(round(l.l_extendedprice * 100) AS BIGINT) AS cents,
         CAST(round(l.l_discount * 100) AS INTEGER) * 4 AS pct,
         (l.l_orderkey + l.l_partkey) % 53 = 0 AS is_comp
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
  LEFT JOIN _geo g ON l.l_suppkey = g.s_suppkey
), _li2 AS (
  SELECT *, CASE WHEN is_comp THEN cents - 50 ELSE (cents * pct) // 100 END AS disc_c,
         (cents * (40 + l_partkey % 70)) // 100 AS cost_c
  FROM _li
), _raw AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS receipt_id,
    {_list(testmodel.ORDER_TYPES)}[l_orderkey % 4 + 1] AS order_type,
    s_name AS sold_by,
    CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST((l_orderkey * 7 + 3) % 14 + 8 AS INTEGER)) AS completed_at,
    CAST(o_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
    r_name || ' - RD' || CAST(l_suppkey AS VARCHAR) AS store,
    p_name || ' #' || CAST(p_partkey AS VARCHAR)
      || CASE WHEN p_partkey % 97 = 0 THEN ' Tester' ELSE '' END
      || CASE WHEN p_partkey % 89 = 0 THEN ' Exit Bag' ELSE '' END AS product,
    CASE WHEN p_partkey % 2 = 0 THEN lower(p_type) ELSE ' ' || p_type END AS category,
    p_brand || ' ' AS brand,
    CAST(l_quantity AS INTEGER) AS quantity,
    CAST(cents AS DOUBLE) / 100 AS pre_discount_revenue,
    CAST(disc_c AS DOUBLE) / 100 AS discounts,
    CAST(CASE WHEN is_comp THEN 50 ELSE cents - disc_c END AS DOUBLE) / 100 AS actual_revenue,
    CAST(CASE WHEN is_comp THEN 50 ELSE cents - disc_c END - cost_c AS DOUBLE) / 100 AS net_profit,
    CAST(cost_c AS DOUBLE) / 100 AS cost,
    CASE WHEN l_quantity >= 1 THEN round(cost_c / CAST(l_quantity AS INTEGER)) / 100 END AS cost_per_item,
    CASE WHEN pct = 0 THEN NULL ELSE {_list(testmodel.DEALS)}[(l_orderkey + l_partkey) % 10 + 1] END AS deals_used,
    CASE WHEN l_suppkey % 11 = 0 THEN 'Employee' END AS inline_discounts,
    CAST(NULL AS VARCHAR) AS file_name, CAST(NULL AS DATE) AS file_end,
    l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate
  FROM _li2
), _norm AS (
  SELECT *, CAST(completed_at AS DATE) AS sale_date,
    CAST(year(completed_at) AS INTEGER) AS year, CAST(month(completed_at) AS INTEGER) AS month,
    CAST(year(completed_at) * 100 + month(completed_at) AS INTEGER) AS ym,
    trim(regexp_replace(store, ' - RD[0-9]+', '', 'g')) AS store_clean,
    trim(brand) AS brand_clean,
    {_category_case("upper(trim(category))")} AS category_clean,
    upper(trim(product)) AS product_clean,
    upper(coalesce(deals_used, '')) AS deals_upper,
    coalesce(discounts > 0, false) AS has_discount
  FROM _raw WHERE completed_at IS NOT NULL
), _dedup AS (
  SELECT * FROM _norm
  QUALIFY row_number() OVER (PARTITION BY receipt_id, product, completed_at
    ORDER BY file_end DESC NULLS LAST, coalesce(file_name, ''), l_linenumber, l_suppkey, l_quantity,
             l_extendedprice, l_discount, l_tax, l_shipdate) = 1
), _classified AS (
  SELECT *,
    CASE WHEN coalesce(product_clean, '') LIKE '%TESTER%' OR deals_upper LIKE '%TESTER%' THEN 'TESTER'
         WHEN regexp_matches(deals_upper, 'MARKOUT|MARK OUT|MARK-OUT') THEN 'MARKOUT'
         WHEN regexp_matches(deals_upper, 'REWARD|POINT|REDEMPTION') THEN 'REWARD'
         WHEN coalesce(actual_revenue, 0) <= 1.0 AND coalesce(product_clean, '') NOT LIKE '%EXIT BAG%' THEN 'COMP'
         ELSE 'REGULAR' END AS transaction_type,
    CASE WHEN deals_upper = '' AND upper(coalesce(inline_discounts, '')) = '' THEN 'NO DEAL'
         WHEN regexp_matches(deals_upper || ' ' || upper(coalesce(inline_discounts, '')),
              'B1G|B2G|BOGO|2 FOR|3 FOR|4 FOR|5 FOR|2/\\$|3/\\$|4/\\$|5/\\$') THEN 'BUNDLE'
         WHEN regexp_matches(deals_upper || ' ' || upper(coalesce(inline_discounts, '')), '%|PERCENT') THEN 'PERCENT OFF'
         WHEN regexp_matches(deals_upper || ' ' || upper(coalesce(inline_discounts, '')),
              'SENIOR|VETERAN|MILITARY|MEDICAL|INDUSTRY|VIP|EMPLOYEE') THEN 'CUSTOMER DISCOUNT'
         WHEN regexp_matches(deals_upper || ' ' || upper(coalesce(inline_discounts, '')), 'FOR \\$|FOR\\$') THEN 'PRICE DEAL'
         ELSE 'OTHER' END AS deal_type,
    {_cost_unit_sql()} AS _unit
  FROM _dedup
), sales AS (
  SELECT receipt_id, order_type, sold_by, completed_at, sale_date, year, month, ym, customer_id,
    customer_name, store, store_clean, product, product_clean, category_clean, brand_clean, quantity,
    pre_discount_revenue, discounts, actual_revenue,
    CASE WHEN _unit IS NULL THEN net_profit ELSE round((actual_revenue - round(quantity * _unit * 100) / 100) * 100) / 100 END AS net_profit,
    CASE WHEN _unit IS NULL THEN cost ELSE round(quantity * _unit * 100) / 100 END AS cost,
    coalesce(_unit, cost_per_item) AS cost_per_item,
    has_discount, deals_used, deals_upper, inline_discounts, transaction_type, deal_type, file_name, file_end
  FROM _classified
  WHERE store_clean IS NULL OR store_clean NOT IN ({excluded})
), regular AS (
  SELECT * FROM sales WHERE transaction_type = 'REGULAR'
)
"""


def oracle(query: str) -> str:
    return sales_ctes() + query
