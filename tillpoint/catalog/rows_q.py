"""Catalog: row functions on inputs that reach every branch (B1-B3, B9, B14, B15, B19, B22, C2, C4), D1's file ranks, and reports on
staff and customer exports (A4, A5)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.catalog.base_sql import _cost_unit_sql, _q, oracle
from tillpoint.catalog.brands_q import I1_SQL

from tillpoint.catalog.staff_q import P2_SQL
from tillpoint.functions import clean, fixed
from tillpoint.functions.expr import cents, fill_numeric
from tillpoint.operators import customers as I
from tillpoint.operators import staff as P
from tillpoint.plans.curate import load_customer_attributes, load_sales, regular
from tillpoint.plans.dedup import DEDUP_KEY, dedup_latest_file
from tillpoint.plans.period import brand_filter, store_filter
from tillpoint.sources import inbox, pos_csv, testmodel
from tillpoint.sources.tables import read_table

# --- B14, B15, B22: every house brand, cost class and an excluded store, dealt to the lines by their keys -------------
BRANDS = [*(b.title() for b in fixed.INTERNAL_BRAND_COSTS), "G&G Extracts", "Other"]
KINDS = [*fixed.PRE_ROLL_CATEGORIES, *fixed.CART_CATEGORIES, *fixed.DISPOSABLE_CATEGORIES, *fixed.FLOWER_CATEGORIES, "EDIBLE"]
WORDS = ["plain", *(k.lower() for k in fixed.FLOWER_HALF_OZ_KEYWORDS)]
STORES = ["Downtown", *fixed.EXCLUDED_STORES]


def _pick(values: list[str], key: str) -> str:
    return f"element_at(array({', '.join(_q(v) for v in values)}), cast({key} % {len(values)} + 1 as int))"


def _pick_sql(values: list[str], key: str) -> str:
    return f"[{', '.join(_q(v) for v in values)}][{key} % {len(values)} + 1]"


DEALT = {"brand_clean": (BRANDS, "l_partkey"), "category_clean": (KINDS, "l_orderkey"), "product": (WORDS, "(l_suppkey + l_linenumber)"), "store_clean": (STORES, "(l_suppkey div 3)")}


def house_brands(spark, sf) -> DataFrame:
    lines = read_table(spark, sf, "lineitem").select(
        *(F.expr(_pick(*v)).alias(k) for k, v in DEALT.items()), F.col("l_quantity").cast("int").alias("quantity"),
        (F.rint(F.col("l_extendedprice") * 100) / 100).alias("actual_revenue"), F.lit(1.0).alias("cost"), F.lit(0.5).alias("cost_per_item"), F.lit(0.25).alias("net_profit"))
    kept = clean.exclude_stores(clean.correct_costs(lines))
    return kept.groupBy("brand_clean", "category_clean", "product", "store_clean", clean.internal_brand(F.col("brand_clean")).alias("internal")).agg(
        F.count(F.lit(1)).alias("lines"), (F.sum(cents("cost")) / 100).alias("cost"), (F.sum(cents("net_profit")) / 100).alias("profit"), F.max("cost_per_item").alias("unit_cost"))


HOUSE_SQL = f"""
WITH x AS (
  SELECT {', '.join(f"{_pick_sql(v, k2.replace(' div ', ' // '))} AS {k}" for k, (v, k2) in DEALT.items())}, CAST(l_quantity AS INTEGER) AS quantity,
    round(l_extendedprice * 100) / 100 AS actual_revenue FROM lineitem
), u AS (SELECT *, {_cost_unit_sql()} AS unit FROM x WHERE store_clean NOT IN ({', '.join(map(_q, fixed.EXCLUDED_STORES))})),
c AS (SELECT *, CASE WHEN unit IS NULL THEN 1.0 ELSE round(quantity * unit * 100) / 100 END AS cost FROM u)
SELECT brand_clean, category_clean, product, store_clean, upper(brand_clean) IN ({', '.join(map(_q, fixed.INTERNAL_BRANDS))}) AS internal, CAST(count(*) AS BIGINT) AS lines,
  sum(CAST(round(cost * 100) AS BIGINT)) / 100 AS cost,
  sum(CAST(round(CASE WHEN unit IS NULL THEN 0.25 ELSE actual_revenue - cost END * 100) AS BIGINT)) / 100 AS profit, max(coalesce(unit, 0.5)) AS unit_cost
FROM c GROUP BY ALL
"""


# --- B1-B3, B9: numbers and times written as an export would, and read back ----------------------------------------
def parsers(spark, sf) -> DataFrame:
    li = read_table(spark, sf, "lineitem").select(
        "l_linenumber", "l_quantity", F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("c"), F.rint(F.col("l_discount") * 100).cast("int").alias("d"),
        F.timestamp_add("MINUTE", (F.col("l_orderkey") % 1440).cast("int"), F.col("l_shipdate").cast("timestamp_ntz")).alias("at"), (F.col("l_orderkey") % 7).alias("k"))
    money = F.concat(F.when(F.col("k") == 1, "-$").otherwise("$"), F.format_number(F.col("c") / 100, 2))
    text = li.select(
        "l_linenumber", F.when(F.col("k") == 0, F.lit(" ")).when(F.col("k") == 2, F.lit("n/a")).otherwise(money).alias("money"),
        F.when(F.col("k") == 3, F.lit("")).otherwise(F.concat(F.col("d").cast("string"), F.lit("%"))).alias("rate"),
        F.when(F.col("k") == 4, F.date_format("at", "yyyy-MM-dd")).otherwise(F.date_format("at", "M/d/yyyy h:mm:ss a")).alias("at"),
        F.when(F.col("k") == 5, F.lit("two")).when(F.col("k") == 6, F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(".7"))).otherwise(
            F.col("l_quantity").cast("int").cast("string")).alias("n"))
    t = clean.parse_timestamp(F.col("at"))
    return text.select("l_linenumber", clean.parse_currency(F.col("money")).alias("money"), clean.parse_percent(F.col("rate")).alias("rate"), t.alias("at"),
                       clean.coerce_quantity(F.col("n")).alias("n")).groupBy("l_linenumber").agg(
        F.sum(cents("money")).alias("cents"), F.count("money").alias("amounts"), F.sum("rate").alias("rates"), F.count("rate").alias("n_rates"), F.count("at").alias("times"),
        F.sum(F.hour("at") * 60 + F.minute("at")).alias("minutes"), F.min(F.to_date("at")).cast("string").alias("first_day"), F.sum("n").alias("quantity"))


PARSERS_SQL = """
WITH x AS (SELECT l_linenumber, CAST(l_quantity AS INTEGER) AS q, CAST(round(l_extendedprice * 100) AS BIGINT) AS c, CAST(round(l_discount * 100) AS INTEGER) AS d,
  l_orderkey % 1440 AS m, l_shipdate, l_orderkey % 7 AS k FROM lineitem)
SELECT l_linenumber, CAST(sum(CASE k WHEN 0 THEN NULL WHEN 2 THEN NULL WHEN 1 THEN -c ELSE c END) AS BIGINT) AS cents,
  CAST(count(CASE WHEN k NOT IN (0, 2) THEN 1 END) AS BIGINT) AS amounts, CAST(sum(CASE WHEN k <> 3 THEN d END) AS DOUBLE) AS rates,
  CAST(count(CASE WHEN k <> 3 THEN 1 END) AS BIGINT) AS n_rates, CAST(count(CASE WHEN k <> 4 THEN 1 END) AS BIGINT) AS times,
  CAST(sum(CASE WHEN k <> 4 THEN m END) AS BIGINT) AS minutes, CAST(CAST(min(CASE WHEN k <> 4 THEN l_shipdate END) AS DATE) AS VARCHAR) AS first_day,
  CAST(sum(CASE WHEN k = 5 THEN 0 ELSE q END) AS BIGINT) AS quantity
FROM x GROUP BY 1
"""


# --- B19, C2, C4 ---------------------------------------------------------------------------------------------------
def filled(spark, sf) -> DataFrame:
    """Parts and what was ever sold of them in one store under one brand; unsold ones are filled with zeros."""
    sold = brand_filter(store_filter(regular(load_sales(spark, sf)), "ASIA"), "brand#12")
    sums = sold.groupBy(F.regexp_extract("product", r"#(\d+)", 1).cast("bigint").alias("p_partkey")).agg(F.sum("quantity").alias("units"), F.max("actual_revenue").alias("best"),
                                                                                                         F.max("deal_type").alias("deal"))
    parts = read_table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    return fill_numeric(parts.join(sums, "p_partkey", "left"))


FILLED_SQL = oracle(r"""
, s AS (SELECT CAST(regexp_extract(product, '#(\d+)', 1) AS BIGINT) AS p_partkey, sum(quantity) AS units, max(actual_revenue) AS best, max(deal_type) AS deal
        FROM regular WHERE store_clean = 'ASIA' AND upper(brand_clean) = 'BRAND#12' GROUP BY 1)
SELECT part.p_partkey, p_brand AS brand, CAST(coalesce(units, 0) AS BIGINT) AS units, coalesce(best, 0.0) AS best, deal FROM part LEFT JOIN s ON s.p_partkey = part.p_partkey
""")


# --- D1: each line in three files; the latest dated one wins, undated ones last, then the file's name ------------------
FILES = [("b early.csv", "2001-01-31", 1), ("a late.csv", "2002-01-31", 3), ("c undated.csv", None, 1), ("a early too.csv", "2001-01-31", 2)]


def latest_file(spark, sf) -> DataFrame:
    lines = testmodel.raw_lines(spark, sf).drop("file_name", "file_end")
    # a file holds one in `n` receipts
    held = F.filter(F.array(*(F.struct(F.lit(f).alias("file_name"), F.lit(e).cast("date").alias("file_end"), F.lit(n).alias("n")) for f, e, n in FILES)),
                    lambda f: F.pmod(F.col("receipt_id").cast("bigint"), f["n"]) == 0)
    # of a copy only what D1 orders by and the result adds up: the texts of a line are no part of it
    copies = lines.select(*DEDUP_KEY, "row_seq", "actual_revenue", F.inline(held)).drop("n").withColumn("actual_revenue", F.col("actual_revenue") + F.length("file_name"))
    return dedup_latest_file(copies).groupBy("file_name").agg(F.count(F.lit(1)).alias("lines"), (F.sum(cents("actual_revenue")) / 100).alias("revenue"))


_FILE_ROWS = ", ".join(f"({_q(f)}, {f'DATE {_q(e)}' if e else 'CAST(NULL AS DATE)'}, {n})" for f, e, n in FILES)
D1_SQL = oracle(f"""
, files(f, e, n) AS (VALUES {_FILE_ROWS}),
copies AS (SELECT _raw.* EXCLUDE (file_name, file_end), f, e, round((actual_revenue + length(f)) * 100) AS c FROM _raw JOIN files ON CAST(receipt_id AS BIGINT) % n = 0),
won AS (SELECT * FROM copies QUALIFY row_number() OVER (PARTITION BY receipt_id, product, completed_at
  ORDER BY e DESC NULLS LAST, f, l_linenumber, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) = 1)
SELECT f AS file_name, CAST(count(*) AS BIGINT) AS lines, sum(c) / 100 AS revenue FROM won GROUP BY 1
""")


# --- A4, A5: the reports on staff and customer exports ---------------------------------------------------------------
STAFF_COLUMNS = {"Name": "budtender", "Store": "store", "Average Cart Value (pre-tax)": "avg_cart_value", "Total Units Sold": "units_sold",
                 "Average Units Per Cart": "avg_units_per_cart", "Number of Carts": "num_transactions", "Sales (pre-tax)": "total_sales",
                 "% of Sales Discounted": "pct_sales_discounted", "Customers Enrolled In Loyalty": "loyalty_enrollments"}
CUSTOMER_COLUMNS = {"ID": "customer_id", "Name": "customer_name", "Groups": "groups", "Loyal": "is_loyal", "Loyalty Points": "loyalty_points"}


def scores_from_export(spark, sf) -> DataFrame:
    sales = load_sales(spark, sf)
    table = P.staff_table(sales).withColumn("total_sales", F.concat(F.lit("$"), F.format_number("total_sales", 2))).withColumn(
        "pct_sales_discounted", F.concat(F.col("pct_sales_discounted").cast("string"), F.lit("%")))
    staff = pos_csv.read_staff_csv(spark, inbox.write_table_inbox(table, STAFF_COLUMNS, "bt sales"))
    whole = ("num_transactions", "units_sold", "loyalty_enrollments")
    return P.sales_scores(staff.withColumns({c: F.col(c).cast("bigint") for c in whole}), sales)


def customers_from_export(spark, sf) -> DataFrame:
    folder = inbox.write_table_inbox(load_customer_attributes(spark, sf), CUSTOMER_COLUMNS, "customer list")
    return I.customer_metrics(regular(load_sales(spark, sf)), pos_csv.read_customer_csv(spark, folder)).select(*I.CUST_OUT)


ENTRIES = {
    "A4_scores_from_export": (scores_from_export, P2_SQL),
    "A5_customers_from_export": (customers_from_export, f"SELECT * REPLACE (nullif(groups, '') AS groups) FROM ({I1_SQL})"),
    "B1_B3_B9_parsers": (parsers, PARSERS_SQL),
    "B14_B15_B22_house_brands": (house_brands, HOUSE_SQL),
    "B19_C2_C4_filled_filters": (filled, FILLED_SQL),
    "D1_latest_file": (latest_file, D1_SQL),
}
