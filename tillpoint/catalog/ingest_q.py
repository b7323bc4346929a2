"""Catalog: the CSV sources, the stream, published views and sanitising (A1-A10), and slugs (B21), on exports and frames of the driver tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.catalog.base_sql import oracle
from tillpoint.catalog.cube_q import T1_SQL
from tillpoint.catalog.sqlh import MS
from tillpoint.functions.expr import msum
from tillpoint.operators import dashboard as S
from tillpoint.plans import rollup as U
from tillpoint.plans.cube import keyed, sanitize
from tillpoint.plans.curate import curate, load_sales, regular
from tillpoint.plans.publish import publish, read_view
from tillpoint.plans.slugs import brand_slugs
from tillpoint.session import scratch_path
from tillpoint.sources import inbox, pos_csv
from tillpoint.sources.tables import read_table
from tillpoint.sources.testmodel import TEST_CATEGORY_ALIASES
from tillpoint.streaming.ingest import incremental_ingest

#: What a line of the fact table comes back as; an export has no empty text, only missing ones.
LINE = ["receipt_id", "product", "customer_id", "sold_by", "store_clean", "category_clean", "brand_clean", "quantity", "pre_discount_revenue", "discounts",
        "actual_revenue", "net_profit", "cost", "transaction_type", "deal_type"]
LINES_SQL = oracle(f"SELECT {', '.join(LINE)}, CAST(completed_at AS VARCHAR) AS completed_at, nullif(deals_used, '') AS deals_used FROM sales")


def _lines(sales: DataFrame) -> DataFrame:
    return sales.select(*LINE, F.col("completed_at").cast("string").alias("completed_at"), "deals_used")


def csv_roundtrip(spark, sf):
    parsed = pos_csv.read_sales_csv(spark, inbox.write_sales_inbox(spark, sf, gzip=True))
    return _lines(curate(pos_csv.accepted(parsed), TEST_CATEGORY_ALIASES))


def stream_roundtrip(spark, sf):
    folder = inbox.write_sales_inbox(spark, sf, early=True)
    return _lines(incremental_ingest(spark, folder, scratch_path(spark, "ingested"), scratch_path(spark, "ingest-checkpoint"), TEST_CATEGORY_ALIASES, files_per_batch=30))


def load_report(spark, sf):
    # exports lie there packed and are reported by their own names
    report = pos_csv.load_quality(pos_csv.read_sales_csv(spark, inbox.write_sales_inbox(spark, sf, gzip=True, broken=True)))
    return report.withColumn("file_name", F.regexp_replace("file_name", r"\.gz$", ""))


LOAD_SQL = oracle(f"""
, f AS (SELECT 'margin report ' || strftime(date_trunc('month', completed_at), '%Y-%m-%d') || ' ' || strftime(last_day(completed_at), '%Y-%m-%d') || '.csv' AS file_name,
  CAST(receipt_id AS BIGINT) % {inbox.BROKEN_ONE_IN} AS k FROM _raw)
SELECT file_name, CAST(count(*) AS BIGINT) AS rows_read, CAST(count(CASE WHEN k NOT IN (7, 11, 13) THEN 1 END) AS BIGINT) AS rows_kept,
  CAST(count(CASE WHEN k IN (7, 11, 13) THEN 1 END) AS BIGINT) AS rows_refused, CAST(count(CASE WHEN k = 13 THEN 1 END) AS BIGINT) AS refused_quotes,
  CAST(0 AS BIGINT) AS refused_header, CAST(count(CASE WHEN k = 11 THEN 1 END) AS BIGINT) AS refused_width,
  CAST(count(CASE WHEN k = 7 THEN 1 END) AS BIGINT) AS refused_date
FROM f GROUP BY file_name
""")


def published_cube(spark, sf):
    """The cube, as it is read back from a publication of several views."""
    up = U.load_rollup(spark, sf)
    reg = regular(load_sales(spark, sf))
    monthly = S.monthly_groups(reg).select(F.col("month_key").alias("period"), F.lit("all").alias("store"), "revenue", "margin", "full_price_pct")
    stores = S.store_totals(reg).withColumnRenamed("name", "store").withColumn("period", F.lit("all"))
    root = scratch_path(spark, "published")
    publish({"cube": U.cube_from_rollup(up), "monthly": monthly, "stores": stores}, root)
    return read_view(spark, root, "cube")


def nested_documents(spark, sf):
    """Documents with nested maps, arrays and structs whose numbers overflow or are none, sanitised and taken apart again."""
    g = regular(load_sales(spark, sf)).groupBy(F.col("store_clean").alias("store"), "inline_discounts").agg(
        msum("actual_revenue").alias("revenue"), F.count(F.lit(1)).alias("lines"), msum("net_profit").alias("profit"))
    # a power of a negative number is no number, e to the number of lines soon infinite
    entry = F.struct(F.col("inline_discounts").alias("key"), F.struct("revenue", F.pow(-F.col("revenue"), F.lit(0.5)).alias("odd"),
                                                                      F.array(F.exp(F.col("lines").cast("double")), F.col("profit")).alias("pair")).alias("value"))
    documents = g.groupBy("store").agg(F.collect_list(entry).alias("entries")).select("store", keyed("entries").alias("by_discount"))
    clean = sanitize(documents)
    return clean.select("store", F.size("by_discount").alias("n_keys"), F.explode("by_discount").alias("discount", "value")).select(
        "store", "n_keys", "discount", "value.revenue", "value.odd", F.get("value.pair", F.lit(0)).alias("grown"), F.get("value.pair", F.lit(1)).alias("profit"))


NESTED_SQL = oracle(f"""
SELECT store_clean AS store, CAST(1 AS INTEGER) AS n_keys, inline_discounts AS discount, {MS('actual_revenue')} AS revenue, CAST(0 AS DOUBLE) AS odd,
  CASE WHEN count(*) > 709 THEN 0.0 ELSE exp(count(*)) END AS grown, {MS('net_profit')} AS profit
FROM regular WHERE inline_discounts IS NOT NULL GROUP BY 1, 3
""")

#: Brand names that collide: part types as they are, in other case, with marks, and with a number at the end.
NAMES_SQL = ("CASE p_partkey % 5 WHEN 0 THEN p_type WHEN 1 THEN lower(p_type) WHEN 2 THEN p_type || '!' WHEN 3 THEN p_type || ' 2' ELSE ' ' || p_type || '_' || CAST(p_partkey % 4 AS VARCHAR) END")


def slugs(spark, sf):
    parts = read_table(spark, sf, "part").select("p_partkey", F.expr(NAMES_SQL.replace("VARCHAR", "STRING")).alias("name"))
    lines = read_table(spark, sf, "lineitem").select("l_partkey", F.rint(F.col("l_extendedprice") * 100).cast("bigint").alias("c"))
    revenue = lines.join(parts, lines.l_partkey == parts.p_partkey).groupBy("name").agg(F.sum("c").alias("revenue"))
    return brand_slugs(revenue)


SLUG_SQL = f"""
WITH RECURSIVE revenue AS (
  SELECT {NAMES_SQL} AS name, sum(CAST(round(l_extendedprice * 100) AS BIGINT)) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
), base AS (
  SELECT name, row_number() OVER (ORDER BY revenue DESC, name) AS k,
    trim(regexp_replace(regexp_replace(lower(trim(name)), '[^a-z0-9_\\s-]', '', 'g'), '[\\s_]+', '-', 'g'), '-') AS s FROM revenue
), g(k, used) AS (
  SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[])
  UNION ALL
  SELECT b.k, list_append(g.used, CASE WHEN NOT list_contains(g.used, b.s) THEN b.s
    ELSE b.s || '-' || CAST(list_filter(range(2, len(g.used) + 3), lambda x: NOT list_contains(g.used, b.s || '-' || CAST(x AS VARCHAR)))[1] AS VARCHAR) END)
  FROM g JOIN base b ON b.k = g.k + 1
)
SELECT base.name AS name, g.used[g.k] AS slug FROM g JOIN base USING (k)
"""

ENTRIES = {
    "A1_csv_roundtrip": (csv_roundtrip, LINES_SQL),
    "A7_load_report": (load_report, LOAD_SQL),
    "A8_stream_roundtrip": (stream_roundtrip, LINES_SQL),
    "A9_published_views": (published_cube, T1_SQL),
    "A10_sanitize_nested": (nested_documents, NESTED_SQL),
    "B21_brand_slugs": (slugs, SLUG_SQL),
}
