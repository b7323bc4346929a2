"""Canonical POS line view over the driver's TPC-H-style tables.

One lineitem becomes one raw sales line with the columns a POS export
carries after the header rename (A1). The mapping is a fixed test model:
all money is integer cents, converted to a two-decimal double at the end.
"""
from __future__ import annotations

from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.plans.dedup import MonthParts, ReceiptParts
from tillpoint.sources.tables import read_table

if TYPE_CHECKING:
    from tillpoint.sources.inbox import MonthFiles

# --- FIXED VALUES: test-model vocabularies --------------------------------
ORDER_TYPES = ["Walk-In", "In-Store", "Online", "Delivery"]
DEALS = [
    "BOGO Small",
    "20% OFF, Veterans - 10% Off",
    "Senior Night",
    "Eighths FOR $25",
    "Mystery Promo",
    "REWARD - 100 Points - Free Pre Roll",
    "2 FOR $30, Happy Hour",
    "MARKOUT",
    "",
    "Points Redemption",
]
SEGMENT_GROUPS = {
    "AUTOMOBILE": "Industry",
    "BUILDING": "Veterans, Locals",
    "FURNITURE": "",
    "HOUSEHOLD": "VIP",
    "MACHINERY": "Medical",
}
TEST_CATEGORY_ALIASES = {"PROMO": "STANDARD"}

#: Suppliers that are handed to all executors (key and two short texts each: about 100 MB).
MOST_SUPPLIERS = 1_000_000


def _lit_array(values):
    return F.array(*[F.lit(v) for v in values])


#: By what the lines of a receipt and product are ordered.
LINE_ORDER = ["l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate"]


def _completed_at():
    hours = ((F.col("o_orderkey") * 7 + 3) % 14 + 8).cast("int")
    return F.timestamp_add("HOUR", hours, F.col("o_orderdate").cast("timestamp_ntz")).alias("completed_at")


def receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(completed_at) of all orders."""
    return read_table(spark, sf_dir, "orders").select(_completed_at())


def raw_lines(spark: SparkSession, sf_dir: str, dealt: MonthParts | ReceiptParts | MonthFiles | None = None) -> DataFrame:
    """Raw sales lines (pre-normalisation) built from the driver tables.

    Joins: parts to the lines' keys and numbers, customers to orders (a quarter of
    the lines), then lines to orders, big-big and after the parts, whatever their
    size: a receipt's lines lie together from there on, so what follows by receipt
    needs no shuffle of its own, and one by month compresses what they share.
    Suppliers last (size decided by AQE, or by their number where lines stay by
    receipt; nation and region are 25 and 5 rows by definition).
    `dealt` leaves the lines by receipt or deals them by month (or file) while they are still
    keys and numbers, before the texts and amounts of a sales line are made of them,
    the receipt's text too; without it lines meet their orders by that text.
    """
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    # a part's own texts are made once a part, not once a line
    category = F.when(F.col("p_partkey") % 2 == 0, F.lower("p_type")).otherwise(F.concat(F.lit(" "), F.col("p_type")))
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", category.alias("p_category"))
    s = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    r = read_table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    # looked up in one array, not joined: a join's estimated size would have suppliers shuffled with the lines, however few
    places = n.join(F.broadcast(r), n.n_regionkey == r.r_regionkey).agg(F.collect_list(F.struct("n_nationkey", "r_name"))).scalar()
    geo = (s.withColumn("_places", places)
           .select("s_suppkey", "s_name", F.inline(F.filter("_places", lambda x: x["n_nationkey"] == F.col("s_nationkey"))))
           .drop("n_nationkey"))

    o = o.join(cu, F.col("o_custkey") == cu.c_custkey, "left").select(
        F.col("o_orderkey").cast("bigint" if dealt else "string").alias("_order"), F.col("o_custkey"), "c_name", _completed_at())
    li = li.join(p, li.l_partkey == p.p_partkey, "left").drop("p_partkey")
    if not dealt:
        li = li.withColumn("receipt_id", F.col("l_orderkey").cast("string"))
    elif isinstance(dealt, ReceiptParts):
        if s.count() <= MOST_SUPPLIERS:  # else they may be shuffled with the lines, and these once more by receipt
            geo = F.broadcast(geo)
        li, o = dealt.gather(li.withColumn("l_orderkey", F.col("l_orderkey").cast("bigint")), "l_orderkey"), dealt.gather(o, "_order")
    df = (li.join(o.hint("merge"), F.col("l_orderkey" if dealt else "receipt_id") == F.col("_order")).drop("_order")
          .join(geo, F.col("l_suppkey") == geo.s_suppkey, "left").drop("s_suppkey"))
    if dealt:
        df = dealt.deal(df, "l_orderkey").withColumn("receipt_id", F.col("l_orderkey").cast("string"))

    cents = F.rint(F.col("l_extendedprice") * 100).cast("long")
    pct = F.rint(F.col("l_discount") * 100).cast("int") * 4
    comp = ((F.col("l_orderkey") + F.col("l_partkey")) % 53) == 0
    df = df.select(
        "*",
        cents.alias("_cents"),
        pct.alias("_pct"),
        comp.alias("_comp"),
    )
    disc = F.when(F.col("_comp"), F.col("_cents") - 50).otherwise(
        F.expr("(_cents * _pct) div 100"))
    df = df.withColumn("_disc", disc)
    actual = F.when(F.col("_comp"), F.lit(50).cast("long")).otherwise(F.col("_cents") - F.col("_disc"))
    df = df.withColumn("_actual", actual)
    df = df.withColumn("_cost", F.expr("(_cents * (40 + l_partkey % 70)) div 100"))

    def money(x):
        return F.col(x).cast("double") / 100.0

    pk = F.col("l_partkey")  # without a part, its texts are null
    product = F.concat(
        F.col("p_name"), F.lit(" #"), pk.cast("string"),
        F.when(pk % 97 == 0, F.lit(" Tester")).otherwise(F.lit("")),
        F.when(pk % 89 == 0, F.lit(" Exit Bag")).otherwise(F.lit("")),
    )
    deals = F.when(F.col("_pct") == 0, F.lit(None).cast("string")).otherwise(
        F.element_at(_lit_array(DEALS), ((F.col("l_orderkey") + F.col("l_partkey")) % 10 + 1).cast("int")))
    out = df.select(
        "receipt_id",
        F.element_at(_lit_array(ORDER_TYPES), (F.col("l_orderkey") % 4 + 1).cast("int")).alias("order_type"),
        F.col("s_name").alias("sold_by"),
        "completed_at",
        F.col("o_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.concat(F.col("r_name"), F.lit(" - RD"), F.col("l_suppkey").cast("string")).alias("store"),
        product.alias("product"),
        F.col("p_category").alias("category"),
        F.concat(F.col("p_brand"), F.lit(" ")).alias("brand"),
        F.col("l_quantity").cast("int").alias("quantity"),
        money("_cents").alias("pre_discount_revenue"),
        money("_disc").alias("discounts"),
        money("_actual").alias("actual_revenue"),
        (F.col("_actual") - F.col("_cost")).cast("double").__truediv__(100.0).alias("net_profit"),
        money("_cost").alias("cost"),
        F.when(F.col("l_quantity") >= 1, F.rint(F.col("_cost") / F.col("l_quantity").cast("int")) / 100.0)
        .alias("cost_per_item"),
        deals.alias("deals_used"),
        F.when(F.col("l_suppkey") % 11 == 0, F.lit("Employee")).alias("inline_discounts"),
        F.lit(None).cast("string").alias("file_name"),
        F.lit(None).cast("date").alias("file_end"),
        F.struct(*LINE_ORDER).alias("row_seq"),
        *(dealt.COLUMNS if dealt else []),
    )
    return out


def customer_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer attribute table (A5 shape) from ``customer``."""
    cu = read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    m = F.create_map(*[F.lit(v) for kv in SEGMENT_GROUPS.items() for v in kv])
    return cu.select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_name").alias("customer_name"),
        F.element_at(m, F.col("c_mktsegment")).alias("groups"),
        F.when(F.col("c_acctbal") > 0, F.lit("Yes")).otherwise(F.lit("No")).alias("is_loyal"),
        F.greatest(F.floor(F.col("c_acctbal")), F.lit(0)).cast("long").alias("loyalty_points"),
    )
