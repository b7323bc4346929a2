"""Customers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.clean import customer_segment
from tillpoint.functions.expr import discount_rate, isum, msum, r, safe_div
from tillpoint.plans.curate import materialize


def customer_metrics(regular: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """Per customer receipts, spend, units, primary store (mode), mean receipt value, segment.

    The lines are hash-aggregated once, to a row a customer, receipt and store; names (of the first receipt), sums and the
    stores' line counts for the mode all come from that table. Null customers are dropped as in a pandas group-by.
    """
    base = regular.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "receipt_id", "customer_name", "store_clean").agg(
        F.min("completed_at").alias("completed_at"), F.count(F.lit(1)).alias("lines"), msum("actual_revenue").alias("actual_revenue"),
        msum("discounts").alias("discounts"), isum("quantity").alias("quantity"))
    base = materialize(regular.sparkSession, base, "customer-receipts", None)
    sums = base.groupBy("customer_id").agg(
        F.countDistinct("receipt_id").alias("transactions"), msum("actual_revenue").alias("total_spent"),
        msum("discounts").alias("total_discounts"), isum("quantity").alias("total_units"), F.min("completed_at").alias("_first"))
    # the first receipt's name: ties at one time go to the least receipt, so few rows are ordered
    first = base.select("customer_id", F.col("completed_at").alias("_first"), "receipt_id", "customer_name").join(
        sums.select("customer_id", "_first"), ["customer_id", "_first"]).groupBy("customer_id").agg(F.min_by("customer_name", "receipt_id").alias("customer_name"))
    sums = sums.drop("_first").join(first, "customer_id", "left")
    sc = base.where(F.col("store_clean").isNotNull()).groupBy("customer_id", "store_clean").agg(
        F.sum("lines").alias("_n"))
    w = Window.partitionBy("customer_id").orderBy(F.desc("_n"), "store_clean")
    mode = sc.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).select(
        "customer_id", F.col("store_clean").alias("primary_store"))
    # mean of per-receipt totals == total spend / distinct receipts (no extra aggregation)
    out = sums.withColumn("avg_transaction", r(safe_div(F.col("total_spent"), F.col("transactions")), 2))
    out = out.join(mode, "customer_id", "left")
    out = out.withColumn("primary_store", F.coalesce(F.col("primary_store"), F.lit("Unknown")))
    out = out.withColumn("discount_rate", discount_rate(F.col("total_discounts"), F.col("total_spent")))
    if attributes is not None:
        out = out.join(attributes.select("customer_id", "groups", "is_loyal"), "customer_id", "left")
    else:
        out = out.withColumn("groups", F.lit("")).withColumn("is_loyal", F.lit("No"))
    return out.withColumn("segment", customer_segment(F.col("groups")))


def customer_summary(regular: DataFrame, attributes: DataFrame | None = None) -> DataFrame:
    """One-row customer KPIs."""
    g = regular.agg(msum("actual_revenue").alias("total_revenue"), msum("discounts").alias("total_discounts"),
                    F.countDistinct("receipt_id").alias("total_transactions"),
                    F.countDistinct("customer_id").alias("total_customers"))
    if attributes is not None:
        loyal = (regular.where(F.col("customer_id").isNotNull()).select("customer_id").distinct()
                 .join(attributes.where(F.col("is_loyal") == "Yes").select("customer_id"), "customer_id", "left_semi")
                 .agg(F.count(F.lit(1))).scalar())
    else:
        loyal = F.lit(0)
    return g.select(
        "total_customers", "total_revenue",
        r(safe_div(F.col("total_revenue"), F.col("total_customers")), 2).alias("revenue_per_customer"),
        r(safe_div(loyal, F.col("total_customers")) * 100, 1).alias("loyalty_rate"),
        "total_transactions",
        r(safe_div(F.col("total_revenue"), F.col("total_transactions")), 2).alias("avg_transaction"),
        "total_discounts",
        r(safe_div(F.col("total_discounts"), F.col("total_revenue") + F.col("total_discounts")) * 100, 1)
        .alias("discount_rate"))


def segment_summary(cust: DataFrame, regular: DataFrame) -> DataFrame:
    """Customers and revenue by segment with shares."""
    total_rev = regular.agg(msum("actual_revenue")).scalar()
    cust = materialize(cust.sparkSession, cust.select("segment", "total_spent", "total_discounts"), "segments", None)
    total_cust = cust.agg(F.count(F.lit(1))).scalar()
    g = cust.groupBy("segment").agg(F.count(F.lit(1)).alias("customers"), msum("total_spent").alias("total_revenue"),
                                    msum("total_discounts").alias("total_discounts"))
    return g.select(
        "segment", "customers", "total_revenue", "total_discounts",
        r(F.col("total_revenue") / F.col("customers"), 2).alias("rev_per_cust"),
        discount_rate(F.col("total_discounts"), F.col("total_revenue")).alias("discount_rate"),
        r(F.col("customers") / total_cust * 100, 1).alias("pct_of_cust"),
        F.when(total_rev > 0, r(F.col("total_revenue") / total_rev * 100, 1)).otherwise(F.lit(0.0)).alias("pct_of_rev"))


CUST_OUT = ["customer_id", "customer_name", "transactions", "total_spent", "total_discounts", "total_units",
            "primary_store", "avg_transaction", "discount_rate", "groups", "is_loyal", "segment"]


def top_customers(cust: DataFrame, n: int = 50) -> DataFrame:
    """I4: top N customers by spend (ties: customer id)."""
    w = Window.orderBy(F.desc("total_spent"), "customer_id")
    return cust.select(*CUST_OUT, F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def top_customers_by_store(cust: DataFrame, n: int = 50) -> DataFrame:
    """Top N customers per primary store."""
    w = Window.partitionBy("primary_store").orderBy(F.desc("total_spent"), "customer_id")
    return (cust.where(F.col("primary_store") != "Unknown")
            .select(*CUST_OUT, F.row_number().over(w).alias("rank")).where(F.col("rank") <= n))
