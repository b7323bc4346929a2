"""Metadata queries."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.expr import count_if, month_label, msum
from tillpoint.plans.prefix import global_running


def stores(sales: DataFrame) -> DataFrame:
    """Distinct store names."""
    return sales.where(F.col("store_clean").isNotNull()).select(F.col("store_clean").alias("store")).distinct()


def categories(sales: DataFrame) -> DataFrame:
    """Distinct categories."""
    return sales.where(F.col("category_clean").isNotNull()).select(
        F.col("category_clean").alias("category")).distinct()


def brands(regular: DataFrame, top_n: int | None = None) -> DataFrame:
    """Brands by regular revenue, descending (ties by name); optional top N."""
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand")).agg(
        msum("actual_revenue").alias("revenue"))
    order = [F.desc("revenue"), F.col("brand")]
    if not top_n:  # all brands are numbered in range partitions, not in one task
        return global_running(g, order, index_col="position").withColumn("position", F.col("position").cast("int"))
    return g.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") <= top_n)


def periods_available(sales: DataFrame) -> DataFrame:
    """Months with data and their labels."""
    return sales.select("year", "month").distinct().select(
        "year", "month", month_label(F.col("year"), F.col("month")).alias("label"))


def row_counts(sales: DataFrame) -> DataFrame:
    """E5: one-row health counts."""
    return sales.agg(
        F.count(F.lit(1)).alias("total_rows"),
        count_if(F.col("transaction_type") == "REGULAR").alias("regular_rows"),
        F.countDistinct("store_clean").alias("stores"),
        F.countDistinct("brand_clean").alias("brands"),
        F.countDistinct("year", "month").alias("periods"),
    )


def date_range(regular: DataFrame) -> DataFrame:
    """First and last sale date of regular rows."""
    return regular.agg(F.min("sale_date").cast("string").alias("first_date"),
                       F.max("sale_date").cast("string").alias("last_date"))
