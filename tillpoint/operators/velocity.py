"""Brand velocity and share (H1-H6), computed for all brands in one job."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.expr import cents, isum, msum, pct_change, r, safe_div


def _bc(regular: DataFrame) -> DataFrame:
    return regular.where(F.col("brand_clean").isNotNull() & F.col("category_clean").isNotNull())


def velocity_metrics(regular: DataFrame) -> DataFrame:
    """H1: units/day and revenue/day over the brand's own inclusive date span."""
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand")).agg(
        (F.datediff(F.max("sale_date"), F.min("sale_date")) + 1).alias("_days"),
        isum("quantity").alias("total_units"), msum("actual_revenue").alias("_rev"),
        F.countDistinct("receipt_id").alias("total_transactions"))
    days = F.greatest(F.col("_days"), F.lit(1))
    return g.select("brand", r(safe_div(F.col("total_units"), days), 2).alias("units_per_day"),
                    r(safe_div(F.col("_rev"), days), 2).alias("revenue_per_day"),
                    r(safe_div(F.col("total_units"), F.col("total_transactions")), 2).alias("avg_units_per_txn"),
                    days.cast("long").alias("days_of_data"), "total_units", "total_transactions")


def _category_totals(regular: DataFrame) -> DataFrame:
    return regular.where(F.col("category_clean").isNotNull()).groupBy(F.col("category_clean").alias("category")).agg(
        isum("quantity").alias("category_units"), msum("actual_revenue").alias("category_revenue"),
        F.countDistinct("brand_clean").alias("brands_in_category"))


def _brand_category(regular: DataFrame) -> DataFrame:
    return _bc(regular).groupBy(F.col("brand_clean").alias("brand"), F.col("category_clean").alias("category")).agg(
        isum("quantity").alias("brand_units"), msum("actual_revenue").alias("brand_revenue"))


def sale_days(regular: DataFrame):
    """Days from the first sale to the last, both included, as a scalar."""
    return regular.agg(F.greatest(F.datediff(F.max("sale_date"), F.min("sale_date")) + 1, F.lit(1))).scalar()


def velocity_by_category(regular: DataFrame, days=None) -> DataFrame:
    """H2: brand units/day vs the category's per-brand average (index x100).

    Days = inclusive span of all regular rows (a scalar subquery). The
    category totals are one row per category, joined on category.
    """
    span = sale_days(regular) if days is None else days
    x = _brand_category(regular).join(_category_totals(regular), "category")
    b_upd = safe_div(F.col("brand_units"), span)
    cat_upd = safe_div(F.col("category_units"), span)
    avg_upd = F.when(F.col("brands_in_category") > 0, safe_div(cat_upd, F.col("brands_in_category"))).otherwise(0.0)
    return x.select(
        "brand", "category", r(b_upd, 2).alias("brand_units_per_day"),
        r(avg_upd, 2).alias("category_avg_units_per_day"),
        F.when(avg_upd > 0, r(safe_div(b_upd, avg_upd) * 100, 1)).otherwise(F.lit(0.0)).alias("velocity_index"),
        r(safe_div(F.col("brand_revenue"), F.col("brand_units")), 2).alias("brand_rev_per_unit"),
        r(safe_div(F.col("category_revenue"), F.col("category_units")), 2).alias("category_rev_per_unit"),
        "brands_in_category")


def share_of_category(regular: DataFrame) -> DataFrame:
    """H3: brand revenue and unit share of each category it sells in."""
    x = _brand_category(regular).join(_category_totals(regular).drop("brands_in_category"), "category")
    return x.select("brand", "category", "brand_revenue", "category_revenue",
                    r(safe_div(F.col("brand_revenue"), F.col("category_revenue")) * 100, 1).alias("revenue_share_pct"),
                    "brand_units", "category_units",
                    r(safe_div(F.col("brand_units"), F.col("category_units")) * 100, 1).alias("units_share_pct"))


def brand_monthly_trend(regular: DataFrame) -> DataFrame:
    """H4: per brand and month, with change vs the brand's previous month present."""
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand"), "ym").agg(
        msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"), isum("quantity").alias("units"),
        F.countDistinct("receipt_id").alias("transactions"), msum("net_profit").alias("profit"))
    m = safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100
    g = g.withColumn("_m", m)
    w = Window.partitionBy("brand").orderBy("ym")
    pr, pu, pm = F.lag("revenue").over(w), F.lag("units").over(w), F.lag("_m").over(w)
    first = F.row_number().over(w) == 1
    return g.select(
        "brand", F.format_string("%d-%02d", F.expr("ym div 100"), F.col("ym") % 100).alias("period"),
        "revenue", "cost", r(F.col("_m"), 1).alias("margin"), "units", "transactions", "profit",
        F.when(~first, r(F.coalesce(pct_change(F.col("revenue"), pr), F.lit(0.0)), 1)).alias("revenue_change_pct"),
        F.when(~first, r(F.coalesce(pct_change(F.col("units"), pu), F.lit(0.0)), 1)).alias("units_change_pct"),
        F.when(~first, r(F.col("_m") - pm, 1)).alias("margin_change_pts"))


def primary_category(regular: DataFrame) -> DataFrame:
    """Each brand's category with the most revenue (ties: category name)."""
    g = _brand_category(regular)
    w = Window.partitionBy("brand").orderBy(F.desc("brand_revenue"), "category")
    return g.withColumn("_k", F.row_number().over(w)).where(F.col("_k") == 1).select("brand", "category")


def share_trend(regular: DataFrame) -> DataFrame:
    """H5: monthly share of the brand's primary category; all category months, missing side 0."""
    cm = (regular.where(F.col("category_clean").isNotNull())
          .groupBy(F.col("category_clean").alias("category"), "ym").agg(msum("actual_revenue").alias("category_revenue")))
    bm = (_bc(regular).groupBy(F.col("brand_clean").alias("brand"), F.col("category_clean").alias("category"), "ym")
          .agg(msum("actual_revenue").alias("brand_revenue")))
    x = primary_category(regular).join(cm, "category").join(bm, ["brand", "category", "ym"], "left")
    br = F.coalesce(F.col("brand_revenue"), F.lit(0.0))
    return x.select("brand", "category", F.format_string("%d-%02d", F.expr("ym div 100"), F.col("ym") % 100).alias("period"),
                    br.alias("brand_revenue"), "category_revenue",
                    r(safe_div(br, F.col("category_revenue")) * 100, 1).alias("share_pct"))


def velocity_rank(regular: DataFrame) -> DataFrame:
    """H6: each brand's position by units within its primary category, and the category's brand count."""
    bc = _brand_category(regular)
    w = Window.partitionBy("category")
    ranked = bc.select("brand", "category",
                       F.row_number().over(w.orderBy(F.desc("brand_units"), "brand")).alias("velocity_rank"),
                       F.count(F.lit(1)).over(w).alias("brands_in_category"))
    return primary_category(regular).join(ranked, ["brand", "category"])
