"""Brand reports (R1-R8, R14), computed for all brands at once, filtered later.

Store grids use the store list as a scalar array (stores are a small
dimension: a handful to a few thousand) exploded per brand, not a cross join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.expr import isum, msum, r, safe_div


def _b(regular: DataFrame) -> DataFrame:
    return regular.where(F.col("brand_clean").isNotNull()).withColumn("brand", F.col("brand_clean"))


def top_products(regular: DataFrame, n: int = 25) -> DataFrame:
    """Each brand's top products by revenue."""
    g = _b(regular).where(F.col("product").isNotNull()).groupBy("brand", "product").agg(
        isum("quantity").alias("units"), msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"))
    w = Window.partitionBy("brand").orderBy(F.desc("revenue"), "product")
    return g.select("*", r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 1).alias("margin"),
                    F.row_number().over(w).alias("rank")).where(F.col("rank") <= n)


def products_by_store(regular: DataFrame, n: int = 15) -> DataFrame:
    """R2: each brand's top products per store."""
    g = (_b(regular).where(F.col("product").isNotNull() & F.col("store_clean").isNotNull())
         .groupBy("brand", F.col("store_clean").alias("store"), "product")
         .agg(isum("quantity").alias("units"), msum("actual_revenue").alias("revenue")))
    w = Window.partitionBy("brand", "store").orderBy(F.desc("revenue"), "product")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def brand_store_summary(regular: DataFrame) -> DataFrame:
    """Per brand and store revenue, margin and discount rate."""
    g = (_b(regular).where(F.col("store_clean").isNotNull()).groupBy("brand", F.col("store_clean").alias("store"))
         .agg(msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"), isum("quantity").alias("units"),
              msum("discounts").alias("discounts")))
    return g.select("*", r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 1).alias("margin"),
                    r(safe_div(F.col("discounts"), F.col("revenue") + F.col("discounts")) * 100, 1).alias("discount_rate"))


def _all_stores(regular: DataFrame):
    return regular.where(F.col("store_clean").isNotNull()).agg(F.array_sort(F.collect_set("store_clean"))).scalar()


def distribution_scorecard(regular: DataFrame) -> DataFrame:
    """Every brand x every store: carried?, SKU count, revenue, units, share of the store."""
    stores = _all_stores(regular)
    brands = _b(regular).select("brand").distinct()
    grid = brands.select("brand", F.explode(stores).alias("store"))
    bs = (_b(regular).where(F.col("store_clean").isNotNull()).groupBy("brand", F.col("store_clean").alias("store"))
          .agg(F.countDistinct("product").alias("sku_count"), msum("actual_revenue").alias("revenue"),
               isum("quantity").alias("units")))
    st = (regular.where(F.col("store_clean").isNotNull()).groupBy(F.col("store_clean").alias("store"))
          .agg(msum("actual_revenue").alias("store_total_revenue")))
    x = grid.join(bs, ["brand", "store"], "left").join(st, "store", "left")
    carried = F.col("revenue").isNotNull()
    return x.select("brand", "store", carried.alias("carries_brand"),
                    F.coalesce(F.col("sku_count"), F.lit(0)).alias("sku_count"),
                    F.coalesce(F.col("revenue"), F.lit(0.0)).alias("revenue"),
                    F.coalesce(F.col("units"), F.lit(0)).alias("units"), "store_total_revenue",
                    F.when(carried, r(safe_div(F.col("revenue"), F.col("store_total_revenue")) * 100, 1))
                    .otherwise(F.lit(0.0)).alias("brand_share_pct"))


def store_gaps(regular: DataFrame, min_demand: float = 0.0, of: str = "brand_clean") -> DataFrame:
    """(a) brand absent from a store whose demand in a brand category is > 0;
    (b) brand present at the store but not in that category, demand > ``min_demand`` (fixed.GAP_MIN_DEMAND
    for the usual report). ``of`` names another column whose gaps are asked for, such as the product.
    """
    stores = _all_stores(regular)
    b = regular.where(F.col(of).isNotNull()).withColumn("brand", F.col(of)).where(F.col("category_clean").isNotNull())
    bc = b.select("brand", F.col("category_clean").alias("category")).distinct()
    bs = b.where(F.col("store_clean").isNotNull()).select("brand", F.col("store_clean").alias("store")).distinct()
    bsc = b.where(F.col("store_clean").isNotNull()).select("brand", F.col("store_clean").alias("store"),
                                                         F.col("category_clean").alias("category")).distinct()
    demand = (regular.where(F.col("store_clean").isNotNull() & F.col("category_clean").isNotNull())
              .groupBy(F.col("store_clean").alias("store"), F.col("category_clean").alias("category"))
              .agg(msum("actual_revenue").alias("category_revenue_at_store")))
    grid = bc.select("brand", "category", F.explode(stores).alias("store"))
    cand = grid.join(bsc, ["brand", "store", "category"], "left_anti")
    cand = cand.join(bs.withColumn("_present", F.lit(True)), ["brand", "store"], "left")
    x = cand.join(demand, ["store", "category"])
    present = F.coalesce(F.col("_present"), F.lit(False))
    x = x.where((~present & (F.col("category_revenue_at_store") > 0)) |
                (present & (F.col("category_revenue_at_store") > min_demand)))
    return x.select("brand", "store", "category", "category_revenue_at_store",
                    F.when(present, F.lit("Category not carried at this store")).otherwise(F.lit("Brand not carried"))
                    .alias("opportunity"))


def store_coverage(regular: DataFrame) -> DataFrame:
    """Stores present / missing per brand (sorted arrays) and n of m."""
    stores = _all_stores(regular)
    g = _b(regular).where(F.col("store_clean").isNotNull()).groupBy("brand").agg(
        F.array_sort(F.collect_set("store_clean")).alias("stores_present"))
    return g.select("brand", "stores_present", F.array_except(stores, F.col("stores_present")).alias("stores_missing"),
                    F.size("stores_present").alias("n_present"), F.size(stores).alias("n_stores"))


def _product_agg(regular: DataFrame) -> DataFrame:
    g = _b(regular).where(F.col("product").isNotNull()).groupBy("brand", "product").agg(
        isum("quantity").alias("units"), msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"),
        msum("net_profit").alias("profit"), F.countDistinct("store_clean").alias("stores"),
        F.countDistinct("receipt_id").alias("transactions"))
    return g.withColumn("margin", F.coalesce(r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue"), None)
                                                * 100, 1), F.lit(0.0)))


def product_mix(regular: DataFrame) -> DataFrame:
    """Top 20 products per brand by revenue; bottom 10 when the brand has more than 20."""
    g = _product_agg(regular)
    wd = Window.partitionBy("brand").orderBy(F.desc("revenue"), "product")
    g = g.withColumn("rank", F.row_number().over(wd)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("brand")))
    top = g.where(F.col("rank") <= 20).withColumn("section", F.lit("top"))
    bottom = g.where((F.col("_n") > 20) & (F.col("rank") > F.col("_n") - 10)).withColumn("section", F.lit("bottom"))
    return top.unionByName(bottom).drop("_n")


def sku_expansion(regular: DataFrame, n: int = 10) -> DataFrame:
    """Products sold in 2+ but not all of the brand's stores; top N by revenue; missing stores."""
    g = _product_agg(regular)
    b = _b(regular).where(F.col("store_clean").isNotNull())
    bstores = b.groupBy("brand").agg(F.array_sort(F.collect_set("store_clean")).alias("_bs"))
    pstores = b.where(F.col("product").isNotNull()).groupBy("brand", "product").agg(
        F.array_sort(F.collect_set("store_clean")).alias("_ps"))
    x = g.join(bstores, "brand").join(pstores, ["brand", "product"])
    x = x.where((F.col("stores") >= 2) & (F.col("stores") < F.size("_bs")))
    w = Window.partitionBy("brand").orderBy(F.desc("revenue"), "product")
    x = x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return x.select("brand", "rank", "product", F.col("stores").alias("current_stores"),
                    F.size("_bs").alias("total_stores"), F.array_except("_bs", "_ps").alias("missing_stores"), "revenue")


def min_rows_guard(regular: DataFrame, min_rows: int = 5) -> DataFrame:
    """Brands with at least ``min_rows`` lines (the others get no report)."""
    return _b(regular).groupBy("brand").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= min_rows)
