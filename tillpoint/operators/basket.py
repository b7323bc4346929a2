"""Basket analysis (K1-K6)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import cents, isum, r, safe_div


def basket_agg(regular: DataFrame) -> DataFrame:
    """K1: one row per receipt: revenue, items, distinct products, month."""
    return regular.groupBy("receipt_id").agg(
        (F.sum(cents("actual_revenue")).cast("double") / 100).alias("revenue"), isum("quantity").alias("items"),
        F.countDistinct("product").alias("n_products"), F.min("ym").alias("ym"))


def basket_monthly(regular: DataFrame) -> DataFrame:
    """K2: per month mean basket value, mean items, receipts (means = total / receipts, exact)."""
    b = basket_agg(regular)
    g = b.groupBy("ym").agg(F.sum(cents("revenue")).alias("_c"), F.sum("items").alias("_i"),
                            F.count(F.lit(1)).alias("transactions"))
    return g.select(F.expr("ym div 100").alias("year"), (F.col("ym") % 100).alias("month"),
                    F.format_string("%d-%02d", F.expr("ym div 100"), F.col("ym") % 100).alias("label"),
                    r(F.col("_c") / 100 / F.col("transactions"), 2).alias("avg_basket"),
                    r(F.col("_i") / F.col("transactions"), 2).alias("avg_items"), "transactions")


def basket_kpis(regular: DataFrame) -> DataFrame:
    """K3: mean basket value and items, multi-item %, and the last-3 vs prior-3 month trend."""
    b = basket_agg(regular)
    m = basket_monthly(regular).withColumn("k", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("month"))))
    tr = m.agg(F.avg(F.when(F.col("k") <= 3, F.col("avg_basket"))).alias("rec"),
               F.avg(F.when((F.col("k") > 3) & (F.col("k") <= 6), F.col("avg_basket"))).alias("pri"),
               F.count(F.lit(1)).alias("n"))
    chg = (F.col("rec") - F.col("pri")) / F.col("pri") * 100
    trend = tr.select(F.when((F.col("n") >= 6) & (F.col("pri") > 0) & (chg > 5), "growing")
                      .when((F.col("n") >= 6) & (F.col("pri") > 0) & (chg < -5), "shrinking")
                      .otherwise("stable").alias("t")).scalar()
    g = b.agg(F.sum(cents("revenue")).alias("_c"), F.sum("items").alias("_i"), F.count(F.lit(1)).alias("total_baskets"),
              F.count(F.when(F.col("n_products") >= 2, 1)).alias("_multi"))
    return g.select(r(F.col("_c") / 100 / F.col("total_baskets"), 2).alias("avg_basket_value"),
                    r(F.col("_i") / F.col("total_baskets"), 2).alias("avg_items_per_basket"),
                    trend.alias("basket_trend"),
                    r(safe_div(F.col("_multi"), F.col("total_baskets")) * 100, 2).alias("multi_item_basket_pct"),
                    "total_baskets")


def _pair_counts(rp: DataFrame) -> DataFrame:
    a, b = (rp.select("receipt_id", F.col("product").alias(c)) for c in ("product_a", "product_b"))
    pairs = a.join(b, "receipt_id").where(F.col("product_a") < F.col("product_b"))
    return pairs.groupBy("product_a", "product_b").agg(F.count(F.lit(1)).alias("co_purchase_count"))


def product_pairs(regular: DataFrame, top_n: int = 20, seeds: int = 200) -> DataFrame:
    """K4: the top product pairs bought together, over whole receipts.

    A pair is bought at most as often as its rarer product, so products bought in fewer receipts than the
    count of the ``top_n``-th pair cannot matter. That count is bounded from below by the pairs of the
    ``seeds`` most bought products alone; all products with at least that support are then paired. The
    result is exact for receipts of any size; the share is over receipts with two or more products.
    """
    rp = regular.where(F.col("product").isNotNull()).select("receipt_id", "product").distinct()
    n_multi = rp.groupBy("receipt_id").count().agg(F.count(F.when(F.col("count") >= 2, 1))).scalar()
    support = rp.groupBy("product").agg(F.count(F.lit(1)).alias("support"))
    common = support.orderBy(F.desc("support"), "product").limit(seeds).select("product")
    seeded = _pair_counts(rp.join(common, "product", "left_semi")).orderBy(F.desc("co_purchase_count")).limit(top_n)
    # fewer pairs than asked for bound nothing
    bound = seeded.agg(F.when(F.count(F.lit(1)) == top_n, F.min("co_purchase_count")).otherwise(1)).scalar()
    g = _pair_counts(rp.join(support.where(F.col("support") >= bound), "product", "left_semi"))
    wt = Window.orderBy(F.desc("co_purchase_count"), "product_a", "product_b")
    top = g.withColumn("rank", F.row_number().over(wt)).where(F.col("rank") <= top_n)
    return top.select("rank", "product_a", "product_b", "co_purchase_count",
                      r(safe_div(F.col("co_purchase_count"), n_multi) * 100, 2).alias("pct_of_multi_baskets"))


def category_pairs(regular: DataFrame, min_baskets: int = 1) -> DataFrame:
    """K5: category pairs, of all categories unless ``min_baskets`` asks for categories seen in that many receipts.

    Rate = pair count / receipts of category_a. The qualifying category set
    is tiny (categories, not products) and is semi-joined before the self-join.
    """
    rc = regular.where(F.col("category_clean").isNotNull()).select(
        "receipt_id", F.col("category_clean").alias("category")).distinct()
    counts = rc.groupBy("category").agg(F.count(F.lit(1)).alias("baskets"))
    q = counts.where(F.col("baskets") >= min_baskets)
    rq = rc.join(q.select("category"), "category", "left_semi")
    a = rq.select("receipt_id", F.col("category").alias("category_a"))
    b = rq.select("receipt_id", F.col("category").alias("category_b"))
    g = (a.join(b, "receipt_id").where(F.col("category_a") < F.col("category_b"))
         .groupBy("category_a", "category_b").agg(F.count(F.lit(1)).alias("co_purchase_count")))
    g = g.join(q.select(F.col("category").alias("category_a"), "baskets"), "category_a")
    return g.select("category_a", "category_b", "co_purchase_count",
                    r(safe_div(F.col("co_purchase_count"), F.col("baskets")) * 100, 2).alias("co_purchase_rate"))


def receipt_sample(df: DataFrame, fraction: float, seed: int = 42) -> DataFrame:
    """K6: deterministic sample of whole receipts (md5 of receipt id and seed); off unless asked for."""
    digest = F.md5(F.concat(F.coalesce(F.col("receipt_id"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return df.where(F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") < int(fraction * (1 << 32)))
