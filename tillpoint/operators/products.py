"""Product intelligence (L1-L4)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import cents, isum, msum, r, safe_div
from tillpoint.plans.curate import materialize
from tillpoint.plans.prefix import global_running


def product_facts(regular: DataFrame, dead_days: int = fixed.DEAD_STOCK_DAYS, trend_days: int = fixed.VELOCITY_WINDOW_DAYS) -> DataFrame:
    """What L1, L2 (by product) and L3 take from the facts, for those numbers of days: a row a product, from one a product and store.

    Stores are counted as rows, since distinct counts would have every line shuffled once for each.
    """
    max_date = regular.agg(F.max("sale_date")).scalar()
    rs, ps = F.date_sub(max_date, trend_days), F.date_sub(max_date, 2 * trend_days)
    rec = F.col("sale_date") >= rs
    pri = (F.col("sale_date") >= ps) & (F.col("sale_date") < rs)
    sums = {"profit": F.sum(cents("net_profit")), "revenue": F.sum(cents("actual_revenue")), "cost": F.sum(cents("cost")), "units": F.sum("quantity"),
            "_ru": F.sum(F.when(rec, F.col("quantity"))), "_pu": F.sum(F.when(pri, F.col("quantity")))}
    least = {"brand": F.col("brand_clean"), "category": F.col("category_clean"), "_rbrand": F.when(rec, F.col("brand_clean")),
             "_rcategory": F.when(rec, F.col("category_clean"))}
    by_store = regular.where(F.col("product").isNotNull()).groupBy("product", "store_clean").agg(
        *(v.alias(k) for k, v in sums.items()), *(F.min(v).alias(k) for k, v in least.items()), F.max("sale_date").alias("_last"))
    g = by_store.groupBy("product").agg(*(F.sum(k).alias(k) for k in sums), *(F.min(k).alias(k) for k in least), F.max("_last").alias("_last"),
                                        *_store_counts(F.date_sub(max_date, dead_days)))
    money = {k: F.coalesce(k, F.lit(0)).cast("double") / 100.0 for k in ("profit", "revenue", "cost")}
    return g.withColumns({**money, "units": F.coalesce("units", F.lit(0)).cast("long")})


def _store_counts(cutoff) -> list:
    """The stores of a product, and those that sold it since `cutoff`, from its rows a store."""
    return [F.count(F.when(F.col("_last") >= cutoff, F.col("store_clean"))).alias("stores_active"), F.count("store_clean").alias("_stores")]


def product_stats(regular: DataFrame) -> DataFrame:
    return regular.where(F.col("product").isNotNull()).groupBy("product").agg(
        msum("net_profit").alias("profit"), msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"),
        isum("quantity").alias("units"), F.min("brand_clean").alias("brand"), F.min("category_clean").alias("category"))


def abc_classification(regular: DataFrame, products: DataFrame | None = None) -> DataFrame:
    """L1: products by profit (desc, then name); cumulative share of positive profit -> A/B/C/D.

    The running sum is the two-phase prefix sum (range partitions + offsets),
    in integer cents, so it is exact and never funnels through one task.
    """
    ps = product_stats(regular) if products is None else products.select("product", "profit", "revenue", "cost", "units", "brand", "category")
    ps = ps.withColumn("_pos_c", F.greatest(cents("profit"), F.lit(0)))
    total = ps.agg(F.sum("_pos_c")).scalar()
    x = global_running(ps, [F.desc("profit"), F.col("product")], value="_pos_c", index_col="position",
                       running_col="_run_c")
    cum = F.when(total > 0, x["_run_c"] / total * 100).otherwise(F.lit(0.0))
    x = x.withColumn("_cum", cum)
    cls = (F.when((total <= 0) | (F.col("profit") <= 0), "D")
           .when(F.col("_cum") <= fixed.ABC_A_PCT, "A").when(F.col("_cum") <= fixed.ABC_B_PCT, "B")
           .when(F.col("_cum") <= fixed.ABC_C_PCT, "C").otherwise("D"))
    return x.select("position", "product", "brand", "category", "revenue", "profit",
                    r(safe_div(F.col("profit"), F.col("revenue")) * 100, 1).alias("margin"), "units",
                    cls.alias("abc_class"), r(F.col("_cum"), 1).alias("cumulative_pct"))


def _first(df: DataFrame, order: list, top_n: int | None) -> DataFrame:
    """The first ``top_n`` rows (None: all) with their ``rank``."""
    if top_n is None:
        return global_running(df, order, index_col="rank")
    return df.withColumn("rank", F.row_number().over(Window.orderBy(*order))).where(F.col("rank") <= top_n)


def dead_stock(regular: DataFrame, days: int = fixed.DEAD_STOCK_DAYS, top_n: int | None = 50,
               grain: str = "product", products: DataFrame | None = None) -> DataFrame:
    """L2: products with no sale in the last ``days`` days before the last sale date; top N by revenue (None: all).

    With the grain 'product_store' a product is looked at in each store by itself, and ``store`` says which. ``products`` are the
    ``product_facts`` for these days, where the caller has them (grain 'product').
    """
    if grain not in ("product", "product_store"):
        raise ValueError(f"unknown grain: {grain}")
    by_store = grain == "product_store"
    keys = ["product", "store_clean"] if by_store else ["product"]
    max_date = regular.agg(F.max("sale_date")).scalar()
    cutoff = F.date_sub(max_date, days)
    if products is None or by_store:
        g = regular.where(F.col("product").isNotNull())
        g = (g.where(F.col("store_clean").isNotNull()) if by_store else g).groupBy("product", "store_clean").agg(
            F.max("sale_date").alias("_last"), F.sum(cents("actual_revenue")).alias("_c"),
            F.min("brand_clean").alias("brand"), F.min("category_clean").alias("category"))
        g = g.groupBy(*keys).agg(
            F.max("_last").alias("_last"), (F.coalesce(F.sum("_c"), F.lit(0)).cast("double") / 100.0).alias("total_revenue"),
            F.min("brand").alias("brand"), F.min("category").alias("category"), *_store_counts(cutoff))
    else:
        g = products.withColumnRenamed("revenue", "total_revenue")
    d = g.where(F.col("_last") < cutoff)
    d = _first(d, [F.desc("total_revenue"), *(F.col(k) for k in keys)], top_n)
    return d.select("rank", *(F.col(k).alias(k.removesuffix("_clean")) for k in keys), "brand", "category", F.col("_last").cast("string").alias("last_sale_date"),
                    F.datediff(max_date, F.col("_last")).alias("days_since_sale"), r(F.col("total_revenue"), 2)
                    .alias("total_revenue"), "stores_active",
                    (F.col("_stores") - F.col("stores_active")).alias("stores_inactive"))


def velocity_trends(regular: DataFrame, days: int = fixed.VELOCITY_WINDOW_DAYS, top_n: int | None = 20,
                     products: DataFrame | None = None) -> DataFrame:
    """L3: units/day in the last ``days`` days vs the ``days`` before; top N up and top N down (None: all).

    ``products`` are the ``product_facts`` for these days, where the caller has them.
    """
    max_date = regular.agg(F.max("sale_date")).scalar()
    rs = F.date_sub(max_date, days)
    ps = F.date_sub(max_date, 2 * days)
    rec = F.col("sale_date") >= rs
    pri = (F.col("sale_date") >= ps) & (F.col("sale_date") < rs)
    if products is None:
        g = regular.where(F.col("product").isNotNull() & (F.col("sale_date") >= ps)).groupBy("product").agg(
            F.sum(F.when(rec, F.col("quantity"))).alias("_ru"), F.sum(F.when(pri, F.col("quantity"))).alias("_pu"),
            F.min(F.when(rec, F.col("brand_clean"))).alias("brand"), F.min(F.when(rec, F.col("category_clean")))
            .alias("category"))
    else:
        g = products.select("product", "_ru", "_pu", F.col("_rbrand").alias("brand"), F.col("_rcategory").alias("category"))
    g = g.where(F.col("_ru").isNotNull() & F.col("_pu").isNotNull())
    rv = F.col("_ru") / float(days)
    pv = F.col("_pu") / float(days)
    g = g.select("product", "brand", "category", rv.alias("_rv"), pv.alias("_pv")).where(F.col("_pv") > 0)
    g = g.withColumn("_chg", (F.col("_rv") - F.col("_pv")) / F.col("_pv") * 100)
    up = _first(g.where(F.col("_chg") > 0), [F.desc("_chg"), F.col("product")], top_n).withColumn("direction", F.lit("accelerating"))
    down = _first(g.where(F.col("_chg") < 0), [F.col("_chg"), F.col("product")], top_n).withColumn("direction", F.lit("decelerating"))
    return up.unionByName(down).select("direction", "rank", "product", "brand", "category",
                                       r(F.col("_rv"), 3).alias("recent_velocity"),
                                       r(F.col("_pv"), 3).alias("prior_velocity"),
                                       r(F.col("_chg"), 1).alias("change_pct"))


def product_kpis(regular: DataFrame, dead_n: int | None = None, trend_n: int | None = None) -> DataFrame:
    """L4: product counts, ABC class counts, A revenue share, dead stock and trend counts.

    All dead and trending products count, unless ``dead_n`` and ``trend_n`` limit the lists as the reference does. The facts are added up
    once, into the row a product that all three start from.
    """
    products = materialize(regular.sparkSession, product_facts(regular), "products", None)
    abc = abc_classification(regular, products)
    k = abc.agg(F.count(F.lit(1)).alias("total_products"),
                *[F.count(F.when(F.col("abc_class") == c, 1)).alias(f"{c.lower()}_count") for c in "ABCD"],
                F.sum(F.when(F.col("abc_class") == "A", cents("revenue"))).alias("_ac"),
                F.sum(cents("revenue")).alias("_tc"))
    ds = dead_stock(regular, top_n=dead_n, products=products).agg(F.count(F.lit(1)).alias("n"), F.sum(cents("total_revenue")).alias("c"))
    vt = velocity_trends(regular, top_n=trend_n, products=products).groupBy().agg(F.count(F.when(F.col("direction") == "accelerating", 1)).alias("a"),
                                                F.count(F.when(F.col("direction") == "decelerating", 1)).alias("d"))
    return k.select("total_products", "a_count", "b_count", "c_count", "d_count",
                    r(safe_div(F.coalesce(F.col("_ac"), F.lit(0)), F.col("_tc")) * 100, 1).alias("a_revenue_pct"),
                    ds.select("n").scalar().alias("dead_stock_count"),
                    (F.coalesce(ds.select("c").scalar(), F.lit(0)).cast("double") / 100).alias("dead_stock_revenue"),
                    vt.select("a").scalar().alias("accelerating_count"),
                    vt.select("d").scalar().alias("decelerating_count"))
