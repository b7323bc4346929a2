"""Deals and promotions."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.expr import cents, discount_rate, isum, isum_if, msum, r, safe_div

SPLIT_COLS = ["revenue", "discounts", "quantity", "cost", "profit", "pre_discount_revenue"]


def expand_deals(df: DataFrame, allocation: str = "even") -> DataFrame:
    """G1: one row per (line, deal); values split evenly over the line's deals.

    ``split -> trim -> drop empties -> explode``: a generator inside the
    scan stage, no shuffle. ``allocation='full'`` keeps the whole line value
    on every deal (legacy variant).
    """
    deals = F.filter(F.transform(F.split(F.col("deals_used"), ","), lambda x: F.trim(x)), lambda x: x != "")
    x = df.where(F.col("deals_used").isNotNull()).select(
        "receipt_id", "store_clean", "brand_clean", "category_clean", "actual_revenue", "discounts",
        "quantity", "cost", "net_profit", "pre_discount_revenue", deals.alias("_deals"))
    x = x.where(F.size("_deals") > 0)
    n = F.size("_deals").cast("double") if allocation == "even" else F.lit(1.0)
    return x.select(
        F.explode("_deals").alias("deal_name"), "receipt_id",
        F.col("store_clean").alias("store"), F.col("brand_clean").alias("brand"),
        F.col("category_clean").alias("category"),
        (F.col("actual_revenue") / n).alias("revenue"),
        (F.col("discounts") / n).alias("discounts"),
        (F.col("quantity") / n).alias("quantity"),
        (F.col("cost") / n).alias("cost"),
        (F.col("net_profit") / n).alias("profit"),
        (F.col("pre_discount_revenue") / n).alias("pre_discount_revenue"),
    )


def _split_sum(x: str):
    """Sum of split values, to 4 decimals: added up as whole millionths of a cent, so the order of lines does not matter.

    Their upper and lower 32 bits are added up apart, since the sum of a large table's does not fit in 64.
    """
    v = F.rint(F.col(x) * 1e8).cast("bigint")
    upper, lower = (F.sum(y).cast("decimal(20,0)") for y in (F.shiftright(v, 32), v.bitwiseAND(F.lit((1 << 32) - 1))))
    return r((upper * F.lit(1 << 32).cast("decimal(10,0)") + lower).cast("double") / 1e8, 4)


def _per_deal(x: DataFrame, keys: list[str], uses: str, sums: list) -> DataFrame:
    """(*keys, uses, *sums). Receipts are counted apart: counted with the sums, all of these are shuffled with every receipt."""
    return x.groupBy(*keys).agg(F.countDistinct("receipt_id").alias(uses)).join(x.groupBy(*keys).agg(*sums), keys)


def _deal_sums() -> list:
    # split values are sums of fractions of cents: shown to 4 decimals
    return [
        _split_sum("quantity").alias("units"),
        _split_sum("revenue").alias("revenue"),
        _split_sum("discounts").alias("discounts"),
        _split_sum("cost").alias("cost"),
        _split_sum("profit").alias("profit"),
        _split_sum("pre_discount_revenue").alias("pre_discount_revenue"),
    ]


def _deal_ratios() -> list:
    return [
        r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 1).alias("margin"),
        discount_rate(F.col("discounts"), F.col("revenue")).alias("avg_discount"),
    ]


def deal_summary(regular: DataFrame, top_n: int | None = 50) -> DataFrame:
    """Per deal; ranked by distinct receipts (ties by name); top N."""
    g = _per_deal(expand_deals(regular), ["deal_name"], "times_used", _deal_sums())
    out = g.select("*", *_deal_ratios())
    if top_n:
        w = Window.orderBy(F.desc("times_used"), "deal_name")
        out = out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
    return out


def deal_type_summary(regular: DataFrame) -> DataFrame:
    """Per deal type."""
    g = regular.where(F.col("deal_type").isNotNull()).groupBy("deal_type").agg(
        F.countDistinct("receipt_id").alias("transactions"), isum("quantity").alias("units"),
        msum("pre_discount_revenue").alias("full_price_revenue"), msum("actual_revenue").alias("actual_revenue"),
        msum("discounts").alias("discounts"), msum("cost").alias("cost"), msum("net_profit").alias("net_profit"))
    return g.select("*", discount_rate(F.col("discounts"), F.col("actual_revenue")).alias("discount_rate"),
                    r(safe_div(F.col("actual_revenue") - F.col("cost"), F.col("actual_revenue")) * 100, 1)
                    .alias("margin"))


def deal_summary_by_store(regular: DataFrame, top_n: int = 10) -> DataFrame:
    """Top N deals per store (WindowGroupLimit on row_number)."""
    g = _per_deal(expand_deals(regular).where(F.col("store").isNotNull()), ["store", "deal_name"], "times_used", _deal_sums()[:5])
    g = g.select("store", "deal_name", "times_used", "units", "revenue", "discounts", "cost",
                 r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 1).alias("margin"))
    w = Window.partitionBy("store").orderBy(F.desc("times_used"), "deal_name")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)


def promo_lift(regular: DataFrame) -> DataFrame:
    """Discounted vs full-price units per active sale day, per brand."""
    fp, d = ~F.col("has_discount"), F.col("has_discount")
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand")).agg(
        F.countDistinct(F.when(fp, F.col("sale_date"))).alias("_fp_days"),
        F.countDistinct(F.when(d, F.col("sale_date"))).alias("_d_days"),
        isum_if(fp, "quantity").alias("_fp_units"), isum_if(d, "quantity").alias("_d_units"),
        F.sum(F.when(fp, cents("actual_revenue"))).alias("_fp_rev_c"),
        F.sum(F.when(d, cents("actual_revenue"))).alias("_d_rev_c"),
    )
    fp_days = F.when(F.col("_fp_days") == 0, 1).otherwise(F.col("_fp_days"))
    d_days = F.when(F.col("_d_days") == 0, 1).otherwise(F.col("_d_days"))
    fp_upd = safe_div(F.col("_fp_units"), fp_days)
    d_upd = safe_div(F.col("_d_units"), d_days)
    fp_rev = F.coalesce(F.col("_fp_rev_c"), F.lit(0)).cast("double") / 100.0
    d_rev = F.coalesce(F.col("_d_rev_c"), F.lit(0)).cast("double") / 100.0
    return g.select(
        "brand",
        r(fp_upd, 2).alias("fp_units_per_day"),
        r(d_upd, 2).alias("disc_units_per_day"),
        F.when(fp_upd > 0, r(safe_div(d_upd - fp_upd, fp_upd) * 100, 1)).alias("lift_pct"),
        r(safe_div(fp_rev, F.col("_fp_units")), 2).alias("fp_avg_revenue_per_unit"),
        r(safe_div(d_rev, F.col("_d_units")), 2).alias("disc_avg_revenue_per_unit"),
    )


def promo_effectiveness(regular: DataFrame, top_n: int = 20) -> DataFrame:
    """Per brand x deal uses, margin, depth; top N per brand."""
    g = _per_deal(expand_deals(regular).where(F.col("brand").isNotNull()), ["brand", "deal_name"], "uses",
                  [_split_sum(x).alias(n) for x, n in (("revenue", "revenue"), ("discounts", "discounts"), ("quantity", "units"), ("cost", "cost"))])
    g = g.select("*", r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue")) * 100, 1).alias("margin"),
                 discount_rate(F.col("discounts"), F.col("revenue")).alias("discount_depth"))
    w = Window.partitionBy("brand").orderBy(F.desc("uses"), "deal_name")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_n)
