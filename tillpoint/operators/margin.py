"""Margin marts (F1-F7): conditional aggregation, one pass per grain."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import isum, isum_if, msum, msum_if, r, safe_div, discount_rate



def _fp():
    return ~F.col("has_discount")


def _disc():
    return F.col("has_discount")


def split_aggs() -> list:
    """Full-price vs discounted sums (the pivot written as conditional sums)."""
    return [
        isum_if(_fp(), "quantity").alias("full_price_units"),
        msum_if(_fp(), "actual_revenue").alias("full_price_sales"),
        msum_if(_fp(), "cost").alias("full_price_cost"),
        isum_if(_disc(), "quantity").alias("discounted_units"),
        msum_if(_disc(), "actual_revenue").alias("discounted_sales"),
        msum_if(_disc(), "cost").alias("discounted_cost"),
        isum("quantity").alias("total_units"),
        msum("actual_revenue").alias("total_revenue"),
        msum("cost").alias("total_cost"),
        msum("net_profit").alias("net_profit"),
        F.count(F.when(_fp(), 1)).alias("_n_fp"),
        F.count(F.when(_disc(), 1)).alias("_n_disc"),
    ]


def split_ratios(null_absent: bool) -> list:
    """Ratios over the split sums; 0 when a denominator is 0 (fillna 0).

    ``null_absent`` (F1): a side with no lines at all has a null margin.
    """
    rev = F.col("total_revenue")
    fp_m = r(safe_div(F.col("full_price_sales") - F.col("full_price_cost"), F.col("full_price_sales")) * 100, 1)
    d_m = r(safe_div(F.col("discounted_sales") - F.col("discounted_cost"), F.col("discounted_sales")) * 100, 1)
    if null_absent:
        fp_m = F.when(F.col("_n_fp") > 0, fp_m)
        d_m = F.when(F.col("_n_disc") > 0, d_m)
    return [
        r(safe_div(F.col("full_price_sales"), rev) * 100, 1).alias("pct_full_price"),
        r(safe_div(F.col("discounted_sales"), rev) * 100, 1).alias("pct_discounted"),
        fp_m.alias("full_price_margin"),
        d_m.alias("discounted_margin"),
        r(safe_div(rev - F.col("total_cost"), rev) * 100, 1).alias("blended_margin"),
    ]


SPLIT_COLS = ["total_units", "total_revenue", "total_cost", "net_profit", "full_price_units",
              "full_price_sales", "full_price_cost", "discounted_units", "discounted_sales", "discounted_cost"]


def company_margin(regular: DataFrame) -> DataFrame:
    """one row of company margin KPIs."""
    g = regular.agg(*split_aggs())
    return g.select(*SPLIT_COLS, *split_ratios(null_absent=True))


def margin_by_group(regular: DataFrame, dim: str) -> DataFrame:
    """full-price vs discounted split by one dimension (null keys dropped)."""
    g = regular.where(F.col(dim).isNotNull()).groupBy(F.col(dim).alias("name")).agg(*split_aggs())
    return g.select("name", *SPLIT_COLS, *split_ratios(null_absent=False))


MARGIN_DIMS = {"store": "store_clean", "brand": "brand_clean", "category": "category_clean",
               "deal_type": "deal_type"}


def margin_by_dims(regular: DataFrame, dims: dict | None = None) -> DataFrame:
    """F2 for several dimensions in one scan: GROUPING SETS over the dims.

    Output: ``dim`` (which dimension), ``name`` (its value), then the F2 metrics.
    """
    dims = dims or MARGIN_DIMS
    cols = list(dims.values())
    base = regular.select(*cols, "has_discount", "quantity", "actual_revenue", "cost", "net_profit")
    g = base.groupingSets([[F.col(c)] for c in cols], *[F.col(c) for c in cols]).agg(
        *split_aggs(), *[F.grouping(c).alias(f"_g_{c}") for c in cols])
    label = F.lit(None).cast("string")
    name = F.lit(None).cast("string")
    for lab, c in reversed(list(dims.items())):
        label = F.when(F.col(f"_g_{c}") == 0, F.lit(lab)).otherwise(label)
        name = F.when(F.col(f"_g_{c}") == 0, F.col(c)).otherwise(name)
    out = g.select(label.alias("dim"), name.alias("name"), *SPLIT_COLS, *split_ratios(null_absent=False))
    return out.where(F.col("name").isNotNull())


def margin_with_total(regular: DataFrame, dim: str, total_label: str = "TOTAL") -> DataFrame:
    """F2 plus a TOTAL line, via ROLLUP(dim) (one aggregation)."""
    g = (regular.where(F.col(dim).isNotNull())
         .rollup(F.col(dim).alias("name")).agg(*split_aggs(), F.grouping_id().alias("_gid")))
    out = g.select(F.when(F.col("_gid") == 1, F.lit(total_label)).otherwise(F.col("name")).alias("name"),
                   *SPLIT_COLS, *split_ratios(null_absent=False))
    return out


def brand_summary_aggs(prefix: str = "") -> list:
    return [
        isum("quantity").alias("total_units"),
        msum("actual_revenue").alias("total_revenue"),
        msum("cost").alias("total_cost"),
        msum("discounts").alias("total_discounts"),
        msum("net_profit").alias("total_profit"),
        msum_if(_fp(), "actual_revenue").alias("fp_revenue"),
        msum_if(_fp(), "cost").alias("_fp_cost"),
        msum_if(_disc(), "actual_revenue").alias("disc_revenue"),
        msum_if(_disc(), "cost").alias("_disc_cost"),
    ]


def brand_summary_ratios() -> list:
    rev = F.col("total_revenue")
    return [
        r(safe_div(rev - F.col("total_cost"), rev) * 100, 1).alias("overall_margin"),
        r(safe_div(F.col("fp_revenue") - F.col("_fp_cost"), F.col("fp_revenue")) * 100, 1).alias("fp_margin"),
        r(safe_div(F.col("disc_revenue") - F.col("_disc_cost"), F.col("disc_revenue")) * 100, 1).alias("disc_margin"),
        r(safe_div(F.col("fp_revenue"), rev) * 100, 1).alias("pct_full_price"),
        r(safe_div(F.col("total_discounts"), rev + F.col("total_discounts")) * 100, 1).alias("avg_discount_rate"),
    ]


BRAND_SUMMARY_COLS = ["total_units", "total_revenue", "total_cost", "total_discounts", "total_profit",
                      "fp_revenue", "disc_revenue"]


def brand_margin_summary(regular: DataFrame) -> DataFrame:
    """per-brand margin summary for all brands in one aggregation."""
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand")).agg(
        *brand_summary_aggs())
    return g.select("brand", *BRAND_SUMMARY_COLS, *brand_summary_ratios())


def brand_extras(regular: DataFrame) -> DataFrame:
    """months present, average monthly cost, cost per unit, unique customers per brand."""
    g = regular.where(F.col("brand_clean").isNotNull()).groupBy(F.col("brand_clean").alias("brand")).agg(
        F.countDistinct("ym").alias("months_count"),
        msum("cost").alias("_cost"),
        isum("quantity").alias("_units"),
        F.countDistinct("customer_id").alias("unique_customers"),
    )
    return g.select(
        "brand", "months_count",
        r(safe_div(F.col("_cost"), F.col("months_count")), 2).alias("avg_monthly_cost"),
        r(safe_div(F.col("_cost"), F.col("_units")), 2).alias("cost_per_unit"),
        "unique_customers",
    )


def category_margin(regular: DataFrame) -> DataFrame:
    """Category benchmark margin (1 dp; null when revenue is 0)."""
    g = regular.where(F.col("category_clean").isNotNull()).groupBy("category_clean").agg(
        msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"))
    return g.select(F.col("category_clean").alias("category"),
                    r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue"), None) * 100, 1).alias("margin"))


def brand_category_rank(regular: DataFrame) -> DataFrame:
    """Revenue rank (min method, desc) of each brand within its category + brand count."""
    g = (regular.where(F.col("category_clean").isNotNull() & F.col("brand_clean").isNotNull())
         .groupBy("category_clean", "brand_clean").agg(msum("actual_revenue").alias("revenue")))
    w = Window.partitionBy("category_clean")
    return g.select(
        F.col("category_clean").alias("category"), F.col("brand_clean").alias("brand"), "revenue",
        F.rank().over(w.orderBy(F.desc("revenue"))).cast("long").alias("rank"),
        F.count(F.lit(1)).over(w).alias("total_brands"),
    )


def brand_category_breakdown(regular: DataFrame) -> DataFrame:
    """per brand x category metrics vs the category benchmark and rank.

    The brand x category aggregate is computed once and reused for the rank
    window (E8) and the category totals (E7), so there is one scan.
    """
    g = (regular.where(F.col("category_clean").isNotNull() & F.col("brand_clean").isNotNull())
         .groupBy(F.col("brand_clean").alias("brand"), F.col("category_clean").alias("category")).agg(
        isum("quantity").alias("units"), msum("actual_revenue").alias("revenue"), msum("cost").alias("cost"),
        msum("net_profit").alias("profit"), msum("discounts").alias("discounts")))
    wc = Window.partitionBy("category")
    cat_rev = F.sum(F.rint(F.col("revenue") * 100).cast("long")).over(wc).cast("double") / 100.0
    cat_cost = F.sum(F.rint(F.col("cost") * 100).cast("long")).over(wc).cast("double") / 100.0
    margin = r(safe_div(F.col("revenue") - F.col("cost"), F.col("revenue"), None) * 100, 1)
    cat_margin = r(safe_div(cat_rev - cat_cost, cat_rev, None) * 100, 1)
    out = g.select(
        "brand", "category", "units", "revenue", "cost", "profit", "discounts",
        margin.alias("margin"), cat_margin.alias("category_avg_margin"),
        F.rank().over(wc.orderBy(F.desc("revenue"))).cast("long").alias("rank"),
        F.count(F.lit(1)).over(wc).alias("total_brands"),
    ).withColumn("vs_category", r(F.col("margin") - F.col("category_avg_margin"), 1))
    wb = Window.partitionBy("brand").orderBy(F.desc("revenue"), "category")
    return out.withColumn("is_primary", F.row_number().over(wb) == 1)


def discount_depth(regular: DataFrame, by: str = "brand_clean") -> DataFrame:
    """five discount-depth tiers per group; empty tiers appear with zeros.

    The tiers are conditional aggregates in one pass, unpivoted with
    ``inline`` (no join to a tier table, no cross join).
    """
    pct = F.coalesce(safe_div(F.col("discounts"), F.col("pre_discount_revenue"), None) * 100, F.lit(0.0))
    base = regular.where(F.col(by).isNotNull()).select(F.col(by).alias("grp"), pct.alias("dp"), "actual_revenue")
    aggs, structs = [F.count(F.lit(1)).alias("_n")], []
    for i, (label, lo, hi) in enumerate(fixed.DISCOUNT_TIERS):
        cond = (F.col("dp") == 0) if lo is None else ((F.col("dp") > lo) & (F.col("dp") <= hi))
        aggs += [F.count(F.when(cond, 1)).alias(f"n{i}"), msum_if(cond, "actual_revenue").alias(f"rev{i}"),
                 F.avg(F.when(cond, F.col("dp"))).alias(f"avg{i}")]
        structs.append(F.struct(F.lit(i).alias("tier_order"), F.lit(label).alias("tier"),
                                F.col(f"n{i}").alias("transactions"), F.col(f"rev{i}").alias("revenue"),
                                F.col(f"avg{i}").alias("avg")))
    g = base.groupBy("grp").agg(*aggs)
    x = g.select(F.col("grp"), F.col("_n"), F.inline(F.array(*structs)))
    return x.select(
        F.col("grp").alias("brand" if by == "brand_clean" else by), "tier_order", "tier", "transactions",
        r(safe_div(F.col("transactions"), F.col("_n")) * 100, 1).alias("pct_of_transactions"),
        "revenue",
        F.when(F.col("transactions") > 0, r(F.col("avg"), 1)).otherwise(F.lit(0.0)).alias("avg_discount"),
    )
