"""Brand advice (R9-R13): prices between stores, period comparison, recommendations and the key insight, all brands at once.

Numbers in texts are rounded half up like every displayed number.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import cents, isum, msum, r, safe_div
from tillpoint.operators.margin import brand_category_breakdown, brand_margin_summary, brand_summary_aggs, brand_summary_ratios
from tillpoint.operators.velocity import sale_days, velocity_by_category
from tillpoint.plans.curate import compact
from tillpoint.plans.period import Period, in_periods, period_calendar


def _sold(regular: DataFrame) -> DataFrame:
    return regular.where("brand_clean is not null").select(
        F.col("brand_clean").alias("brand"), F.col("store_clean").alias("store"), F.col("category_clean").alias("category"), "product",
        "quantity", "actual_revenue")


def _whole(x: Column) -> Column:
    """1,234 for 1234.4"""
    return F.format_number(r(x, 0).cast("long"), 0)


def pricing_consistency(regular: DataFrame, n: int | None = fixed.PRICING_PRODUCTS) -> DataFrame:
    """Unit price of each product between the stores that sell it (two at least); the `n` widest ranges of a brand, None for all."""
    stores = _sold(regular).where("product is not null and store is not null").groupBy("brand", "product", "store").agg(
        isum("quantity").alias("units"), msum("actual_revenue").alias("revenue"))
    price = F.when(F.col("units") > 0, F.col("revenue") / F.col("units")).otherwise(F.lit(0.0))
    g = stores.withColumn("price", price).groupBy("brand", "product").agg(
        F.min("price").alias("low"), F.max("price").alias("high"), F.avg("price").alias("mean"),
        F.stddev_samp("price").alias("spread"), F.count("*").alias("store_count")).where("store_count >= 2")
    out = g.select("brand", "product", r("low", 4).alias("min_price"), r("high", 4).alias("max_price"), r("mean", 4).alias("avg_price"),
                   r("spread", 4).alias("std_dev"), "store_count", r(F.col("high") - F.col("low"), 4).alias("price_range"),
                   r(safe_div(F.col("high") - F.col("low"), F.col("mean")) * 100, 1).alias("range_pct"))
    if n is None:
        return out
    widest = Window.partitionBy("brand").orderBy(F.desc("range_pct"), "product")
    return out.withColumn("nth", F.row_number().over(widest)).where(F.col("nth") <= n).drop("nth")


COMPARED = {"Revenue": "total_revenue", "Units": "total_units", "Margin %": "overall_margin",
            "Full Price %": "pct_full_price", "Profit": "total_profit"}


def comparison(regular: DataFrame, current: Period, other: Period | None) -> DataFrame:
    """A brand's summary in two periods, for brands with lines in both; no rows without a second period.

    A line counts in each period it falls in, so the periods may overlap; the facts are read once.
    """
    sides = F.array(F.when(current.predicate(), F.lit("current")), F.when(other.predicate() if other else F.lit(False), F.lit("previous")))
    lines = regular.where("brand_clean is not null").withColumn("side", F.explode(F.array_compact(sides)))
    sums = lines.groupBy(F.col("brand_clean").alias("brand"), "side").agg(*brand_summary_aggs()).select("*", *brand_summary_ratios())
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), F.col(v).cast("double").alias("value")) for k, v in COMPARED.items()))
    each = sums.select("brand", "side", F.inline(pairs)).groupBy("brand", "metric").agg(
        *(F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("current", "previous")))
    return each.where("current is not null and previous is not null").withColumn("change", r(F.col("current") - F.col("previous"), 2))


def comparison_by_period(regular: DataFrame) -> DataFrame:
    """R10 for every month, quarter and year against the one before it, for brands with lines in both: one job.

    The facts are read once, into a row a brand and month; months join the calendar of periods.
    """
    lines = regular.where("brand_clean is not null")
    full = F.when(~F.col("has_discount"), cents("actual_revenue"))
    monthly = lines.groupBy(F.col("brand_clean").alias("brand"), "year", "month").agg(
        F.sum(cents("actual_revenue")).alias("revenue"), F.sum("quantity").alias("units"), F.sum(cents("cost")).alias("cost"),
        F.sum(cents("net_profit")).alias("profit"), F.sum(full).alias("full"))
    monthly = monthly.withColumn("first_day", F.make_date("year", "month", F.lit(1)))
    sums = in_periods(monthly, period_calendar(regular), "first_day").groupBy("grain", "period", "brand", "side").agg(
        *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("revenue", "units", "cost", "profit", "full")))
    money = lambda c: F.col(c).cast("double") / 100
    values = {"Revenue": money("revenue"), "Units": F.col("units").cast("double"),
              "Margin %": r(safe_div(money("revenue") - money("cost"), money("revenue")) * 100, 1),
              "Full Price %": r(safe_div(money("full"), money("revenue")) * 100, 1), "Profit": money("profit")}
    pairs = F.array(*(F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in values.items()))
    each = sums.select("grain", "period", "brand", "side", F.inline(pairs)).groupBy("grain", "period", "brand", "metric").agg(
        *(F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("current", "previous")))
    return each.where("current is not null and previous is not null").withColumn("change", r(F.col("current") - F.col("previous"), 2))


def _standing(summary: DataFrame, breakdown: DataFrame) -> DataFrame:
    """A brand's summary beside its place in its primary category."""
    primary = breakdown.where("is_primary").select("brand", F.col("category").alias("primary_category"), F.col("category_avg_margin").alias("cat_margin"), "rank")
    return summary.join(primary, "brand").withColumn("gap", r(F.col("overall_margin") - F.col("cat_margin"), 1))


def _advice(when: Column, texts: tuple[str, str, str, str], title: list = (), detail: list = (), action: list = ()) -> Column:
    severity, *forms = texts
    filled = [F.format_string(form, *args) if args else F.lit(form) for form, args in zip(forms, (title, detail, action))]
    return F.when(when, F.struct(F.lit(severity).alias("severity"), *(c.alias(k) for k, c in zip(("title", "detail", "action"), filled))))


def recommendations(regular: DataFrame) -> DataFrame:
    """(brand, severity, title, detail, action), a row for each rule that a brand meets."""
    c = F.col
    breakdown = brand_category_breakdown(regular)
    below = _advice(c("vs_category") < fixed.REC_BELOW_CATEGORY_PTS, fixed.ADVICE_BELOW_CATEGORY, [c("category")],
                    [c("margin"), r(-c("vs_category"), 0), c("category"), c("rank"), c("total_brands")], [r(-c("vs_category") / 2, 0), c("category")])
    of_brand = F.array(
        _advice(c("gap") < fixed.REC_MARGIN_VS_CAT_GAP_PTS, fixed.ADVICE_BENCHMARK_GAP, detail=[c("overall_margin"), c("primary_category"), c("cat_margin"), -c("gap")]),
        _advice(c("pct_full_price") < fixed.REC_PROMO_DEPENDENCY_PCT, fixed.ADVICE_PROMOTION, detail=[r("pct_full_price", 0)]),
        _advice((c("disc_margin") < fixed.REC_LOW_DISC_MARGIN_PCT) & (c("disc_revenue") > 0), fixed.ADVICE_DISCOUNTED, detail=[c("disc_margin")]),
        _advice((c("gap") >= fixed.REC_STRONG_PTS) & (c("rank") <= fixed.REC_STRONG_RANK), fixed.ADVICE_STRONG, detail=[c("rank"), c("primary_category"), c("gap")]),
        _advice(c("total_revenue") > fixed.REC_VOLUME_LEVERAGE_REVENUE, fixed.ADVICE_VOLUME, detail=[_whole(c("total_revenue"))]))
    standing = _standing(brand_margin_summary(regular), breakdown)
    return (breakdown.select("brand", F.inline(F.array_compact(F.array(below))))
            .unionByName(standing.select("brand", F.inline(F.array_compact(of_brand)))))


def key_insight(regular: DataFrame) -> DataFrame:
    """(brand, insight), the one line that says most about a brand."""
    c = F.col
    s = _standing(brand_margin_summary(regular), brand_category_breakdown(regular))
    margin, category, average = c("overall_margin"), c("primary_category"), c("cat_margin")
    line = (F.when(c("gap") < fixed.REC_BELOW_CATEGORY_PTS, F.format_string(fixed.INSIGHT_FAR_BELOW, c("brand"), margin, r(-c("gap"), 0), category, average))
            .when(c("gap") < 0, F.format_string(fixed.INSIGHT_BELOW, c("brand"), margin, category, average))
            .when(c("pct_full_price") < fixed.INSIGHT_FULL_PRICE_PCT, F.format_string(fixed.INSIGHT_DISCOUNTS, r("pct_full_price", 0)))
            .otherwise(F.format_string(fixed.INSIGHT_WELL, c("brand"), c("rank"), category, margin, average)))
    return s.select("brand", line.alias("insight"))


def growth_opportunities(regular: DataFrame, n_products: int | None = fixed.REC_SKU_PRODUCTS) -> DataFrame:
    """(brand, type, title, detail, priority): stores that sell the brand's categories without it, products that
    some of its stores lack (the first `n_products` by name, None for all), categories it sells slowly in."""
    # one read of the facts for a row a brand, store, category and product, one for the days they span
    days = sale_days(regular)
    regular = compact(regular, "brand_clean", "store_clean", "category_clean", "product")
    c, sold = F.col, _sold(regular)
    demand = regular.where("store_clean is not null and category_clean is not null").groupBy(
        c("store_clean").alias("store"), c("category_clean").alias("category")).agg(F.sum(cents("actual_revenue")).alias("cents"))
    in_store = sold.where("store is not null")
    missing = (sold.where("category is not null").select("brand", "category").distinct().join(demand, "category")
               .join(in_store.select("brand", "store").distinct(), ["brand", "store"], "left_anti")
               .groupBy("brand", "store").agg((F.sum("cents") / 100.0).alias("wanted"), F.array_sort(F.collect_set("category")).alias("categories")))
    title, detail = fixed.GROWTH_STORE
    stores = missing.select(
        "brand", F.lit("distribution").alias("type"), F.format_string(title, c("store")).alias("title"),
        F.format_string(detail, _whole(c("wanted")), F.array_join("categories", ", "), c("brand")).alias("detail"),
        F.when(c("wanted") > fixed.REC_HIGH_PRIORITY_CATEGORY_REVENUE, "high").otherwise("medium").alias("priority"))

    own = in_store.groupBy("brand").agg(F.array_sort(F.collect_set("store")).alias("own"))
    having = in_store.where("product is not null").groupBy("brand", "product").agg(F.collect_set("store").alias("having"))
    partial = having.join(own, "brand").where((F.size("having") >= 2) & (F.size("having") < F.size("own"))).withColumn("lacking", F.array_except("own", "having"))
    if n_products is not None:
        partial = partial.withColumn("nth", F.row_number().over(Window.partitionBy("brand").orderBy("product"))).where(c("nth") <= n_products)
    title, detail = fixed.GROWTH_SKU
    products = partial.select(
        "brand", F.lit("sku_expansion").alias("type"), F.format_string(title, c("product"), F.size("lacking")).alias("title"),
        F.format_string(detail, F.size("having"), F.array_join("lacking", ", ")).alias("detail"), F.lit("medium").alias("priority"))

    title, detail = fixed.GROWTH_VELOCITY
    slow = velocity_by_category(regular, days).where(c("velocity_index") < fixed.REC_VELOCITY_INDEX).select(
        "brand", F.lit("velocity").alias("type"), F.format_string(title, c("category")).alias("title"),
        F.format_string(detail, r("velocity_index", 0), r("brand_units_per_day", 1), r("category_avg_units_per_day", 1)).alias("detail"),
        F.lit("medium").alias("priority"))
    return stores.unionByName(products).unionByName(slow)
