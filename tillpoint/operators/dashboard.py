"""Executive dashboards.

All frames are small aggregates of one scan of the fact table; "rule"
outputs (insights) are unions of one-row rule frames, never driver loops.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import (count_if, isum, month_key, month_label, msum, msum_if, pct_change, r,
                                      safe_div)
from tillpoint.plans.curate import compact


def _m(x) -> Column:
    return F.col(x)


def monthly_groups(regular: DataFrame) -> DataFrame:
    """Per month revenue, profit, margin, units, receipts, customers, full-price %."""
    g = regular.groupBy("year", "month").agg(
        msum("actual_revenue").alias("revenue"), msum("net_profit").alias("profit"), msum("cost").alias("cost"),
        isum("quantity").alias("units"), F.countDistinct("receipt_id").alias("transactions"),
        F.countDistinct("customer_id").alias("customers"), msum("discounts").alias("discounts"))
    return g.select(
        (F.col("year") * 100 + F.col("month")).alias("ym"), "year", "month",
        month_key(F.col("year"), F.col("month")).alias("month_key"),
        month_label(F.col("year"), F.col("month")).alias("label"),
        "revenue", "profit", "cost", "units", "transactions", "customers", "discounts",
        r(safe_div(_m("profit"), _m("revenue")) * 100, 4).alias("margin"),
        F.when(_m("revenue") > 0, r(safe_div(_m("revenue") - _m("discounts"), _m("revenue")) * 100, 4))
        .otherwise(F.lit(0.0)).alias("full_price_pct"),
    )


def sales_mix(regular: DataFrame) -> DataFrame:
    """F8: full-price share, margins on net profit, gap, health."""
    fp, d = ~F.col("has_discount"), F.col("has_discount")
    g = regular.agg(msum_if(fp, "actual_revenue").alias("full_price_revenue"),
                    msum_if(fp, "net_profit").alias("_fp_profit"),
                    msum_if(d, "actual_revenue").alias("discounted_revenue"),
                    msum_if(d, "net_profit").alias("_d_profit"),
                    msum("actual_revenue").alias("_total"))
    fp_pct = safe_div(_m("full_price_revenue"), _m("_total")) * 100
    fpm = safe_div(_m("_fp_profit"), _m("full_price_revenue")) * 100
    dm = safe_div(_m("_d_profit"), _m("discounted_revenue")) * 100
    return g.select(
        r(fp_pct, 1).alias("full_price_pct"), r(100 - fp_pct, 1).alias("discounted_pct"),
        F.when(fp_pct >= fixed.SALES_MIX_HEALTHY_PCT, "healthy").when(fp_pct >= fixed.SALES_MIX_WATCH_PCT, "watch")
        .otherwise("concern").alias("health"),
        "full_price_revenue", "discounted_revenue",
        r(fpm, 1).alias("full_price_margin"), r(dm, 1).alias("discounted_margin"),
        r(fpm - dm, 1).alias("margin_gap_pts"),
    )


def excluded_breakdown(sales: DataFrame) -> DataFrame:
    """non-regular lines by type plus a TOTAL row (ROLLUP)."""
    ex = sales.where(F.col("transaction_type") != "REGULAR")
    g = ex.rollup("transaction_type").agg(F.count(F.lit(1)).alias("count"), msum("actual_revenue").alias("value"),
                                         isum("quantity").alias("units"), F.grouping_id().alias("_g"))
    return g.select(F.when(_m("_g") == 1, F.lit("TOTAL")).otherwise(_m("transaction_type")).alias("type"),
                    "count", "value", "units")


def pnl(regular: DataFrame) -> DataFrame:
    """revenue, COGS, gross profit, GM %, discounts, net after discounts.

    ``net_after_discounts`` subtracts discounts from post-discount revenue,
    as the reference defines it.
    """
    g = regular.agg(msum("actual_revenue").alias("revenue"), msum("cost").alias("cogs"),
                    msum("discounts").alias("total_discounts"))
    gp = F.rint((_m("revenue") - _m("cogs")) * 100) / 100.0
    return g.select("revenue", "cogs", gp.alias("gross_profit"),
                    r(safe_div(gp, _m("revenue")) * 100, 1).alias("gross_margin_pct"), "total_discounts",
                    (F.rint((_m("revenue") - _m("total_discounts")) * 100) / 100.0).alias("net_after_discounts"))


def ebitda_proxy(regular: DataFrame, opex: dict | None = None) -> DataFrame:
    """gross profit less monthly opex x months, plus D&A; null unless opex is configured."""
    opex = fixed.MONTHLY_OPEX if opex is None else opex
    configured = any(v > 0 for v in opex.values())
    g = regular.agg(msum("actual_revenue").alias("revenue"), msum("cost").alias("cogs"),
                    F.countDistinct("year", "month").alias("months"))
    months = F.greatest(_m("months"), F.lit(1))
    gp = F.rint((_m("revenue") - _m("cogs")) * 100) / 100.0
    op = sum(float(opex[k]) for k in ("labor", "rent", "utilities", "other_opex"))
    total_opex = months * F.lit(op)
    da = months * F.lit(float(opex["depreciation"]))
    ebitda = gp - total_opex + da

    def gate(x):
        return F.when(F.lit(configured), x)

    return g.select(
        F.lit(configured).alias("configured"), months.cast("long").alias("months"),
        gate(gp).alias("gross_profit"), gate(total_opex).alias("total_opex"),
        gate(gp - total_opex).alias("ebit"), gate(da).alias("depreciation"), gate(ebitda).alias("ebitda"),
        gate(r(safe_div(ebitda, _m("revenue")) * 100, 1)).alias("ebitda_margin_pct"))


def exec_kpis(sales: DataFrame, regular: DataFrame) -> DataFrame:
    """Headline KPIs + monthly averages + global store/brand counts."""
    g = regular.agg(
        msum("actual_revenue").alias("total_revenue"), msum("net_profit").alias("net_profit"),
        isum("quantity").alias("total_units"), F.countDistinct("receipt_id").alias("total_transactions"),
        msum("discounts").alias("total_discounts"), F.countDistinct("customer_id").alias("unique_customers"),
        F.countDistinct("year", "month").alias("_months"))
    n_stores = sales.agg(F.countDistinct("store_clean")).scalar()
    n_brands = regular.agg(F.countDistinct("brand_clean")).scalar()
    n = F.greatest(_m("_months"), F.lit(1))
    rev = _m("total_revenue")
    return g.select(
        "total_revenue", "net_profit", r(safe_div(_m("net_profit"), rev) * 100, 1).alias("blended_margin"),
        "total_units", "total_transactions", "total_discounts",
        r(safe_div(rev - _m("total_discounts"), rev) * 100, 1).alias("full_price_pct"),
        r(safe_div(rev, _m("total_transactions")), 2).alias("avg_basket"),
        "unique_customers", n_stores.alias("stores"), n_brands.alias("brands"),
        r(rev / n, 0).alias("avg_monthly_revenue"), r(_m("net_profit") / n, 0).alias("avg_monthly_profit"))


def best_worst_month(monthly: DataFrame) -> DataFrame:
    """S3: best/worst month by revenue, best by profit and margin, worst by profit (earliest wins ties)."""
    def hi(metric):
        return F.max_by(F.struct(_m("label"), _m(metric)), F.struct(_m(metric), -_m("ym")))

    def lo(metric):
        return F.min_by(F.struct(_m("label"), _m(metric)), F.struct(_m(metric), _m("ym")))

    g = monthly.agg(hi("revenue").alias("b"), lo("revenue").alias("w"), hi("profit").alias("bp"),
                    hi("margin").alias("bm"), lo("profit").alias("wp"))
    return g.select(
        F.col("b.label").alias("best_month"), F.col("b.revenue").alias("best_revenue"),
        F.col("w.label").alias("worst_month"), F.col("w.revenue").alias("worst_revenue"),
        F.col("bp.label").alias("best_profit_month"), F.col("bp.profit").alias("best_profit"),
        F.col("bm.label").alias("best_margin_month"), F.col("bm.margin").alias("best_margin"),
        F.col("wp.label").alias("worst_profit_month"), F.col("wp.profit").alias("worst_profit"))


def top_categories(regular: DataFrame, n: int = 8) -> DataFrame:
    """Top categories by revenue with margin and share of total."""
    g = regular.where(F.col("category_clean").isNotNull()).groupBy(F.col("category_clean").alias("name")).agg(
        msum("actual_revenue").alias("revenue"), msum("net_profit").alias("_profit"))
    tot = regular.agg(msum("actual_revenue")).scalar()
    w = Window.orderBy(F.desc("revenue"), "name")
    x = g.withColumn("position", F.row_number().over(w)).where(_m("position") <= n).withColumn("_total", tot)
    return x.select("position", "name", "revenue", r(safe_div(_m("_profit"), _m("revenue")) * 100, 1).alias("margin"),
                    r(safe_div(_m("revenue"), _m("_total")) * 100, 1).alias("pct_of_total"))


def store_totals(regular: DataFrame) -> DataFrame:
    """Per store revenue, margin, units (ranked)."""
    g = regular.where(F.col("store_clean").isNotNull()).groupBy(F.col("store_clean").alias("name")).agg(
        msum("actual_revenue").alias("revenue"), msum("net_profit").alias("_profit"), isum("quantity").alias("units"))
    return g.select("name", "revenue", r(safe_div(_m("_profit"), _m("revenue")) * 100, 1).alias("margin"), "units",
                    F.row_number().over(Window.orderBy(F.desc("revenue"), "name")).alias("position"))


def insights(regular: DataFrame, top: int | None = None) -> DataFrame:
    """Rule-based insights in rule order; all of them unless ``top`` asks for fewer.

    Each rule is a filtered one-row (or per-store) frame; union + row_number.
    """
    regular = compact(regular, "store_clean", "year", "month", "has_discount")
    k = regular.agg(msum("actual_revenue").alias("rev"), msum("net_profit").alias("profit"))
    k = k.select(r(safe_div(_m("profit"), _m("rev")) * 100, 1).alias("margin"))
    mix = sales_mix(regular)
    stores = store_totals(regular)
    mon = monthly_groups(regular)
    w = Window.orderBy(F.desc("ym"))
    last2 = mon.select("ym", "label", "revenue", "margin", F.row_number().over(w).alias("k")).where(_m("k") <= 2)
    pair = last2.groupBy().agg(
        F.max(F.when(_m("k") == 1, _m("revenue"))).alias("lrev"), F.max(F.when(_m("k") == 2, _m("revenue"))).alias("prev"),
        F.max(F.when(_m("k") == 1, _m("margin"))).alias("lm"), F.max(F.when(_m("k") == 2, _m("margin"))).alias("pm"),
        F.max(F.when(_m("k") == 1, _m("label"))).alias("ll"), F.max(F.when(_m("k") == 2, _m("label"))).alias("pl"),
        F.count(F.lit(1)).alias("n"))

    def rule(df, order, sub, typ, title, detail):
        return df.select(F.lit(order).alias("rule_order"), F.lit(sub).cast("string").alias("_sub"),
                         F.lit(typ).alias("type"), title.alias("title"), detail.alias("detail"))

    rules = [
        rule(k.where(_m("margin") >= fixed.MARGIN_EXCELLENT_PCT), 1, "", "success", F.lit("Strong Margins"),
             F.format_string("Blended margin of %.1f%% is excellent — well above industry norms.", _m("margin"))),
        rule(k.where(_m("margin") < fixed.MARGIN_BELOW_TARGET_PCT), 1, "", "warning", F.lit("Margin Pressure"),
             F.format_string("Blended margin of %.1f%% is below target. Review pricing and discount strategies.",
                             _m("margin"))),
        rule(mix.where(_m("full_price_pct") < fixed.DISCOUNT_DEPENDENCY_PCT), 2, "", "warning",
             F.lit("High Discount Dependency"),
             F.format_string("Only %.1f%% of revenue is full-price. %.1f%% of sales are discounted.",
                             _m("full_price_pct"), _m("discounted_pct"))),
        rule(mix.where(_m("full_price_pct") >= fixed.SALES_MIX_HEALTHY_PCT + 5), 2, "", "success",
             F.lit("Healthy Sales Mix"),
             F.format_string("%.1f%% of revenue is at full price, limiting margin erosion from discounts.",
                             _m("full_price_pct"))),
        rule(mix.where(_m("margin_gap_pts") > fixed.MARGIN_GAP_SIGNIFICANT_PTS), 3, "", "info",
             F.lit("Significant Margin Gap"),
             F.format_string("Full-price margin is %.1f pts higher than discounted. Discounts are cutting deep "
                             "into profit.", _m("margin_gap_pts"))),
        stores.where(_m("margin") < fixed.MARGIN_BELOW_TARGET_PCT).select(
            F.lit(4).alias("rule_order"), F.lpad(_m("position").cast("string"), 6, "0").alias("_sub"),
            F.lit("warning").alias("type"), F.concat(_m("name"), F.lit(" Needs Attention")).alias("title"),
            F.format_string("Margin of %.1f%% is below %d%%. Review store operations and pricing.", _m("margin"),
                            F.lit(fixed.MARGIN_BELOW_TARGET_PCT)).alias("detail")),
        rule(pair.where((_m("n") >= 2) & (pct_change(_m("lrev"), _m("prev")) < -10)), 5, "", "warning",
             F.lit("Revenue Declining"),
             F.format_string("%s revenue dropped %.1f%% vs %s.", _m("ll"), F.abs(pct_change(_m("lrev"), _m("prev"))),
                             _m("pl"))),
        rule(pair.where((_m("n") >= 2) & ((_m("lm") - _m("pm")) > 3)), 6, "", "success", F.lit("Margin Improving"),
             F.format_string("Margin increased %.1f pts from %s to %s.", _m("lm") - _m("pm"), _m("pl"), _m("ll"))),
    ]
    u = rules[0]
    for x in rules[1:]:
        u = u.unionByName(x)
    w2 = Window.orderBy("rule_order", "_sub")
    placed = u.withColumn("position", F.row_number().over(w2)).drop("_sub")
    return placed if top is None else placed.where(_m("position") <= top)


def mom_yoy(regular: DataFrame) -> DataFrame:
    """Month-over-month vs the previous present month; YoY vs the same month a year earlier."""
    m = monthly_groups(regular)
    w = Window.orderBy("ym")
    prev = F.lag
    x = m.select("*", prev("revenue").over(w).alias("_pr"), prev("profit").over(w).alias("_pp"),
                 prev("margin").over(w).alias("_pm"), prev("units").over(w).alias("_pu"))
    py = m.select((F.col("year") + 1).alias("_y"), F.col("month").alias("_mo"), F.col("revenue").alias("_yr"),
                  F.col("profit").alias("_yp"), F.col("margin").alias("_ym"))
    x = x.join(py, (x.year == py._y) & (x.month == py._mo), "left")
    return x.select(
        "ym", "year", "month", "month_key", "label", "revenue", "profit", "margin", "units", "transactions",
        "customers", "full_price_pct",
        r(pct_change(_m("revenue"), _m("_pr")), 4).alias("mom_revenue_pct"),
        r(pct_change(_m("profit"), _m("_pp")), 4).alias("mom_profit_pct"),
        r(_m("margin") - _m("_pm"), 1).alias("mom_margin_pts"),
        r(pct_change(_m("units"), _m("_pu")), 4).alias("mom_units_pct"),
        r(pct_change(_m("revenue"), _m("_yr")), 4).alias("yoy_revenue_pct"),
        r(pct_change(_m("profit"), _m("_yp")), 4).alias("yoy_profit_pct"),
        r(_m("margin") - _m("_ym"), 1).alias("yoy_margin_pts"),
    )


def mom_totals(regular: DataFrame) -> DataFrame:
    """Totals over the monthly rows."""
    m = monthly_groups(regular)
    g = m.agg(msum("revenue").alias("revenue"), msum("profit").alias("profit"), isum("units").alias("units"),
              isum("transactions").alias("transactions"), F.count(F.lit(1)).alias("_n"),
              F.sum("full_price_pct").alias("_fps"))
    return g.select("revenue", "profit", "units", "transactions",
                    r(safe_div(_m("profit"), _m("revenue")) * 100, 1).alias("avg_margin"),
                    F.when(_m("_n") > 0, r(_m("_fps") / _m("_n"), 1)).otherwise(F.lit(0.0)).alias("avg_full_price_pct"))


def yoy_matrix(regular: DataFrame, n_years: int = 3) -> DataFrame:
    """Month rows x the latest ``n_years`` years as columns, plus latest-vs-prior change.

    Years are ranked in a window (no driver collect); the pivot is a
    conditional aggregation on the year rank, so the column set is fixed:
    y1 = latest year, y2 = the year before, ...
    """
    m = monthly_groups(regular)
    yrs = m.select("year").distinct().withColumn("yr", F.row_number().over(Window.orderBy(F.desc("year"))))
    x = m.join(yrs.where(_m("yr") <= n_years), "year")
    aggs = []
    for k in range(1, n_years + 1):
        sel = _m("yr") == k
        aggs += [F.max(F.when(sel, _m("year"))).alias(f"y{k}"),
                 F.max(F.when(sel, _m("revenue"))).alias(f"y{k}_revenue"),
                 F.max(F.when(sel, _m("profit"))).alias(f"y{k}_profit"),
                 F.max(F.when(sel, r(_m("margin"), 1))).alias(f"y{k}_margin"),
                 F.max(F.when(sel, _m("units"))).alias(f"y{k}_units"),
                 F.max(F.when(sel, r(_m("full_price_pct"), 1))).alias(f"y{k}_full_price_pct")]
    g = x.groupBy(F.col("month").alias("month_num")).agg(*aggs)
    return g.select("*", F.date_format(F.make_date(F.lit(2000), _m("month_num"), F.lit(1)), "MMMM").alias("month_label"),
                    r(pct_change(_m("y1_revenue"), _m("y2_revenue")), 4).alias("revenue_change_pct"),
                    r(pct_change(_m("y1_profit"), _m("y2_profit")), 4).alias("profit_change_pct"),
                    r(_m("y1_margin") - _m("y2_margin"), 1).alias("margin_change_pts"))


def store_performance(regular: DataFrame, history: DataFrame | None = None, counts: bool = True) -> DataFrame:
    """Store ranking, share, margin status, top brand/category, same-store growth.

    ``regular`` is the period slice; ``history`` is the full regular table the
    prior-year months are read from (defaults to ``regular``). The prior
    months are the slice's months shifted one year back (a left-semi join to
    a table of at most a few hundred months). The facts are read once for all sums and once for the distinct
    counts (not at all without ``counts``).
    """
    dims = ["store_clean", "brand_clean", "category_clean", "year", "month"]
    lines, regular = regular, compact(regular, *dims)
    history = regular if history is None else compact(history, *dims)
    g = regular.where(F.col("store_clean").isNotNull()).groupBy(F.col("store_clean").alias("name")).agg(
        msum("actual_revenue").alias("revenue"), msum("net_profit").alias("profit"), msum("cost").alias("cost"),
        isum("quantity").alias("units"), msum("discounts").alias("discounts"))
    if counts:
        g = g.join(lines.where(F.col("store_clean").isNotNull()).groupBy(F.col("store_clean").alias("name")).agg(
            F.countDistinct("receipt_id").alias("transactions"), F.countDistinct("customer_id").alias("unique_customers")), "name")
    else:
        g = g.withColumns({c: F.lit(None).cast("bigint") for c in ("transactions", "unique_customers")})
    trev = regular.agg(msum("actual_revenue")).scalar()
    tprofit = regular.agg(msum("net_profit")).scalar()
    prior_keys = regular.select((F.col("year") - 1).alias("year"), "month").distinct()
    prior = (history.join(prior_keys, ["year", "month"], "left_semi").where(F.col("store_clean").isNotNull())
             .groupBy(F.col("store_clean").alias("name")).agg(msum("actual_revenue").alias("prior_revenue")))
    top_b = _top_by(regular, "brand_clean", "top_brand")
    top_c = _top_by(regular, "category_clean", "top_category")
    x = g.join(prior, "name", "left").join(top_b, "name", "left").join(top_c, "name", "left")
    avg_m = safe_div(tprofit, trev) * 100
    margin = safe_div(_m("profit"), _m("revenue")) * 100
    return x.select(
        "name", F.row_number().over(Window.orderBy(F.desc("revenue"), "name")).alias("rank"), "revenue",
        r(safe_div(_m("revenue"), trev) * 100, 1).alias("share_pct"), "profit", r(margin, 1).alias("margin"),
        F.when(margin >= avg_m + 2, "green").when(margin <= avg_m - 2, "red").otherwise("yellow").alias("margin_status"),
        "units", "transactions",
        r(safe_div(_m("revenue") - _m("discounts"), _m("revenue")) * 100, 1).alias("full_price_pct"),
        "unique_customers", "top_brand", "top_category",
        F.when(_m("prior_revenue") != 0, r(pct_change(_m("revenue"), _m("prior_revenue")), 1)).alias("sssg"),
        "prior_revenue", r(avg_m, 1).alias("company_avg_margin"))


def _top_by(regular: DataFrame, col: str, name: str) -> DataFrame:
    """Per store the value of ``col`` with the most revenue (ties: smallest value)."""
    g = (regular.where(F.col("store_clean").isNotNull() & F.col(col).isNotNull())
         .groupBy(F.col("store_clean").alias("name"), F.col(col).alias(name)).agg(msum("actual_revenue").alias("_r")))
    w = Window.partitionBy("name").orderBy(F.desc("_r"), name)
    return g.withColumn("_k", F.row_number().over(w)).where(_m("_k") == 1).select("name", name)


def company_sssg(regular: DataFrame, history: DataFrame | None = None) -> DataFrame:
    """S12 company line + S13 top/bottom performer."""
    sp = store_performance(regular, history, counts=False)
    return sp.agg(
        msum("revenue").alias("revenue"), msum("prior_revenue").alias("prior_revenue"),
        F.max_by("name", F.struct(_m("revenue"), F.lit(0) - _m("rank"))).alias("top_performer"),
        F.min_by("name", F.struct(_m("margin"), _m("rank"))).alias("bottom_performer"),
    ).select("revenue", "prior_revenue",
             F.when(_m("prior_revenue") > 0, r(pct_change(_m("revenue"), _m("prior_revenue")), 1)).alias("company_sssg"),
             "top_performer", "bottom_performer")


def year_end(regular_all: DataFrame, year: int) -> DataFrame:
    """S14 + S15: the year's KPIs and the YoY block over the same months of the prior year.

    One scan of the two years with conditional sums; the current year's
    month set (at most 12 values) comes from a scalar subquery.
    """
    months = regular_all.where(F.col("year") == year).agg(F.collect_set("month")).scalar()
    is_c = F.col("year") == year
    is_p = (F.col("year") == year - 1) & F.array_contains(months, F.col("month"))
    x = regular_all.where(F.col("year").isin(year, year - 1)).where(is_c | is_p).agg(
        msum_if(is_c, "actual_revenue").alias("total_revenue"), msum_if(is_c, "net_profit").alias("total_profit"),
        F.coalesce(F.sum(F.when(is_c, F.col("quantity"))), F.lit(0)).cast("long").alias("total_units"),
        msum_if(is_c, "discounts").alias("total_discounts"),
        F.countDistinct(F.when(is_c, F.col("month"))).alias("months"),
        F.countDistinct(F.when(is_c, F.col("store_clean"))).alias("stores"),
        F.countDistinct(F.when(is_c, F.col("brand_clean"))).alias("brands"),
        msum_if(is_p, "actual_revenue").alias("_prev_revenue"), msum_if(is_p, "net_profit").alias("_prev_profit"),
        F.coalesce(F.sum(F.when(is_p, F.col("quantity"))), F.lit(0)).cast("long").alias("_prev_units"),
        count_if(is_p).alias("_prev_n"))
    margin = safe_div(_m("total_profit"), _m("total_revenue")) * 100
    pm = r(safe_div(_m("_prev_profit"), _m("_prev_revenue")) * 100, 1)
    rpu = safe_div(_m("total_revenue"), _m("total_units"))
    prpu = safe_div(_m("_prev_revenue"), _m("_prev_units"))
    old = _m("total_revenue") * (pm / 100)
    has = _m("_prev_n") > 0
    n = F.greatest(_m("months"), F.lit(1))
    return x.select(
        F.lit(year).alias("year"), "stores", "brands", "months", "total_revenue", "total_profit",
        r(margin, 1).alias("blended_margin"), "total_units", "total_discounts",
        r(safe_div(_m("total_revenue") - _m("total_discounts"), _m("total_revenue")) * 100, 1).alias("full_price_pct"),
        r(_m("total_revenue") / n, 0).alias("avg_monthly_revenue"), r(_m("total_profit") / n, 0).alias("avg_monthly_profit"),
        F.when(has, F.lit(year - 1)).alias("prev_year"),
        F.when(has, r(pct_change(_m("total_revenue"), _m("_prev_revenue")), 4)).alias("revenue_change_pct"),
        F.when(has, _m("_prev_revenue")).alias("prev_revenue"),
        F.when(has, r(pct_change(_m("total_profit"), _m("_prev_profit")), 4)).alias("profit_change_pct"),
        F.when(has, _m("_prev_profit")).alias("prev_profit"),
        F.when(has, pm).alias("margin_prev"),
        F.when(has, r(margin - pm, 1)).alias("margin_change_pts"),
        F.when(has, r(_m("total_profit") - old, 0)).alias("margin_impact_dollars"),
        F.when(has, r(old, 0)).alias("profit_at_old_margin"),
        F.when(has, r(pct_change(rpu, prpu), 4)).alias("rev_per_unit_change_pct"),
        F.when(has, r(rpu, 2)).alias("rev_per_unit_current"),
        F.when(has, r(prpu, 2)).alias("rev_per_unit_prev"),
    )


def year_end_insights(regular_all: DataFrame, year: int) -> DataFrame:
    """Margin drift, discount dependency, mix health, YoY margin insight."""
    regular_all = compact(regular_all.where(F.col("year").isin(year, year - 1)), "store_clean", "brand_clean", "year", "month", "has_discount")
    cur = regular_all.where(F.col("year") == year)
    mon = monthly_groups(cur)
    fl = mon.agg(F.min_by(F.struct("margin", "label"), "ym").alias("f"), F.max_by(F.struct("margin", "label"), "ym")
                 .alias("l"), F.count(F.lit(1)).alias("n"))
    d = _m("l.margin") - _m("f.margin")
    drift = fl.where(_m("n") >= 2).select(
        F.lit(1).alias("rule_order"),
        F.when(d > 1, "success").when(d < -1, "warning").otherwise("info").alias("type"),
        F.when(d > 1, "Margin Improved").when(d < -1, "Margin Declined").otherwise("Margin Stable").alias("title"),
        F.when(F.abs(d) > 1, F.format_string("%.1f pts from %s (%.1f%%) to %s (%.1f%%)", F.abs(d), _m("f.label"),
                                               _m("f.margin"), _m("l.label"), _m("l.margin")))
        .otherwise(F.format_string("Less than 1 pt change from %s to %s", _m("f.label"), _m("l.label")))
        .alias("detail"))
    mix = sales_mix(cur)
    dep = mix.select(
        F.lit(2).alias("rule_order"),
        F.when(_m("full_price_pct") < 30, "warning").otherwise("info").alias("type"),
        F.when(_m("full_price_pct") < 30, "Discount Dependency").otherwise("Discount Dependency Stable").alias("title"),
        F.format_string("%.1f%% of revenue from discounted sales", _m("discounted_pct")).alias("detail"))
    health = mix.select(
        F.lit(3).alias("rule_order"),
        F.when(_m("health") == "healthy", "success").when(_m("health") == "concern", "warning").otherwise("info")
        .alias("type"),
        F.concat(F.lit("Sales Mix "), F.when(_m("health") == "healthy", "Healthy Mix")
                 .when(_m("health") == "watch", "Monitor Closely").otherwise("Action Needed")).alias("title"),
        F.format_string("%.1f%% full price, %.1f%% discounted", _m("full_price_pct"), _m("discounted_pct"))
        .alias("detail"))
    ye = year_end(regular_all, year).where(_m("prev_year").isNotNull())
    dl = _m("margin_change_pts")
    yoy = ye.select(
        F.lit(0).alias("rule_order"),
        F.when(dl > 0.5, "success").when(dl < -0.5, "warning").otherwise("info").alias("type"),
        F.when(dl > 0.5, F.lit(f"Margin Up vs {year - 1}")).when(dl < -0.5, F.lit(f"Margin Down vs {year - 1}"))
        .otherwise(F.lit(f"Margin Flat vs {year - 1}")).alias("title"),
        F.format_string("Blended margin %s%% vs %s%% in %d (%s)", _m("blended_margin").cast("string"),
                        _m("margin_prev").cast("string"), F.lit(year - 1),
                        F.when(dl > 0.5, F.concat(F.lit("+"), dl.cast("string"), F.lit(" pts year-over-year")))
                        .when(dl < -0.5, F.concat(dl.cast("string"), F.lit(" pts year-over-year")))
                        .otherwise(F.lit("unchanged"))).alias("detail"))
    return yoy.unionByName(drift).unionByName(dep).unionByName(health)
