"""Margin waterfall (O1-O5): current vs prior period decomposition in one scan.

Both periods are read in one pass and split with conditional aggregation
per category (the full outer join of the two category tables becomes one
grouped aggregation over their union, missing side = 0).
"""
from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.expr import cents, r, safe_div
from tillpoint.plans.curate import compact
from tillpoint.plans.period import Period, in_periods, period_calendar

EFFECTS = ["Mix Effect", "Price Effect", "Cost Effect", "Discount Effect"]


def _default_windows(regular: DataFrame):
    """current = the 181 dates ending at the last sale; prior = the 181 dates before."""
    mx = regular.agg(F.max("sale_date")).scalar()
    cur = (F.col("sale_date") >= F.date_sub(mx, 180)) & (F.col("sale_date") <= mx)
    pri = (F.col("sale_date") >= F.date_sub(mx, 362)) & (F.col("sale_date") <= F.date_sub(mx, 181))
    return cur, pri


def _windows(regular: DataFrame, period: Period | None):
    if period is None:
        return _default_windows(regular)
    return period.predicate(), period.previous().predicate()


def category_stats(regular: DataFrame, period: Period | None = None) -> DataFrame:
    """O1: per category and side (current/prior): revenue, cost, qty, discounts, share, margin, per-unit, rate."""
    cur, pri = _windows(regular, period)
    x = regular.where(cur | pri).withColumn("side", F.when(cur, "current").otherwise("prior"))
    g = x.where(F.col("category_clean").isNotNull()).groupBy("side", F.col("category_clean").alias("category")).agg(
        F.sum(cents("actual_revenue")).alias("_rc"), F.sum(cents("cost")).alias("_cc"),
        F.sum("quantity").alias("quantity"), F.sum(cents("discounts")).alias("_dc"))
    tot = x.groupBy("side").agg(F.sum(cents("actual_revenue")).alias("_tc"))
    g = g.join(F.broadcast(tot), "side")  # two rows
    rev, cost, disc = (F.col("_rc") / 100, F.col("_cc") / 100, F.col("_dc") / 100)
    return g.select(
        "side", "category", rev.alias("revenue"), cost.alias("cost"), F.col("quantity").cast("long").alias("quantity"),
        disc.alias("discounts"), ((F.col("_rc") + F.col("_dc")) / 100).alias("pre_discount_revenue"),
        F.when(F.col("_tc") != 0, F.col("_rc") / F.col("_tc") * 100).otherwise(F.lit(0.0)).alias("share"),
        (safe_div(F.col("_rc") - F.col("_cc"), F.col("_rc")) * 100).alias("margin"),
        safe_div(rev, F.col("quantity")).alias("revenue_per_unit"),
        safe_div(cost, F.col("quantity")).alias("cost_per_unit"),
        (safe_div(F.col("_dc"), F.col("_rc") + F.col("_dc")) * 100).alias("discount_rate"),
    )


def _side(c: Column, side: str) -> Column:
    return F.max(F.when(F.col("side") == side, c))


def waterfall_detail(regular: DataFrame, period: Period | None = None) -> DataFrame:
    """Per category shares, margins and contribution (pts), both periods side by side."""
    cs = category_stats(regular, period)
    g = cs.groupBy("category").agg(
        F.coalesce(_side(F.col("share") / 100, "current"), F.lit(0.0)).alias("cs"),
        F.coalesce(_side(F.col("share") / 100, "prior"), F.lit(0.0)).alias("ps"),
        F.coalesce(_side(F.col("margin"), "current"), F.lit(0.0)).alias("cm"),
        F.coalesce(_side(F.col("margin"), "prior"), F.lit(0.0)).alias("pm"),
        F.coalesce(_side(F.col("revenue_per_unit"), "current"), F.lit(0.0)).alias("crpu"),
        F.coalesce(_side(F.col("revenue_per_unit"), "prior"), F.lit(0.0)).alias("prpu"),
        F.coalesce(_side(F.col("cost_per_unit"), "current"), F.lit(0.0)).alias("ccpu"),
        F.coalesce(_side(F.col("cost_per_unit"), "prior"), F.lit(0.0)).alias("pcpu"))
    return g.select(
        "category", "cs", "ps", "cm", "pm",
        ((F.col("cs") - F.col("ps")) * F.col("pm")).alias("mix"),
        F.when(F.col("crpu") != 0, F.col("cs") * (F.col("crpu") - F.col("prpu")) / F.col("crpu") * F.col("cm"))
        .otherwise(F.lit(0.0)).alias("price"),
        F.when(F.col("crpu") != 0, F.col("cs") * (F.col("pcpu") - F.col("ccpu")) / F.col("crpu") * 100)
        .otherwise(F.lit(0.0)).alias("costfx"),
        (F.col("cs") * F.col("cm") - F.col("ps") * F.col("pm")).alias("contribution"))


def _days(regular: DataFrame, period: Period | None) -> DataFrame:
    """The facts a day and category, of the two periods alone where they are known: the waterfall's only read of them."""
    if period is not None:
        regular = regular.where(period.predicate() | period.previous().predicate())
    return compact(regular, "sale_date", "year", "month", "store_clean", "category_clean")


def waterfall_detail_view(regular: DataFrame, period: Period | None = None) -> DataFrame:
    d = waterfall_detail(_days(regular, period), period)
    return d.select("category", r(F.col("ps") * 100, 2).alias("prior_share"), r(F.col("cs") * 100, 2)
                    .alias("current_share"), r(F.col("pm"), 2).alias("prior_margin"),
                    r(F.col("cm"), 2).alias("current_margin"), r(F.col("contribution"), 2).alias("contribution_pts"))


def effects_by_period(regular: DataFrame) -> DataFrame:
    """O3 for every month, quarter and year against the one before it, where both have sales: one job.

    The facts are read once, into a row a category and month; months join the calendar of periods.
    """
    monthly = regular.groupBy(F.col("category_clean").alias("category"), "year", "month").agg(
        F.sum(cents("actual_revenue")).alias("rc"), F.sum(cents("cost")).alias("cc"), F.sum("quantity").alias("q"), F.sum(cents("discounts")).alias("dc"))
    monthly = monthly.withColumn("first_day", F.make_date("year", "month", F.lit(1)))
    sums = in_periods(monthly, period_calendar(regular), "first_day").groupBy("grain", "period", "category").agg(
        *(F.sum(F.when(F.col("side") == s, F.col(c))).alias(f"{s[0]}_{c}") for s in ("current", "previous") for c in ("rc", "cc", "q", "dc")))
    whole = sums.groupBy("grain", "period").agg(*(F.sum(f"{s}_{c}").alias(f"t{s}_{c}") for s in "cp" for c in ("rc", "cc", "dc")))
    x = sums.where("category is not null").join(whole, ["grain", "period"])

    def side(s: str) -> tuple[Column, ...]:
        rc, cc, q, total = F.col(f"{s}_rc"), F.col(f"{s}_cc"), F.col(f"{s}_q"), F.col(f"t{s}_rc")
        share = F.when(rc.isNotNull() & (total != 0), rc / total * 100 / 100).otherwise(F.lit(0.0))
        return share, safe_div(rc - cc, rc) * 100, safe_div(rc / 100, q), safe_div(cc / 100, q)

    (cs, cm, crpu, ccpu), (ps, pm, prpu, pcpu) = side("c"), side("p")
    x = x.select("grain", "period", ((cs - ps) * pm).alias("mix"), F.when(crpu != 0, cs * (crpu - prpu) / crpu * cm).otherwise(F.lit(0.0)).alias("price"),
                 F.when(crpu != 0, cs * (pcpu - ccpu) / crpu * 100).otherwise(F.lit(0.0)).alias("costfx"))
    sums = x.groupBy("grain", "period").agg(*(F.sum(c).alias(c) for c in ("mix", "price", "costfx")))
    margin = lambda s: safe_div(F.col(f"t{s}_rc") - F.col(f"t{s}_cc"), F.col(f"t{s}_rc")) * 100
    rate = lambda s: safe_div(F.col(f"t{s}_dc"), F.col(f"t{s}_rc") + F.col(f"t{s}_dc")) * 100
    y = whole.where("tp_rc is not null and tc_rc is not null").join(sums, ["grain", "period"], "left").fillna(0.0, ["mix", "price", "costfx"])
    y = y.withColumn("disc", (rate("c") - rate("p")) * -1)
    total = margin("c") - margin("p")
    return y.select("grain", "period", r(margin("p"), 2).alias("prior_margin"), r(margin("c"), 2).alias("current_margin"), r(total, 2).alias("total_change_pts"),
                    *(r(F.col(c), 2).alias(f"{n}_pts") for c, n in (("mix", "mix"), ("price", "price"), ("costfx", "cost"), ("disc", "discount"))),
                    r(total - (F.col("mix") + F.col("price") + F.col("costfx") + F.col("disc")), 2).alias("residual_pts"))


def waterfall_effects(regular: DataFrame, period: Period | None = None) -> DataFrame:
    """O2 + O3: blended margins and discount rates per side, the four effects and the residual."""
    regular = _days(regular, period)
    cur, pri = _windows(regular, period)
    tot = regular.where(cur | pri).agg(
        F.sum(F.when(cur, cents("actual_revenue"))).alias("cr"), F.sum(F.when(cur, cents("cost"))).alias("cc"),
        F.sum(F.when(cur, cents("discounts"))).alias("cd"), F.sum(F.when(pri, cents("actual_revenue"))).alias("pr"),
        F.sum(F.when(pri, cents("cost"))).alias("pc"), F.sum(F.when(pri, cents("discounts"))).alias("pd"))
    d = waterfall_detail(regular, period)
    eff = d.agg(F.sum("mix").alias("mix"), F.sum("price").alias("price"), F.sum("costfx").alias("costfx"))
    cm = safe_div(F.col("cr") - F.col("cc"), F.col("cr")) * 100
    pm = safe_div(F.col("pr") - F.col("pc"), F.col("pr")) * 100
    cdr = safe_div(F.col("cd"), F.col("cr") + F.col("cd")) * 100
    pdr = safe_div(F.col("pd"), F.col("pr") + F.col("pd")) * 100
    x = tot.select(cm.alias("cm"), pm.alias("pm"), ((cdr - pdr) * -1).alias("disc"), F.col("pr").alias("_pr"))
    x = x.select("*", eff.select("mix").scalar().alias("mix"), eff.select("price").scalar().alias("price"),
                 eff.select("costfx").scalar().alias("costfx"))
    x = x.where(F.col("_pr").isNotNull())
    total = F.col("cm") - F.col("pm")
    resid = total - (F.col("mix") + F.col("price") + F.col("costfx") + F.col("disc"))
    rows = F.array(*[F.struct(F.lit(i).alias("effect_order"), F.lit(n).alias("name"), v.alias("impact"))
                     for i, (n, v) in enumerate(zip(EFFECTS, [F.col("mix"), F.col("price"), F.col("costfx"),
                                                              F.col("disc")]))])
    y = x.select(r(F.col("pm"), 2).alias("prior_margin"), r(F.col("cm"), 2).alias("current_margin"),
                 r(total, 2).alias("total_change_pts"), r(resid, 2).alias("residual_pts"), F.inline(rows))
    return y.select("effect_order", "name", r(F.col("impact"), 2).alias("impact_pts"),
                    F.when(F.col("impact") > 0, "positive").when(F.col("impact") < 0, "negative").otherwise("neutral")
                    .alias("direction"), "prior_margin", "current_margin", "total_change_pts", "residual_pts")
