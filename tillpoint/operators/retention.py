"""Retention.

Everything derives from one customer-month table, one aggregation of the facts, which callers may make once and hand to
several reports. The activity table adds ``idx``: ``idx`` is the position of the
month among months present in the data (months with no sales do not
consume an index). No per-customer sets are ever collected: churn expands
each activity row to the three following month indexes and anti-joins.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import cents, msum, r, safe_div
from tillpoint.plans.curate import materialize
from tillpoint.plans.prefix import median_of


def _label(ym):
    return F.format_string("%d-%02d", F.expr(f"{ym} div 100"), F.col(ym) % 100)


def customer_months(regular: DataFrame) -> DataFrame:
    """(customer_id, ym, rev_c, lines, first_at, last_at): one row per active customer-month; the reports' only read of the facts."""
    return regular.where(F.col("customer_id").isNotNull()).groupBy("customer_id", "ym").agg(
        F.coalesce(F.sum(cents("actual_revenue")), F.lit(0)).alias("rev_c"), F.count(F.lit(1)).alias("lines"),
        F.min("completed_at").alias("first_at"), F.max("completed_at").alias("last_at"))


def activity(cm: DataFrame) -> DataFrame:
    """(customer_id, ym, idx, rev_c, lines, first_idx, first_ym) of the customer-months."""
    months = cm.select("ym").distinct()
    # one row per month present: a bounded table (hundreds of rows), ranked in one task
    months = months.withColumn("idx", F.row_number().over(Window.orderBy("ym")) - 1)
    x = cm.join(F.broadcast(months), "ym")
    w = Window.partitionBy("customer_id")
    return x.withColumn("first_idx", F.min("idx").over(w)).withColumn("first_ym", F.min("ym").over(w))


def new_vs_returning(regular: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """Per month total/new/returning customers and revenue."""
    a = activity(customer_months(regular) if months is None else months)
    new = F.col("ym") == F.col("first_ym")
    g = a.groupBy("ym").agg(
        F.count(F.lit(1)).alias("total_customers"), F.count(F.when(new, 1)).alias("new_customers"),
        F.count(F.when(~new, 1)).alias("returning_customers"),
        (F.sum("rev_c").cast("double") / 100).alias("total_revenue"),
        (F.coalesce(F.sum(F.when(new, F.col("rev_c"))), F.lit(0)).cast("double") / 100).alias("new_revenue"),
        (F.coalesce(F.sum(F.when(~new, F.col("rev_c"))), F.lit(0)).cast("double") / 100).alias("returning_revenue"))
    return g.select(
        F.expr("ym div 100").alias("year"), (F.col("ym") % 100).alias("month"), _label("ym").alias("label"),
        "total_customers", "new_customers", "returning_customers",
        r(safe_div(F.col("new_customers"), F.col("total_customers")) * 100, 1).alias("new_pct"),
        r(safe_div(F.col("returning_customers"), F.col("total_customers")) * 100, 1).alias("returning_pct"),
        "total_revenue", "new_revenue", "returning_revenue")


def churn_3m(regular: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """From the 4th present month, customers active in the prior 3 present months and absent now.

    Also emits ``reactivated``: active now, active before the 3-month window,
    but not inside it.
    """
    a = activity(customer_months(regular) if months is None else months).select("customer_id", "ym", "idx", "first_idx")
    months = a.select("ym", "idx").distinct()
    prior = (a.select("customer_id", F.explode(F.sequence(F.col("idx") + 1, F.col("idx") + 3)).alias("t"))
             .distinct())
    cur = a.select("customer_id", F.col("idx").alias("t"), "first_idx")
    prior_n = prior.groupBy("t").agg(F.count(F.lit(1)).alias("active_prior_3m"))
    cur_n = cur.groupBy("t").agg(F.count(F.lit(1)).alias("active_current"))
    churned = prior.join(cur, ["customer_id", "t"], "left_anti").groupBy("t").agg(F.count(F.lit(1)).alias("churned"))
    react = (cur.where(F.col("first_idx") < F.col("t") - 3).join(prior, ["customer_id", "t"], "left_anti")
             .groupBy("t").agg(F.count(F.lit(1)).alias("reactivated")))
    x = (months.where(F.col("idx") >= 3).withColumnRenamed("idx", "t")
         .join(prior_n, "t", "left").join(cur_n, "t", "left").join(churned, "t", "left").join(react, "t", "left"))
    x = x.fillna(0, ["active_prior_3m", "active_current", "churned", "reactivated"])
    rate = safe_div(F.col("churned"), F.col("active_prior_3m")) * 100
    return x.select(_label("ym").alias("label"), F.expr("ym div 100").alias("year"), (F.col("ym") % 100).alias("month"),
                    "active_prior_3m", "active_current", "churned",
                    F.when(F.col("t") > 3, F.col("reactivated")).otherwise(F.lit(0)).alias("reactivated"),
                    r(rate, 1).alias("churn_rate"), r(100 - rate, 1).alias("retention_rate"))


def cohort_retention(regular: DataFrame, min_size: int = 1) -> DataFrame:
    """Cohorts (first month) of at least ``min_size`` (fixed.COHORT_MIN_SIZE for the usual report); active count and % at every offset.

    The dense grid is generated per cohort with ``sequence(0, last - idx)``
    (no cross join); counts come from one aggregation of the activity table.
    """
    a = activity(customer_months(regular))
    last = a.agg(F.max("idx")).scalar()
    sizes = (a.where(F.col("idx") == F.col("first_idx")).groupBy("first_idx", "first_ym")
             .agg(F.count(F.lit(1)).alias("cohort_size")).where(F.col("cohort_size") >= min_size))
    counts = a.groupBy("first_idx", (F.col("idx") - F.col("first_idx")).alias("month_offset")).agg(
        F.count(F.lit(1)).alias("active"))
    grid = sizes.select("*", F.explode(F.sequence(F.lit(0), last - F.col("first_idx"))).alias("month_offset"))
    x = grid.join(counts, ["first_idx", "month_offset"], "left").fillna(0, ["active"])
    return x.select(_label("first_ym").alias("cohort_label"), "cohort_size", "month_offset",
                    F.col("active").cast("long").alias("active"),
                    r(safe_div(F.col("active"), F.col("cohort_size")) * 100, 1).alias("retention_pct"))


def cohort_summary(regular: DataFrame, min_size: int = 1) -> DataFrame:
    """Retention % at months 1, 3, 6, 12 per cohort (null when not reached)."""
    c = cohort_retention(regular, min_size)
    aggs = [F.max(F.when(F.col("month_offset") == k, F.col("retention_pct"))).alias(f"m{k}") for k in (1, 3, 6, 12)]
    return c.groupBy(F.col("cohort_label").alias("cohort"), F.col("cohort_size").alias("size")).agg(*aggs)


def customer_ltv(regular: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """J5 (per customer): revenue, first/last purchase, tenure in whole days, active months."""
    g = (customer_months(regular) if months is None else months).groupBy("customer_id").agg(
        (F.sum("rev_c").cast("double") / 100).alias("total_revenue"), F.min("first_at").alias("first_purchase"),
        F.max("last_at").alias("last_purchase"), F.count(F.lit(1)).alias("transaction_months"))
    secs = F.unix_timestamp(F.col("last_purchase").cast("timestamp")) - F.unix_timestamp(
        F.col("first_purchase").cast("timestamp"))
    return g.select("customer_id", "total_revenue", "first_purchase", "last_purchase",
                    F.floor(secs / 86400).alias("tenure_days"), "transaction_months",
                    (F.col("total_revenue") / F.greatest(F.col("transaction_months"), F.lit(1))).alias("monthly_value"))


def ltv_kpis(regular: DataFrame, months: DataFrame | None = None) -> DataFrame:
    """J5 (summary): customers, mean and exact median LTV, mean tenure and monthly value.

    The customers' values are written once; the median is found by refining a histogram of them, not by sorting.
    """
    ltv = customer_ltv(regular, months).select(cents("total_revenue").alias("_c"), "total_revenue", "tenure_days", "monthly_value")
    ltv = materialize(regular.sparkSession, ltv, "ltv", None)
    middle = median_of(ltv, "_c")
    med = F.lit(None if middle is None else middle / 100).cast("double")
    g = ltv.agg(F.count(F.lit(1)).alias("total_unique_customers"), F.avg("total_revenue").alias("_avg"),
                F.avg("tenure_days").alias("_t"), F.avg("monthly_value").alias("_mv"))
    return g.select("total_unique_customers", r(F.col("_avg"), 2).alias("avg_ltv"), r(med, 2).alias("median_ltv"),
                    r(F.col("_t"), 0).alias("avg_tenure_days"), r(F.col("_mv"), 2).alias("avg_monthly_value"))


def ltv_by_tenure(regular: DataFrame) -> DataFrame:
    """Customers and revenue by tenure bucket (empty buckets omitted)."""
    ltv = customer_ltv(regular)
    total = ltv.agg(F.count(F.lit(1))).scalar()
    b = None
    for i, (label, lo, hi) in enumerate(fixed.TENURE_BUCKETS):
        cond = (F.col("tenure_days") > lo) & ((F.col("tenure_days") <= hi) if hi is not None else F.lit(True))
        b = (F.when(cond, F.struct(F.lit(i).alias("o"), F.lit(label).alias("l"))) if b is None
             else b.when(cond, F.struct(F.lit(i).alias("o"), F.lit(label).alias("l"))))
    x = ltv.withColumn("_b", b).where(F.col("_b").isNotNull())
    g = x.groupBy(F.col("_b.o").alias("bucket_order"), F.col("_b.l").alias("bucket")).agg(
        F.count(F.lit(1)).alias("customers"), F.sum(cents("total_revenue")).alias("_c"))
    return g.select("bucket_order", "bucket", "customers",
                    r(safe_div(F.col("customers"), total) * 100, 1).alias("pct_of_total"),
                    r(F.col("_c") / 100 / F.col("customers"), 2).alias("avg_revenue"),
                    (F.col("_c").cast("double") / 100).alias("total_revenue"))


def revenue_at_risk(regular: DataFrame, customer_month: DataFrame | None = None) -> DataFrame:
    """Customers whose last-3-month spend is below half their prior average line value.

    Prior window = month indexes n-9..n-4 (or all but the last 3 when fewer
    than 9 months); requires more than 6 months. ``mode='reference'``
    compares a 3-month sum with a per-line mean, as the reference does.
    """
    base = customer_months(regular) if customer_month is None else customer_month
    months = base.select("ym").distinct()
    months = months.withColumn("idx", F.row_number().over(Window.orderBy("ym")) - 1)
    n = months.agg(F.count(F.lit(1))).scalar()
    x = base.join(F.broadcast(months), "ym")
    recent = F.col("idx") >= n - 3
    prior = (F.col("idx") < n - 3) & (F.col("idx") >= F.when(n >= 9, n - 9).otherwise(F.lit(0)))
    g = x.groupBy("customer_id").agg(
        F.sum(F.when(recent, F.col("rev_c"))).alias("_rc"), F.sum(F.when(prior, F.col("rev_c"))).alias("_pc"),
        F.coalesce(F.sum(F.when(prior, F.col("lines"))), F.lit(0)).alias("_pn"))
    g = g.where(F.col("_rc").isNotNull() & (F.col("_pn") > 0))
    pavg = F.col("_pc") / 100 / F.col("_pn")
    risk = g.where((F.col("_rc") / 100 < pavg * 0.5) & (F.lit(n) > 6))
    return risk.agg(F.count(F.lit(1)).alias("at_risk_customers"),
                    r(F.coalesce(F.sum(pavg), F.lit(0.0)), 0).alias("at_risk_monthly_revenue"))


def retention_kpis(regular: DataFrame) -> DataFrame:
    """Headline retention KPIs (one row). The facts are read once, into the customer-months that all parts start from."""
    months = materialize(regular.sparkSession, customer_months(regular), "customer-months", None)
    last = [F.desc("year"), F.desc("month")]
    parts = [
        ltv_kpis(regular, months),
        new_vs_returning(regular, months).orderBy(*last).limit(1).select(
            F.col("new_customers").alias("latest_new_customers"), F.col("returning_customers").alias("latest_returning_customers"),
            F.col("returning_pct").alias("latest_returning_pct")),
        churn_3m(regular, months).orderBy(*last).limit(1).select(F.col("churn_rate").alias("latest_churn_rate")),
        revenue_at_risk(regular, months)]
    # one row each, or none where there is no such month
    one = lambda df: df.select(F.lit(1).alias("_one"), "*")
    return reduce(lambda a, b: a.join(one(b), "_one", "left"), parts[1:], one(parts[0])).drop("_one")
