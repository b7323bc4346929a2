"""Revenue forecast (N1-N4) on the month grain."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions.expr import msum, r, safe_div
from tillpoint.plans.curate import compact


def _abbr(m):
    return F.date_format(F.make_date(F.lit(2000), m, F.lit(1)), "MMM")


def monthly_revenue(regular: DataFrame) -> DataFrame:
    """Monthly revenue/profit and trailing-3-month means (fewer rows at the start)."""
    g = regular.groupBy("year", "month").agg(msum("actual_revenue").alias("revenue"), msum("net_profit").alias("profit"))
    w = Window.orderBy("year", "month").rowsBetween(-2, 0)  # month grain: one row per month
    return g.select("year", "month", F.concat(_abbr(F.col("month")), F.lit(" "), F.col("year").cast("string"))
                    .alias("label"), "revenue", "profit",
                    r(F.avg("revenue").over(w), 2).alias("trailing_3m_revenue"),
                    r(F.avg("profit").over(w), 2).alias("trailing_3m_profit"))


def _indexed(regular: DataFrame) -> DataFrame:
    m = monthly_revenue(regular)
    return m.withColumn("k", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("month"))))


def growth_trajectory(regular: DataFrame) -> DataFrame:
    """Last 3 vs previous 3 months (6+ months), else last 3 vs the first max(n-3, 1); +-2 % classes."""
    m = _indexed(compact(regular, "year", "month"))
    n = m.agg(F.count(F.lit(1))).scalar()
    cur = F.avg(F.when(F.col("k") <= 3, F.col("revenue")))
    prior = F.when(n >= 6, F.avg(F.when((F.col("k") > 3) & (F.col("k") <= 6), F.col("revenue")))) \
        .otherwise(F.avg(F.when(F.col("k") > n - F.greatest(n - 3, F.lit(1)), F.col("revenue"))))
    g = m.agg(cur.alias("cur"), prior.alias("pri"))
    rate = F.when(n >= 3, safe_div(F.col("cur") - F.col("pri"), F.abs(F.col("pri"))) * 100)
    return g.select(r(rate, 2).alias("growth_rate"),
                    F.when(rate > 2.0, "accelerating").when(rate < -2.0, "decelerating").otherwise("stable")
                    .alias("trajectory"))


def seasonal_factors(regular: DataFrame) -> DataFrame:
    """Month revenue / mean month of the latest complete (12-month) year; all data if none; else 1.0."""
    m = monthly_revenue(compact(regular, "year", "month"))
    yrs = m.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    base_year = yrs.where(F.col("n") == 12).agg(F.max("year")).scalar()
    base = m.where(base_year.isNull() | (F.col("year") == base_year))
    avg = base.agg(F.sum(F.rint(F.col("revenue") * 100).cast("long")).cast("double") / 100 / F.count(F.lit(1))).scalar()
    per = base.groupBy("month").agg(F.sum(F.rint(F.col("revenue") * 100).cast("long")).alias("c"))
    months = regular.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    x = months.join(per, "month", "left")
    f = F.when(F.col("c").isNull() | (avg == 0), F.lit(1.0)).otherwise(r(F.col("c") / 100 / avg, 4))
    return x.select("month", F.date_format(F.make_date(F.lit(2000), F.col("month"), F.lit(1)), "MMMM")
                    .alias("month_name"), f.alias("factor"))


def forecast_3m(regular: DataFrame) -> DataFrame:
    """Next 3 months = trailing-3 mean x factor (same month last year / that year's mean, else N3)."""
    regular = compact(regular, "year", "month")
    m = _indexed(regular)
    n = m.agg(F.count(F.lit(1))).scalar()
    last = m.where(F.col("k") == 1)
    tr = m.agg(F.avg(F.when(F.col("k") <= 3, F.col("revenue"))).alias("tr"),
               F.avg(F.when(F.col("k") <= 3, F.col("profit"))).alias("tp"))
    steps = last.select("year", "month", F.explode(F.sequence(F.lit(1), F.lit(3))).alias("i"))
    fwd = steps.select(((F.col("month") + F.col("i") - 1) % 12 + 1).alias("month"),
                       (F.col("year") + F.expr("(month + i - 1) div 12")).alias("year"))
    yavg = m.groupBy("year").agg((F.sum(F.rint(F.col("revenue") * 100).cast("long")).cast("double") / 100
                                  / F.count(F.lit(1))).alias("yavg"))
    prior = m.select((F.col("year") + 1).alias("year"), "month", F.col("revenue").alias("prev_rev")) \
        .join(yavg.select((F.col("year") + 1).alias("year"), "yavg"), "year")
    sf = seasonal_factors(regular).select("month", F.col("factor").alias("sfac"))
    x = fwd.join(prior, ["year", "month"], "left").join(sf, "month", "left")
    factor = F.when(F.col("prev_rev").isNotNull(),
                    F.when(F.col("yavg") > 0, F.col("prev_rev") / F.col("yavg")).otherwise(F.lit(1.0))) \
        .otherwise(F.coalesce(F.col("sfac"), F.lit(1.0)))
    x = x.withColumn("_f", factor).where(F.lit(n) >= 6)
    return x.select("year", "month", F.concat(_abbr(F.col("month")), F.lit(" "), F.col("year").cast("string")).alias("label"),
                    r(tr.select("tr").scalar() * F.col("_f"), 2).alias("projected_revenue"),
                    r(tr.select("tp").scalar() * F.col("_f"), 2).alias("projected_profit"),
                    r(F.col("_f"), 4).alias("seasonality_factor"))
