"""Traffic heatmap (M1-M6)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.functions import fixed
from tillpoint.functions.expr import day_name, msum, r, safe_div
from tillpoint.plans.curate import compact


def hour_label(h):
    """'12am', '1am' ... '12pm', '1pm' ..."""
    h = F.col(h) if isinstance(h, str) else h
    return (F.when(h == 0, F.lit("12am")).when(h < 12, F.concat(h.cast("string"), F.lit("am")))
            .when(h == 12, F.lit("12pm")).otherwise(F.concat((h - 12).cast("string"), F.lit("pm"))))


def _parts(df: DataFrame) -> DataFrame:
    """weekday (Monday=0) and hour of the sale."""
    return df.withColumn("day", F.weekday("completed_at")).withColumn("hour", F.hour("completed_at"))


def traffic_grid(regular: DataFrame) -> DataFrame:
    """M1: revenue and distinct receipts by (weekday, hour)."""
    g = _parts(regular).groupBy("day", "hour").agg(msum("actual_revenue").alias("revenue"),
                                                   F.countDistinct("receipt_id").alias("transactions"))
    return g.select("day", day_name(F.col("day")).alias("day_name"), "hour", "revenue", "transactions")


def peak_hours(regular: DataFrame, n: int = 5) -> DataFrame:
    """M2: top cells by revenue and by receipts (ties: day, hour)."""
    g = traffic_grid(regular)
    a = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("revenue"), "day", "hour"))) \
        .where(F.col("rank") <= n).withColumn("ranked_by", F.lit("revenue"))
    b = g.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("transactions"), "day", "hour"))) \
        .where(F.col("rank") <= n).withColumn("ranked_by", F.lit("transactions"))
    return a.unionByName(b).select("ranked_by", "rank", "day_name", "hour", hour_label("hour").alias("hour_label"),
                                   "revenue", "transactions")


def daily_summary(regular: DataFrame) -> DataFrame:
    """M3: per weekday revenue, receipts, mean basket."""
    g = _parts(regular).groupBy("day").agg(msum("actual_revenue").alias("revenue"),
                                           F.countDistinct("receipt_id").alias("transactions"))
    return g.select("day", day_name(F.col("day")).alias("day_name"), "revenue", "transactions",
                    r(safe_div(F.col("revenue"), F.col("transactions")), 2).alias("avg_basket"))


def store_traffic_grid(regular: DataFrame) -> DataFrame:
    """M4: the grid of every store."""
    return (_parts(regular).where(F.col("store_clean").isNotNull())
         .groupBy(F.col("store_clean").alias("store"), "day", "hour")
         .agg(msum("actual_revenue").alias("revenue"), F.countDistinct("receipt_id").alias("transactions")))


def traffic_kpis(regular: DataFrame) -> DataFrame:
    """M5 + M6: busiest/quietest day, busiest hour, and the peak window description."""
    cells = compact(_parts(regular), "day", "hour")  # at most 7 x 24 rows
    d = cells.groupBy("day").agg(F.sum(F.rint(F.col("actual_revenue") * 100).cast("long")).alias("c"))
    h = cells.groupBy("hour").agg(F.sum(F.rint(F.col("actual_revenue") * 100).cast("long")).alias("c"))
    busiest_day = d.agg(F.max_by("day", F.struct(F.col("c"), -F.col("day")))).scalar()
    quietest_day = d.agg(F.min_by("day", F.struct(F.col("c"), -F.col("day")))).scalar()
    busiest_hour = h.agg(F.max_by("hour", F.struct(F.col("c"), -F.col("hour")))).scalar()
    return regular.sparkSession.range(1).select(
        day_name(busiest_day).alias("busiest_day"), busiest_hour.alias("busiest_hour"),
        hour_label(busiest_hour).alias("busiest_hour_label"), day_name(quietest_day).alias("quietest_day"),
        peak_window(regular, cells).select("description").scalar().alias("peak_description"))


def peak_window(regular: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """M6: contiguous hours around the peak cell (same day) with revenue >= 50 % of the peak.

    Gaps-and-islands: keep cells at or above the threshold on the peak's day,
    island key = hour - row_number(); keep the peak's island.
    """
    cells = compact(_parts(regular), "day", "hour") if cells is None else cells
    g = cells.select("day", "hour", F.rint(F.col("actual_revenue") * 100).cast("long").alias("c"))
    peak = g.agg(F.max_by(F.struct("day", "hour", "c"), F.struct(F.col("c"), -F.col("day"), -F.col("hour")))
                 .alias("p"))
    pd_, ph, pc = (peak.select("p.day").scalar(), peak.select("p.hour").scalar(), peak.select("p.c").scalar())
    cells = g.where((F.col("day") == pd_) & (F.col("c") >= pc * 0.5))
    cells = cells.withColumn("_isl", F.col("hour") - F.row_number().over(Window.partitionBy("day").orderBy("hour")))
    isl = cells.where(F.col("hour") == ph).select("_isl")
    span = cells.join(isl, "_isl").agg(F.min("hour").alias("s"), F.max("hour").alias("e"), F.first("day").alias("d"))
    return span.select(F.when(F.col("s") == F.col("e"), F.concat(day_name(F.col("d")), F.lit(" "), hour_label("s")))
                       .otherwise(F.concat(day_name(F.col("d")), F.lit(" "), hour_label("s"), F.lit("-"),
                                           hour_label("e"))).alias("description"),
                       F.col("s").alias("start_hour"), F.col("e").alias("end_hour"))
