"""Two-phase global prefix sums / row numbers without a single-partition window.

A plain ``Window.orderBy(...)`` with no partition moves every row into one
task. Instead:

1. range-partition on the ordering (distributed sort sample) and cut lineage
   with ``checkpoint()`` so partition boundaries are fixed;
2. per-partition counts and sums (one tiny row per partition);
3. exclusive offsets per partition (a window over at most
   ``spark.sql.shuffle.partitions`` rows, broadcast back);
4. a running window *inside* each range partition plus its offset.

The ordering must be total (add a unique tie-break column) so both the
range boundaries and the within-partition order are deterministic.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tillpoint.session import shared_dir


def global_running(df: DataFrame, order: list[Column], value: str | None = None, n_parts: int | None = None,
                   index_col: str = "global_index", running_col: str = "running_sum") -> DataFrame:
    """Add a 1-based global row index (and running sum of ``value``) in ``order``."""
    spark = df.sparkSession
    shared_dir(spark)  # make sure a checkpoint folder exists (tests/local)
    n_parts = n_parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    val = F.col(value) if value else F.lit(0)
    ranged = (df.repartitionByRange(n_parts, *order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_v", val))
    ranged = ranged.checkpoint(eager=True)
    stats = ranged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"), F.sum("_v").alias("_s"))
    w_all = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = stats.select("_pid", F.coalesce(F.sum("_n").over(w_all), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_s").over(w_all), F.lit(0)).alias("_s0"))
    w_in = Window.partitionBy("_pid").orderBy(*order)
    w_run = w_in.rowsBetween(Window.unboundedPreceding, 0)
    out = (ranged.join(F.broadcast(offsets), "_pid")
           .withColumn(index_col, F.row_number().over(w_in) + F.col("_n0"))
           .withColumn(running_col, F.sum("_v").over(w_run) + F.col("_s0")))
    drop = ["_pid", "_v", "_n0", "_s0"] + ([] if value else [running_col])
    return out.drop(*drop)


#: Buckets of one histogram of `value_at`.
BUCKETS = 1024


def value_at(df: DataFrame, value: str, rank: int, low: int, high: int) -> int:
    """The `rank`-th smallest (from 1) of a bigint column whose values lie from `low` to `high`.

    Each round counts BUCKETS equal stretches and goes on in the one that holds the rank: one aggregation a round, at most
    BUCKETS rows on the driver, and as many rounds as the span has powers of BUCKETS (four for 10^12 values).
    """
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        inside = df.where(F.col(value).between(low, high))
        counts = inside.groupBy(F.floor((F.col(value) - low) / F.lit(width)).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy("b").collect()
        for b, n in counts:
            if rank <= n:
                low, high = low + b * width, min(high, low + (b + 1) * width - 1)
                break
            rank -= n
    return low


def median_of(df: DataFrame, value: str) -> float | None:
    """Exact median of a bigint column (mean of the two middle values for an even number); None without values."""
    n, low, high = df.agg(F.count(value), F.min(value), F.max(value)).first()
    if not n:
        return None
    middle = value_at(df, value, (n + 1) // 2, low, high)
    if n % 2:
        return float(middle)
    # the next value is the same one, if it occurs past the middle, or the least above it
    upto, above = df.agg(F.count(F.when(F.col(value) <= middle, 1)), F.min(F.when(F.col(value) > middle, F.col(value)))).first()
    return (middle + (middle if upto > n // 2 else above)) / 2
