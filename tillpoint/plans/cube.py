"""Period x store cube from the facts (T1) and sanitising of output (A10).

The reference recomputes every view for every month and store in nested
loops; here the loop variables are grouping keys: one GROUPING SETS
aggregation ((ym, store), (ym), (store), ()) for additive metrics, and a
second one for the distinct counts (distincts make Spark expand rows, so
keeping them apart keeps the additive pass cheap). The two are joined on
the (null-safe) key.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.functions.expr import isum, msum, r, safe_div

KEYS = ["ym", "store_clean"]


def _sets(df: DataFrame):
    k = [F.col(c) for c in KEYS]
    return df.groupingSets([[k[0], k[1]], [k[0]], [k[1]], []], *k)


def period_store_cube(regular: DataFrame) -> DataFrame:
    """Additive and distinct metrics for every (month, store), month, store and all-time cell."""
    add = _sets(regular.select(*KEYS, "actual_revenue", "net_profit", "cost", "quantity", "discounts")).agg(
        msum("actual_revenue").alias("revenue"), msum("net_profit").alias("profit"), msum("cost").alias("cost"),
        isum("quantity").alias("units"), msum("discounts").alias("discounts"), F.count(F.lit(1)).alias("lines"),
        F.grouping_id().alias("gid"))
    dist = _sets(regular.select(*KEYS, "receipt_id", "customer_id")).agg(
        F.countDistinct("receipt_id").alias("transactions"), F.countDistinct("customer_id").alias("customers"),
        F.grouping_id().alias("gid"))
    cond = [add[c].eqNullSafe(dist[c]) for c in KEYS] + [add["gid"] == dist["gid"]]
    x = add.join(dist, cond).select(add["ym"], add["store_clean"], add["gid"], "revenue", "profit", "cost", "units",
                                    "discounts", "lines", "transactions", "customers")
    period = F.when(F.col("gid").bitwiseAND(2) == 0, F.format_string("%d-%02d", F.expr("ym div 100"), F.col("ym") % 100)) \
        .otherwise(F.lit("all"))
    store = F.when(F.col("gid").bitwiseAND(1) == 0, F.col("store_clean")).otherwise(F.lit("all"))
    return x.select(period.alias("period"), store.alias("store"), "revenue", "profit", "cost", "units", "discounts",
                    "lines", "transactions", "customers",
                    r(safe_div(F.col("profit"), F.col("revenue")) * 100, 1).alias("margin"),
                    r(safe_div(F.col("revenue"), F.col("transactions")), 2).alias("avg_basket"))


def _clean(value, kind):
    """A value without NaN and infinities, at any depth; null if nothing of its type can hold one."""
    from pyspark.sql.types import ArrayType, DoubleType, FloatType, MapType, StructType

    if isinstance(kind, (DoubleType, FloatType)):
        return F.when(F.isnan(value) | (F.abs(value) == float("inf")), F.lit(0.0).cast(kind)).otherwise(value)
    if isinstance(kind, ArrayType):
        inner = _clean(F.lit(None), kind.elementType) is not None
        return F.transform(value, lambda x: _clean(x, kind.elementType)) if inner else None
    if isinstance(kind, MapType):
        odd_key = isinstance(kind.keyType, (DoubleType, FloatType))
        if odd_key:  # such a key names nothing
            value = F.map_filter(value, lambda k, v: ~F.isnan(k) & (F.abs(k) != float("inf")))
        inner = _clean(F.lit(None), kind.valueType) is not None
        return F.transform_values(value, lambda k, v: _clean(v, kind.valueType)) if inner else value if odd_key else None
    if isinstance(kind, StructType):
        fields = [(f.name, _clean(value.getField(f.name), f.dataType)) for f in kind.fields]
        if all(c is None for _, c in fields):
            return None
        made = F.struct(*((value.getField(n) if c is None else c).alias(n) for n, c in fields))
        return F.when(value.isNotNull(), made)
    return None


def sanitize(df: DataFrame) -> DataFrame:
    """A10: NaN and infinities -> 0 in all floating values, inside arrays, maps and structs too; map keys that are none go."""
    cols = []
    for f in df.schema.fields:
        c = _clean(F.col(f"`{f.name}`"), f.dataType)
        cols.append(F.col(f"`{f.name}`") if c is None else c.alias(f.name))
    return df.select(*cols)


def keyed(entries: str):
    """A10: a map from an array of (key, value) structs, without those that have no key."""
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull()))
