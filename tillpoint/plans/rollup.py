"""T1-T3 from stored month results that merge: the facts are read at the build alone.

Four tables, by month (``ym``) and store:

* ``cells``: additive measures, money as integer cents;
* ``ids``: each receipt and customer id with a number, dealt out by first month, so that a month's new ids lie together;
* ``distinct``: which ids were there, exactly, as sets that merge: ids fall into buckets of 32768 numbers, a set is a
  bitmap of 4 KB where it holds more than SPARSE of a bucket's numbers, else the list of them;
* ``sketches``: the same sets as HLL sketches, for approximate counts of any range.

Counts of a range, a store or everything are unions of the sets of its months and stores. ``merged`` replaces or adds
months without reading the others' facts.
"""
from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.functions.expr import cents, r, safe_div
from tillpoint.plans.curate import load_sales, materialize, regular

KEYS = ["ym", "store"]
MONEY = {"revenue": "actual_revenue", "profit": "net_profit", "cost": "cost", "discounts": "discounts"}
KINDS = {"transactions": "receipt_id", "customers": "customer_id"}
#: Numbers of a bucket (fixed by the bitmap functions), a set's most numbers as a list, and the sketches' size (2^14 registers).
BUCKET_BITS, SPARSE, LG_K = 15, 512, 14
#: Four standard errors of such a sketch.
SKETCH_ERROR = 4 * 1.04 / 2 ** (LG_K / 2)

STATE = {"cells": "ym int, store string, revenue bigint, profit bigint, cost bigint, discounts bigint, units bigint, lines bigint",
         "ids": "kind string, id string, code bigint", "distinct": "ym int, store string, kind string, bucket bigint, bits binary, few array<int>",
         "sketches": "ym int, store string, kind string, sketch binary"}


@dataclass(frozen=True)
class Rollup:
    cells: DataFrame
    ids: DataFrame
    distinct: DataFrame
    sketches: DataFrame

    def where(self, condition: Column) -> Rollup:
        """The months and stores that meet a condition on ``ym`` and ``store``."""
        return Rollup(self.cells.where(condition), self.ids, self.distinct.where(condition), self.sketches.where(condition))


def empty_rollup(spark: SparkSession) -> Rollup:
    return Rollup(**{k: spark.createDataFrame([], v) for k, v in STATE.items()})


def numbered(new: DataFrame, start: int) -> DataFrame:
    """(kind, id, first, *others) -> (kind, id, code, *others): consecutive numbers from `start`, by kind and first month."""
    order = ["kind", "first", "id"]
    others = [c for c in new.columns if c not in order]
    placed = new.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(new.sparkSession, placed, "rollup-numbered", None)
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return placed.withColumn("part", part).join(F.broadcast(starts), "part").select("kind", "id", (F.col("start") + place + start).alias("code"), *others)


def merged(old: Rollup, facts: DataFrame) -> Rollup:
    """The roll-up with the months of `facts` (regular lines) in place of what it held for them.

    The facts are read twice: into a row a month and store, and into a row an id with the months and stores it was in (at most all of
    them), which is shuffled once and keeps them while ids are numbered.
    """
    spark = facts.sparkSession
    save = lambda df, name: materialize(spark, df, f"rollup-{name}", None)
    facts = facts.withColumn("store", F.col("store_clean"))
    base = save(facts.groupBy(*KEYS).agg(
        *(F.coalesce(F.sum(cents(c)), F.lit(0)).alias(k) for k, c in MONEY.items()),
        F.coalesce(F.sum("quantity"), F.lit(0)).cast("bigint").alias("units"), F.count(F.lit(1)).alias("lines"),
        F.array(*(F.struct(F.lit(k).alias("kind"), F.count(c).alias("n"), F.hll_sketch_agg(c, LG_K).alias("sketch")) for k, c in KINDS.items())).alias("sketches")), "base")
    months = [x.ym for x in base.select("ym").distinct().collect()]  # one row a month
    kept = old.where(~F.col("ym").isin(months)) if months else old
    cells = base.select(*KEYS, *MONEY, "units", "lines")
    sketches = base.select(*KEYS, F.inline("sketches")).where("n > 0").drop("n")
    there = F.array(*(F.struct(F.lit(k).alias("kind"), F.col(c).alias("id")) for k, c in KINDS.items()))
    seen = facts.select(*KEYS, F.inline(there)).where("id is not null").groupBy("kind", "id").agg(F.collect_set(F.struct(*KEYS)).alias("seen"))
    last = old.ids.agg(F.max("code")).first()[0]
    known = None
    if last is not None:
        seen = save(seen, "seen")
        known = seen.join(old.ids, ["kind", "id"]).select("kind", "code", "seen")
        seen = seen.join(old.ids, ["kind", "id"], "left_anti")
    new = numbered(seen.withColumn("first", F.array_min("seen.ym")), 0 if last is None else last + 1)
    ids = save(old.ids.union(new.select("kind", "id", "code")), "ids")
    coded = new.select("kind", "code", "seen")
    coded = (coded if known is None else coded.union(known)).select("kind", "code", F.inline("seen"))
    bucket, place = F.shiftright("code", BUCKET_BITS), F.col("code").bitwiseAND(F.lit((1 << BUCKET_BITS) - 1)).cast("int")
    lists = coded.groupBy(*KEYS, "kind", bucket.alias("bucket")).agg(F.collect_list(place).alias("few"))  # at most a bucket's numbers
    lists = save(lists, "lists")
    sparse = F.size("few") <= SPARSE
    dense = lists.where(~sparse).select(*KEYS, "kind", "bucket", F.explode("few").alias("p")).groupBy(*KEYS, "kind", "bucket").agg(
        F.bitmap_construct_agg(F.col("p").cast("bigint")).alias("bits")).select("*", F.lit(None).cast("array<int>").alias("few"))
    distinct = dense.unionByName(lists.where(sparse).withColumn("bits", F.lit(None).cast("binary")))
    return Rollup(save(kept.cells.unionByName(cells), "cells"), ids, save(kept.distinct.unionByName(distinct.select(*kept.distinct.columns)), "distinct"),
                  save(kept.sketches.unionByName(sketches), "sketches"))


def exact_counts(rollup: Rollup, by: list[str]) -> DataFrame:
    """(*by, transactions, customers): sizes of the unions of the sets over all months and stores of each value of `by`."""
    keys = [*by, "kind", "bucket"]
    x = rollup.distinct
    listed = x.where("few is not null").select(*keys, F.explode("few").alias("p")).groupBy(*keys).agg(F.bitmap_construct_agg(F.col("p").cast("bigint")).alias("bits"))
    sets = x.where("bits is not null").select(*keys, "bits").union(listed).groupBy(*keys).agg(F.bitmap_or_agg("bits").alias("bits"))
    return sets.groupBy(*by).agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.bitmap_count("bits"))), F.lit(0)).alias(k) for k in KINDS))


def cube_from_rollup(rollup: Rollup, levels: tuple[tuple[str, ...], ...] = (("ym", "store"), ("ym",), ("store",), ())) -> DataFrame:
    """Additive and distinct metrics at each level of the lattice; what a level leaves out reads 'all'."""
    out = None
    for by in levels:
        by = list(by)
        sums = rollup.cells.groupBy(*by).agg(*(F.sum(c).alias(c) for c in (*MONEY, "units", "lines")))
        counts = exact_counts(rollup, by)
        same = F.lit(True)
        for k in by:
            same = same & sums[k].eqNullSafe(counts[k])
        x = sums.join(counts, same, "left").select(*(sums[k] for k in by), *MONEY, "units", "lines", *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS))
        period = F.format_string("%d-%02d", F.expr("ym div 100"), F.col("ym") % 100) if "ym" in by else F.lit("all")
        x = x.select(period.alias("period"), (F.col("store") if "store" in by else F.lit("all")).alias("store"),
                     *((F.col(c).cast("double") / 100).alias(c) for c in MONEY), "units", "lines", *KINDS)
        out = x if out is None else out.union(x)
    return out.select("period", "store", "revenue", "profit", "cost", "units", "discounts", "lines", "transactions", "customers",
                      r(safe_div(F.col("profit"), F.col("revenue")) * 100, 1).alias("margin"),
                      r(safe_div(F.col("revenue"), F.col("transactions")), 2).alias("avg_basket"))


def store_cube(rollup: Rollup, store: str) -> DataFrame:
    """One store's cells of the cube, from its own rows alone."""
    return cube_from_rollup(rollup.where(F.col("store") == F.lit(store)), (("ym", "store"), ("store",)))


def range_by_store(rollup: Rollup, start_ym: int, end_ym: int) -> DataFrame:
    """A range of months, by store, with exact distinct counts."""
    part = rollup.where(F.col("ym").between(start_ym, end_ym))
    sums = part.cells.groupBy("store").agg((F.sum("revenue").cast("double") / 100).alias("revenue"))
    return sums.join(exact_counts(part, ["store"]).select(F.col("store").alias("s"), *KINDS), F.col("store").eqNullSafe(F.col("s")), "left").select(
        "store", "revenue", *(F.coalesce(k, F.lit(0)).alias(k) for k in KINDS))


def range_sketched(rollup: Rollup, start_ym: int, end_ym: int) -> DataFrame:
    """T2, approximately: (store, kind, estimate), within SKETCH_ERROR of the exact count but for one case in ten thousand."""
    part = rollup.where(F.col("ym").between(start_ym, end_ym)).sketches
    return part.groupBy("store", "kind").agg(F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("estimate"))


_CACHE: dict = {}
_LOCK = threading.Lock()


def load_rollup(spark: SparkSession, sf_dir: str) -> Rollup:
    """The roll-up of the driver tables' regular sales (built once per session)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    with _LOCK:
        if key not in _CACHE:
            _CACHE[key] = merged(empty_rollup(spark), regular(load_sales(spark, sf_dir)))
        return _CACHE[key]
