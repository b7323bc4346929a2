"""Operator 8: mixing sources to target weights by Pfair scheduling of source blocks.

Each source's documents are dealt into blocks of equal size. Weights are integers, W their sum; the k-th block of a source of
weight w is released at slot floor(k * W / w) and due by ceil((k + 1) * W / w). Earliest deadline first among the
released blocks meets all deadlines, so at every slot each source has less than one block more or less than
its exact share. After W slots all begins anew, without remainder: the driver computes that much once, at
most MAX_PERIOD slots, and the executors find any block's slot from it. When a source runs out, the weights of the rest
stand against their own sum and a new phase begins, so every document is placed and none twice.

Whole and fractional weights are taken exactly, as far as their common denominator gives no more than MAX_PERIOD
slots, else rounded to that; without weights, tempered sizes are rounded once to integers, and those are the target.
The MAX_SOURCES sources with a weight of their own are given ones and then the largest; all others
share the weight of a pool, in which the blocks of each are spread evenly from its first place to its last.

A null source is a source of its own; documents are numbered as they are read, so null, repeated or tied doc_ids are placed
like any other; an empty table gives no rows. `mix_order` ignores other columns, `mixed` keeps them, whatever their names.
"""
from __future__ import annotations

import heapq
import math
import re
from bisect import bisect_right
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import save, small_batches

#: Least sum of tempered weights, documents of a block, sources with a weight of their own, and slots of a hyperperiod at most.
PERIOD, BLOCK_DOCS, MAX_SOURCES, MAX_PERIOD = 1000, 16, 1024, 1 << 20


def whole_weights(weights: dict) -> dict:
    """Integers in the proportion of `weights`, exactly if their sum stays within MAX_PERIOD; a weight of 0 counts as the least other."""
    exact = {s: Fraction(str(w)) for s, w in weights.items()}
    least = min((x for x in exact.values() if x > 0), default=Fraction(1))
    exact = {s: x if x > 0 else least for s, x in exact.items()}
    common = math.lcm(*(x.denominator for x in exact.values()))
    parts = {s: int(x * common) for s, x in exact.items()}
    shared = math.gcd(*parts.values())
    parts = {s: n // shared for s, n in parts.items()}
    total = sum(parts.values())
    return parts if total <= MAX_PERIOD else {s: max(1, n * (MAX_PERIOD - len(parts)) // total) for s, n in parts.items()}


def tempered(counts: dict, power: float, period: int = PERIOD) -> dict:
    """Integer weights in proportion to a power of the sources' sizes, whose sum is about `period` or four a source."""
    raw = {s: n ** power for s, n in counts.items()}
    scale = max(period, 4 * len(raw)) / max(sum(raw.values()), 1e-300)
    return {s: max(1, round(x * scale)) for s, x in raw.items()}


def schedule(weights: dict, blocks: dict) -> dict:
    """source -> the slots of its blocks in the first hyperperiod, up to the slot after which a source has none left."""
    total = sum(weights.values())
    names = sorted(weights, key=lambda s: (s is None, str(s)))
    w = [weights[s] for s in names]
    have = [blocks[s] for s in names]
    out: list[list[int]] = [[] for _ in names]
    # by time: the next release of each source; by deadline: released blocks (one a source, as windows follow each other)
    release = [(0, i) for i in range(len(names))]
    ready: list[tuple[int, int]] = []
    for t in range(total):
        while release and release[0][0] <= t:
            i = heapq.heappop(release)[1]
            heapq.heappush(ready, (-(-(len(out[i]) + 1) * total // w[i]), i))
        i = heapq.heappop(ready)[1]
        out[i].append(t)
        k = len(out[i])
        if k == have[i]:
            break
        if k < w[i]:
            heapq.heappush(release, (k * total // w[i], i))
    return dict(zip(names, out))


def phases(blocks: dict, weights: dict) -> list[tuple]:
    """Rows (first slot, slots of a hyperperiod, {source: (first block, last block + 1, slots of its blocks in a hyperperiod)})."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        period = sum(weights[s] for s in left)
        mine = {s: weights[s] for s in left}
        # whole hyperperiods before the one in which a source runs out; what is left for that one
        whole = min((n - 1) // mine[s] for s, n in left.items())
        rest = {s: n - whole * mine[s] for s, n in left.items()}
        table = schedule(mine, dict.fromkeys(left, math.inf) if whole else rest)
        end = min(table[s][n - 1] for s, n in rest.items() if n <= len(table[s]))
        had = {s: whole * mine[s] + bisect_right(table[s], end) for s in left}
        out.append((start, period, {s: (done[s], done[s] + had[s], np.array(table[s], np.int64)) for s in left}))
        start += sum(had.values())
        for s, n in had.items():
            done[s] += n
            left[s] -= n
        left = {s: n for s, n in left.items() if n}
    return out


def slot_of(plan: dict, source: int, block: np.ndarray) -> np.ndarray:
    """Slots of blocks of a source, from `by_source`."""
    starts, parts = plan[source]
    out = np.empty(len(block), np.int64)
    at = np.searchsorted(starts, block, "right") - 1
    for p in np.unique(at):
        first, slot0, period, table = parts[p]
        mine = at == p
        k = block[mine] - first
        out[mine] = slot0 + k // len(table) * period + table[k % len(table)]
    return out


def by_source(rows: list[tuple]) -> dict:
    """source -> (first blocks of its phases, [(first block, first slot, hyperperiod, slots of its blocks in one)])."""
    out: dict = {}
    for slot0, period, sources in rows:
        for s, (first, end, table) in sources.items():
            if end > first:
                parts = out.setdefault(s, ([], []))
                parts[0].append(first)
                parts[1].append((first, slot0, period, table))
    return out


def _place(plan, block_docs: int):
    """(code, bucket, before, n) -> (code, bucket, before, slots): slots of the blocks that a bucket's documents fall into."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, before, n = (batch.column(c).to_numpy() for c in ("code", "before", "n"))
            slots = [slot_of(plan.value, c, np.arange(b // block_docs, (b + k - 1) // block_docs + 1)) for c, b, k in zip(code.tolist(), before.tolist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([batch.column("code"), batch.column("bucket"), batch.column("before"), pa.array(slots, pa.list_(pa.int64()))],
                                             ["code", "bucket", "before", "slots"])
    return run


def placed(docs: DataFrame, weights: dict | None, power: float, block_docs: int, period: int, columns: list[str]) -> DataFrame:
    """(row, block, slot, position): `row` is a struct of the `columns` of each document; position is unique."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = save(docs.select(F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"), F.col("source").cast("string").alias("source")).select(
        "*", F.monotonically_increasing_id().alias("nth")), "mix-rows")
    totals = save(rows.groupBy("source").agg(F.count("*").alias("n")), "mix-sources")
    asked = [s for s in (weights or {}) if s is not None]
    first = F.coalesce(F.col("source").isin(asked), F.lit(None in (weights or {})))
    own = totals.orderBy(F.desc(first), F.desc("n"), F.asc_nulls_first("source")).limit(MAX_SOURCES).collect()
    counts = {i: r.n for i, r in enumerate(own)}
    names = {r.source: i for i, r in enumerate(own)}
    codes = spark.createDataFrame([(r.source, i) for i, r in enumerate(own)], "s string, own int")  # at most MAX_SOURCES rows
    coded = totals.join(F.broadcast(codes), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "n", "own")
    pool = coded.where("own is null").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.pow("n", F.lit(power))).alias("w")).first()
    n_all = sum(counts.values()) + (pool.n or 0)
    if weights is None:
        mass = {i: n ** power for i, n in counts.items()} | ({-1: pool.w} if pool.k else {})
        share = tempered(mass, 1, period)
    else:
        least = min(weights.values())
        share = whole_weights({i: weights.get(s, least) for s, i in names.items()} | ({-1: Fraction(str(least)) * pool.k} if pool.k else {}))
    if pool.k:
        counts[-1] = pool.n
    plan = by_source(phases({i: -(-n // block_docs) for i, n in counts.items()}, share)) if n_all else {}
    # about sqrt(n) buckets a source, so neither a bucket nor the list of buckets of a hot source is large
    n_buckets = max(1, math.isqrt(n_all))
    mixed_up = F.xxhash64("nth", F.lit(8))
    keyed = rows.join(F.broadcast(codes), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    known = keyed.where("own is not null").select("row", "nth", F.col("own").alias("code"), mixed_up.alias("h"), F.pmod(mixed_up, F.lit(n_buckets)).alias("bucket"))
    if pool.k:
        # a pooled source's documents are spread evenly: the k-th of n stands at (k + 1/2) / n of the pool
        other = keyed.where("own is null").drop("own").withColumn("k", F.row_number().over(Window.partitionBy("source").orderBy(mixed_up)))
        sizes = coded.where("own is null").select(F.col("source").alias("s"), F.col("n"))
        other = other.join(sizes, F.col("source").eqNullSafe(F.col("s"))).withColumn("at", (F.col("k") - 0.5) / F.col("n"))
        known = known.union(other.select("row", "nth", F.lit(-1).alias("code"), (F.col("at") * (1 << 52)).cast("bigint").alias("h"),
                                         F.least(F.floor(F.col("at") * n_buckets), F.lit(n_buckets - 1)).cast("bigint").alias("bucket")))
    sizes = known.groupBy("code", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("code").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    spans = save(sizes.select("code", "bucket", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")), "mix-sizes")
    shared = spark.sparkContext.broadcast(plan)
    spans = save(spans.mapInArrow(_place(shared, block_docs), "code int, bucket bigint, before bigint, slots array<bigint>"), "mix-plan")
    inside = Window.partitionBy("code", "bucket").orderBy("h", "nth")
    ranked = known.withColumn("in_bucket", F.row_number().over(inside) - 1).join(spans, ["code", "bucket"])
    rank = F.col("before") + F.col("in_bucket")
    ranked = ranked.withColumn("rank", rank).withColumn("block", F.expr(f"rank div {block_docs}"))
    slot = F.expr(f"element_at(slots, cast(block - before div {block_docs} + 1 as int))")
    return ranked.withColumn("slot", slot).select("row", "block", "slot", (F.col("slot") * block_docs + F.pmod("rank", F.lit(block_docs))).alias("position"))


def mix_order(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """(doc_id, source, block, slot, position); position is unique and counts up from 0 nearly without gaps.

    `weights` gives the target of each source (others weigh as the smallest); without it they are tempered sizes.
    """
    place = placed(docs, weights, power, block_docs, period, ["doc_id", "source"])
    return place.select("row.doc_id", "row.source", "block", "slot", "position")


def mixed(docs: DataFrame, weights: dict | None = None, power: float = 0.5, block_docs: int = BLOCK_DOCS, period: int = PERIOD) -> DataFrame:
    """The documents, all columns, written out in mixed order: range partitions of position, sorted inside."""
    place = placed(docs, weights, power, block_docs, period, docs.columns).select("row", "position")
    return place.repartitionByRange("position").sortWithinPartitions("position").select("row.*")


def written_order(docs: DataFrame) -> DataFrame:
    """(row, position): a struct of each row of `docs`, read from files that `mixed` wrote, and its place (0, 1, ...) in that order."""
    file = F.col("_metadata.file_name")
    sizes = {r[0]: r[1] for r in docs.groupBy(file.alias("_file")).count().collect()}  # one row a file

    def place(name: str) -> tuple:
        part = re.match(r"part-(\d+)\b.*?[-.]c(\d+)\b", name)
        return (int(part[1]), int(part[2])) if part else (math.inf, name)

    starts, at = [], 0
    for name in sorted(sizes, key=place):
        starts.append((name, at))
        at += sizes[name]
    starts = docs.sparkSession.createDataFrame(starts, "file string, start bigint")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), file.alias("file"), F.col("_metadata.row_index").alias("nth"))
    return rows.join(F.broadcast(starts), "file").select("row", (F.col("start") + F.col("nth")).alias("position"))
