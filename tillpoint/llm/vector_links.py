"""Operator 11: near-duplicate vectors by sorted projection passes.

1. Vectors are told apart by (group, vector): copies share one representative and are counted, never paired. A group
   is a label and a length; vectors of different groups are not compared.
2. Every representative is kept as a byte a component, with the error that this makes. A pass orders them by
   group and 63 concatenated signs of random projections of its own; each is compared with its next WINDOW
   neighbours in that order, and those that may reach the threshold, by the bytes and their error, are
   united. `passes_for` gives the number of passes: the more vectors the largest group has, the more signs a pair must
   share to stay within a window, and the more passes it takes to meet it with probability `recall`. A group of
   at most WINDOW vectors is compared whole.
3. United vectors are compared all against all in double precision, in blocks of BLOCK a side, so a large
   group of near copies loses no link to the windows' bound and is spread over many tasks; a task gives a row a vector
   (links counted, and whom it hangs on), never one a pair.

A vector that is null, empty, zero or holds null or non-finite components, or whose group column is null, links
with nothing: 0 links, a component of its own. Equal vectors are linked. Repeated ids keep a row each; a null id
is carried, and is no component's number unless all of its ids are null (then it is null and the row counts
as kept). Other columns are ignored, whatever their names; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import key_runs, save, small_batches
from tillpoint.llm.components import Joined, components

THRESHOLD, RECALL = 0.93, 0.995
#: Neighbours that each vector is compared with in a pass; vectors of one task's stretch of the order; a side of a verified block.
WINDOW, CHUNK, BLOCK = 1024, 4096, 1024
#: Passes whose order is made by one sort.
PASSES_A_SORT = 4
SIGNS = 63


def passes_for(n: int, threshold: float = THRESHOLD, recall: float = RECALL, window: int = WINDOW) -> int:
    """Passes that meet a pair at the threshold with probability `recall` in a group of `n` vectors."""
    if n <= window + 1:
        return 1
    same_sign = 1 - math.acos(threshold) / math.pi
    met = same_sign ** (math.log2(n / window) + 1)
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - met)))


def as_matrix(column: pa.ListArray) -> np.ndarray:
    """Rows of equal length as a matrix in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # first, so that no square over- or underflows
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, grp, v) -> (node, grp, bytes, scale, error): unit vector = bytes * scale, but for `error` in length."""
    for batch in batches:
        sizes = batch.column("v").value_lengths().to_numpy(zero_copy_only=False)
        data, scale, error = [b""] * len(sizes), np.zeros(len(sizes)), np.zeros(len(sizes))
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            u = unit(as_matrix(batch.column("v").take(pa.array(at))))
            scale[at] = s = np.abs(u).max(1) / 127
            q = np.rint(u / s[:, None]).astype(np.int8)
            rest = u - q * s[:, None]
            error[at] = np.sqrt((rest * rest).sum(1))
            for i, row in zip(at, q):
                data[i] = row.tobytes()
        yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("grp"), pa.array(data, pa.binary()), pa.array(scale), pa.array(error)],
                                         ["node", "grp", "bytes", "scale", "error"])


def projections(number: int, size: int) -> np.ndarray:
    return np.random.default_rng([11, number, size]).standard_normal((size, SIGNS)).astype(np.float32)


def _codes(numbers: list[int]):
    """(node, grp, bytes) -> (pass, grp, code, node) for each of the passes `numbers`."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            rows = batch.column("bytes").to_pylist()
            sizes = np.fromiter(map(len, rows), np.int64, len(rows))
            for number in numbers:
                code = np.zeros(len(rows), np.int64)
                for size in np.unique(sizes).tolist():
                    if (number, size) not in planes:
                        planes = planes if len(planes) < 256 else {}
                        planes[number, size] = projections(number, size)
                    at = np.flatnonzero(sizes == size)
                    x = np.frombuffer(b"".join(rows[i] for i in at), np.int8).reshape(len(at), size).astype(np.float32)
                    signs = np.zeros((len(at), 64), np.uint8)
                    signs[:, 1:] = x @ planes[number, size] > 0
                    code[at] = np.packbits(signs, axis=1).view(">i8")[:, 0]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), number, np.int32)), batch.column("grp"), pa.array(code), batch.column("node")],
                                                 ["pass", "grp", "code", "node"])
    return run


def _compare_windows(threshold: float, window: int):
    """Rows of a chunk, by rank -> (a, b): a hangs on b, such that all that are close in a window are connected."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["chunk"]):
            n, own = t.num_rows, t.column("own").to_numpy()
            key = list(zip(t.column("pass").to_pylist(), t.column("grp").to_pylist()))
            run_of = np.cumsum([0] + [x != y for x, y in zip(key, key[1:])])
            node, scale, error = (t.column(c).to_numpy() for c in ("node", "scale", "error"))
            data, joined = t.column("bytes").to_pylist(), Joined(n)
            for r in range(run_of[-1] + 1):  # vectors of a run are of one length
                lo, hi = np.searchsorted(run_of, [r, r + 1])
                x = np.frombuffer(b"".join(data[lo:hi]), np.int8).reshape(hi - lo, -1).astype(np.float32) * scale[lo:hi, None].astype(np.float32)
                e = error[lo:hi].astype(np.float32)
                for i in range(0, hi - lo, 256):
                    j = min(i + 256 + window, hi - lo)
                    rows = slice(i, min(i + 256, hi - lo))
                    most = x[rows] @ x[i:j].T
                    most += e[rows, None] + e[None, i:j] + e[rows, None] * e[None, i:j] + np.float32(1e-4)
                    apart = np.arange(j - i)[None, :] - np.arange(rows.stop - i)[:, None]
                    near = (most >= threshold) & (apart > 0) & (apart <= window) & own[lo + i:lo + rows.stop, None]
                    if near.any():
                        joined.add(lo + i, near)
            hung = np.flatnonzero(joined.head != np.arange(n))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[joined.head[hung]])], ["a", "b"])
    return run


def one_sort(small: DataFrame, numbers: list[int], threshold: float, window: int, chunk: int) -> DataFrame:
    """(a, b) edges that the passes `numbers` find: ordered by one range sort, compared in chunks of the order."""
    key = ["pass", "grp", "code", "node"]
    order = small.select("node", "grp", "bytes").mapInArrow(_codes(numbers), "pass int, grp string, code bigint, node bigint")
    order = save(order.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("at", F.monotonically_increasing_id()), "vector-order")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = order.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # one row a partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    ranked = order.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("rank", F.col("start") + place)
    mine = F.floor(F.col("rank") / chunk).cast("bigint")
    # the first `window` rows of a chunk are also seen by the chunk before
    there = F.when((F.pmod("rank", F.lit(chunk)) < window) & (mine > 0), F.array(mine, mine - 1)).otherwise(F.array(mine))
    rows = ranked.select("pass", "grp", "node", "rank", mine.alias("mine"), F.explode(there).alias("chunk"))
    rows = rows.join(small.select("node", "bytes", "scale", "error"), "node").withColumn("own", F.col("chunk") == F.col("mine"))
    rows = rows.select("chunk", "rank", "own", "pass", "grp", "node", "bytes", "scale", "error")
    return rows.repartition("chunk").sortWithinPartitions("chunk", "rank").mapInArrow(_compare_windows(threshold, window), "a bigint, b bigint")


def _verify(threshold: float):
    """Rows of (root, one, two, side, node, copies, v), by the first three -> (node, head, links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["root", "one", "two"]):
            raw, side = as_matrix(t.column("v").combine_chunks()), t.column("side").to_numpy()
            u = unit(raw)
            cosine = u @ u.T
            for i, j in zip(*np.nonzero(np.abs(cosine - threshold) < 1e-9)):  # the rounding of a matrix product must not decide
                a, b = u[i], u[j]
                cosine[i, j] = math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))
            link = cosine >= threshold
            np.fill_diagonal(link, False)
            if side.any():  # two blocks: only pairs across them
                link &= side[:, None] != side[None, :]
            joined = Joined(t.num_rows)
            joined.add(0, link)
            node = t.column("node").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[joined.head]), pa.array(link @ t.column("copies").to_numpy())], ["node", "head", "links"])
    return run


def link_vectors(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", group: str = "label", threshold: float = THRESHOLD,
                 recall: float = RECALL, window: int = WINDOW, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of `vectors`; `kept` marks the least id of its component."""
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = F.col("v")
    sound = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(v, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("vec_id"), F.col(f"`{group}`").cast("string").alias("label"), F.col(f"`{vector}`").alias("v"))
    # the label as text with the length before it: "64:label"; null for a row that links with nothing
    rows = rows.withColumn("grp", F.when(F.coalesce(sound, F.lit(False)), F.concat(F.size(v).cast("string"), F.lit(":"), F.col("label"))))
    rows = save(rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "grp", "v"), "vectors")
    texts = save(rows.where("grp is not null").groupBy("grp", "v").agg(
        F.min("row").alias("node"), F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")), "distinct-vectors")
    small = save(texts.select("node", "grp", "v").mapInArrow(quantised, "node bigint, grp string, bytes binary, scale double, error double"), "vector-bytes")
    largest = small.groupBy("grp").count().agg(F.max("count")).first()[0] or 0
    numbers = list(range(passes_for(largest, threshold, recall, window)))
    found = reduce(DataFrame.union, (
        save(one_sort(small, numbers[i:i + PASSES_A_SORT], threshold, window, chunk), "vector-edges") for i in range(0, len(numbers), PASSES_A_SORT)))
    united = save(components(found.distinct()), "united-vectors")
    sizes = united.groupBy("root").agg(F.ceil(F.count("*") / block).cast("int").alias("n_blocks"))
    members = united.join(sizes, "root").join(texts.select("node", "copies", "v"), "node")
    members = members.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    paired = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))).select(
        "root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"),
        (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies", "v")
    checked = save(paired.repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "node").mapInArrow(
        _verify(threshold), "node bigint, head bigint, links bigint"), "vector-links")
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("head").alias("b")))
    of_text = save(texts.select("grp", "v", "node", "vec_id", "copies").join(links, "node", "left").join(classes, "node", "left").select(
        "grp", "v", "vec_id", F.coalesce("root", "node").alias("root"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "vector-classes")
    heads = of_text.groupBy("root").agg(F.min("vec_id").alias("component_id"))
    named = of_text.join(heads, "root").select("grp", "v", "n_links", "component_id")
    alone = rows.where("grp is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    linked = rows.where("grp is not null").select("vec_id", "grp", "v").join(named, ["grp", "v"]).select("vec_id", "n_links", "component_id")
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
