"""Operator 6: URL rules in a sorted digest array: memory-mapped xxhash64 keys, vectorised binary search, string check.

The array is one file in the shared folder, which Spark hands to each executor (addFile): count, sorted
64-bit keys, string offsets, verdicts, strings. Python workers of an executor map the same pages. Rules
beyond MAX_RULES rows or MAX_BYTES are joined instead (same digests, same string check).

A null url, or one without '://', has empty host and path and fits no rule; repeated rows are judged
each; an empty table gives an empty result; without rules everything is allowed.
"""
from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.llm.common import small_batches
from tillpoint.session import scratch_path

MAX_RULES, MAX_BYTES = 4_000_000, 512 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]


class DigestArray:
    """Sorted digests of strings with a verdict each, over any buffer."""

    def __init__(self, buffer):
        n, = struct.unpack_from("<Q", buffer, 0)
        at = 8
        self.keys = np.frombuffer(buffer, "<u8", n, at)
        self.ends = np.frombuffer(buffer, "<u8", n + 1, at + 8 * n)
        self.block = np.frombuffer(buffer, "u1", n, at + 16 * n + 8)
        self.text, self.start = buffer, at + 17 * n + 8

    @staticmethod
    def pack(rules: list[Rule]) -> bytes:
        rows = sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), v == "block") for v, s in set(rules))
        ends = np.cumsum([0, *(len(s) for _, s, _ in rows)])
        return b"".join([struct.pack("<Q", len(rows)), np.array([d for d, _, _ in rows], "<u8").tobytes(), ends.astype("<u8").tobytes(),
                         np.array([b for _, _, b in rows], "u1").tobytes(), *(s for _, s, _ in rows)])

    @classmethod
    def mapped(cls, path: str) -> DigestArray:
        return cls(np.memmap(path, "u1", "r"))

    def string(self, i: int) -> bytes:
        return bytes(self.text[self.start + int(self.ends[i]):self.start + int(self.ends[i + 1])])

    def find(self, strings: list[str]) -> np.ndarray:
        """Entry of each string, or -1: equal digests are walked until the full string fits."""
        coded = [s.encode() for s in strings]
        digests = np.fromiter(map(xxhash.xxh64_intdigest, coded), np.uint64, len(coded))
        at = np.searchsorted(self.keys, digests, "left")
        found = np.full(len(coded), -1, np.int64)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == digests) if len(self.keys) else []):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == digests[i]:
                if self.string(j) == coded[i]:
                    found[i] = j
                    # a string listed with both verdicts blocks
                    if self.block[j]:
                        break
                j += 1
        return found


def share_array(spark: SparkSession, rules: list[Rule]) -> str:
    """Write the array into the shared folder and register it; returns the name under which executors have it."""
    path = scratch_path(spark, "url-digests")
    name = path.rsplit("/", 1)[1] + ".bin"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target)
    out.write(bytearray(DigestArray.pack(rules)))
    out.close()
    spark.sparkContext.addFile(f"{path}/{name}")
    return name


def split_urls(pages: DataFrame) -> DataFrame:
    """(page_id, host, path)"""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    return pages.select("page_id", F.coalesce(rest, F.lit("")).alias("rest")).select(
        "page_id", F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), UPPER, LOWER).alias("host"),
        F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"))


def candidates(host: str, path: str, cuts: list[int]) -> list[str]:
    """Rules that could fit: the host and its parent domains, each with the path cut to a length some rule has."""
    hosts, at = [], 0
    while host and at >= 0:
        hosts.append(host[at:])
        at = host.find(".", at) + 1 or -1
    tails = [path[:n] for n in cuts if n <= len(path)]
    return [h + t for h in hosts for t in tails]


def judge_urls(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict); `rules` are (verdict, host + path) with the path from its '/'.

    The longest fitting rule wins; without one the verdict is `default`.
    """
    spark = pages.sparkSession
    parts = split_urls(pages)
    cuts = sorted({len(s) - s.index("/") for _, s in rules})
    if len(rules) > MAX_RULES or sum(len(s) for _, s in rules) > MAX_BYTES:
        return _judge_by_join(parts, spark.createDataFrame(rules, "verdict string, rule string"), cuts, default)
    small_batches(spark, 4096)
    name = share_array(spark, rules)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = DigestArray.mapped(SparkFiles.get(name))
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            tries = [candidates(h, p, cuts) for h, p in zip(hosts, paths)]
            flat = [s for t in tries for s in t]
            owner = np.repeat(np.arange(len(tries)), [len(t) for t in tries])
            rule, verdict = [None] * len(tries), [default] * len(tries)
            entry = array.find(flat)
            for i in np.flatnonzero(entry >= 0):
                k = owner[i]
                if rule[k] is None or len(flat[i]) > len(rule[k]):
                    rule[k], verdict[k] = flat[i], "block" if array.block[entry[i]] else "allow"
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), batch.column("host"), batch.column("path"),
                                              pa.array(rule, pa.string()), pa.array(verdict, pa.string())],
                                             ["page_id", "host", "path", "rule", "verdict"])

    return parts.mapInArrow(judge, "page_id bigint, host string, path string, rule string, verdict string")


def _judge_by_join(parts: DataFrame, rules: DataFrame, cuts: list[int], default: str) -> DataFrame:
    """The way for rule lists too large to hand out: candidates meet the rules by digest and full string."""
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    tails = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in cuts)), lambda t: t.isNotNull())
    urls = parts.select("host", "path").distinct()
    tries = urls.select("host", "path", F.explode(hosts).alias("h"), tails.alias("t")).select("host", "path", "h", F.explode("t").alias("t"))
    tries = tries.select("host", "path", F.concat("h", "t").alias("rule")).withColumn("digest", F.xxhash64("rule"))
    best = (tries.join(rules.withColumn("digest", F.xxhash64("rule")), ["digest", "rule"])
            .groupBy("host", "path").agg(F.max(F.struct(F.length("rule").alias("n"), F.col("verdict"), F.col("rule"))).alias("best")))
    return parts.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
