"""Operator 10: one-permutation MinHash fingerprints, in DataFrame functions only.

Every five-word shingle is hashed once; the top bits choose one of BINS bins, each keeps its least hash.
An empty bin borrows from the first non-empty bin in a fixed random order of its own (optimal
densification): PROBES universal-hash probes, then the non-empty bin of least priority. The low BITS bits of each
bin's hash (mixed with the bin) are packed as one hexadecimal digit; the share of equal digits, less what chance gives, is the likeness.

A text of one to four words has one shingle, a text without words (or null) the empty one. Documents with equal
(doc_id, text) count as one in the order of ids and get equal rows; equal ids with unlike texts follow the
text's hash; a null doc_id is the lowest. Other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import save, words_column

SHINGLE, BINS, PROBES, BITS = 5, 256, 8, 4
_SHIFT = 56  # 64 bits less log2(BINS)
_LOW = (1 << _SHIFT) - 1
LOWEST = -(1 << 63)


def _empty(x: Column) -> Column:
    return x.bitwiseAND(F.lit(_LOW)) == F.lit(_LOW)


def with_fingerprint(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds the packed fingerprint of column `text`: one hexadecimal digit a bin."""
    w, h, m, full = (f"_{x}" for x in ("words", "hashes", "mins", "full"))
    df = df.withColumn(w, words_column(F.col(text)))
    n = F.size(w)
    shingles = F.when(n >= SHINGLE, F.transform(F.sequence(F.lit(0), n - SHINGLE), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(SHINGLE))))) \
        .otherwise(F.array(F.xxhash64(F.array_join(w, " "))))
    # one sentinel a bin, above all its hashes: after sorting, the first of each bin is its least hash or shows an empty bin
    sentinels = F.transform(F.sequence(F.lit(-BINS // 2), F.lit(BINS // 2 - 1)), lambda b: F.shiftleft(b.cast("bigint"), _SHIFT).bitwiseOR(F.lit(_LOW)))
    df = df.withColumn(h, F.sort_array(F.concat(shingles, sentinels))).drop(w)
    a_bin = lambda x: F.shiftright(x, _SHIFT)
    df = df.withColumn(m, F.filter(h, lambda x, i: (i == 0) | (a_bin(x) != a_bin(F.get(h, i - 1))))).drop(h)
    df = df.withColumn(full, F.filter(m, lambda x: ~_empty(x)))

    def probe(j: Column, t: int) -> Column:
        x = F.get(m, F.pmod(F.xxhash64(j, F.lit(t)), F.lit(BINS)).cast("int"))
        return F.when(~_empty(x), x)

    def first_by_priority(j: Column) -> Column:
        return F.array_min(F.transform(full, lambda v: F.struct(F.xxhash64(j, a_bin(v), F.lit(PROBES)).alias("p"), v.alias("v"))))["v"]

    dense = F.transform(m, lambda x, j: F.when(~_empty(x), x).otherwise(F.coalesce(*(probe(j, t) for t in range(PROBES)), first_by_priority(j))))
    # a borrowed hash is mixed with its bin, or two texts of few shingles would agree by chance in all bins at once
    digits = F.transform(dense, lambda x, j: F.hex(F.xxhash64(x, j).bitwiseAND(F.lit((1 << BITS) - 1))))
    return df.withColumn(out, F.lower(F.array_join(digits, ""))).drop(m, full)


def likeness(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints: equal digits, corrected for those equal by chance."""
    same = F.size(F.filter(F.arrays_zip(F.split(a, "").alias("a"), F.split(b, "").alias("b")), lambda x: x["a"] == x["b"])) / F.lit(BINS)
    chance = 1 / (1 << BITS)
    return F.greatest(F.lit(0.0), (same - F.lit(chance)) / F.lit(1 - chance))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of every whole text."""
    return with_fingerprint(docs.select("doc_id", "text"), "text", "fingerprint").drop("text")


def _neighbours(keys: DataFrame) -> DataFrame:
    """(k1, k2, n_chars) -> (k1, k2, next's n1, n2, previous p1, p2, its p_cut): neighbours in descending order, as a ring.

    Range partitions are ordered apart; only their first and last keys (a row a partition) meet in one task.
    """
    dealt = save(keys.distinct().repartitionByRange("k1", "k2").withColumn("part", F.spark_partition_id()), "id-order")
    key, inside = F.struct("k1", "k2", "n_chars"), Window.partitionBy("part").orderBy(F.desc("k1"), F.desc("k2"))
    ends = dealt.groupBy("part").agg(F.max(key).alias("top"), F.min(key).alias("bottom"))
    down, every = Window.orderBy(F.desc("part")), Window.partitionBy()
    ends = ends.select("part", F.coalesce(F.lead("top").over(down), F.max("top").over(every)).alias("after"),
                       F.coalesce(F.lag("bottom").over(down), F.min("bottom").over(every)).alias("before"))
    both = dealt.withColumn("n", F.lead(key).over(inside)).withColumn("p", F.lag(key).over(inside)).join(ends, "part")
    n, p = F.coalesce("n", "after"), F.coalesce("p", "before")
    return both.select("k1", "k2", n["k1"].alias("n1"), n["k2"].alias("n2"), p["k1"].alias("p1"), p["k2"].alias("p2"),
                       F.expr("coalesce(p, before).n_chars div 3").cast("int").alias("p_cut"))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edit (last third replaced by the start of the next document, descending
    doc_id), with their likeness and that to the next document."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOWEST)).alias("k1"), F.xxhash64(text).alias("k2"), text.alias("text"))
    ring = save(_neighbours(rows.select("k1", "k2", F.length("text").alias("n_chars"))), "id-ring")
    tied = rows.join(ring, ["k1", "k2"])
    heads = tied.select(F.col("p1").alias("k1"), F.col("p2").alias("k2"), F.expr("left(text, p_cut)").alias("head")).dropDuplicates(["k1", "k2"])
    n_chars = F.length("text")
    edited = F.concat(F.expr("left(text, length(text) - length(text) div 3)"), F.col("head"))
    made = tied.join(heads, ["k1", "k2"]).select("k1", "k2", "n1", "n2", n_chars.cast("bigint").alias("n_chars"), "text", edited.alias("edited"))
    made = with_fingerprint(with_fingerprint(made, "text", "fingerprint"), "edited", "edited_fingerprint")
    made = save(made.select("k1", "k2", "n1", "n2", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
                            "fingerprint", "edited_fingerprint"), "fingerprints")
    following = made.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("fingerprint").alias("next_fingerprint")).dropDuplicates(["n1", "n2"])
    return made.join(following, ["n1", "n2"]).select(
        F.when(F.col("k1") != LOWEST, F.col("k1")).alias("doc_id"), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
