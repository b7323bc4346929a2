"""Operator 5: n-gram Jaccard join by MinHash banding, verified on full n-gram sets.

1. Texts are told apart by sha256: copies share one representative and are counted, never paired.
2. Each representative gets a MinHash signature over its five-word shingles; bands and rows are chosen so that
   a pair at the threshold meets in some band with the target probability.
3. Rows are shuffled on band hashes. In each bucket every text first meets one hub; those whose signatures are
   near it are united, and so are texts that meet through hubs of several buckets. In the buckets that are still of
   several parts, what lies outside the largest part is compared with all of the bucket, signature against
   signature, in blocks; near ones are united. Two rounds settle buckets of any size, and pairs that are already
   united cost nothing.
4. United texts are compared on their full shingle sets, all against all, in blocks of BLOCK texts
   a side at most: large groups are spread over many tasks, and a task gives one row a text (links counted, and whom
   it hangs on), never one a pair. Shingles are hashed once a text, and their hashes shipped to the blocks.

Every row gets its class (connected by links of at least the threshold) and its number of links: other rows,
copies included, whose similarity reaches the threshold. Copies of one text are always linked, also empty
ones; a text without words has no other link; one to four words make one shingle. A null text counts as empty; repeated
rows are copies; a null doc_id is carried (and is no class's number unless all of its ids are null); other columns are
ignored; an empty table gives no rows.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import BLANKS, drop, key_runs, save, small_batches, text_chunks
from tillpoint.llm.components import Joined, components

SHINGLE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.999, 220
#: Texts on either side of a verification task's matrix, and their shingles, at most (about, as they are dealt by hash).
BLOCK, BLOCK_SHINGLES = 512, 2_000_000
#: Signatures on either side of a task that compares parts of a bucket.
BUCKET_BLOCK = 512
#: Texts are united whose estimated similarity is at most this far below the threshold: 3.6 standard deviations at 0.8.
ERROR = 0.1


@dataclass(frozen=True)
class Banding:
    bands: int
    rows: int

    @classmethod
    def for_recall(cls, threshold: float, recall: float, most: int = MAX_HASHES) -> Banding:
        """The most selective (longest) bands that find a pair at the threshold with probability `recall`."""
        for rows in range(32, 0, -1):
            bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))
            if bands * rows <= most:
                return cls(bands, rows)
        raise ValueError("no banding reaches that recall with so few hashes")


class ShingleHasher:
    """64-bit hashes of the distinct five-word shingles of a text; word hashes are remembered, boundedly."""

    def __init__(self, n: int = SHINGLE, keep: int = 300_000):
        self.n, self.keep, self.known = n, keep, {}

    def __call__(self, text: str) -> np.ndarray:
        for blank in BLANKS[1:]:
            text = text.replace(blank, " ")
        words = list(filter(None, text.split(" ")))
        if not words:
            return np.empty(0, np.uint64)
        if len(self.known) > self.keep:
            self.known = {}
        known = self.known
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w.encode())
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        mixed = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            mixed = (mixed ^ h[k:len(h) - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed)


def hash_family(k: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_011)
    return rng.integers(0, 1 << 32, k, np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, k, np.uint32)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """MinHash of a non-empty set under each (a, b)."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), np.uint32(0xFFFFFFFF))
    for i in range(0, len(x), 512):
        out = np.minimum(out, (a[:, None] * x[None, i:i + 512] + b[:, None]).min(1))
    return out


def text_key() -> Column:
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def signatures(docs: DataFrame, banding: Banding) -> DataFrame:
    """(row, doc_id, key, bands, low, size): a number for each row, band hashes, the low byte of each MinHash, and the
    number of shingles; written."""
    small_batches(docs.sparkSession)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, row = ShingleHasher(), TaskContext.get().partitionId() << 40
        a, b = hash_family(banding.bands * banding.rows)
        for batch, texts in text_chunks(batches, "text"):
            bands, low, size = [], [], []
            for t in texts:
                s = shingles(t)
                size.append(len(s))
                if len(s):
                    sig = signature(s, a, b)
                    bands.append([xxhash.xxh64_intdigest(sig[i * banding.rows:(i + 1) * banding.rows].tobytes(), seed=i) - (1 << 63) for i in range(banding.bands)])
                    low.append(sig.astype(np.uint8).tobytes())
                else:
                    bands.append([])
                    low.append(b"")
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(row, row + len(texts)), pa.int64()), batch.column("doc_id").cast(pa.int64()), batch.column("key"),
                 pa.array(bands, pa.list_(pa.int64())), pa.array(low, pa.binary()), pa.array(size, pa.int64())], ["row", "doc_id", "key", "bands", "low", "size"])
            row += len(texts)

    return save(docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(
        sign, "row bigint, doc_id bigint, key binary, bands array<bigint>, low binary, size bigint"), "signatures")


def likeness(equal: np.ndarray, n: int) -> np.ndarray:
    """Estimated similarity from the number of equal low bytes among `n`; unlike MinHashes agree in one of 256."""
    return (equal / n - 1 / 256) / (1 - 1 / 256)


def _near_hub(near: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for c in ("low_a", "low_b"))
                good = pa.array(likeness((x == y).sum(1), x.shape[1]) >= near)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])
    return run


def _near_parts(near: float):
    """Rows of (band, one, two, side, node, part, low), by the first three -> (a, b): edges that unite parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["band", "one", "two"]):
            n, node, part, side = t.num_rows, *(t.column(c).to_numpy() for c in ("node", "part", "side"))
            low = np.frombuffer(b"".join(t.column("low").to_pylist()), np.uint8).reshape(n, -1)
            first = np.flatnonzero(side == side.min())
            second = np.flatnonzero(side) if side.any() else first
            if len(first) * len(second) <= 256:
                equal = (low[first][:, None, :] == low[second][None, :, :]).sum(2)
            else:
                equal = np.zeros((len(first), len(second)), np.uint16)
                for x, y in zip(low[first].T, low[second].T):
                    equal += x[:, None] == y[None, :]
            found = (likeness(equal, low.shape[1]) >= near) & (part[first][:, None] != part[second][None, :])
            if found.any():
                pairs = np.zeros((n, n), bool)
                pairs[np.ix_(first, second)] = found
                joined = Joined(n)
                joined.add(0, pairs | pairs.T)
                hung = np.flatnonzero(joined.head != np.arange(n))
                yield pa.RecordBatch.from_arrays([pa.array(node[hung]), pa.array(node[joined.head[hung]])], ["a", "b"])
    return run


def candidate_groups(texts: DataFrame, threshold: float) -> DataFrame:
    """(node, root) of the texts that share a band with a text whose signature is near, such that texts of a bucket
    with near signatures have one root."""
    near = threshold - ERROR
    low = texts.select("node", "low")
    rest = texts.select("node", F.explode("bands").alias("band"))
    # the least node of a bucket under a mask of its own: another order in each bucket, as one long
    mask = F.xxhash64("band")
    hubs = rest.groupBy("band").agg(F.min(F.col("node").bitwiseXOR(mask)).alias("least"), F.count("*").alias("n")).where("n > 1")
    hubs = hubs.select("band", "n", F.col("least").bitwiseXOR(mask).alias("hub"))
    met = save(rest.join(hubs, "band"), "band-members")
    pairs = met.where("node != hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = pairs.join(low.select(F.col("node").alias("a"), F.col("low").alias("low_a")), "a").join(low.select(F.col("node").alias("b"), F.col("low").alias("low_b")), "b")
    parts = save(components(pairs.mapInArrow(_near_hub(near), "a bigint, b bigint")), "parts")
    # buckets of two have been compared whole
    members = met.where("n > 2").select("band", "node").join(parts, "node", "left").select("band", "node", F.coalesce("root", "node").alias("part"))
    members = save(members, "bucket-parts")
    counts = members.groupBy("band", "part").agg(F.count("*").alias("n"))
    major = counts.groupBy("band").agg(F.max(F.struct("n", "part")).alias("major"), F.sum("n").alias("n")).where("n > major.n").select(
        "band", F.col("major.part").alias("major"), F.ceil((F.col("n") - F.col("major.n")) / BUCKET_BLOCK).cast("int").alias("n_minor"),
        F.ceil(F.col("n") / BUCKET_BLOCK).cast("int").alias("n_major"))
    dealt = F.xxhash64("node")
    minor = F.col("part") != F.col("major")
    rows = members.join(major, "band").withColumn("mine", F.when(minor, F.pmod(dealt, F.col("n_minor"))).otherwise(F.col("n_minor") + F.pmod(dealt, F.col("n_major"))).cast("int"))
    # a block of the largest part meets the others' blocks only
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_minor") + F.when(minor, F.col("n_major")).otherwise(0) - 1)))
    rows = rows.select("band", "node", "part", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).cast("int").alias("side"))
    rows = rows.join(low, "node").repartition("band", "one", "two").sortWithinPartitions("band", "one", "two")
    more = rows.mapInArrow(_near_parts(near), "a bigint, b bigint")
    groups = save(components(parts.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more)), "candidate-groups")
    drop(met, parts, members)
    return groups


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) -> (node, shingles): sorted 64-bit hashes, little-endian."""
    hasher = ShingleHasher()
    for batch, texts in text_chunks(batches, "text"):
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([hasher(t).astype("<u8").tobytes() for t in texts], pa.binary())], ["node", "shingles"])


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which of the sets (of distinct hashes) reach the threshold with which."""
    size = np.array([len(s) for s in sets])
    values, column = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(column, minlength=len(values)) > 1  # a shingle of one text is in no intersection
    place = np.cumsum(often) - 1
    owner = np.repeat(np.arange(len(sets)), size)
    shared = often[column]
    owner, column = owner[shared], place[column[shared]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(sets), len(sets)), np.float32)
    step = 4096
    for at in range(0, int(often.sum()), step):
        lo, hi = np.searchsorted(column, [at, at + step])
        m = np.zeros((len(sets), step), np.float32)
        m[owner[lo:hi], column[lo:hi] - at] = 1
        common += m @ m.T
    either = size[:, None] + size[None, :] - common
    link = common >= threshold * either - 1e-6
    np.fill_diagonal(link, False)
    return link


def _verify(threshold: float):
    """Rows of (root, one, two, side, node, copies, shingles), by the first three -> (node, head, links)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in key_runs(batches, ["root", "one", "two"]):
            link = linked([np.frombuffer(x, "<u8") for x in t.column("shingles").to_pylist()], threshold)
            side, node = t.column("side").to_numpy(), t.column("node").to_numpy()
            if side.any():  # two blocks: only pairs across them
                link &= side[:, None] != side[None, :]
            joined = Joined(len(node))
            joined.add(0, link)
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[joined.head]), pa.array(link @ t.column("copies").to_numpy())], ["node", "head", "links"])
    return run


def link_documents(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """(doc_id, class_id, n_links, key, head_key, head_id): class_id is the least doc_id of the class; head_key and
    head_id name the text and document that stand for it."""
    signed = signatures(docs, Banding.for_recall(threshold, recall))
    # all rows of one text have one signature, so any of them will do
    texts = save(signed.groupBy("key").agg(F.min("row").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"),
                                           F.first("bands").alias("bands"), F.first("low").alias("low"), F.first("size").alias("size")), "texts")
    rows = save(signed.select("doc_id", "key"), "text-rows")
    drop(signed)
    groups = candidate_groups(texts, threshold)
    # blocks of a group: its members are dealt by hash into as many as hold about BLOCK of them and BLOCK_SHINGLES shingles
    members = groups.join(texts.select("node", "key", "doc_id", "copies", "size"), "node")
    sizes = members.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    wanted = members.select("node", "key", F.col("doc_id").alias("id"))
    # one row a text: rows of its least doc_id, of which any will do
    whole = docs.select(text_key().alias("text_key"), "doc_id", "text").join(wanted, (F.col("text_key") == F.col("key")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = save(whole.select("node", "text").mapInArrow(_shingles, "node bigint, shingles binary").dropDuplicates(["node"]), "shingles")
    mine = F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int")
    paired = members.join(sizes, "root").select("root", "node", "copies", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    paired = paired.select("root", F.least("mine", "other").alias("one"), F.greatest("mine", "other").alias("two"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "node", "copies")
    checked = save(paired.join(sets, "node").repartition("root", "one", "two").sortWithinPartitions("root", "one", "two", "node").mapInArrow(
        _verify(threshold), "node bigint, head bigint, links bigint"), "links")
    drop(groups, sets)
    links = checked.groupBy("node").agg(F.sum("links").alias("links"))
    classes = components(checked.select(F.col("node").alias("a"), F.col("head").alias("b")))
    of_text = save(texts.select("key", "node", "doc_id", "copies").join(classes, "node", "left").join(links, "node", "left").select(
        "key", "doc_id", "copies", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links")), "classes")
    drop(texts, checked)
    heads = of_text.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("head"))
    named = of_text.join(heads, "root").select("key", F.col("head.doc_id").alias("class_id"), F.col("head.key").alias("head_key"),
                                               (F.col("links") + F.col("copies") - 1).alias("n_links"))
    return rows.join(named, "key").select(
        "doc_id", "class_id", "n_links", "key", "head_key", F.col("class_id").alias("head_id"))


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, with one of each class: the least doc_id's text, one row of it."""
    names = docs.columns
    heads = link_documents(docs, threshold).where(F.col("key") == F.col("head_key")).select(F.col("head_key").alias("_key"), "head_id").distinct()
    row = docs.select(text_key().alias("_key"), F.struct(*(F.col(f"`{c}`") for c in names)).alias("_row"))
    row = row.withColumn("_id", F.coalesce(F.col("_row")["doc_id"].cast("bigint"), F.lit(-1 << 63)))
    heads = heads.select("_key", F.coalesce("head_id", F.lit(-1 << 63)).alias("_id"))
    stay = row.join(heads, ["_key", "_id"])
    first = F.row_number().over(Window.partitionBy("_key", "_id").orderBy(F.lit(0)))  # repeated rows: any one
    return stay.withColumn("_nth", first).where("_nth = 1").select(*(F.col("_row").getField(c).alias(c) for c in names))
