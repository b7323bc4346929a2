"""Operator 12: exact ranked search by sparse ball-trees.

A document is a sparse vector: for each query term it holds, an integer weight from its frequency, its length and the
term's rarity. A query scores a document by their inner product. Documents are ordered by their weightiest
terms and cut into stretches of at most CHUNK_DOCS; each stretch grows a ball-tree: a node has the centroid of its
documents and the radius around it, so centroid . query + radius * |query| bounds all scores below it. Each query
descends best-first, splitting a node when it first needs to, and ends when no bound reaches its worst kept score.
Bounds are rounded up, leaves are scored in integers, and a bound equal to the worst score is still followed, so
the result is exact, with ties. A task keeps its best `k` of each query from stretch to stretch; the best of all tasks
are ranked last.

Only counts of the queries' terms leave the texts; the number of documents, their lengths and the terms'
document frequencies are counted over all documents. Queries are handled in blocks of about QUERY_BLOCK.

A null text has no terms, a query without terms (or with none that any document holds) no results. Repeated documents
are ranked each; equal scores go by ascending id, null ids last; repeated query ids keep their own results; other columns
are ignored; empty tables give no rows.
"""
from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import save, small_batches

TOP, QUERY_BLOCK = 50, 1024
#: Documents, and vector entries, of one tree at most; documents of a leaf at most.
CHUNK_DOCS, CHUNK_ENTRIES, LEAF = 4096, 1_000_000, 32

#: UTF-8 bytes: A-Z lower-cased; other than letters, digits and what stands beyond ASCII is blank.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 0x80 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERMS).split()


def _count_terms(known: dict[bytes, int]):
    """(doc_id, text) -> (doc_id, n, terms, tfs): number of terms; numbers and counts of those that queries hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, terms, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                found = terms_of(text)
                count = sorted(Counter(i for i in map(known.get, found) if i is not None).items())
                ns.append(len(found))
                terms.append([t for t, _ in count])
                tfs.append([c for _, c in count])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ns, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))],
                                             ["doc_id", "n", "terms", "tfs"])
    return run


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _weigh(weights: np.ndarray, n_docs: int, all_terms: int):
    """(doc_id, n, terms, tfs) -> (first, second, doc_id, terms, values): the vector, and its two weightiest terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for id, n, terms, tfs in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n", "terms", "tfs"))):
                terms, tf = np.array(terms, np.int64), np.array(tfs, np.int64)
                m = 100 - 50 + (50 * n * n_docs) // all_terms
                values = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))
                terms, values = terms[values > 0], values[values > 0]
                if len(terms):
                    best = terms[np.argsort(-values, kind="stable")[:2]]
                    out.append((int(best[0]), int(best[-1]), id, terms, values))
            if out:
                kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["first", "second", "doc_id", "terms", "values"])
    return run


class Queries:
    """Queries as rows of term numbers, none empty."""

    def __init__(self, rows: list[list[int]]):
        self.rows = [np.array(r, np.int64) for r in rows]
        self.terms = np.concatenate(self.rows)
        self.starts = np.concatenate([[0], np.cumsum([len(r) for r in rows])[:-1]])

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(dense[self.terms], self.starts)


class Ball:
    """A node of the tree: documents as rows of (terms, values), and for each query a bound of their scores."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray, queries: Queries, width: int):
        self.docs, self.sizes, self.terms, self.values, self.queries, self.width = docs, sizes, terms, values, queries, width
        self.children: tuple[Ball, Ball] | None = None
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        x = values.astype(np.float64)
        self.square = np.add.reduceat(x * x, self.starts)
        self.centre = np.bincount(terms, x, width) / len(docs)
        centre_square = float(self.centre @ self.centre)
        self.apart = self.square - 2 * self.dot(self.centre) + centre_square  # squared distances from the centroid
        # the difference of large squares may be off by a few units of their last place
        radius = math.sqrt(max(0.0, float(self.apart.max())) + 1e-12 * (float(self.square.max()) + centre_square))
        # terms that no document here holds add nothing to a score or to a distance
        held = queries.dot((np.bincount(terms, minlength=width) > 0).astype(np.float64))
        self.bound = (queries.dot(self.centre) + np.sqrt(held) * radius) * (1 + 1e-12) + 1
        self.bound[held == 0] = 0
        self.flat = float(self.apart.max()) <= 1e-9 * centre_square  # copies of one vector need no split

    def dot(self, dense: np.ndarray) -> np.ndarray:
        return np.add.reduceat(self.values * dense[self.terms], self.starts)

    def _vector(self, i: int) -> np.ndarray:
        part = slice(self.starts[i], self.starts[i] + self.sizes[i])
        return np.bincount(self.terms[part], self.values[part].astype(np.float64), self.width)

    def is_leaf(self) -> bool:
        return self.flat or len(self.docs) <= LEAF

    def split(self) -> tuple[Ball, Ball]:
        """Two halves along the line between a document far from the centroid and one far from that."""
        if self.children is None:
            one = self._vector(int(self.apart.argmax()))
            two = self._vector(int((self.square - 2 * self.dot(one)).argmax()))
            low = np.zeros(len(self.docs), bool)
            low[np.argsort(self.dot(two - one), kind="stable")[:len(self.docs) // 2]] = True
            entry = np.repeat(low, self.sizes)
            self.children = tuple(Ball(self.docs[m], self.sizes[m], self.terms[e], self.values[e], self.queries, self.width)
                                  for m, e in ((low, entry), (~low, ~entry)))
            self.terms = self.values = None  # the halves have them
        return self.children

    def scores(self, wanted: np.ndarray) -> np.ndarray:
        """Exact scores, as integers, for a query given as one flag a term."""
        return np.add.reduceat(np.where(wanted[self.terms], self.values, 0), self.starts)


class Best:
    """The best `k` (score, id) of each query: highest score first, then ascending id, null ids last."""

    def __init__(self, n: int, k: int):
        self.k, self.kept, self.worst = k, [(np.empty(0, np.int64),) * 3 for _ in range(n)], np.ones(n, np.int64)

    def offer(self, q: int, scores: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = scores >= self.worst[q]
        if not good.any():
            return
        s, i, e = (np.concatenate([old, new[good]]) for old, new in zip(self.kept[q], (scores, ids, none)))
        order = np.lexsort((i, e, -s))[:self.k]
        self.kept[q] = s[order], i[order], e[order]
        if len(order) == self.k:
            self.worst[q] = s[order[-1]]


def search(root: Ball, queries: Queries, best: Best, ids: np.ndarray, none: np.ndarray) -> None:
    """Descends best-first for each query; `best` keeps what is found."""
    wanted = np.zeros(root.width, bool)
    for q, terms in enumerate(queries.rows):
        todo, n = [(-root.bound[q], 0, root)], 1
        wanted[terms] = True
        while todo and -todo[0][0] >= best.worst[q]:
            ball = heapq.heappop(todo)[2]
            if ball.is_leaf():
                best.offer(q, ball.scores(wanted), ids[ball.docs], none[ball.docs])
            else:
                for half in ball.split():
                    if half.bound[q] >= best.worst[q]:
                        heapq.heappush(todo, (-half.bound[q], n, half))
                        n += 1
        wanted[terms] = False


def _search_chunks(rows: list[list[int]], width: int, k: int):
    """(doc_id, terms, values) in order -> (query, doc_id, score): the best of this task."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = Queries(rows)
        best = Best(len(rows), k)
        held: list[tuple] = []

        def done() -> None:
            ids, none, sizes, terms, values = (np.concatenate(c) for c in zip(*held))
            search(Ball(np.arange(len(ids)), sizes, terms, values, queries, width), queries, best, ids, none)

        docs = entries = 0
        for batch in batches:
            sizes = batch.column("terms").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            at = 0
            while at < len(sizes):
                room = max(1, min(CHUNK_DOCS - docs, int(np.searchsorted(np.cumsum(sizes[at:]), CHUNK_ENTRIES - entries, "right"))))
                part = batch.slice(at, room)
                id = part.column("doc_id")
                held.append((id.fill_null(0).to_numpy(zero_copy_only=False), id.is_null().to_numpy(zero_copy_only=False).astype(np.int64), sizes[at:at + room],
                             part.column("terms").flatten().to_numpy().astype(np.int64), part.column("values").flatten().to_numpy()))
                docs, entries, at = docs + part.num_rows, entries + int(sizes[at:at + room].sum()), at + room
                if docs >= CHUNK_DOCS or at < len(sizes):
                    done()
                    held, docs, entries = [], 0, 0
        if held:
            done()
        for q, (scores, ids, none) in enumerate(best.kept):
            if len(scores):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scores), q, np.int32)), pa.array(ids, mask=none > 0), pa.array(scores)], ["query", "doc_id", "score"])
    return run


def _rank_block(docs: DataFrame, items: list[tuple[int | None, bytes]], k: int) -> DataFrame | None:
    """The ranking of a block of queries, or None if none has a result."""
    spark = docs.sparkSession
    asked = [(id, sorted(set(terms_of(text)))) for id, text in items]
    known = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    if not known:
        return None
    counts = save(docs.mapInArrow(_count_terms(known), "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>"), "term-counts")
    n_docs, all_terms = counts.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r[0]: r[1] for r in counts.select(F.explode("terms").alias("t")).groupBy("t").count().collect()}  # one row a query term
    rows = [(id, [known[t] for t in terms if known[t] in df]) for id, terms in asked]
    rows = [(id, terms) for id, terms in rows if terms]
    if not rows:
        return None
    weights = np.zeros(len(known), np.int64)
    for t, n in df.items():
        weights[t] = term_weight(n_docs, n)
    vectors = counts.where(F.size("terms") > 0).mapInArrow(
        _weigh(weights, n_docs, all_terms), "first int, second int, doc_id bigint, terms array<int>, values array<bigint>")
    order = ["first", "second", "doc_id"]
    found = save(vectors.repartitionByRange(*order, F.xxhash64("terms", "values")).sortWithinPartitions(*order).select("doc_id", "terms", "values").mapInArrow(
        _search_chunks([terms for _, terms in rows], len(known), k), "query int, doc_id bigint, score bigint"), "found")
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    names = spark.createDataFrame([(q, id) for q, (id, _) in enumerate(rows)], "query int, item_id bigint")
    return found.withColumn("rank", place).where(F.col("rank") <= k).join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = TOP, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
                   query_block: int = QUERY_BLOCK) -> DataFrame:
    """(item_id, rank, doc_id, score): the `k` best documents of every item, from rank 1."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(f"`{id}`").cast("bigint").alias("doc_id"), F.col(f"`{text}`").cast("binary").alias("text"))
    asked = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{item_text}`").cast("binary").alias("text"))
    n_blocks = -(-asked.count() // query_block)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(n_blocks, 1)))
    ranked = [_rank_block(texts, [(r.item_id, bytes(r.text or b"")) for r in asked.where(block == b).collect()], k) for b in range(n_blocks)]
    ranked = [r for r in ranked if r is not None]
    return reduce(DataFrame.union, ranked) if ranked else spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
