"""Operator 7: best-two-fit packing of token pieces into sequences of a fixed size.

Pieces of one length are interchangeable, so the packing is planned on the histogram of lengths (at
most `size` rows, whatever the corpus): a bin is filled greedily, then its smallest piece gives way
to two unpacked ones that fit the widened gap more tightly; a bin's pattern is repeated as long as its
lengths last. Pieces take the places of their length by rank. Ranks come from (task, running number)
pairs and per-task counts, so no length, however common, is sorted or gathered in one task.

`pack_in_order` packs each window of consecutive documents on its own and numbers the sequences in their
order, so that an order of the documents (a mix of sources) holds among the sequences too.

Null text counts as empty (the end id alone); null and repeated doc_ids are packed like any other; an
empty table gives no pieces; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import ENCODE_CHARS, ENCODE_ROWS, save, small_batches, text_chunks
from tillpoint.llm.units import encoder
from tillpoint.plans.prefix import global_running

#: Documents that `pack_in_order` packs together.
WINDOW_DOCS = 2048


def cut_lengths(n: int, size: int) -> list[int]:
    """Piece lengths of a document of `n` tokens: whole sequences, but a shorter first piece if need be."""
    if n <= size:
        return [n]
    return ([n % size] if n % size else []) + [size] * (n // size)


def token_pieces(docs: DataFrame, vocab: str, end_id: int, size: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, piece, start, length, ids, nth, task, *keep): the pieces with their ids (little-endian uint32).

    `nth` numbers the pieces of one length within one writing task; `keep` are bigint columns of the documents.
    """
    small_batches(docs.sparkSession, ENCODE_ROWS)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, task, seen = encoder(vocab), TaskContext.get().partitionId(), Counter()
        end = np.array([end_id], "<u4").tobytes()
        for batch, texts in text_chunks(batches, "text", ENCODE_CHARS):
            out, row = [[] for _ in range(6)], []
            for i, (doc_id, raw) in enumerate(zip(batch.column("doc_id").to_pylist(), enc.encode(texts))):
                ids = np.frombuffer(raw, enc.dtype).astype("<u4").tobytes() + end
                start = 0
                for piece, n in enumerate(cut_lengths(len(ids) // 4, size)):
                    for column, value in zip(out, (doc_id, piece, start, n, ids[4 * start:4 * (start + n)], seen[n])):
                        column.append(value)
                    row.append(i)
                    seen[n] += 1
                    start += n
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, k) for c, k in zip(out, kinds)), pa.array([task] * len(out[0]), pa.int32()),
                 *(batch.column(c).take(pa.array(row, pa.int64())) for c in keep)],
                ["doc_id", "piece", "start", "length", "ids", "nth", "task", *keep])

    schema = "doc_id bigint, piece int, start bigint, length bigint, ids binary, nth bigint, task int"
    return save(docs.select("doc_id", "text", *keep).mapInArrow(cut, ", ".join([schema, *(f"{c} bigint" for c in keep)])), "pieces")


def best_two_fit(histogram: dict[int, int], size: int) -> list[tuple[int, list[int]]]:
    """[(number of bins, lengths in the bin)] for a histogram of lengths of at most `size`."""
    left = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    every = np.arange(size + 1)
    plan = []
    while left.any():
        rest, room, lengths = left.copy(), size, []

        def fill() -> None:
            nonlocal room
            while room > 0:
                fits = np.flatnonzero(rest[:room + 1])
                if not len(fits):
                    return
                longest = int(fits[-1])
                k = min(int(rest[longest]), room // longest)
                lengths.extend([longest] * k)
                rest[longest] -= k
                room -= k * longest

        fill()
        least = min(lengths)
        gap = room + least
        # the pair a >= b with the largest a + b <= gap; b is the longest left that fits beside a
        below = np.maximum.accumulate(np.where(rest > 0, every, 0))
        a = np.flatnonzero(rest[:gap + 1])
        b = below[np.minimum(a, gap - a)]
        alone = (b == a) & (rest[a] < 2)
        b = np.where(alone, below[np.maximum(b - 1, 0)], b)
        if len(a) and (tight := np.where(b > 0, a + b, 0)).max() > least:
            best = int(tight.argmax())
            lengths.remove(least)
            rest[least] += 1
            for x in (int(a[best]), int(b[best])):
                lengths.append(x)
                rest[x] -= 1
            room = gap - int(tight[best])
            fill()
        use = Counter(lengths)
        times = min(int(left[x]) // n for x, n in use.items())
        for x, n in use.items():
            left[x] -= times * n
        plan.append((times, sorted(lengths, reverse=True)))
    return plan


def places(plan: list[tuple[int, list[int]]]) -> np.ndarray:
    """Rows (length, first rank, first sequence, offset): that length's next ranks go one to a sequence."""
    taken, sequence, rows = Counter(), 0, []
    for times, lengths in plan:
        offset = 0
        for x in lengths:
            rows.append((x, taken[x], sequence, offset))
            taken[x] += times
            offset += x
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def assign_sequences(pieces: DataFrame, size: int) -> DataFrame:
    """Adds sequence_id and offset to rows that have length, task and nth (unique together), drops the latter two."""
    spark = pieces.sparkSession
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    counts = save(counts, "length-counts")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    table = spark.sparkContext.broadcast(places(best_two_fit(histogram, size)))
    tasks = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("task", "length", F.coalesce(F.sum("n").over(tasks), F.lit(0)).alias("ranks_before"))
    # tasks x lengths grow with the table: shuffled, never broadcast
    ranked = pieces.join(base.hint("merge"), ["task", "length"]).withColumn("rank", F.col("ranks_before") + F.col("nth"))
    columns = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = table.value
        keys = (rows[:, 0] << 48) + rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(keys, (length << 48) + rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(rows[at, 2] + rank - rows[at, 1]), pa.array(rows[at, 3])],
                [*columns, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name in columns)
    return ranked.select(*columns, "rank").mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, vocab: str, end_id: int = 0, size: int = 2048) -> tuple[DataFrame, DataFrame]:
    """(pieces with their ids, places of the pieces): the latter has (doc_id, piece, start, length, ids_crc32,
    sequence_id, offset). Both have `task` and `nth`'s join key left out; see `sequences` for whole sequences."""
    pieces = token_pieces(docs, vocab, end_id, size)
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "task", "nth")
    return pieces, assign_sequences(digests, size)


def pack_in_order(docs: DataFrame, vocab: str, end_id: int = 0, size: int = 2048, window_docs: int = WINDOW_DOCS) -> DataFrame:
    """As the second of `pack_documents`, for documents with a `position` that counts up from 0.

    Each window of `window_docs` positions fills sequences of its own, pieces of one length by position, and its
    sequences are numbered after those of the windows before, by the least position they hold. So the first
    sequences hold the first documents, up to one window; a window leaves about one sequence part empty.
    """
    pieces = token_pieces(docs, vocab, end_id, size, ("position",))
    digests = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "position",
                            F.expr(f"position div {int(window_docs)}").alias("window"))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def pack(window: pa.Table) -> pa.Table:
        window = window.sort_by([("position", "ascending"), ("piece", "ascending")]).combine_chunks()
        length = window.column("length").to_numpy()
        rows = places(best_two_fit(Counter(length.tolist()), size))
        by_length = np.argsort(length, kind="stable")
        ordered = length[by_length]
        rank = np.empty(len(length), np.int64)
        rank[by_length] = np.arange(len(length)) - np.searchsorted(ordered, ordered)
        at = np.searchsorted((rows[:, 0] << 48) + rows[:, 1], (length << 48) + rank, "right") - 1
        # each planned sequence's first row, and from that its number
        _, first, planned = np.unique(rows[at, 2] + rank - rows[at, 1], return_index=True, return_inverse=True)
        number = np.empty(len(first), np.int64)
        number[np.argsort(first)] = np.arange(len(first))
        return pa.table([*(window.column(c) for c in kept), window.column("window"), pa.array(number[planned]), pa.array(rows[at, 3])],
                        [*kept, "window", "number", "offset"])

    placed = save(digests.groupBy("window").applyInArrow(
        pack, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, window bigint, number bigint, offset bigint"), "placed")
    counts = placed.groupBy("window").agg((F.max("number") + 1).alias("n"))
    starts = global_running(counts, [F.col("window")], "n").select("window", (F.col("running_sum") - F.col("n")).alias("before"))
    return placed.join(starts, "window").select(*kept, (F.col("before") + F.col("number")).alias("sequence_id"), "offset")


def sequences(pieces: DataFrame, size: int) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, at most `size` ids each, from `token_pieces` rows."""
    placed = assign_sequences(pieces.select("length", "task", "nth", "ids"), size)
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))  # at most `size` pieces of `size` ids in all
    return placed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"])).alias("ids"))
