"""Operator 2: token counts without ids: each distinct pre-token is counted once and joined to per-document frequencies.

Pre-tokens here are the units of `units.py` (runs of the tokenizer's own pieces, with their leading
space); a unit that is not among the commonest is taken apart into its words, marks and line breaks. The commonest ones, from a bounded stable sample, are counted first and broadcast (at
most HOT_UNITS of at most LONG_UNIT characters, a few MB at any corpus size) so that no very common
key is ever shuffled; every other pre-token of every document takes the join. The sample only chooses
the route of a pre-token; all counts are exact.

Null text counts as empty (0 bytes, 0 tokens); null and repeated doc_ids keep a row each; an empty
table gives an empty result; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillpoint.llm.common import save, small_batches, stable_sample, text_chunks
from tillpoint.llm.units import LONG_UNIT, encoder, plain_pieces, units_of

HOT_UNITS, HOT_DOCS = 300_000, 10_000


def _count_pieces(vocab: str):
    """unit -> unit, number of its ids."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for batch in batches:
            units = batch.column("unit").to_pylist()
            yield pa.RecordBatch.from_arrays([pa.array(units, pa.string()), pa.array(enc.counts(units), pa.int64())], ["unit", "pieces"])

    return count


def _taking_apart(vocab: str) -> Callable[[str], list[str]]:
    """unit -> the pieces counted for it: itself, unless the vocabulary is known to see its pieces apart."""
    if encoder(vocab).folds is None:
        return lambda unit: [unit]
    return lambda unit: plain_pieces(unit) or [unit]


def hot_units(docs: DataFrame, vocab: str, n_docs: int = HOT_DOCS, n_units: int = HOT_UNITS) -> dict[str, int]:
    """Pieces of the commonest pre-tokens of a bounded sample."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apart = _taking_apart(vocab)
        for _, texts in text_chunks(batches, "text"):
            seen = Counter(u for p in units_of(texts)[0] for u in p if len(u) <= LONG_UNIT)
            for unit, n in list(seen.items()):
                pieces = apart(unit)
                if len(pieces) > 1:
                    for piece in pieces:
                        seen[piece] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["unit", "n"])

    sample = stable_sample(docs.select("doc_id", "text"), F.col("doc_id"), n_docs).select("text")
    top = (sample.mapInArrow(tally, "unit string, n bigint").groupBy("unit").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "unit").limit(n_units).select("unit"))
    return {r.unit: r.pieces for r in top.mapInArrow(_count_pieces(vocab), "unit string, pieces bigint").collect()}


def count_tokens(docs: DataFrame, vocab: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    spark = docs.sparkSession
    small_batches(spark)
    base = docs.select("doc_id", "text")
    hot = spark.sparkContext.broadcast(hot_units(base, vocab))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row, apart = hot.value, TaskContext.get().partitionId() << 40, _taking_apart(vocab)
        for batch, texts in text_chunks(batches, "text"):
            n_hot, units, freqs = [], [], []
            for parts in units_of(texts)[0]:
                counts = [known.get(u, -1) for u in parts]
                total, rest = sum(counts), Counter()
                if -1 in counts:
                    for unit, c in zip(parts, counts):
                        if c < 0:
                            total += 1
                            for piece in apart(unit):
                                n = known.get(piece, -1)
                                if n < 0:
                                    rest[piece] += 1
                                else:
                                    total += n
                n_hot.append(total)
                units.append(list(rest))
                freqs.append(list(rest.values()))
            yield pa.RecordBatch.from_arrays([
                pa.array(range(row, row + len(texts)), pa.int64()), batch.column("doc_id").cast(pa.int64()),
                pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n_hot, pa.int64()),
                pa.array(units, pa.list_(pa.string())), pa.array(freqs, pa.list_(pa.int32()))],
                ["row", "doc_id", "n_bytes", "n_hot", "units", "freqs"])
            row += len(texts)

    table = save(base.mapInArrow(
        frequencies, "row bigint, doc_id bigint, n_bytes bigint, n_hot bigint, units array<string>, freqs array<int>"), "frequencies")
    rare = table.select("row", F.explode(F.arrays_zip("units", "freqs")).alias("u")).select("row", F.col("u.units").alias("unit"), F.col("u.freqs").alias("freq"))
    pieces = rare.select("unit").distinct().mapInArrow(_count_pieces(vocab), "unit string, pieces bigint")
    sums = rare.join(pieces, "unit").groupBy("row").agg(F.sum(F.col("freq") * F.col("pieces")).alias("n_rare"))
    total = F.col("n_hot") + F.coalesce("n_rare", F.lit(0))
    return table.select("row", "doc_id", "n_bytes", "n_hot").join(sums, "row", "left").select(
        "doc_id", "n_bytes", total.alias("n_tokens"), (total > limit).alias("over_limit"))
