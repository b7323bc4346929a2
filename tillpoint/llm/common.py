"""Helpers the operators share: tables in the shared folder, stable samples, bounded Arrow batches."""
from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.session import scratch_path

#: Rows an Arrow batch may hold on its way to a Python worker; texts can be long.
BATCH_ROWS, BATCH_BYTES = 512, 32 << 20
#: The same for encoders, which cut and look up the more texts at once the better, and the characters they take at once.
ENCODE_ROWS, ENCODE_CHARS = 2048, 6_000_000

#: Words of a text: runs of anything but space, tab and the line and page breaks.
BLANKS = " \t\n\x0b\f\r"


#: Has Spark drop a query's shuffle files as soon as the query ends.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def save(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """Write `df` once to the shared folder and read it back: cuts lineage and survives lost executors.

    The written table takes the place of the shuffles behind it, so their files go when it is written.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    before = spark.conf.get(_DROP_SHUFFLES, None)
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        df.write.option("compression", compression).parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_DROP_SHUFFLES)
        else:
            spark.conf.set(_DROP_SHUFFLES, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(*tables: DataFrame) -> None:
    """Delete tables that `save` wrote and nothing will read again."""
    for df in tables:
        spark = df.sparkSession
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the rows and bytes of an Arrow batch of this session's Python stages."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def stable_sample(df: DataFrame, key: Column, n: int, by: str | None = None, salt: int = 17) -> DataFrame:
    """About `n` rows (of each value of `by`), the same ones on every run: those whose salted key hash is low.

    Only for fitting and for choosing routes. One count over the key columns sets the threshold; the
    rows themselves are filtered in the scan, never sorted or gathered. All rows come back if there are
    fewer than `n`.
    """
    place = F.pmod(F.xxhash64(F.lit(salt), key), F.lit(1 << 30))
    if by is None:
        total = df.count()
        return df.where(place < int((1 << 30) * min(1.0, n / max(total, 1))))
    totals = {r[0]: r[1] for r in df.groupBy(by).count().collect()}
    return df.where(reduce(
        lambda a, v: a | ((F.col(by) == F.lit(v)) & (place < int((1 << 30) * min(1.0, n / totals[v])))),
        totals, F.lit(False)))


def key_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """One table for each run of rows with equal `keys`; rows of a key follow each other. Keys must not be null."""
    held, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = list(zip(*(batch.column(k).to_pylist() for k in keys)))
        starts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
        for lo, hi in zip(starts, starts[1:]):
            if held and values[lo] != key:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            key = values[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def crc_mod(key: str, m: int) -> Column:
    """crc32 of an id written as text, modulo `m`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % m


def words_column(text: Column) -> Column:
    """Array of a text's words, in order; empty for a null text or one without words."""
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(F.coalesce(bare, F.lit("")) == "", F.array().cast("array<string>")).otherwise(
        F.split(bare, r"[\x20\x09-\x0D]+"))


def text_chunks(batches: Iterator[pa.RecordBatch], column: str, most: int = 4_000_000) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with at most `most` characters of text (or one row), null texts as ''."""
    for batch in batches:
        texts = [t or "" for t in batch.column(column).to_pylist()]
        at = size = 0
        for i, t in enumerate(texts):
            if i > at and size + len(t) > most:
                yield batch.slice(at, i - at), texts[at:i]
                at, size = i, 0
            size += len(t)
        if at < len(texts):
            yield batch.slice(at), texts[at:]
