"""Operator 1: token ids in binary blocks, each document its own zstandard frame under a shared dictionary.

Format (a folder in the shared storage):
  blocks/    Parquet rows (shard, block, dict_hash, doc_ids[], starts[], counts[], offsets[], payload):
             payload holds the documents' frames back to back, offsets[i]..offsets[i+1] is document i, so
             one short document is read by one slice and one small decompression. Frames hold the ids as
             little-endian unsigned 16- or 32-bit integers (`width`). starts[] count from the shard's start.
  shards/    one row a shard: ids before it, ids in it, dict_hash, width.
  dictionary/ one row: dict_hash (sha256) and the dictionary's bytes.

Rows are in ascending (doc_id, xxhash64(text)) order: shards are range partitions, sorted inside.
Null text counts as empty (only the end id); a null doc_id sorts first; repeated rows are written each;
an empty table gives empty folders of the same schema; other columns are ignored.
"""
from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.llm.common import ENCODE_CHARS, ENCODE_ROWS, small_batches, stable_sample, text_chunks
from tillpoint.llm.units import encoder
from tillpoint.session import scratch_path

#: Documents the dictionary is trained on, bytes of one training piece, and the most pieces.
DICT_DOCS, DICT_PIECE, DICT_PIECES = 512, 2048, 2048
DICT_BYTES = 32_768
#: Payload bytes of a block, about.
BLOCK_BYTES = 1 << 18

BLOCK_SCHEMA = ("shard int, block int, dict_hash string, width int, doc_ids array<bigint>, starts array<bigint>, "
                "counts array<bigint>, offsets array<bigint>, payload binary")


def train_dictionary(docs: DataFrame, vocab: str, n_docs: int = DICT_DOCS, n_bytes: int = DICT_BYTES) -> bytes:
    """Dictionary fitted on the serialised ids of about `n_docs` whole documents, cut into pieces.

    Only the compression ratio depends on this bounded sample (at most DICT_PIECES pieces of DICT_PIECE
    bytes reach the driver). Too few samples give b'': frames are then written without a dictionary.
    """
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        for _, texts in text_chunks(batches, "text"):
            cut = [b[i:i + DICT_PIECE] for b in enc.encode(texts) for i in range(0, len(b), DICT_PIECE)]
            yield pa.RecordBatch.from_arrays([pa.array(cut, pa.binary())], ["piece"])

    sample = stable_sample(docs.select("doc_id", "text"), F.col("doc_id"), n_docs)
    found = (sample.select("text").mapInArrow(pieces, "piece binary")
             .orderBy(F.xxhash64("piece")).limit(DICT_PIECES).collect())
    try:
        return zstandard.train_dictionary(n_bytes, [bytes(r.piece) for r in found]).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _writer(vocab: str, end_id: int, dictionary: bytes, dict_hash: str, level: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocab)
        end = np.array([end_id], enc.dtype).tobytes()
        made = zstandard.ZstdCompressor(level=level, write_content_size=True, dict_data=zstandard.ZstdCompressionDict(dictionary)) \
            if dictionary else zstandard.ZstdCompressor(level=level, write_content_size=True)
        shard, block, start, size = TaskContext.get().partitionId(), 0, 0, 0
        ids, starts, counts, frames = [], [], [], []

        def row() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)]).tolist()
            values = [[shard], [block], [dict_hash], [enc.dtype.itemsize], [ids], [starts], [counts], [offsets], [b"".join(frames)]]
            kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), *[pa.list_(pa.int64())] * 4, pa.binary()]
            names = ["shard", "block", "dict_hash", "width", "doc_ids", "starts", "counts", "offsets", "payload"]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], names)

        for batch, texts in text_chunks(batches, "text", ENCODE_CHARS):
            for doc_id, raw in zip(batch.column("doc_id").to_pylist(), enc.encode(texts)):
                n = len(raw) // enc.dtype.itemsize + 1
                frame = made.compress(raw + end)
                ids.append(doc_id), starts.append(start), counts.append(n), frames.append(frame)
                start, size = start + n, size + len(frame)
                if size >= BLOCK_BYTES:
                    yield row()
                    block, size = block + 1, 0
                    ids, starts, counts, frames = [], [], [], []
        if ids:
            yield row()

    return write


def write_token_files(docs: DataFrame, vocab: str, end_id: int, path: str | None = None, level: int = 3) -> str:
    """Encode every whole text and write the format above; returns its folder."""
    spark = docs.sparkSession
    small_batches(spark, ENCODE_ROWS)
    path = path or scratch_path(spark, "token-files")
    base = docs.select("doc_id", "text")
    dictionary = train_dictionary(base, vocab)
    dict_hash = hashlib.sha256(dictionary).hexdigest()
    order = [F.col("doc_id"), F.xxhash64("text")]
    (base.repartitionByRange(*order).sortWithinPartitions(*order)
     .mapInArrow(_writer(vocab, end_id, dictionary, dict_hash, level), BLOCK_SCHEMA)
     .write.option("compression", "uncompressed").parquet(f"{path}/blocks"))
    spark.createDataFrame([(dict_hash, bytearray(dictionary))], "dict_hash string, dictionary binary") \
        .coalesce(1).write.parquet(f"{path}/dictionary")
    shards = (spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
              .select("shard", "dict_hash", "width", F.aggregate("counts", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
              .groupBy("shard").agg(F.sum("n").alias("n_ids"), F.first("dict_hash").alias("dict_hash"), F.first("width").alias("width")))
    # one row a shard: the running sum over shards is small whatever the corpus
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards.withColumn("ids_before", F.coalesce(before, F.lit(0))).coalesce(1).write.parquet(f"{path}/shards")
    return path


def load_dictionary(spark: SparkSession, path: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{path}/dictionary").first()
    return row.dict_hash, bytes(row.dictionary)


def read_documents(row: dict, dictionary: bytes, dict_hash: str) -> Iterator[tuple[int, int, np.ndarray]]:
    """(doc_id, start in the shard, ids) of each document of one block; the dictionary's hash must fit."""
    if row["dict_hash"] != dict_hash:
        raise ValueError("the block was written with another dictionary")
    undo = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    kind = np.dtype(f"<u{row['width']}")
    view = memoryview(row["payload"])
    for i, doc_id in enumerate(row["doc_ids"]):
        ids = np.frombuffer(undo.decompress(view[row["offsets"][i]:row["offsets"][i + 1]]), kind)
        if len(ids) != row["counts"][i]:
            raise ValueError(f"document {doc_id} has {len(ids)} ids, its index says {row['counts'][i]}")
        yield doc_id, row["starts"][i], ids


def read_token_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) read back from the files."""
    small_batches(spark)
    dict_hash, dictionary = load_dictionary(spark, path)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                docs = [(d, row["ids_before"] + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
                        for d, s, ids in read_documents(row, dictionary, dict_hash)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*docs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    shards = spark.read.parquet(f"{path}/shards").select("shard", "ids_before")
    return blocks.join(shards, "shard").mapInArrow(digests, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
