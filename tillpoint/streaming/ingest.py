"""Incremental ingest (A8) and its dedup (D2) with Structured Streaming, each batch exactly once.

A file-source stream hands each micro-batch its files' lines, header rows included; ``foreachBatch`` binds them by header
name. Below the table's folder:

* ``raw/batch=<id>``: the batch's accepted lines by (year, month), ``refused/batch=<id>``: the others with their reason;
* ``months/batch=<id>``: the curated months that the batch touches, derived anew from all raw lines of those months, so
  the latest-file rule D1 holds over everything that ever arrived: corrected, late and repeated lines end as one load of
  the same files would;
* ``log/<id>.json``: written last, in one step. It says which batches count and which batch holds each month.

Folders that no log entry names are not part of the table. A batch that dies before its entry is written is run again by
the stream under the same id and overwrites what it left; one that dies after is recognised by its entry and passed
over. Readers take the newest entry, so they see a batch whole or not at all. ``availableNow`` processes what has
landed, then stops.
"""
from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions import fixed
from tillpoint.plans.curate import SALES_COLUMNS, curate
from tillpoint.plans.dedup import DEDUP_KEY, MonthParts
from tillpoint.plans.publish import create_file, list_files, read_file
from tillpoint.session import short_methods
from tillpoint.sources.pos_csv import _keyword_filter, accepted, file_lines, header_rows, name_lines, refused_lines, typed_sales

NOTHING = {"batches": [], "refused": [], "months": {}}


def sales_stream(spark: SparkSession, inbox: str, files_per_batch: int | None = None) -> DataFrame:
    """The lines of new sales files."""
    reader = spark.readStream if files_per_batch is None else spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    return file_lines(reader, inbox).where(_keyword_filter(F.col("file_name"), fixed.SALES_KEYWORDS))


def committed(spark: SparkSession, table_path: str) -> dict[int, dict]:
    """batch id -> its log entry."""
    names = list_files(spark, f"{table_path}/log")
    newest = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json")), default=None)
    return {} if newest is None else {newest: json.loads(read_file(spark, f"{table_path}/log/{newest:010d}.json"))}


def _stage(batch: DataFrame, batch_id: int, table_path: str, state: dict, category_aliases: dict | None) -> dict:
    """Write the batch's folders; the log entry that would make them count."""
    spark = batch.sparkSession
    # cut twice, from the batch's own files, rather than kept: kept cells would take several times the files' size; one row a file is kept
    found = header_rows(batch, fixed.COLUMN_MAP)
    heads = spark.createDataFrame(found.collect(), found.schema)
    parsed = typed_sales(name_lines(batch, fixed.COLUMN_MAP, heads))
    new = accepted(parsed).withColumns({"year": F.year("completed_at"), "month": F.month("completed_at")})
    with short_methods(spark):
        refused_lines(parsed).write.mode("overwrite").parquet(f"{table_path}/refused/batch={batch_id}")
        new.write.mode("overwrite").partitionBy("year", "month").parquet(f"{table_path}/raw/batch={batch_id}")
    raw = lambda batches: spark.read.schema(new.schema).option("basePath", f"{table_path}/raw").parquet(*(f"{table_path}/raw/batch={b}" for b in batches))
    # one row a month: the months' literals prune the partitions read below
    months = [(r.year, r.month) for r in raw([batch_id]).select("year", "month").distinct().collect()]
    entry = {"batches": list(state["batches"]), "refused": [*state["refused"], batch_id], "months": dict(state["months"])}
    if months:
        entry["batches"].append(batch_id)
        touched = reduce(lambda a, m: a | ((F.col("year") == m[0]) & (F.col("month") == m[1])), months, F.lit(False))
        # a line's place in its file holds within its batch; the same file never comes twice
        stored = raw(entry["batches"]).where(touched).drop("year", "month", "batch")
        stored = MonthParts.for_lines(spark, stored.count()).deal(stored, *DEDUP_KEY)
        with short_methods(spark):
            curate(stored, category_aliases=category_aliases).write.mode("overwrite").partitionBy("year", "month").parquet(f"{table_path}/months/batch={batch_id}")
        entry["months"] |= {f"{y}-{m}": batch_id for y, m in months}
    return entry


def _commit(spark: SparkSession, table_path: str, batch_id: int, entry: dict) -> None:
    create_file(spark, f"{table_path}/log/{batch_id:010d}.json", json.dumps(entry))


def _merge_batch(table_path: str, category_aliases: dict | None):
    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        log = committed(spark, table_path)
        if log and max(log) >= batch_id:
            return  # it ended after its entry was written
        state = next(iter(log.values()), NOTHING)
        _commit(spark, table_path, batch_id, _stage(batch, batch_id, table_path, state, category_aliases))

    return merge


def read_ingested(spark: SparkSession, table_path: str) -> DataFrame:
    """The curated table as of the newest log entry."""
    state = next(iter(committed(spark, table_path).values()), NOTHING)
    by_batch: dict[int, list[str]] = {}
    for month, b in state["months"].items():
        by_batch.setdefault(b, []).append(month)
    parts = []
    for b, months in by_batch.items():
        held = reduce(lambda a, m: a | ((F.col("year") == int(m.split("-")[0])) & (F.col("month") == int(m.split("-")[1]))), months, F.lit(False))
        parts.append(spark.read.parquet(f"{table_path}/months/batch={b}").where(held).select(*SALES_COLUMNS))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], ", ".join(f"{c} string" for c in SALES_COLUMNS))


def read_raw(spark: SparkSession, table_path: str, folder: str = "raw") -> DataFrame | None:
    """All accepted ('raw') or 'refused' lines of the batches that count; None if there are none."""
    state = next(iter(committed(spark, table_path).values()), NOTHING)
    batches = state["batches" if folder == "raw" else "refused"]
    if not batches:
        return None
    return spark.read.option("basePath", f"{table_path}/{folder}").parquet(*(f"{table_path}/{folder}/batch={b}" for b in batches))


def incremental_ingest(spark: SparkSession, inbox: str, table_path: str, checkpoint: str, category_aliases: dict | None = None,
                       files_per_batch: int | None = None):
    """Run the ingest stream once over everything that has landed (availableNow)."""
    table_path = table_path.rstrip("/")
    q = (sales_stream(spark, inbox, files_per_batch).writeStream.foreachBatch(_merge_batch(table_path, category_aliases))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return read_ingested(spark, table_path)
