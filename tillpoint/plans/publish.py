"""All views in one partitioned write, put in force by a manifest that is written last, and read back.

A view is a DataFrame with `period` and `store` columns. Each row becomes a JSON document; the rows of all views go out in one
write, partitioned by view and period, into a folder of their own. The manifest (a single small file, created in one step)
names that folder and the views' schemas; readers take the newest one, so a publication is seen whole or not at all.
"""
from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tillpoint.plans.cube import sanitize


def _place(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def create_file(spark: SparkSession, path: str, text: str) -> None:
    """Create a small file in one step: written aside, then renamed; an error if it is there already."""
    final, fs = _place(spark, path)
    aside = spark._jvm.org.apache.hadoop.fs.Path(final.getParent(), f".{uuid.uuid4().hex}.tmp")
    fs.mkdirs(final.getParent())
    out = fs.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(final) or not fs.rename(aside, final):
        fs.delete(aside, False)
        raise FileExistsError(path)


def list_files(spark: SparkSession, folder: str) -> list[str]:
    p, fs = _place(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_file(spark: SparkSession, path: str) -> str:
    p, fs = _place(spark, path)
    source = fs.open(p)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
    finally:
        source.close()


def publish(views: dict[str, DataFrame], root: str) -> dict:
    """Write all `views` (each with period and store) at once and put them in force; the manifest."""
    spark = next(iter(views.values())).sparkSession
    root = root.rstrip("/")
    clean = {name: sanitize(df) for name, df in views.items()}
    rows = reduce(DataFrame.union, (df.select(F.lit(name).alias("view"), F.col("period").cast("string").alias("period"), F.col("store").cast("string").alias("store"),
                                              F.to_json(F.struct(*df.columns)).alias("document")) for name, df in clean.items()))
    version = max((int(n[:10]) for n in list_files(spark, f"{root}/manifest") if n.endswith(".json")), default=-1) + 1
    folder = f"data/{version:010d}-{uuid.uuid4().hex[:8]}"
    rows.write.partitionBy("view", "period").json(f"{root}/{folder}")
    manifest = {"version": version, "folder": folder, "views": {name: json.loads(df.schema.json()) for name, df in clean.items()}}
    create_file(spark, f"{root}/manifest/{version:010d}.json", json.dumps(manifest))
    return manifest


def published(spark: SparkSession, root: str) -> dict:
    """The manifest in force."""
    newest = max(n for n in list_files(spark, f"{root.rstrip('/')}/manifest") if n.endswith(".json"))
    return json.loads(read_file(spark, f"{root.rstrip('/')}/manifest/{newest}"))


def read_view(spark: SparkSession, root: str, name: str, period: str | None = None) -> DataFrame:
    """A published view (or one period of it, from that folder alone), with the columns it was published with."""
    manifest = published(spark, root)
    schema = StructType.fromJson(manifest["views"][name])
    rows = spark.read.schema("store string, document string, view string, period string").json(f"{root.rstrip('/')}/{manifest['folder']}").where(F.col("view") == name)
    if period is not None:
        rows = rows.where(F.col("period") == period)
    return rows.select(F.from_json("document", schema).alias("row")).select("row.*")
