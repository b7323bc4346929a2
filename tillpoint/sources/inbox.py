"""An inbox of CSV exports written from the driver tables, as a store's system would leave them: the CSV sources' counterpart.

One file a month, named with its first and last day, with a header row, quoted cells, ``$`` amounts and 12-hour times.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillpoint.functions import fixed
from tillpoint.functions.expr import cents
from tillpoint.plans.publish import _place
from tillpoint.session import scratch_path, short_methods
from tillpoint.sources import testmodel

#: Lines that a damaged export breaks, by order number: one in this many for each kind.
BROKEN_ONE_IN = 50


def _csv(columns: list) -> F.Column:
    return F.concat(F.lit('"'), F.concat_ws('","', *(F.replace(F.coalesce(c, F.lit("")), F.lit('"'), F.lit('""')) for c in columns)), F.lit('"'))


def _header(names) -> str:
    return ",".join(f'"{n}"' for n in names)


def _write(rows: DataFrame, folder: str, gzip: bool) -> None:
    """(name, line), each file's lines in order in one partition -> the files."""
    spark = rows.sparkSession
    aside = scratch_path(spark, "inbox")
    with short_methods(spark):
        rows.write.options(compression="gzip" if gzip else "none", **{"zlib.compress.level": "BEST_SPEED"}).partitionBy("name").text(aside)
    target, fs = _place(spark, folder)
    fs.mkdirs(target)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for part in fs.listStatus(path(aside)):  # one folder a file
        if part.isDirectory():
            name = part.getPath().getName().removeprefix("name=")
            for f in fs.listStatus(part.getPath()):
                if f.getPath().getName().startswith("part-"):
                    fs.rename(f.getPath(), path(target, name + (".csv.gz" if gzip else ".csv")))


def write_files(lines: DataFrame, header: str, folder: str, gzip: bool = False) -> None:
    """(name, place, line) -> the file `name` with `header` and its lines in the order of `place`."""
    # the header goes before a file's first line: no second pass over the lines for their names
    first = F.row_number().over(Window.partitionBy("name").orderBy("place")) == 1
    _write(lines.select("name", F.when(first, F.concat(F.lit(header + "\n"), "line")).otherwise(F.col("line")).alias("line")), folder, gzip)


@dataclass(frozen=True)
class MonthFiles:
    """How lines are dealt to the files they are written to, one a month, in the order of their place, while they are keys and numbers.

    `months` (completed_at) are the times of all receipts: a header row goes before the lines of each of their months. `early`: a March line
    also goes to a file of the first half of the month.
    """

    months: DataFrame
    early: bool = False

    COLUMNS: ClassVar[tuple[str, ...]] = ("name", "is_header", "is_early")

    def _files(self) -> F.Column:
        first = F.trunc("completed_at", "MM")
        start = F.concat(F.lit("margin report "), first.cast("string"), F.lit(" "))
        # never null, or the write would take the name for another column than the one that is sorted by
        month = F.struct(F.coalesce(F.concat(start, F.last_day(first).cast("string")), F.lit("")).alias("name"), F.lit(False).alias("is_early"))
        half = F.struct(F.coalesce(F.concat(start, F.date_add(first, 14).cast("string")), F.lit("")).alias("name"), F.lit(True).alias("is_early"))
        return F.when(F.month(first) == 3, F.array(month, half)).otherwise(F.array(month)) if self.early else F.array(month)

    def deal(self, lines: DataFrame, key: str) -> DataFrame:
        """`lines` with COLUMNS and a row for each header, a file's rows in one partition and in order."""
        dealt = lambda rows, head: rows.where(F.col("completed_at").isNotNull()).select("*", F.inline(self._files()), F.lit(head).alias("is_header"))
        heads = dealt(self.months.select(F.trunc("completed_at", "MM").alias("completed_at")).distinct(), True).drop("completed_at")
        rows = dealt(lines, False).unionByName(heads, allowMissingColumns=True)
        return rows.repartition("name").sortWithinPartitions("name", F.col("is_header").desc(), *testmodel.LINE_ORDER)


def _money(c: str) -> F.Column:
    """A two-decimal double as $ and its digits, from its cents: a cast to a decimal goes by its text."""
    n = cents(c)
    digits = F.lpad(F.abs(n).cast("string"), F.greatest(F.length(F.abs(n).cast("string")), F.lit(3)), "0")
    return F.concat(F.when(n < 0, "$-").otherwise("$"), F.substr(digits, F.lit(1), F.length(digits) - 2), F.lit("."), F.right(digits, F.lit(2)))


def sales_lines(spark: SparkSession, sf_dir: str, broken: bool = False, early: bool = False) -> DataFrame:
    """(name, line) of the month files of all raw lines, as `MonthFiles` deals them, and their header rows; `broken` damages some lines."""
    raw = testmodel.raw_lines(spark, sf_dir, MonthFiles(testmodel.receipts(spark, sf_dir), early))
    text = {k: F.col(v).cast("string") for k, v in fixed.COLUMN_MAP.items() if v in raw.columns}
    text |= {k: _money(v) for k, v in fixed.COLUMN_MAP.items() if v in raw.columns and v in fixed.MONEY_COLS}
    when = F.date_format("completed_at", "MM/dd/yyyy hh:mm:ss a")
    spoilt = F.pmod(F.col("receipt_id").cast("bigint"), F.lit(BROKEN_ONE_IN))
    text["Completed At"] = F.when(spoilt == 7, F.lit("soon")).otherwise(when) if broken else when
    line = _csv(list(text.values()))
    if broken:
        line = F.when(spoilt == 11, F.concat(line, F.lit(',"one","more"'))).when(spoilt == 13, F.concat(F.lit('"'), line)).otherwise(line)
    rows = raw.select("name", "is_header", "is_early", line.alias("line"))  # the line is made once
    line = F.when(F.col("is_early"), F.replace("line", F.lit("$"), F.lit("$9"))).otherwise(F.col("line")) if early else F.col("line")
    return rows.select("name", F.when(F.col("is_header"), F.lit(_header(text))).otherwise(line).alias("line"))


def write_sales_inbox(spark: SparkSession, sf_dir: str, gzip: bool = False, broken: bool = False, early: bool = False) -> str:
    """The folder of an inbox with the month files; `early` adds half-month files of the same lines that ended sooner and are wrong."""
    folder = scratch_path(spark, "sales-inbox")
    _write(sales_lines(spark, sf_dir, broken, early), folder, gzip)
    return folder


def write_table_inbox(table: DataFrame, columns: dict[str, str], keyword: str) -> str:
    """An inbox with two exports of a small table, the older one of them wrong in every cell."""
    folder = scratch_path(table.sparkSession, "table-inbox")
    line = _csv([F.col(c).cast("string") for c in columns.values()])
    place = F.monotonically_increasing_id()
    now = table.select(F.lit(f"{keyword} 2001-06-01 2001-06-30").alias("name"), place.alias("place"), line.alias("line"))
    old = table.select(F.lit(f"{keyword} 2001-05-01 2001-05-31").alias("name"), place.alias("place"), F.regexp_replace(line, "[0-9]", "1").alias("line"))
    write_files(now.union(old), _header(columns), folder)
    return folder
