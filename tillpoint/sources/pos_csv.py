"""POS CSV sources (A1-A7): discovery, tolerant all-string reads, typing, refused lines.

Files are read as lines and cut into cells by one expression, however many there are, the same in batches and in streams;
columns are bound by the names in each file's header row, never by position. The file name and its end date come
from the ``_metadata`` column, so discovery, dedup ranking and "latest file
only" are column expressions rather than driver-side file loops. Every line that is not used keeps its file, text and reason.
"""
from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillpoint.functions import clean, fixed

FILE_DATES = r"(\d{4}-\d{2}-\d{2})\s+(\d{4}-\d{2}-\d{2})"


def _keyword_filter(col, keywords, exclude=None):
    name = F.lower(col)
    inc = F.lit(False)
    for k in keywords:
        inc = inc | name.contains(k.lower())
    if exclude:
        for k in exclude:
            inc = inc & ~name.contains(k.lower())
    return inc


#: A cell with the comma before it: quoted (a doubled quote stands for one), or without quotes.
CELL = r',("[^"]*(?:""[^"]*)*"|[^,"]*)'


def file_lines(reader, inbox: str) -> DataFrame:
    """A2 + A6: (line, file_name, file_mtime) of all *.csv and *.csv.gz files below `inbox`, from ``spark.read`` or ``spark.readStream``."""
    lines = (reader.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").option("ignoreCorruptFiles", True).text(inbox))
    text = F.when(F.startswith("value", F.lit("\ufeff")), F.substr("value", F.lit(2))).otherwise(F.col("value"))
    return lines.select(text.alias("line"), F.url_decode(F.col("_metadata.file_name")).alias("file_name"),
                        F.col("_metadata.file_modification_time").alias("file_mtime"))


def _raw() -> Column:
    """A line's cells as they stand."""
    return F.regexp_extract_all(F.concat(F.lit(","), "line"), F.lit(CELL), F.lit(1))


def _text(raw: Column) -> Column:
    """A cell's text: quotes taken off."""
    return F.when(raw.startswith('"'), F.replace(raw.substr(F.lit(2), F.length(raw) - 2), F.lit('""'), F.lit('"'))).otherwise(raw)


def _names(raw: Column) -> Column:
    return F.transform(raw, lambda c: F.trim(_text(c)))


def _is_header(headers: list[str]) -> Column:
    """Whether at least three of the wanted names (or all, if fewer) are cells; only lines with a cell that may be one are looked at cell by cell."""
    least = min(3, len(headers))
    names = [h.replace('"', '""') for h in headers]
    starts = "".join(sorted({re.escape(n[0]) for n in names}))
    may = F.rlike(F.concat(F.lit(","), "line"), F.lit(f',"?\\x20*(?=[{starts}])(?:{"|".join(map(re.escape, names))})\\x20*(?:[",]|$)'))
    known = F.array_intersect(_names(F.col("_raw")), F.array(*(F.lit(h) for h in headers)))
    return F.when(may, F.size(known) >= least).otherwise(F.lit(False))


def header_rows(lines: DataFrame, headers) -> DataFrame:
    """(_file, _at) of lines (line, file_name): one row a file with a header row, its first, with the places of the wanted names (from 1,
    null if missing) as h0, h1, ... and its width. No other line is cut."""
    headers = list(headers)
    lines = lines.where(F.trim("line") != "").withColumn("_no", F.monotonically_increasing_id()).withColumn("_raw", _raw())
    rows = lines.where(_is_header(headers)).select("file_name", "_no", F.size("_raw").alias("width"), _names(F.col("_raw")).alias("_names"))
    firsts = rows.groupBy(F.col("file_name").alias("_file")).agg(F.min_by(F.struct("_names", "width"), "_no").alias("_first"))
    places = (F.nullif(F.array_position("_names", F.lit(h)).cast("int"), F.lit(0)).alias(f"h{i}") for i, h in enumerate(headers))
    return firsts.select("_file", "_first.*").select("_file", F.struct(*places, "width").alias("_at"))


def name_lines(lines: DataFrame, headers, heads: DataFrame | None = None) -> DataFrame:
    """Lines (line, file_name, file_mtime) -> one column a header, by the names in each file's own header row, with line_no, line and ``refused``.

    A header row is one with at least three of the wanted names (or all, if fewer); the first of a file counts (`heads`: those of
    `header_rows`, where they are known already). Columns may stand in any order, unknown ones are left out, missing ones are null.
    Blank lines and header rows are no rows. A row is refused ('quotes', 'header' or 'width') if its quotes do not pair, its file has
    no header row, or it has more cells than the header. The header table has one row a file. ``line_no`` rises within a file.
    """
    headers = list(headers)
    heads = header_rows(lines, headers) if heads is None else heads
    rows = lines.where(F.trim("line") != "").withColumns({"_no": F.monotonically_increasing_id(), "_raw": _raw()})
    rows = rows.where(~_is_header(headers))
    # one row a file: broadcast, or all cells of all lines would be shuffled by their file
    rows = rows.join(F.broadcast(heads), F.col("file_name") == F.col("_file"), "left")
    # the cells and a comma between two of them are the whole line, or its quotes do not pair
    length = F.aggregate("_raw", F.size("_raw") - 1, lambda n, c: n + F.length(c))
    refused = (F.when(length != F.length("line"), "quotes").when(F.col("_file").isNull(), "header")
               .when(F.size("_raw") > F.col("_at.width"), "width"))
    # in steps, each cell once a step, and those with a lambda apart from the others: the generated code of twenty cells in one is too long for
    # the JVM to compile
    rows = rows.withColumns({f"_{i}": F.try_element_at("_raw", F.col(f"_at.h{i}")) for i in range(len(headers))})
    rows = rows.select(*(_text(F.col(f"_{i}")).alias(f"_{i}") for i in range(len(headers))), "file_name", "file_mtime", F.col("_no").alias("line_no"), "line", refused.alias("refused"))
    return rows.select(*(F.nullif(F.col(f"_{i}"), F.lit("")).alias(h) for i, h in enumerate(headers)), "file_name", "file_mtime", "line_no", "line", "refused")


def read_csv_files(spark: SparkSession, inbox: str, headers, keywords=None, exclude=None) -> DataFrame:
    """A2 + A6 + A7: recursive discovery of *.csv / *.csv.gz, keyword filter on the file name, columns bound by
    header name. Unreadable files are skipped here and listed by `skipped_files`."""
    lines = file_lines(spark.read, inbox)
    if keywords:
        lines = lines.where(_keyword_filter(F.col("file_name"), keywords, exclude))
    return name_lines(lines, headers)


def skipped_files(spark: SparkSession, inbox: str, read: DataFrame) -> DataFrame:
    """Files of the inbox (file_name, length) of which no row was read: unreadable, empty or without a known header."""
    listed = (spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv*").load(inbox)
              .select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("file_name"), "length"))
    return listed.join(read.where("refused is null or refused != 'header'").select("file_name").distinct(), "file_name", "left_anti")


def file_end_date(file_name_col) -> F.Column:
    """A3: end date parsed from '... YYYY-MM-DD YYYY-MM-DD.csv' (null when absent)."""
    s = F.regexp_extract(file_name_col, FILE_DATES, 2)
    return F.when(s != "", F.to_date(s))


def read_sales_csv(spark: SparkSession, inbox: str, keywords=None, exclude=None) -> DataFrame:
    """A1: sales lines with internal names and typed values, ready for curation (plans.curate)."""
    df = read_csv_files(spark, inbox, fixed.COLUMN_MAP.keys(), keywords or fixed.SALES_KEYWORDS, exclude)
    return typed_sales(df)


def typed_sales(named: DataFrame) -> DataFrame:
    """Named text columns -> internal names and types; row_seq is the line's place in its file. A row without a readable
    time is refused, too ('date')."""
    out = named.select(*[F.col(f"`{k}`").alias(v) for k, v in fixed.COLUMN_MAP.items()], "file_name", "line_no", "line", "refused")
    # not deterministic, or filters on what is parsed would be moved before it and parse it once more
    place = F.when(F.monotonically_increasing_id() >= 0, F.col("line_no"))
    # amounts by one lambda, which keeps this step's code apart from that of the cells
    out = out.withColumn("_money", F.transform(F.array(*fixed.MONEY_COLS), clean.parse_currency)).select(
        "receipt_id", "order_type", "sold_by", clean.parse_timestamp(F.col("completed_at")).alias("completed_at"),
        "customer_id", "customer_name", "store", "product",
        "category", "brand", clean.coerce_quantity(F.col("quantity")).alias("quantity"),
        *(F.get("_money", F.lit(i)).alias(c) for i, c in enumerate(fixed.MONEY_COLS)), "deals_used", "inline_discounts", "file_name",
        file_end_date(F.col("file_name")).alias("file_end"), place.alias("row_seq"), "line", "refused")
    return out.withColumn("refused", F.coalesce("refused", F.when(F.col("completed_at").isNull(), "date")))


def accepted(parsed: DataFrame) -> DataFrame:
    """The rows of `typed_sales` that are used, ready for curation."""
    return parsed.where("refused is null").drop("refused", "line")


def refused_lines(parsed: DataFrame) -> DataFrame:
    """(file_name, line_no, reason, line) of the rows that are not used."""
    return parsed.where("refused is not null").select("file_name", F.col("row_seq").alias("line_no"), F.col("refused").alias("reason"), "line")


REASONS = ["quotes", "header", "width", "date"]


def load_quality(parsed: DataFrame) -> DataFrame:
    """Rows read, kept and refused of each file, by reason; read = kept + refused."""
    return parsed.groupBy("file_name").agg(
        F.count(F.lit(1)).alias("rows_read"), F.count(F.when(F.col("refused").isNull(), 1)).alias("rows_kept"), F.count("refused").alias("rows_refused"),
        *(F.count(F.when(F.col("refused") == x, 1)).alias(f"refused_{x}") for x in REASONS))


STAFF_HEADERS = ["Name", "Store", "Average Cart Value (pre-tax)", "Total Units Sold", "Average Units Per Cart",
                 "Number of Carts", "Sales (pre-tax)", "% of Sales Discounted", "Customers Enrolled In Loyalty",
                 "Upsell Total Price", "Upsell Total Profit"]


def _latest_only(df: DataFrame) -> DataFrame:
    """Keep rows of the newest file (by end date in the name, then modification time)."""
    df = df.where("refused is null").withColumn("_end", file_end_date(F.col("file_name")))
    best = df.agg(F.max_by("file_name", F.struct(F.col("_end"), F.col("file_mtime")))).scalar()
    return df.where(F.col("file_name") == best).drop("_end")


def read_staff_csv(spark: SparkSession, inbox: str) -> DataFrame:
    """A4: staff table from the latest matching file; $ , % stripped."""
    df = _latest_only(read_csv_files(spark, inbox, STAFF_HEADERS, fixed.STAFF_KEYWORDS))
    num = lambda c: clean.parse_currency(F.regexp_replace(F.col(f"`{c}`"), "%", ""))
    return df.select(
        F.col("Name").alias("budtender"), clean.clean_store(F.col("Store")).alias("store"),
        num("Average Cart Value (pre-tax)").alias("avg_cart_value"), num("Total Units Sold").alias("units_sold"),
        num("Average Units Per Cart").alias("avg_units_per_cart"), num("Number of Carts").alias("num_transactions"),
        num("Sales (pre-tax)").alias("total_sales"), num("% of Sales Discounted").alias("pct_sales_discounted"),
        num("Customers Enrolled In Loyalty").alias("loyalty_enrollments"))


def read_customer_csv(spark: SparkSession, inbox: str) -> DataFrame:
    """A5: customer attributes from the latest matching file."""
    df = _latest_only(read_csv_files(spark, inbox, ["ID", "Name", "Groups", "Loyal", "Loyalty Points"],
                                     fixed.CUSTOMER_KEYWORDS))
    return df.select(F.col("ID").alias("customer_id"), F.col("Name").alias("customer_name"),
                     F.col("Groups").alias("groups"), F.col("Loyal").alias("is_loyal"),
                     F.col("`Loyalty Points`").alias("loyalty_points"))
