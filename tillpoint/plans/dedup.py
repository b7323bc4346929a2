"""Keep one row per (receipt_id, product, completed_at).

The winner is the row from the file with the latest end date (undated files
last), then file name, then the row's position in its file. Written as a
grouped ``min`` of one struct, the ordering first and the other columns behind
it, rather than a window: the aggregation combines map-side, so a hot key (one
receipt repeated across many files) collapses before the shuffle instead of
landing whole in one window partition. Null keys form their own group, as in
both engines.
"""
from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEDUP_KEY = ["receipt_id", "product", "completed_at"]


@dataclass(frozen=True)
class MonthParts:
    """How lines are dealt so that one shuffle serves both D1 and a table partitioned by month: whole months, large ones in `parts`
    parts by the hash of their key; `partitions` where the session's number of shuffle partitions would make them too large."""

    parts: int
    partitions: int | None

    #: Functions of the key: D1 within them is D1.
    COLUMNS: ClassVar[tuple[str, ...]] = ("year", "month", "month_part")

    @classmethod
    def for_lines(cls, spark, n: int) -> MonthParts:
        """For `n` lines: about 100 000 a part where they spread over 80 months, at most about 400 000 a partition."""
        most = n // 400_000
        return cls(1 + n // 8_000_000, most if most > int(spark.conf.get("spark.sql.shuffle.partitions")) else None)

    def deal(self, lines: DataFrame, *key: str) -> DataFrame:
        """`lines` with COLUMNS; `key` are columns that D1's key determines."""
        lines = lines.where(F.col("completed_at").isNotNull()).withColumns({
            "year": F.year("completed_at"), "month": F.month("completed_at"), "month_part": F.pmod(F.hash(*key), F.lit(self.parts))})
        return lines.repartition(*([self.partitions] if self.partitions else []), *self.COLUMNS)


@dataclass(frozen=True)
class ReceiptParts:
    """How lines that meet their receipts by a shuffle stay where they met: it serves D1 too, whose key determines the receipt, and the table.
    `partitions` where the session's settings would make them too large for a task's memory."""

    partitions: int | None

    #: Functions of the key, in the order the table is sorted by: D1 within them is D1.
    COLUMNS: ClassVar[tuple[str, ...]] = ("year", "month", "receipt_number")

    @classmethod
    def for_lines(cls, n: int) -> ReceiptParts:
        """For `n` lines: about 400 000 a partition, however many partitions the session asks for or gathers."""
        return cls(n // 400_000 if n > 8_000_000 else None)

    def gather(self, rows: DataFrame, key: str) -> DataFrame:
        """`rows` by the receipt's number `key`, as a join on it needs them; to be called on both sides of the join."""
        return rows.repartition(self.partitions, key) if self.partitions else rows

    def deal(self, lines: DataFrame, key: str) -> DataFrame:
        """`lines` with COLUMNS, where they are; `key` is the number they were joined by."""
        return lines.where(F.col("completed_at").isNotNull()).withColumns(
            {"year": F.year("completed_at"), "month": F.month("completed_at"), "receipt_number": F.col(key)})


def dedup_order() -> list[Column]:
    """The ordering, ahead of a line's other columns: smaller wins."""
    return [
        F.col("file_end").isNull().alias("o1"),
        (-F.unix_date(F.col("file_end"))).alias("o2"),
        F.coalesce(F.col("file_name"), F.lit("")).alias("o3"),
        F.col("row_seq").alias("o4"),
        F.col("file_name").isNull().alias("o5"),
    ]


def dedup_latest_file(df: DataFrame, key=None) -> DataFrame:
    """One row a key. Lines that `MonthParts` or `ReceiptParts` dealt are kept where they are, sorted by what they were dealt by."""
    key = list(key or DEDUP_KEY)
    within = next((list(by.COLUMNS) for by in (MonthParts, ReceiptParts) if by.COLUMNS[-1] in df.columns), [])
    ordered = {"file_end": F.date_from_unix_date(-F.col("_w.o2")), "file_name": F.when(~F.col("_w.o5"), F.col("_w.o3")), "row_seq": F.col("_w.o4")}
    rest = [c for c in df.columns if c not in (*key, *within, *ordered)]
    won = df.groupBy(*within, *key).agg(F.min(F.struct(*dedup_order(), *rest)).alias("_w"))
    return won.select(*((ordered[c] if c in ordered else F.col(f"_w.{c}") if c in rest else F.col(c)).alias(c) for c in df.columns))
