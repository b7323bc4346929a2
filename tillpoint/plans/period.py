"""Periods as date spans, their predicates and predecessors, and the month calendar.

Every period is a span of days with a grain: a whole number of months ("month", "quarter", "year", "range"),
a number of days ("custom"), or everything ("all"). The span alone gives the predicate and the preceding
period; the grain only chooses how a label reads.
"""
from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First and last day shown in a label, by grain.
LABELS = {
    "month": lambda a, b: f"{a:%B %Y}", "quarter": lambda a, b: f"Q{(a.month + 2) // 3} {a.year}", "year": lambda a, b: f"{a:%Y}",
    "range": lambda a, b: f"{a:%b %Y} to {b:%b %Y}", "custom": lambda a, b: f"{a or '?'} to {b or '?'}", "all": lambda a, b: "All Time",
}


def month_number(day: dt.date) -> int:
    return day.year * 12 + day.month - 1


def month_span(first: int, months: int) -> tuple[dt.date, dt.date]:
    """First and last day of `months` months from month number `first`."""
    after = first + months
    return dt.date(first // 12, first % 12 + 1, 1), dt.date(after // 12, after % 12 + 1, 1) - dt.timedelta(days=1)


@dataclass(frozen=True)
class Period:
    """Days from `start` to `end`, both included; None leaves a side open."""

    grain: str = "all"
    start: dt.date | None = None
    end: dt.date | None = None
    store: str | None = None

    @classmethod
    def of_months(cls, grain: str, first: int, months: int, store: str | None = None) -> Period:
        return cls(grain, *month_span(first, months), store)

    @classmethod
    def all(cls, store: str | None = None) -> Period:
        return cls(store=store)

    @classmethod
    def of_month(cls, year: int, month: int, store: str | None = None) -> Period:
        return cls.of_months("month", year * 12 + month - 1, 1, store)

    @classmethod
    def of_quarter(cls, year: int, quarter: int, store: str | None = None) -> Period:
        return cls.of_months("quarter", year * 12 + quarter * 3 - 3, 3, store)

    @classmethod
    def of_year(cls, year: int, store: str | None = None) -> Period:
        return cls.of_months("year", year * 12, 12, store)

    @classmethod
    def of_range(cls, year: int, month: int, end_year: int, end_month: int, store: str | None = None) -> Period:
        first = year * 12 + month - 1
        return cls.of_months("range", first, end_year * 12 + end_month - first, store)

    @classmethod
    def custom(cls, start: dt.date | None = None, end: dt.date | None = None, store: str | None = None) -> Period:
        return cls("custom", start, end, store)

    @property
    def in_months(self) -> bool:
        return self.grain not in ("custom", "all")

    def date_predicate(self) -> Column:
        """Bounds on the partition columns year and month, and on the day where the span cuts a month."""
        out, ym = F.lit(True), F.col("year") * 12 + F.col("month") - 1
        for day, year_in, in_span in ((self.start, F.col("year").__ge__, lambda c, x: c >= x), (self.end, F.col("year").__le__, lambda c, x: c <= x)):
            if day is not None:
                out = out & year_in(day.year) & in_span(ym, month_number(day))
                if not self.in_months:
                    out = out & in_span(F.col("sale_date"), F.lit(day))
        return out

    def predicate(self) -> Column:
        """C1 and C2."""
        return self.date_predicate() & (F.col("store_clean") == self.store) if self.store else self.date_predicate()

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())

    @property
    def label(self) -> str:
        return LABELS[self.grain](self.start, self.end)

    def previous(self) -> Period:
        """The span of equal length that ends where this one begins; everything for an open span."""
        if self.start is None or self.end is None:
            return Period(store=self.store)
        if self.in_months:
            first = month_number(self.start)
            months = month_number(self.end) - first + 1
            return Period.of_months(self.grain, first - months, months, self.store)
        days = self.end - self.start + dt.timedelta(days=1)
        return Period(self.grain, self.start - days, self.end - days, self.store)


def comparison_period(kind: str | None, **fields) -> Period | None:
    """A second period, asked for independently of the first; None without a kind, an error for an unknown one."""
    if kind is None:
        return None
    makers = {"all": Period.all, "month": Period.of_month, "quarter": Period.of_quarter, "year": Period.of_year,
              "range": Period.of_range, "custom": Period.custom}
    if kind not in makers:
        raise ValueError(f"unknown kind of period: {kind}")
    return makers[kind](**fields)


def store_filter(df: DataFrame, store: str | None) -> DataFrame:
    """C2."""
    return df if not store else df.where(F.col("store_clean") == F.lit(store))


def brand_filter(df: DataFrame, brand: str) -> DataFrame:
    """C4: case-insensitive brand match."""
    return df.where(F.upper(F.col("brand_clean")) == F.lit(brand.upper()))


#: Months of each grain of the calendar.
GRAINS = {"month": 1, "quarter": 3, "year": 12}


def _day(month_no: Column) -> Column:
    """First day of a month number (year * 12 + month - 1)."""
    return F.make_date(F.floor(month_no / 12).cast("int"), (F.pmod(month_no, F.lit(12)) + 1).cast("int"), F.lit(1))


def period_calendar(sales: DataFrame, grains: tuple[str, ...] = tuple(GRAINS)) -> DataFrame:
    """C5 for every period at once: (grain, period, start, end, prev_start, prev_end) of each month, quarter and year
    that has a sale, with the span of equal length before it."""
    months = sales.select((F.col("year") * 12 + F.col("month") - 1).alias("m")).distinct()
    sizes = F.array(*(F.struct(F.lit(g).alias("grain"), F.lit(GRAINS[g]).alias("n")) for g in grains))
    spans = months.select("m", F.inline(sizes)).select("grain", "n", (F.col("m") - F.pmod("m", F.col("n"))).alias("first")).distinct()
    year, first = F.floor(F.col("first") / 12).cast("string"), F.pmod("first", F.lit(12))
    name = (F.when(F.col("grain") == "year", year).when(F.col("grain") == "quarter", F.concat(year, F.lit("-Q"), (F.floor(first / 3) + 1).cast("string")))
            .otherwise(F.concat(year, F.lit("-"), F.lpad((first + 1).cast("string"), 2, "0"))))
    start, after, before = _day(F.col("first")), _day(F.col("first") + F.col("n")), _day(F.col("first") - F.col("n"))
    return spans.select("grain", name.alias("period"), start.alias("start"), F.date_sub(after, 1).alias("end"),
                        before.alias("prev_start"), F.date_sub(start, 1).alias("prev_end"))


def spans_of_days(days: DataFrame, length: int, anchor: dt.date, grain: str) -> DataFrame:
    """The same rows for spans of `length` days counted from `anchor`, each that holds a `sale_date` of `days`."""
    start = F.date_add(F.lit(anchor), (F.floor(F.datediff("sale_date", F.lit(anchor)) / length) * length).cast("int"))
    return days.select(start.alias("start")).distinct().select(
        F.lit(grain).alias("grain"), F.col("start").cast("string").alias("period"), "start", F.date_add("start", length - 1).alias("end"),
        F.date_sub("start", length).alias("prev_start"), F.date_sub("start", 1).alias("prev_end"))


def in_periods(facts: DataFrame, calendar: DataFrame, day: str = "sale_date") -> DataFrame:
    """Interval join: each row of `facts` once for every period of `calendar` that it falls in (side 'current') or whose
    predecessor it falls in ('previous'), as (grain, period, side, *facts).

    A period is cut into the months it touches, so the join is an equality on the month (a shuffle or a size-checked broadcast,
    never a nested loop) with the bounds as the rest of the condition. A month-grain table joins by its months' first days.
    """
    sides = F.array(F.struct(F.lit("current").alias("side"), F.col("start").alias("a"), F.col("end").alias("b")),
                    F.struct(F.lit("previous").alias("side"), F.col("prev_start").alias("a"), F.col("prev_end").alias("b")))
    spans = calendar.select("grain", "period", F.inline(sides))
    cut = spans.select("grain", "period", "side", "a", "b", F.explode(F.sequence(F.trunc("a", "MM"), F.trunc("b", "MM"), F.expr("interval 1 month"))).alias("_month"))
    inside = (F.trunc(facts[day], "MM") == cut["_month"]) & facts[day].between(cut["a"], cut["b"])
    return facts.join(cut, inside).select("grain", "period", "side", *(facts[c] for c in facts.columns))
