"""Column-expression helpers (B16-B20): all JVM-side, codegen-friendly.

Money in the fact table is a double holding a value with at most two
decimals. ``msum`` adds it up exactly as integer cents (a long sum, no
BigDecimal), so totals are exact at any scale and identical across engines.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillpoint.functions import fixed


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def cents(x) -> Column:
    """Money double -> exact integer cents (Math.rint, not BigDecimal)."""
    return F.rint(c(x) * 100).cast("long")


def msum(x) -> Column:
    """Exact money sum; 0 for an empty group (pandas semantics)."""
    return F.coalesce(F.sum(cents(x)), F.lit(0)).cast("double") / 100.0


def msum_if(cond: Column, x) -> Column:
    return F.coalesce(F.sum(F.when(cond, cents(x))), F.lit(0)).cast("double") / 100.0


def isum(x) -> Column:
    return F.coalesce(F.sum(c(x)), F.lit(0)).cast("long")


def isum_if(cond: Column, x) -> Column:
    return F.coalesce(F.sum(F.when(cond, c(x))), F.lit(0)).cast("long")


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, 1).otherwise(0)), F.lit(0)).cast("long")


def r(x, n: int = 1) -> Column:
    """Display rounding to ``n`` decimals as floor(x*10^n + 0.5) / 10^n.

    Plain IEEE arithmetic, so any engine given the same double returns the
    same double (library ``round`` implementations differ at .5 ties).
    """
    k = float(10 ** n)
    return (F.floor(c(x).cast("double") * k + 0.5).cast("double") / k)


def safe_div(a, b, default=0.0) -> Column:
    """A / b, ``default`` when b is 0 or null (ANSI-safe)."""
    a, b = c(a).cast("double"), c(b).cast("double")
    res = F.when((b == 0) | b.isNull(), F.lit(None).cast("double")).otherwise(a / b)
    return res if default is None else F.coalesce(res, F.lit(default).cast("double"))


def margin_pct(revenue, cost, default=0.0) -> Column:
    """B16 calc_margin: (revenue - cost) / revenue * 100."""
    return safe_div(c(revenue) - c(cost), revenue, None) * 100 if default is None else \
        safe_div(c(revenue) - c(cost), revenue, 0.0) * 100


def pct_of(part, total, default=0.0) -> Column:
    return safe_div(part, total, default) * 100


def discount_rate(discounts, revenue) -> Column:
    """Discounts / (revenue + discounts) * 100, 1 dp, 0 when undefined."""
    return r(safe_div(discounts, c(revenue) + c(discounts), 0.0) * 100, 1)


def pct_change(cur, prev) -> Column:
    """(cur - prev) / |prev| * 100; null when prev is 0 or null."""
    cur, prev = c(cur).cast("double"), c(prev).cast("double")
    return F.when((prev == 0) | prev.isNull(), F.lit(None).cast("double")).otherwise((cur - prev) / F.abs(prev) * 100)


def fill_numeric(df, value=0):
    """Null -> value on numeric columns only."""
    from pyspark.sql.types import NumericType

    cols = [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]
    return df.fillna(value, subset=cols) if cols else df


def month_label(year, month) -> Column:
    """B20: 'January 2025' style label."""
    return F.date_format(F.make_date(c(year), c(month), F.lit(1)), "MMMM yyyy")


def month_key(year, month) -> Column:
    """B20: 'YYYY-MM'."""
    return F.format_string("%d-%02d", c(year), c(month))


def day_name(weekday_mon0) -> Column:
    """Weekday (Monday=0) -> day name."""
    return F.element_at(F.array(*[F.lit(d) for d in fixed.DAY_NAMES]), c(weekday_mon0) + 1)


def hour_label(hour) -> Column:
    """12-hour clock label: 12 AM, 1 AM ... 12 PM, 1 PM ..."""
    h = c(hour)
    h12 = F.when(h % 12 == 0, 12).otherwise(h % 12)
    return F.concat(h12.cast("string"), F.when(h < 12, F.lit(" AM")).otherwise(F.lit(" PM")))
