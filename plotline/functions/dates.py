"""Dates of the Republic calendar (year 1 = 1912) kept as text, and period helpers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plotline.functions.text import _c


def compact(col: Column | str) -> Column:
    """``101/01/09`` to ``1010109``."""
    return F.replace(_c(col), F.lit("/"), F.lit(""))


def _digits(col: Column | str) -> Column:
    return F.replace(compact(F.trim(_c(col))), F.lit("-"), F.lit(""))


def roc_year(col: Column | str, exact: bool = True) -> Column:
    """Year of the calendar.  ``exact=False`` takes the first three characters as they are."""
    c = _c(col)
    if not exact:
        return F.substring(c, 1, 3).try_cast("int")
    d = _digits(c)
    return F.substring(d, F.lit(1), F.length(d) - 4).try_cast("int")


def roc_year_computed(col: Column | str) -> Column:
    """Year as the computed search column: everything but the last four characters."""
    d = compact(col)
    return F.substring(d, F.lit(1), F.length(d) - 4).try_cast("int")


def tx_date(col: Column | str) -> Column:
    """DATE, or NULL when the text is not a calendar day."""
    d = _digits(col)
    n = F.length(d)
    text = F.concat(
        (roc_year(d) + 1911).cast("string"), F.lit("-"),
        F.substring(d, n - 3, F.lit(2)), F.lit("-"), F.substring(d, n - 1, F.lit(2)),
    )
    return F.when(d.rlike("^[0-9]{6,7}$"), text.try_cast("date"))


def sort_key(col: Column | str) -> Column:
    """Date text padded to seven digits, so that text order is date order."""
    return F.lpad(_digits(col), 7, "0")


def gregorian_text(col: Column | str) -> Column:
    """``1130101`` to ``2024/01/01``; NULL if shorter than seven characters."""
    c = F.trim(_c(col))
    y = F.substring(c, 1, 3).try_cast("int")
    return F.when(
        (F.length(c) >= 7) & y.isNotNull(),
        F.concat((y + 1911).cast("string"), F.lit("/"), F.substring(c, 4, 2), F.lit("/"), F.substring(c, 6, 2)),
    )


def _year_month(col: Column | str) -> tuple[Column, Column, Column]:
    d = _digits(col)
    long = F.length(d) >= 7
    y = F.when(long, F.substring(d, 1, 3)).otherwise(F.substring(d, 1, 2)).try_cast("int")
    m = F.when(long, F.substring(d, 4, 2)).otherwise(F.substring(d, 3, 2)).try_cast("int")
    bad = (F.length(d) < 5) | y.isNull() | m.isNull()
    return bad, y, m


def period_label(col: Column | str, period: str = "monthly") -> Column:
    """Label of the month (113/01), quarter (113Q1) or year (113); 未知 for bad dates."""
    bad, y, m = _year_month(col)
    if period == "yearly":
        label = y.cast("string")
    elif period == "quarterly":
        label = F.concat(y.cast("string"), F.lit("Q"), (F.floor((m - 1) / 3) + 1).cast("string"))
    else:
        label = F.concat(y.cast("string"), F.lit("/"), F.lpad(m.cast("string"), 2, "0"))
    return F.when(bad, "未知").otherwise(label)


def period_index(col: Column | str) -> Column:
    """Months since year 0, to sort labels and to look back; NULL for bad dates."""
    bad, y, m = _year_month(col)
    return F.when(~bad, y * 12 + m - 1)


def display(col: Column | str, era: str = "roc") -> Column:
    """``113/01/01`` (or ``2024/01/01`` with era='ce'); short text unchanged, blank to '-'."""
    c = F.trim(_c(col))
    n = F.length(c)
    y = F.substring(c, F.lit(1), n - 4).try_cast("int")
    year = (y + 1911 if era == "ce" else y).cast("string")
    rest = F.concat(F.lit("/"), F.substring(c, n - 3, F.lit(2)), F.lit("/"), F.substring(c, n - 1, F.lit(2)))
    return (
        F.when(c.isNull() | (c == ""), "-")
        .when(n >= 7, F.concat(F.coalesce(year, F.lit("")), rest))
        .otherwise(c)
    )


def display_build(col: Column | str, era: str = "roc") -> Column:
    """Completion month ``yyy/mm`` from at least five characters; blank to '-'."""
    c = F.trim(_c(col))
    y = F.substring(c, 1, 3).try_cast("int")
    year = (y + 1911 if era == "ce" else y).cast("string")
    return (
        F.when(c.isNull() | (c == ""), "-")
        .when(F.length(c) >= 5, F.concat(F.coalesce(year, F.lit("")), F.lit("/"), F.substring(c, 4, 2)))
        .otherwise(c)
    )


def periods(start: Column, end: Column, months: int = 1) -> Column:
    """Array of struct(from_date, to_date): month or quarter steps, the last one cut at ``end``.

    ``start`` and ``end`` are first days of a month.
    """
    step = F.make_ym_interval(F.lit(0), F.lit(months))
    return F.transform(
        F.sequence(start, end, step),
        lambda d: F.struct(
            d.alias("from_date"), F.least(F.add_months(d, months - 1), end).alias("to_date")
        ),
    )
