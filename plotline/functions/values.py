"""Reading numbers out of text, ranges, JSON fields, enrichment maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from plotline import schema
from plotline.functions.text import _c, blank

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?$"


def to_double(col: Column | str) -> Column:
    """Text to DOUBLE; thousands commas allowed; anything else, NaN and infinities are NULL."""
    c = F.trim(F.replace(_c(col), F.lit(","), F.lit("")))
    d = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.when(F.abs(d) < float("inf"), d)


def to_long(col: Column | str) -> Column:
    """Text to BIGINT; commas and spaces allowed; fractions are cut off towards zero."""
    c = F.replace(F.replace(_c(col), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    whole = F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))
    d = F.when(c.rlike(_NUMBER), c.try_cast("double"))
    return F.coalesce(whole, F.when(F.abs(d) < 9.2e18, d.cast("long")))


def to_int(col: Column | str) -> Column:
    return to_long(col).try_cast("int")


def to_price(col: Column | str) -> Column:
    """``39,380,000`` to BIGINT; NULL unless it is a whole number."""
    c = F.replace(F.replace(_c(col), F.lit(","), F.lit("")), F.lit(" "), F.lit(""))
    return F.when(c.rlike(r"^[+-]?[0-9]+$"), c.try_cast("long"))


def parse_range(col: Column | str) -> Column:
    """``a-b``, ``-b``, ``a-`` or ``v`` to struct(lo, hi); both NULL if it is not a range."""
    c = F.trim(_c(col))
    cut = F.instr(c, "-")
    left = F.trim(F.substring(c, F.lit(1), cut - 1))
    right = F.trim(F.substring(c, cut + 1, F.length(c)))
    lo, hi, one = to_double(left), to_double(right), to_double(c)
    ok = (blank(left) | lo.isNotNull()) & (blank(right) | hi.isNotNull())
    return F.struct(
        F.when(cut > 0, F.when(ok, lo)).otherwise(one).alias("lo"),
        F.when(cut > 0, F.when(ok, hi)).otherwise(one).alias("hi"),
    )


def first_filled(*cols: Column) -> Column:
    """The first value that is neither NULL nor empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def scrub(col: Column | str) -> Column:
    """NaN and infinities to 0."""
    c = _c(col)
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), 0.0).otherwise(c)


def is_empty(col: Column | str, rule: str) -> Column:
    """Is a field empty, by the rule of its kind (number, text, null)?"""
    c = _c(col)
    if rule == "text":
        return blank(c)
    if rule == "number":
        return c.isNull() | (c == 0)
    return c.isNull()


def changed_fields(old: str, new: str, fields: dict[str, str] | None = None) -> Column:
    """Map of fields that are empty in struct ``old`` and have a value in struct ``new``."""
    fields = fields or schema.FILLABLE
    names = F.array(*[F.lit(n) for n in fields])
    values = F.array(
        *[
            F.when(
                is_empty(F.col(f"{old}.{n}"), rule),
                F.nullif(F.col(f"{new}.{n}").cast("string"), F.lit("")),
            )
            for n, rule in fields.items()
        ]
    )
    return F.map_filter(F.map_from_arrays(names, values), lambda k, v: v.isNotNull())
