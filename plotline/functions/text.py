"""Character-level column functions: widths, numerals, names, similarity."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from plotline import constants as K

_FULL = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
_HALF = "".join(map(chr, range(0x21, 0x7F))) + " "
_DIGITS = "0123456789"
_FULL_DIGITS = "０１２３４５６７８９"
_ALNUM = _DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FULL_ALNUM = "".join(chr(ord(c) + 0xFEE0) for c in _ALNUM)
_SPACES = " \t\r\n"


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    Keeps an expression that needs an intermediate result several times linear in size, where
    plain nesting would repeat the whole text of it (and outgrow a generated method).
    """
    return F.transform(F.array(value), use)[0]


def half_width(col: Column | str, kind: str = "all") -> Column:
    """Full-width forms to half-width: ``all`` ASCII, ``digits`` or ``alnum``."""
    full, half = {
        "all": (_FULL, _HALF),
        "digits": (_FULL_DIGITS, _DIGITS),
        "alnum": (_FULL_ALNUM, _ALNUM),
    }[kind]
    return F.translate(_c(col), full, half)


def full_width_digits(col: Column | str) -> Column:
    return F.translate(_c(col), _DIGITS, _FULL_DIGITS)


def strip(col: Column | str) -> Column:
    return F.btrim(_c(col), F.lit(_SPACES))


def blank(col: Column | str) -> Column:
    """True for NULL and for the empty string."""
    return F.coalesce(_c(col), F.lit("")) == ""


def chars(col: Column | str) -> Column:
    """Characters of a string, in order."""
    return F.filter(F.split(_c(col), ""), lambda x: x != "")


def distinct_chars(col: Column | str) -> Column:
    return F.array_distinct(chars(col))


# --- numerals -------------------------------------------------------------
def _additive_value(col: Column) -> Column:
    """Value of a numeral written with 十/百/千; NULL if a character is unknown or the sum is 0."""
    names = "".join(K.NUMERAL_DIGITS) + "".join(K.NUMERAL_UNITS)
    # Each character becomes one code: digits stay digits, 十/百/千 become t/h/k.
    codes = "".join(str(v) for v in K.NUMERAL_DIGITS.values()) + "".join(
        {10: "t", 100: "h", 1000: "k"}[v] for v in K.NUMERAL_UNITS.values()
    )
    coded = F.translate(col, names, codes)
    weight = lambda ch: F.when(ch == "t", 10).when(ch == "h", 100).otherwise(1000)
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("digit"))
    folded = F.aggregate(
        chars(coded),
        start,
        lambda acc, ch: F.when(
            ch.rlike("[0-9]"),
            F.struct(acc["total"].alias("total"), ch.cast("long").alias("digit")),
        ).otherwise(
            F.struct(
                (acc["total"] + F.greatest(acc["digit"], F.lit(1)) * weight(ch)).alias("total"),
                F.lit(0).cast("long").alias("digit"),
            )
        ),
        lambda acc: acc["total"] + acc["digit"],
    )
    known = col.rlike("^[" + names + "]+$")
    return F.when(known & (folded > 0), folded).when(
        strip(col).isin("零", "○", "〇"), F.lit(0).cast("long")
    )


def numeral_value(col: Column | str) -> Column:
    """Integer value of Arabic, positional (一二三) or standard (一百二十三) numerals."""
    c = _c(col)
    positional = F.translate(c, K.PLAIN_DIGITS, _DIGITS).try_cast("long")
    return (
        F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), strip(c).try_cast("long"))
        .when(c.rlike("^[" + K.PLAIN_DIGITS + "]+$"), positional)
        .otherwise(_additive_value(c))
    )


def numerals_before(c: Column, suffixes: str) -> Column:
    """Replace each numeral that stands directly before one of ``suffixes`` by its digits.

    The text is cut at the borders of such numerals, so a piece made only of
    numeral characters is exactly one numeral to convert.
    """
    n, s = f"[{K.NUMERAL_CHARS}]", f"[{suffixes}]"

    def convert(col: Column) -> Column:
        pieces = F.split(col, f"(?<!{n})(?={n}+{s})|(?<={n})(?={s})")
        converted = F.transform(
            pieces,
            lambda p: F.when(
                p.rlike(f"^{n}+$"), F.coalesce(numeral_value(p).cast("string"), p)
            ).otherwise(p),
        )
        return F.when(col.rlike(n + s), F.array_join(converted, "")).otherwise(col)

    return bound(c, convert)


def _digit_name(d: Column) -> Column:
    return F.substring(F.lit(K.PLAIN_DIGITS), d.cast("int") + 1, F.lit(1))


def numeral_names(col: Column | str) -> Column:
    """All written forms of an integer 1..9999 (positional, standard, 一十x), sorted."""
    n = _c(col).cast("long")
    th, hu = F.floor(n / 1000), F.floor(n / 100) % 10
    te, un = F.floor(n / 10) % 10, n % 10
    positional = F.translate(n.cast("string"), _DIGITS, K.PLAIN_DIGITS)
    standard = F.concat(
        F.when(th > 0, F.concat(_digit_name(th), F.lit("千"))).otherwise(""),
        F.when(hu > 0, F.concat(_digit_name(hu), F.lit("百")))
        .when((th > 0) & (n % 100 > 0), "零").otherwise(""),
        F.when((te == 1) & (n < 100), "十")
        .when(te > 0, F.concat(_digit_name(te), F.lit("十")))
        .when((n >= 100) & (un > 0), "零").otherwise(""),
        F.when(un > 0, _digit_name(un)).otherwise(""),
    )
    teen = F.when(n.between(10, 19), F.concat(F.lit("一十"), F.when(un > 0, _digit_name(un)).otherwise("")))
    forms = F.array_sort(F.array_distinct(F.array_compact(F.array(positional, standard, teen))))
    return F.when(n.between(1, 9999), forms).otherwise(F.array().cast("array<string>"))


def number_variants(col: Column | str) -> Column:
    """Half-width, full-width and written forms of a number string (plus 廿x), sorted."""
    c = half_width(col)
    n = F.when(c.rlike(r"^\s*[+-]?[0-9]+\s*$"), strip(c).try_cast("long"))
    twenty = F.when(
        n.between(20, 29), F.concat(F.lit("廿"), F.when(n % 10 > 0, _digit_name(n % 10)).otherwise(""))
    )
    base = F.array_compact(F.array(c, full_width_digits(c), twenty))
    both = F.concat(base, F.coalesce(numeral_names(n), F.array().cast("array<string>")))
    return F.array_sort(F.array_distinct(F.filter(both, lambda x: x != "")))


# --- names ----------------------------------------------------------------
def community_name(col: Column | str, spaces: str = "collapse") -> Column:
    """Comparison form of a building-project name.

    ``collapse``: all ASCII to half width, runs of spaces to one.
    ``remove``: letters and digits to half width, all spaces dropped.
    """
    c = strip(F.coalesce(_c(col), F.lit("")))
    if spaces == "remove":
        return F.regexp_replace(F.upper(half_width(c, "alnum")), r"[\s　]+", "")
    return strip(F.regexp_replace(F.upper(half_width(c)), r"\s+", " "))


# --- similarity -----------------------------------------------------------
def edit_distance(a: Column, b: Column, bound: int | None = None) -> Column:
    """Levenshtein distance; beyond ``bound`` the answer is ``bound + 1``."""
    if bound is None:
        return F.levenshtein(a, b)
    d = F.levenshtein(a, b, bound)
    return F.when(d < 0, bound + 1).otherwise(d)


def is_subsequence(short: Column, long: Column) -> Column:
    """True if the characters of ``short`` appear in ``long`` in order."""
    matched = F.aggregate(
        chars(long),
        F.lit(0),
        lambda i, ch: F.when(F.substring(short, i + 1, F.lit(1)) == ch, i + 1).otherwise(i),
    )
    return matched == F.length(short)


def shared_char_ratio(a: Column, b: Column) -> Column:
    """Shared distinct characters over the larger distinct set; 0 for empty input."""
    sa, sb = distinct_chars(a), distinct_chars(b)
    ratio = F.size(F.array_intersect(sa, sb)) / F.greatest(F.size(sa), F.size(sb))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), ratio).otherwise(0.0)


def _occurrences(text: Column, ch: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, ch, F.lit("")))


def overlap_ratio(keyword: Column, name: Column) -> Column:
    """Characters shared as multisets, over the keyword's length."""
    shared = F.aggregate(
        distinct_chars(keyword),
        F.lit(0),
        lambda acc, ch: acc + F.least(_occurrences(keyword, ch), _occurrences(name, ch)),
    )
    return shared / F.greatest(F.length(keyword), F.lit(1))


def hit_count(query: Column, name: Column) -> Column:
    """How many characters of ``query`` (with repeats) occur in ``name``."""
    return F.size(F.filter(chars(query), lambda ch: F.contains(name, ch)))
