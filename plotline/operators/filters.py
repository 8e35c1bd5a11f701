"""Predicates over transactions, and the filter settings that build them."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plotline import constants as K
from plotline.functions import dates as D, money as M
from plotline.functions.text import _c, blank


def _range(text: str) -> tuple[float | None, float | None]:
    """A range argument as two bounds; the Column form is ``values.parse_range``."""
    low, dash, high = text.strip().partition("-")
    try:
        if not dash:
            return float(low), float(low)
        return (float(low) if low.strip() else None), (float(high) if high.strip() else None)
    except ValueError:
        return None, None


@dataclass(frozen=True)
class Filters:
    """Optional bounds; areas in ping, unit price in 萬/ping, price in 萬, years of the calendar."""

    building_types: tuple[str, ...] = ()
    rooms: tuple[int, ...] = ()
    public_ratio: tuple[float | None, float | None] = (None, None)
    year: tuple[float | None, float | None] = (None, None)
    ping: tuple[float | None, float | None] = (None, None)
    unit_price: tuple[float | None, float | None] = (None, None)
    price: tuple[float | None, float | None] = (None, None)
    exclude_special: bool = False
    exact_year: bool = field(default=True)

    @classmethod
    def from_args(cls, args: Mapping[str, str]) -> Filters:
        """From text arguments such as ``{'ping': '20-40', 'rooms': '2,3'}``."""
        words = lambda k: [w.strip() for w in str(args.get(k, "")).split(",") if w.strip()]
        bounds = {k: _range(str(args.get(k, ""))) if str(args.get(k, "")).strip() else (None, None)
                  for k in ("public_ratio", "year", "ping", "unit_price", "price")}
        # A year of the common era is meant when it is beyond any year of this calendar.
        bounds["year"] = tuple(v - 1911 if v is not None and v > 1911 else v for v in bounds["year"])
        return cls(
            building_types=tuple(words("building_type")),
            rooms=tuple(int(w) for w in words("rooms") if w.isdigit()),
            exclude_special=str(args.get("exclude_special", "")).lower() in ("1", "true", "yes"),
            **bounds,
        )


def all_of(preds: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def _between(col: Column, lo, hi) -> list[Column]:
    return ([col >= lo] if lo is not None else []) + ([col <= hi] if hi is not None else [])


def _scaled(bounds, factor: float):
    return tuple(None if b is None else b * factor for b in bounds)


def type_is_any(types: Iterable[str]) -> Column:
    """Building type contains any of the given words."""
    return reduce(lambda a, b: a | b, [F.col("building_type").contains(t) for t in types])


def raw_filters(f: Filters) -> Column:
    """Bounds on the stored columns (areas and prices are converted, not rounded)."""
    preds: list[Column] = []
    if f.building_types:
        preds.append(type_is_any(f.building_types))
    if f.rooms:
        preds.append(F.col("rooms").isin(*f.rooms))
    ratio = M.public_ratio_raw("building_area", "main_area", "attached_area", "balcony_area")
    preds += _between(ratio, *f.public_ratio)
    year = D.roc_year("transaction_date", f.exact_year)
    preds += _between(year, *[None if y is None else int(y) for y in f.year])
    preds += _between(F.col("building_area"), *_scaled(f.ping, K.PING_SQM))
    per_sqm = tuple(None if b is None else b * 10000 / K.PING_SQM for b in f.unit_price)
    preds += _between(F.col("unit_price"), *per_sqm)
    preds += _between(F.col("total_price"), *_scaled(f.price, 10000.0))
    if f.exclude_special:
        preds.append(~is_special("note"))
    return all_of(preds)


def computed_filters(f: Filters) -> Column:
    """Bounds on the computed columns of ``present.with_computed`` (rounded values)."""
    preds: list[Column] = []
    if f.building_types:
        preds.append(type_is_any(f.building_types))
    if f.rooms:
        preds.append(F.col("rooms").isin(*f.rooms))
    preds += _between(F.col("public_ratio"), *f.public_ratio)
    preds += _between(F.col("roc_year"), *f.year)
    preds += _between(F.col("ping"), *f.ping)
    preds += _between(F.col("unit_price_per_ping"), *f.unit_price)
    preds += _between(F.col("total_price"), *[None if b is None else int(b * 10000) for b in f.price])
    if f.exclude_special:
        preds.append(~is_special("note"))
    # A bound never accepts a NULL, and neither does a missing answer.
    return F.coalesce(all_of(preds), F.lit(False))


def is_special(note: Column | str) -> Column:
    """Does the note name a special transaction (relatives, auction, ...)?"""
    return F.coalesce(_c(note).rlike("|".join(K.SPECIAL_NOTE_WORDS)), F.lit(False))


def in_territory(lat: Column | str, lng: Column | str) -> Column:
    a, b = _c(lat), _c(lng)
    return (a > K.LAT_MIN) & (a < K.LAT_MAX) & (b > K.LNG_MIN) & (b < K.LNG_MAX)


def geocodable(address: Column | str) -> Column:
    """Has a road and a house number and is not a lot number."""
    a = F.coalesce(_c(address), F.lit(""))
    return a.rlike("路|街|大道") & a.contains("號") & ~a.contains("地號")


def is_lot(address: Column | str) -> Column:
    return F.coalesce(_c(address).rlike(r"^\S*段\S*地號|段[0-9]+地號"), F.lit(False))


def reject_reason(address: Column | str) -> Column:
    """Why an import row is refused: no_address, no_number, or NULL if it is fine."""
    a = _c(address)
    return F.when(blank(a), "no_address").when(~a.contains("號"), "no_number")


def in_box(south: float, north: float, west: float, east: float) -> Column:
    return F.col("lat").between(south, north) & F.col("lng").between(west, east)


def mentions(keyword: str, literal: bool = True) -> Column:
    """Trend rows: name or address has the keyword, price above zero, date present."""
    name, addr = F.col("community_name"), F.col("address")
    if literal:
        hit = name.contains(keyword) | addr.contains(keyword)
    else:
        hit = name.ilike(f"%{keyword}%") | addr.ilike(f"%{keyword}%")
    return hit & (F.col("total_price") > 0) & F.col("transaction_date").isNotNull()


def recent_years(as_of_roc_year: int, years: int) -> Column:
    """Quick filter: the last ``years`` years up to ``as_of_roc_year``."""
    return D.roc_year("transaction_date").between(as_of_roc_year - years, as_of_roc_year)


def recent_regular(as_of_roc_year: int, note: str = "note", date: str = "transaction_date") -> Column:
    """Not special, and dated within two years before ``as_of_roc_year``."""
    digits = F.regexp_replace(F.coalesce(F.col(date), F.lit("0")), "[^0-9]", "").try_cast("long")
    return ~is_special(note) & F.coalesce(digits >= (as_of_roc_year - 2) * 10000, F.lit(False))


def in_district(keyword_district: Column) -> Column:
    """District or address contains the district named by the search text."""
    inside = F.contains(F.coalesce("district", F.lit("")), keyword_district) | F.contains(
        F.coalesce("address", F.lit("")), keyword_district
    )
    return blank(keyword_district) | inside


def trusted_level(level: Column | str = "level") -> Column:
    """Geocodes good enough to show."""
    return _c(level).isin("exact", "road")


def distinct_addresses(tx: DataFrame, district: str | None = None, limit: int | None = None) -> DataFrame:
    """Distinct geocodable (district, address), ordered, optionally of one district and cut."""
    rows = tx.where(geocodable("address"))
    if district is not None:
        rows = rows.where(F.col("district") == district)
    out = rows.select("district", "address").distinct().orderBy("district", "address")
    return out if limit is None else out.limit(limit)
