"""Units, ratios, price colours, score tiers, projected coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from plotline import constants as K
from plotline.functions.text import _c


def rounded(col: Column | str, digits: int) -> Column:
    """Half away from zero on the binary value (a tie that only exists in decimals is none)."""
    scale = 10.0**digits
    return F.round(_c(col) * scale, 0) / scale


def ping(area: Column | str, digits: int | None = 2) -> Column:
    """Square metres to ping."""
    v = _c(area) / K.PING_SQM
    return v if digits is None else rounded(v, digits)


def sqm(area_ping: Column | str) -> Column:
    return _c(area_ping) * K.PING_SQM


def price_per_ping(unit_price: Column | str, digits: int | None = 2) -> Column:
    """Price per square metre to price per ping."""
    v = _c(unit_price) * K.PING_SQM
    return v if digits is None else rounded(v, digits)


def _shared(building: Column, main: Column, attached: Column, balcony: Column) -> Column:
    zero = F.lit(0.0)
    return building - main - F.coalesce(attached, zero) - F.coalesce(balcony, zero)


def public_ratio_shown(building, main, attached, balcony) -> Column:
    """Share of common area in percent for display: one digit, never below 0, else 0."""
    b, m = F.coalesce(_c(building), F.lit(0.0)), F.coalesce(_c(main), F.lit(0.0))
    v = rounded(_shared(b, m, _c(attached), _c(balcony)) / b * 100, 1)
    return F.when((b > 0) & (m > 0), F.greatest(v, F.lit(0.0))).otherwise(0.0)


def public_ratio_computed(building, main, attached, balcony) -> Column:
    """Share of common area as the computed search column: NULL unless building > main > 0."""
    b, m = _c(building), _c(main)
    v = rounded(_shared(b, m, _c(attached), _c(balcony)) / b * 100, 1)
    return F.when((b > 0) & (m > 0) & (b > m), v)


def public_ratio_raw(building, main, attached, balcony) -> Column:
    """Share of common area for raw filters: not rounded; NULL without both areas."""
    b, m = _c(building), _c(main)
    return F.when((b > 0) & (m > 0), _shared(b, m, _c(attached), _c(balcony)) * 100.0 / b)


def price_hue(value: Column, lo: float, hi: float) -> Column:
    """Colour of a value: struct(hue, sat, light), green to red; NULL for no price."""
    ratio = (value - lo) / (hi - lo)

    def channel(low: float, high: float, mid: Column) -> Column:
        # Math.round of a non-negative number: half goes up.
        return (
            F.when(value <= 0, None).when(value <= lo, low).when(value >= hi, high)
            .otherwise(F.floor(mid + 0.5)).cast("int")
        )

    return F.struct(
        channel(120, 0, 120 - ratio * 120).alias("hue"),
        channel(70, 75, 70 + ratio * 5).alias("sat"),
        channel(35, 45, 35 + ratio * 10).alias("light"),
    )


def price_band(value: Column, low: float, mid: float, high: float) -> Column:
    """Band 0..3 by the three thresholds."""
    return (
        F.when(value < low, 0).when(value < mid, 1).when(value < high, 2).otherwise(3).cast("int")
    )


def legacy_band(price: Column) -> Column:
    """Three-band rule on the total price; 0 means no price."""
    return (
        F.when(price > 40_000_000, 3).when(price > 20_000_000, 2).when(price > 0, 1).otherwise(0).cast("int")
    )


def distance_points(diff: Column) -> Column:
    """Points for the distance between two house numbers."""
    return (
        F.when(diff == 0, 20).when(diff <= 2, 15).when(diff <= 5, 10)
        .when(diff <= 20, 5).when(diff <= 50, 2).otherwise(0)
    )


def tm2_to_wgs84(easting: Column, northing: Column) -> tuple[Column, Column]:
    """TWD97 TM2 (zone 121) metres to (lat, lng) degrees, by the Krüger series in the third flattening.

    The plane is mapped to the conformal sphere, and the conformal latitude to the geodetic one by
    iterating the isometric latitude (each step gains more than two digits).
    """
    f = 1 / 298.257222101
    n, e = f / (2 - f), math.sqrt(f * (2 - f))
    scale = 0.9999 * 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
        n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840,
        4397 * n**4 / 161280,
    )
    xi, eta = northing / scale, (easting - 250000.0) / scale
    north, east = xi, eta
    for j, b in enumerate(beta, start=1):
        north = north - F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b
        east = east - F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b
    sphere = F.sin(north) / F.cosh(east)
    sine = sphere
    for _ in range(6):
        sine = F.tanh(F.atanh(sphere) + F.atanh(sine * e) * e)
    return F.degrees(F.asin(sine)), F.degrees(F.atan2(F.sinh(east), F.cos(north))) + 121.0
