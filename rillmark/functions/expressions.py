"""Column expressions: columns in, columns out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_db(x: Column) -> Column:
    return F.log10(F.greatest(x, F.lit(1e-7))) * 10


def normalized_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), held off zero as the indices are."""
    return F.coalesce(F.try_divide(a - b, a + b + 1e-6), F.lit(0.0))


def bare_soil(blue: Column, red: Column, nir: Column, swir: Column) -> Column:
    return normalized_difference(swir + red, nir + blue)


def cross_ratio(vv: Column, vh: Column) -> Column:
    return (vh - vv) / (F.abs(vh) + F.abs(vv) + 1e-6)


def scaled(x: Column, top: float) -> Column:
    return F.least(F.greatest(x / top, F.lit(0.0)), F.lit(1.0))


def water(dvv: Column, dvh: Column, threshold: float) -> Column:
    """A drop in either polarisation beyond the threshold (1.5 dB more in the cross one)."""
    return (dvv < threshold) | (dvh < threshold - 1.5)


def damage_class(overlap: Column, bridge: Column) -> Column:
    return F.when(overlap >= 0.5, "likely_hit").when((overlap >= 0.05) | (bridge & (overlap > 0)), "possibly_hit").otherwise("not_hit")


def ratio(a: Column, b: Column, empty: float) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(empty))


def half_even_tenth(x: Column) -> Column:
    """A count of tenths (0 or more) as units, halves to even: exact, unlike rounding binary fractions."""
    return (x - x % 10) / 10 + F.when((x % 10 > 5) | (x % 20 == 15), 1).otherwise(0)


def km(metres: Column) -> Column:
    """Whole metres as kilometres to two places."""
    return half_even_tenth(metres.cast("long")) / 100


def km2(pixels: Column, cell: int = 30) -> Column:
    """A count of square pixels as square kilometres to three places."""
    return half_even_tenth((pixels * (cell * cell // 100)).cast("long")) / 1000


def entropy(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return -q * F.log2(q) - (1 - q) * F.log2(1 - q)


def point_text(lon: Column, lat: Column) -> Column:
    return F.format_string("POINT(%s %s)", lon.cast("string"), lat.cast("string"))


#: Marker colours of settlements by state.
COLOURS = {"cut_off": "#d7191c", "still_connected": "#2ca25f"}
OTHER_COLOUR = "#999999"


def marker_colour(state: Column) -> Column:
    return F.coalesce(*[F.when(state == k, v) for k, v in COLOURS.items()], F.lit(OTHER_COLOUR))


def marker_radius(buildings: Column) -> Column:
    """Whole steps of five buildings, as the dashboard draws it."""
    return 6 + F.least(F.floor(buildings / 5), F.lit(8))


def web_marker_radius(buildings: Column) -> Column:
    return 8 + F.least(buildings / 4, F.lit(10.0))
