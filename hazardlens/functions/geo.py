"""Coordinates: validity, great-circle distance and grid cells.

Arguments are column names or SQL numbers.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens.constants import EARTH_RADIUS_KM


def in_range(latitude: str = "latitude", longitude: str = "longitude") -> Column:
    """True only for real coordinates; NULL and NaN never qualify."""
    return F.expr(
        f"{latitude} BETWEEN -90D AND 90D AND {longitude} BETWEEN -180D AND 180D"
    )


def haversine_km(lat1: str, lon1: str, lat2: str, lon2: str) -> Column:
    """Distance on a sphere; the chord is kept within the domain of the arc sine."""
    chord = (
        f"pow(sin(radians({lat2} - {lat1}) / 2), 2)"
        f" + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2)"
    )
    return F.expr(f"2 * {EARTH_RADIUS_KM}D * asin(sqrt(least(1D, {chord})))")


def cell_y(latitude: str, degrees: float) -> Column:
    return F.expr(f"CAST(floor({latitude} / {degrees}D) AS INT)")


def cell_x(longitude: str, degrees: float) -> Column:
    """Column of the grid, wrapped so that -180 and 180 share a cell."""
    return F.expr(f"CAST(pmod(floor(({longitude} + 180D) / {degrees}D), {int(360 / degrees)}) AS INT)")
