"""Map arithmetic as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mercator_y(lat: Column) -> Column:
    limited = F.greatest(F.lit(-85.0), F.least(F.lit(85.0), lat))
    return F.log(F.tan(F.pi() / 4 + F.radians(limited) / 2))


def view_xy(lon: Column, lat: Column, west: Column, east: Column, south: Column, north: Column) -> tuple[Column, Column]:
    """Pixel position on the 1000 by 600 board with paddings of 24 and 20."""
    x = 24 + (lon - west) / (east - west) * (1000 - 48)
    y = 20 + (mercator_y(north) - mercator_y(lat)) / (mercator_y(north) - mercator_y(south)) * (600 - 40)
    return x, y


def touches_view(points: Column, west: Column, east: Column, south: Column, north: Column) -> Column:
    """Any vertex inside the view padded by 12 degrees of longitude and 8 of latitude."""
    return F.coalesce(
        F.exists(points, lambda p: p["lon"].between(west - 12, east + 12) & p["lat"].between(south - 8, north + 8)),
        F.lit(False),
    )
