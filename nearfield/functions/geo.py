"""Geographic columns: great-circle distance, boxes, polygons, grid cells and geohashes."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0
GEOHASH_DIGITS = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(x: Column | float) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = map(_col, (lat1, lon1, lat2, lon2))
    up, across = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return 2 * EARTH_KM * F.atan2(F.sqrt(h), F.sqrt(F.greatest(F.lit(0.0), 1 - h)))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    return haversine_km(lat1, lon1, lat2, lon2) * 1000


def valid(lat: Column, lon: Column) -> Column:
    return F.coalesce(lat.between(-90, 90) & lon.between(-180, 180), F.lit(False))


def in_box(lat: Column, lon: Column, top: float, left: float, bottom: float, right: float) -> Column:
    """Borders included; a box whose left is east of its right crosses the date line."""
    inside = lon.between(left, right) if left <= right else (lon >= left) | (lon <= right)
    return lat.between(bottom, top) & inside


def _in_ring(lat: Column, lon: Column, ring: Sequence[tuple[float, float]]) -> Column:
    """Parity of the edges that a ray to the east crosses; the ring is (lat, lon) corners, closed by itself."""
    odd = F.lit(False)
    for (la, lo), (lb, lp) in zip(ring, [*ring[1:], ring[0]], strict=True):
        if la != lb:
            crossed = ((F.lit(la) > lat) != (F.lit(lb) > lat)) & (lon < (lp - lo) * (lat - la) / (lb - la) + lo)
            odd = odd != crossed
    return odd


def in_polygon(lat: Column, lon: Column, exterior: Sequence[tuple[float, float]], holes: Sequence[Sequence[tuple[float, float]]] = ()) -> Column:
    """Within the exterior and in no hole; a ring of fewer than three corners holds nothing."""
    if len(exterior) < 3:
        return F.lit(False)
    inside = _in_ring(lat, lon, exterior)
    for hole in holes:
        if len(hole) >= 3:
            inside = inside & ~_in_ring(lat, lon, hole)
    return inside


def polygon_box(ring: Sequence[tuple[float, float]]) -> tuple[float, float, float, float]:
    """(top, left, bottom, right)."""
    lats, lons = [p[0] for p in ring], [p[1] for p in ring]
    return max(lats), min(lons), min(lats), max(lons)


def grid_cell(lat: Column, lon: Column) -> Column:
    """Number of the cell of a tenth of a degree."""
    return ((F.floor(lat * 10) + 900) * 3600 + F.floor(lon * 10) + 1800).cast("bigint")


def radius_box(lat: float, lon: float, km: float) -> tuple[float, float, float, float]:
    """A box that holds the circle, for a cheap first filter."""
    dlat = math.degrees(km / EARTH_KM)
    top, bottom = min(90.0, lat + dlat), max(-90.0, lat - dlat)
    if abs(lat) + dlat >= 90:
        return top, -180.0, bottom, 180.0
    dlon = math.degrees(math.asin(min(1.0, math.sin(km / EARTH_KM / 2) / math.cos(math.radians(lat)) * 2)))
    left, right = lon - dlon - 0.01, lon + dlon + 0.01
    if right - left >= 360:
        return top, -180.0, bottom, 180.0
    return top, (left + 540) % 360 - 180, bottom, (right + 540) % 360 - 180


def geohash(lat: Column, lon: Column, precision: int = 12) -> Column:
    """Base-32 digits of the interleaved halvings, longitude first."""
    half = 5 * precision // 2
    bits_lon, bits_lat = 5 * precision - half, half

    def steps(value: Column, low: float, width: float, bits: int) -> Column:
        cells = float(1 << bits)
        return F.least(F.lit((1 << bits) - 1).cast("bigint"), F.floor((value - low) / width * cells).cast("bigint"))

    x, y = steps(lon, -180.0, 360.0, bits_lon), steps(lat, -90.0, 180.0, bits_lat)
    digits = []
    for d in range(precision):
        value = F.lit(0).cast("bigint")
        for k in range(5 * d, 5 * d + 5):
            source, left = (x, bits_lon - 1 - k // 2) if k % 2 == 0 else (y, bits_lat - 1 - k // 2)
            value = value * 2 + F.shiftright(source, left).bitwiseAND(F.lit(1).cast("bigint"))
        digits.append(F.substring(F.lit(GEOHASH_DIGITS), value.cast("int") + 1, F.lit(1)))
    return F.concat(*digits)


def parse_point(json: Column) -> Column:
    """struct(lat, lon) of a JSON object with lat or latitude, and lon, lng or longitude; null if either is missing."""
    def number(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object(json, f"$.{n}").try_cast("double") for n in names])

    lat, lon = number("lat", "latitude"), number("lon", "lng", "longitude")
    return F.when(lat.isNotNull() & lon.isNotNull(), F.struct(lat.alias("lat"), lon.alias("lon")))
