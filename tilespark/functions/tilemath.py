"""Mercator and tile arithmetic as column expressions: JVM code, no Python per row."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_ZOOM = 30
PI = math.pi


def _c(v: Column | str | float | int) -> Column:
    return F.col(v) if isinstance(v, str) else v if isinstance(v, Column) else F.lit(v)


def project_x(lng) -> Column:
    """Longitude to [0, 1]; no wrapping or clamping."""
    return _c(lng) / F.lit(360.0) + F.lit(0.5)


def project_y(lat) -> Column:
    """Latitude to [0, 1] from the north, clamped; the poles give 0 and 1, NaN stays NaN."""
    lat = _c(lat).cast("double")
    s = F.sin(F.radians(lat))
    y = F.lit(0.5) - F.lit(0.25) * F.ln(F.try_divide(F.lit(1.0) + s, F.lit(1.0) - s)) / F.lit(PI)
    return F.when(F.isnan(lat), lat).when(lat >= 90, 0.0).when(lat <= -90, 1.0).when(y < 0, 0.0).when(y > 1, 1.0).otherwise(y)


def tiles_across(z) -> Column:
    """2 to the power of the zoom."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), _c(z).cast("int"))


def tile_id(z, x, y) -> Column:
    return (tiles_across(z) * _c(y) + _c(x)) * 32 + _c(z)


def tile_lng(x, z) -> Column:
    """Longitude of a tile's west edge."""
    return _c(x).cast("double") / tiles_across(z) * 360.0 - 180.0


def tile_lat(y, z) -> Column:
    """Latitude of a tile's north edge."""
    n = F.lit(PI) - F.lit(2 * PI) * _c(y).cast("double") / tiles_across(z)
    return F.degrees(F.atan(F.sinh(n)))


def tile_box(z, x, y) -> dict[str, Column]:
    """A tile's box in degrees."""
    x, y = _c(x), _c(y)
    return {"w_minx": tile_lng(x, z), "w_miny": tile_lat(y + 1, z), "w_maxx": tile_lng(x + 1, z), "w_maxy": tile_lat(y, z)}


def clip_box(z, x, y, buffer, extent) -> dict[str, Column]:
    """A tile's box with its buffer, in Mercator units; may leave [0, 1]."""
    n, x, y = tiles_across(z).cast("double"), _c(x), _c(y)
    k = _c(buffer).cast("double") / _c(extent)
    return {"c_minx": (x - k) / n, "c_miny": (y - k) / n, "c_maxx": (x + 1 + k) / n, "c_maxy": (y + 1 + k) / n}


def tile_of(m, z) -> Column:
    """Number of the tile that holds a Mercator coordinate."""
    return F.floor(_c(m) * tiles_across(z)).cast("long")


def quantize(m, z, t, extent) -> Column:
    """Mercator coordinate to tile units, ties up."""
    return F.floor(_c(extent) * (_c(m) * tiles_across(z) - _c(t)) + 0.5).cast("long")


def sq_tolerance(tolerance, z, extent) -> Column:
    """Squared simplification tolerance in Mercator units; 0 switches simplifying off."""
    t = _c(tolerance).cast("double") / (tiles_across(z).cast("double") * _c(extent))
    return t * t


def boxes_meet(a: tuple, b: tuple) -> Column:
    """Whether two boxes (minx, miny, maxx, maxy) share a point; touching counts."""
    a, b = [_c(v) for v in a], [_c(v) for v in b]
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def valid_tile(z, x, y) -> Column:
    z, x, y = _c(z), _c(x), _c(y)
    return (z >= 0) & (z <= MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < tiles_across(z)) & (y < tiles_across(z))


def check_tile(z: int, x: int, y: int) -> None:
    if not (0 <= z <= MAX_ZOOM and 0 <= x < 1 << z and 0 <= y < 1 << z):
        raise ValueError(f"no such tile: {z}/{x}/{y}")
