"""Affine placement, coordinate channels and closed-form map projections."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from canopygrid.model import COORD_OCTAVES


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pixel_x(row, col, t, at: str = "center") -> Column:
    """Map x of a pixel under affine (a, b, c, d, e, f); ``corner`` is the upper left."""
    o = 0.5 if at == "center" else 0.0
    return t[2] + t[0] * (_col(col) + o) + t[1] * (_col(row) + o)


def pixel_y(row, col, t, at: str = "center") -> Column:
    o = 0.5 if at == "center" else 0.0
    return t[5] + t[3] * (_col(col) + o) + t[4] * (_col(row) + o)


def window_transform(t, r0, c0) -> Column:
    """Affine of the window whose first pixel is (r0, c0)."""
    r, c = _col(r0), _col(c0)
    return F.array(
        F.lit(t[0]), F.lit(t[1]), t[2] + c * t[0] + r * t[1],
        F.lit(t[3]), F.lit(t[4]), t[5] + c * t[3] + r * t[4],
    )


@dataclass(frozen=True)
class Channel:
    """One extra input channel: an axis share, plain or as a wave of 2**octave half turns."""

    name: str
    axis: str
    wave: str | None = None
    octave: int = 0

    def of(self, share: Column) -> Column:
        turned = share * (math.pi * 2**self.octave)
        return {None: share, "sin": F.sin(turned), "cos": F.cos(turned)}[self.wave].alias(self.name)


# The channels of each layout, in the order the model reads them.
LAYOUTS: dict[str, tuple[Channel, ...]] = {
    "none": (),
    "xy": (Channel("coord_x", "x"), Channel("coord_y", "y")),
    "sincos": tuple(Channel(f"{wave}_{axis}{o}", axis, wave, o)
                    for o in COORD_OCTAVES for axis in "xy" for wave in ("sin", "cos")),
}


def with_position(px: DataFrame, layout: str, x, y, boxes: DataFrame, on: list[str]) -> DataFrame:
    """Add the layout's channels: where a map position lies in its scene's box (not clipped).

    ``boxes`` has one row per ``on`` key with xmin, ymin, xmax, ymax; a box without extent
    gives NULL. Pixels of a scene without a box are left out.
    """
    if layout not in LAYOUTS:
        raise ValueError(f"layouts are {sorted(LAYOUTS)}, not {layout!r}")
    placed = px.join(boxes.select(*on, *[F.col(c).alias(f"_{c}") for c in ("xmin", "ymin", "xmax", "ymax")]), on)
    share = {axis: F.try_divide(_col(c) - F.col(f"_{axis}min"), F.col(f"_{axis}max") - F.col(f"_{axis}min"))
             for axis, c in (("x", x), ("y", y))}
    return placed.select(*px.columns, *[c.of(share[c.axis]) for c in LAYOUTS[layout]])


# Spherical Mercator radius; GRS80 ellipsoid; UTM scale and false easting.
SPHERE_R = 6378137.0
GRS80_A, GRS80_F = 6378137.0, 1 / 298.257222101
UTM_K0, UTM_E0 = 0.9996, 500000.0


def to_mercator(lon, lat) -> tuple[Column, Column]:
    lon, lat = _col(lon), _col(lat)
    return (F.radians(lon) * SPHERE_R,
            F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2)) * SPHERE_R)


def from_mercator(x, y) -> tuple[Column, Column]:
    x, y = _col(x), _col(y)
    return (F.degrees(x / SPHERE_R),
            F.degrees(F.atan(F.exp(y / SPHERE_R)) * 2 - math.pi / 2))


_N = GRS80_F / (2 - GRS80_F)
_RADIUS = UTM_K0 * GRS80_A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360, _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
         17 * _N**3 / 480 - 37 * _N**4 / 840, 4397 * _N**4 / 161280)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45, 7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
          56 * _N**3 / 15 - 136 * _N**4 / 35, 4279 * _N**4 / 630)


def _waves(xi: Column, eta: Column, factors: tuple[float, ...], sign: int) -> tuple[Column, Column]:
    """(xi, eta) with the terms of a Krueger series added or taken away."""
    north, east = xi, eta
    for j, a in enumerate(factors, 1):
        north = north + F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * (sign * a)
        east = east + F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * (sign * a)
    return north, east


# A projection is a chain of steps from one pair of values to the next. Each step names its input several
# times, so on many rows the pairs between steps should be columns (``with_projected``), not one expression.
Steps = list[Callable[[Column, Column], tuple[Column, Column]]]


def _utm_steps(zone: int) -> Steps:
    k = 2 * math.sqrt(_N) / (1 + _N)
    return [
        lambda lon, lat: (F.radians(lon - (zone * 6 - 183)), F.sin(F.radians(lat))),
        lambda lam, s: (lam, F.sinh(F.atanh(s) - F.atanh(s * k) * k)),
        lambda lam, t: (F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))),
        lambda xi, eta: _waves(xi, eta, _ALPHA, 1),
        lambda north, east: (east * _RADIUS + UTM_E0, north * _RADIUS)]


def _utm_inverse_steps(zone: int) -> Steps:
    def geodetic(lon: Column, chi: Column) -> tuple[Column, Column]:
        return F.degrees(lon) + (zone * 6 - 183), F.degrees(sum((F.sin(chi * (2 * j)) * e for j, e in enumerate(_DELTA, 1)), chi))

    return [
        lambda east, north: (north / _RADIUS, (east - UTM_E0) / _RADIUS),
        lambda xi, eta: _waves(xi, eta, _BETA, -1),
        lambda up, across: (F.atan2(F.sinh(across), F.cos(up)), F.asin(F.sin(up) / F.cosh(across))),
        geodetic]


def _through(steps: Steps, x, y) -> tuple[Column, Column]:
    x, y = _col(x), _col(y)
    for step in steps:
        x, y = step(x, y)
    return x, y


def to_utm(lon, lat, zone: int) -> tuple[Column, Column]:
    """Transverse Mercator by the third-order Krueger series (northern zones).

    The datum shift between the geographic system and the zone is taken as zero.
    """
    return _through(_utm_steps(zone), lon, lat)


def from_utm(east, north, zone: int) -> tuple[Column, Column]:
    """Longitude and latitude of a position in a northern zone: the inverse Krueger series, of fourth order.

    With ``to_utm`` a position comes back to a fraction of a millimetre anywhere in the zone.
    """
    return _through(_utm_inverse_steps(zone), east, north)


def utm_zone(code: int) -> int | None:
    """Zone of a northern UTM code (26901..26923, 6330..6348), else None."""
    if 26901 <= code <= 26923:
        return code - 26900
    return code - 6329 if 6330 <= code <= 6348 else None


def _steps(src: int | None, dst: int) -> Steps:
    if src is None or src == dst:
        return []
    for code, way in ((src, "from"), (dst, "to")):
        if code not in (3857, 4326) and utm_zone(code) is None:
            raise ValueError(f"no conversion {way} EPSG:{code}")
    there = {3857: [from_mercator], 4326: []}
    back = {3857: [to_mercator], 4326: []}
    return [*(there[src] if src in there else _utm_inverse_steps(utm_zone(src))),
            *(back[dst] if dst in back else _utm_steps(utm_zone(dst)))]


def reproject(x, y, src: int | None, dst: int) -> tuple[Column, Column]:
    """No source code -> stamp only; equal -> pass; known pair -> convert; else error.

    Known codes: 4326, 3857 and the northern UTM zones 26901..26923 / 6330..6348, both ways.
    """
    return _through(_steps(src, dst), x, y)


def with_projected(df: DataFrame, points: dict[tuple[str, str], tuple], src: int | None, dst: int) -> DataFrame:
    """``reproject`` for several points of each row: names of the new columns -> (x, y). Step by step, so that no
    value is computed twice; they end in a one-element explode, which keeps filters on the result from being moved
    below the steps and written out in full there."""
    names = [n for pair in points for n in pair]
    df = df.withColumns({n: _col(c) for pair, xy in points.items() for n, c in zip(pair, xy, strict=True)})
    for step in _steps(src, dst):
        df = df.withColumns({n: c for a, b in points for n, c in zip((a, b), step(F.col(a), F.col(b)), strict=True)})
    others = [c for c in df.columns if c not in names]
    done = df.select(*others, F.explode(F.array(F.struct(*names))).alias("_projected"))
    return done.select(*others, *[F.col("_projected")[n].alias(n) for n in names])


def reproject_box(xmin: float, ymin: float, xmax: float, ymax: float, src: int | None, dst: int, spark,
                  steps: int = 32) -> tuple[float, float, float, float]:
    """Box around a box in another system: its sides are converted at ``steps`` places each, because straight
    sides become curves; the bulge between two places is made up for by the same amount again."""
    if src is None or src == dst:
        return xmin, ymin, xmax, ymax
    t = F.col("id") / F.lit(float(steps))
    sides = spark.range(steps + 1).select(F.explode(F.array(*[
        F.struct((F.lit(float(x)) + t * dx).alias("x"), (F.lit(float(y)) + t * dy).alias("y"))
        for x, y, dx, dy in ((xmin, ymin, xmax - xmin, 0.0), (xmin, ymax, xmax - xmin, 0.0),
                             (xmin, ymin, 0.0, ymax - ymin), (xmax, ymin, 0.0, ymax - ymin))])).alias("p"), "id")
    x, y = reproject("p.x", "p.y", src, dst)
    got = sides.select(x.alias("x"), y.alias("y")).agg(F.min("x"), F.min("y"), F.max("x"), F.max("y")).first()
    # a side that bends by b in all bends by b / steps^2 between two places
    margin = max(got[2] - got[0], got[3] - got[1]) / steps ** 2
    return got[0] - margin, got[1] - margin, got[2] + margin, got[3] + margin
