"""Lengths, areas, tiles and colours as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: metres in a degree of latitude.
M_PER_DEG = 111_320.0
#: Coordinates are compared as multiples of this part of a degree.
PER_DEGREE = 10_000_000


def edge_length(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Metres between two lon/lat points, with longitudes scaled at the middle latitude."""
    scale = F.cos(F.radians((ay + by) / 2))
    dx, dy = (bx - ax) * scale, by - ay
    return F.sqrt(dx * dx + dy * dy) * M_PER_DEG


def area_term(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """An edge's part of twice a ring's signed area in square degrees scaled at its middle latitude."""
    return (ax * by - bx * ay) * F.cos(F.radians((ay + by) / 2))


def vertex_key(x: Column, y: Column) -> Column:
    """One number for a vertex, equal for points that agree to 1e-7 degrees."""
    kx, ky = F.round(x * PER_DEGREE).cast("long"), F.round(y * PER_DEGREE).cast("long")
    return (kx + 180 * PER_DEGREE) * (180 * PER_DEGREE + 1) + (ky + 90 * PER_DEGREE)


def signed_area(ring: Column) -> Column:
    """Twice the signed area of a closed ring of ``struct<x, y>``, positive if counter-clockwise."""
    n = F.size(ring)
    pairs = F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.aggregate(pairs, F.lit(0.0), lambda a, t: a + t)


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Whether a point lies in a closed ring: parity of the edges that a ray to the right meets."""
    n = F.size(ring)

    def meets(p: Column, q: Column) -> Column:
        apart = (p["y"] > y) != (q["y"] > y)
        return F.when(apart & (x < (q["x"] - p["x"]) * (y - p["y"]) / F.when(apart, q["y"] - p["y"]) + p["x"]), 1).otherwise(0)

    return F.aggregate(F.zip_with(F.slice(ring, 1, n - 1), F.slice(ring, 2, n - 1), meets), F.lit(0), lambda a, t: a + t) % 2 == 1


def in_polygons(x: Column, y: Column, geom: Column) -> Column:
    """Whether a point lies in any polygon of ``geom`` (rings of points, the first the outer one) and not in its holes."""
    return F.exists(geom, lambda p: in_ring(x, y, p[0]) & ~F.exists(F.slice(p, 2, F.greatest(F.size(p) - 1, F.lit(0))), lambda h: in_ring(x, y, h)))


def mercator_x(lon: Column) -> Column:
    """Longitude as a share of the world's width."""
    return (lon + 180.0) / 360.0


def mercator_y(lat: Column) -> Column:
    """Latitude as a share of the Mercator world's height from the top."""
    return (1.0 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2.0


def tile_of(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Column and row of the tile that a point lies in."""
    n = 1 << zoom
    clamp = lambda v: F.least(F.greatest(F.floor(v * n), F.lit(0)), F.lit(n - 1)).cast("int")
    return clamp(mercator_x(lon)), clamp(mercator_y(lat))


def zoom_tolerance(zoom: int, max_zoom: int) -> float:
    """Degrees that simplification may move a line at a zoom; none at the largest."""
    return 0.0 if zoom >= max_zoom else 360.0 / 2**zoom / 1000.0


# Lower bounds of lean and the colour from there on; the last bound includes 1.
PARTISAN = (
    (-1.0, 202, 0, 32), (-0.5, 211, 33, 58), (-0.3, 220, 66, 83), (-0.2, 229, 99, 109), (-0.15, 238, 132, 135),
    (-0.12, 243, 160, 157), (-0.09, 241, 176, 174), (-0.06, 238, 192, 190), (-0.04, 236, 208, 207), (-0.02, 233, 224, 224),
    (0.0, 223, 228, 231), (0.02, 205, 221, 229), (0.04, 187, 213, 227), (0.06, 168, 206, 225), (0.09, 150, 199, 222),
    (0.12, 123, 183, 215), (0.15, 94, 166, 205), (0.2, 64, 148, 195), (0.3, 35, 131, 186), (0.5, 5, 113, 176),
)


def hex_colour(r: Column | int, g: Column | int, b: Column | int) -> Column:
    return F.format_string("#%02x%02x%02x", *(x if isinstance(x, Column) else F.lit(x) for x in (r, g, b)))


def partisan_colour(lean: Column) -> Column:
    """The colour of a lean of -1 to 1, clamped; grey where it is null, NaN or infinite."""
    out = F.lit(f"#{5:02x}{113:02x}{176:02x}")
    for i in range(len(PARTISAN) - 2, -1, -1):
        _, r, g, b = PARTISAN[i]
        out = F.when(lean < PARTISAN[i + 1][0], F.lit(f"#{r:02x}{g:02x}{b:02x}")).otherwise(out)
    finite = lean.isNotNull() & ~F.isnan(lean) & (F.abs(lean) != float("inf"))
    return F.when(finite, out).otherwise(F.lit("#969696"))


def choropleth_colour(value: Column, low: Column, high: Column) -> Column:
    """Between #deebf7 and #08519c by the place of a value between two others; null counts as the lowest."""
    t = F.coalesce(F.when(high > low, F.least(F.greatest((value - low) / (high - low), F.lit(0.0)), F.lit(1.0))), F.lit(0.0))
    mix = lambda a, b: F.round(F.lit(float(a)) + t * (b - a)).cast("int")
    return hex_colour(mix(0xDE, 0x08), mix(0xEB, 0x51), mix(0xF7, 0x9C))


def golden_colour(index: Column) -> Column:
    """Hues a golden angle apart."""
    return F.format_string("hsl(%.1f,70%%,55%%)", F.pmod(index * F.lit(137.50776405), F.lit(360.0)))


def district_colour(district: Column) -> Column:
    """The colour of an assigned district; null for 0."""
    return F.when(district > 0, F.format_string("hsl(%d 70%% 50%%)", (district * 57 % 360).cast("int")))
