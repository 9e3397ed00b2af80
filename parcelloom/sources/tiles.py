"""Vector tiles: which tiles units are on, clipping, and the tiles' bytes."""

from __future__ import annotations

import gzip
import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.functions.measure import tile_of

EXTENT, BUFFER, SPREAD = 4096, 256, 64


def tile_cover(unit_geom: DataFrame, zoom: int) -> DataFrame:
    """``idx, x, y``: the tiles that a unit's box touches; a unit over more than ``SPREAD`` tiles either way has none."""
    x0, y0 = tile_of(F.col("minx"), F.col("maxy"), zoom)
    x1, y1 = tile_of(F.col("maxx"), F.col("miny"), zoom)
    boxes = unit_geom.select("idx", x0.alias("x0"), x1.alias("x1"), y0.alias("y0"), y1.alias("y1")).where(f"x1 - x0 <= {SPREAD} and y1 - y0 <= {SPREAD}")
    return boxes.select("idx", "y0", "y1", F.explode(F.sequence("x0", "x1")).alias("x")).select("idx", "x", F.explode(F.sequence("y0", "y1")).alias("y"))


def to_tile(points: list, zoom: int, x: int, y: int) -> list[tuple[int, int]]:
    """Points of lon and lat in a tile's own units."""
    n, out = 1 << zoom, []
    for lon, lat in points:
        px, py = (lon + 180) / 360 * n - x, (1 - math.asinh(math.tan(math.radians(lat))) / math.pi) / 2 * n - y
        out.append((round(px * EXTENT), round(py * EXTENT)))
    return out


def clip(ring: list, low: int = -BUFFER, high: int = EXTENT + BUFFER) -> list:
    """A ring cut to a square, a side at a time."""
    for axis in (0, 1):
        for bound, keep in ((low, lambda v: v >= low), (high, lambda v: v <= high)):
            out = []
            for i, q in enumerate(ring):
                p = ring[i - 1]
                if keep(p[axis]) != keep(q[axis]):
                    t = (bound - p[axis]) / (q[axis] - p[axis])
                    cut = [round(p[0] + t * (q[0] - p[0])), round(p[1] + t * (q[1] - p[1]))]
                    cut[axis] = bound
                    out.append(tuple(cut))
                if keep(q[axis]):
                    out.append(q)
            ring = out
    return ring


def clean(ring: list) -> list:
    """A ring without repeats, without its closing point and without spikes; nothing if fewer than three points are left."""
    changed = True
    while changed:
        changed = False
        out: list = []
        for p in ring:
            if out and out[-1] == p:
                changed = True
            elif len(out) > 1 and out[-2] == p:
                out.pop()
                changed = True
            else:
                out.append(p)
        while len(out) > 1 and out[0] == out[-1]:
            out.pop()
            changed = True
        ring = out
    return ring if len(ring) >= 3 else []


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, raw: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(raw)) + raw


def _commands(rings: list) -> bytes:
    words, x, y = [], 0, 0
    zigzag = lambda v: v << 1 if v >= 0 else (-v << 1) - 1
    for ring in rings:
        for i, (px, py) in enumerate(ring):
            if i == 0:
                words.append(1 | 1 << 3)
            elif i == 1:
                words.append(2 | len(ring) - 1 << 3)
            words += [zigzag(px - x), zigzag(py - y)]
            x, y = px, py
        words.append(7 | 1 << 3)
    return b"".join(map(_varint, words))


def encode_tile(layer: str, rows: list[tuple[str, list]], zoom: int, x: int, y: int) -> bytes:
    """A gzipped tile of one layer: features ``(geo_id, polygons)`` as polygons with their id as an attribute."""
    values, features = [], []
    for geo_id, geom in rows:
        rings = []
        for polygon in geom:
            for k, ring in enumerate(polygon):
                r = clean(clip(to_tile(ring, zoom, x, y)))
                if not r:
                    if k == 0:
                        break
                    continue
                area = sum(r[i - 1][0] * r[i][1] - r[i][0] * r[i - 1][1] for i in range(len(r)))
                rings.append(r if (area > 0) == (k == 0) else r[::-1])
        if rings:
            features.append(_field(2, _field(2, _varint(0) + _varint(len(values))) + _varint(3 << 3) + _varint(3) + _field(4, _commands(rings))))
            values.append(geo_id)
    body = _varint(15 << 3) + _varint(2) + _field(1, layer.encode()) + b"".join(features) + _field(3, b"geo_id") + b"".join(_field(4, _field(1, v.encode())) for v in values) + _varint(5 << 3) + _varint(EXTENT)
    return gzip.compress(_field(3, body), mtime=0)


def tiles(units: DataFrame, geoms: DataFrame, unit_geom: DataFrame, layer: str, zoom: int) -> DataFrame:
    """``zoom, x, y, tile, features``: the bytes of every tile of a layer.

    A tile's units come together in one task, a tile at a time; by zoom that is as many as a screen shows.
    """
    rows = tile_cover(unit_geom, zoom).join(units.select("idx", "geo_id"), "idx").join(geoms, "idx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        key = (0, 0)
        for batch in batches:
            for r in batch.to_pylist():
                found.append((r["geo_id"], [[[(p["x"], p["y"]) for p in ring] for ring in polygon] for polygon in r["geom"]]))
                key = (r["x"], r["y"])
        if found:
            yield pa.RecordBatch.from_pydict({"zoom": pa.array([zoom], pa.int32()), "x": pa.array([key[0]], pa.int32()), "y": pa.array([key[1]], pa.int32()), "tile": pa.array([encode_tile(layer, sorted(found, key=lambda f: f[0]), zoom, *key)], pa.binary()), "features": pa.array([len(found)], pa.int32())})

    return rows.select("x", "y", "geo_id", "geom").groupBy("x", "y").applyInArrow(run, "zoom int, x int, y int, tile binary, features int")
