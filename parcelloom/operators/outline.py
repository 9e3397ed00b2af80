"""Rings from boundary segments: dissolved units, hulls and simplified arcs, a group at a time.

What is next to what is settled by joins before; only the walk along a group's boundary is done in Python, on the
boundary alone, which for a district is a small part of its units.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.operators.topology import boundary_segments

_POINT = pa.struct([("x", pa.float64()), ("y", pa.float64())])
_GEOM = "array<array<array<struct<x:double,y:double>>>>"


def twice_area(ring: list) -> float:
    return sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(ring, ring[1:]))


def trace(edges: list[tuple[tuple, tuple]]) -> list[list[tuple]]:
    """Closed rings from directed edges with the inside on the left.  Where rings touch in a point the sharpest left turn is taken."""
    out: dict[tuple, list[tuple]] = {}
    for a, b in sorted(edges):
        out.setdefault(a, []).append(b)
    rings = []
    for a, b in sorted(edges):
        if b not in out.get(a, ()):
            continue
        ring = [a]
        out[a].remove(b)
        while True:
            p = ring[-1]
            ring.append(b)
            if b == ring[0]:
                break
            ends = out[b]
            if len(ends) > 1:  # a touching point: leave it on the left
                back = (p[0] - b[0], p[1] - b[1])
                turn = lambda q: _angle(back, (q[0] - b[0], q[1] - b[1]))  # noqa: B023, E731
                q = min(ends, key=turn)
            else:
                q = ends[0]
            ends.remove(q)
            b = q
        rings.append(ring)
    return rings


def _angle(a: tuple, b: tuple) -> float:
    """The turn from ``a`` clockwise to ``b``, more than 0 and at most a full one."""
    from math import atan2, pi

    turn = (atan2(a[1], a[0]) - atan2(b[1], b[0])) % (2 * pi)
    return turn if turn > 1e-12 else 2 * pi


def inside(p: tuple, ring: list) -> bool:
    odd = False
    for (x0, y0), (x1, y1) in zip(ring, ring[1:]):
        if (y0 > p[1]) != (y1 > p[1]) and p[0] < (x1 - x0) * (p[1] - y0) / (y1 - y0) + x0:
            odd = not odd
    return odd


def polygons(rings: list[list[tuple]]) -> list[list[list[tuple]]]:
    """Outer rings (counter-clockwise) with the holes whose smallest enclosing ring they are."""
    outer = sorted((r for r in rings if twice_area(r) > 0), key=lambda r: (twice_area(r), r))
    found = [[r] for r in outer]
    for hole in (r for r in rings if twice_area(r) < 0):
        middle = ((hole[0][0] + hole[1][0]) / 2, (hole[0][1] + hole[1][1]) / 2)
        for polygon in found:
            if abs(twice_area(polygon[0])) > abs(twice_area(hole)) and inside(middle, polygon[0]):
                polygon.append(hole)
                break
    return found


def hull(points: list[tuple]) -> list[tuple]:
    """The closed convex hull, counter-clockwise."""
    points = sorted(set(points))
    if len(points) < 3:
        return [*points, points[0]] if points else []

    def half(side: list) -> list:
        out: list = []
        for p in side:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    ring = half(points) + half(points[::-1])
    return [*ring, ring[0]]


def simplified(line: list[tuple], tolerance: float) -> list[tuple]:
    """Douglas-Peucker with an explicit stack: the ends stay, and all points farther from the result than the tolerance."""
    if tolerance <= 0 or len(line) < 3:
        return line
    keep = {0, len(line) - 1}
    stack = [(0, len(line) - 1)]
    while stack:
        a, b = stack.pop()
        (ax, ay), (bx, by) = line[a], line[b]
        dx, dy = bx - ax, by - ay
        far, at = tolerance, -1
        for i in range(a + 1, b):
            px, py = line[i][0] - ax, line[i][1] - ay
            t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy))) if dx or dy else 0.0
            d = ((px - t * dx) ** 2 + (py - t * dy) ** 2) ** 0.5
            if d > far:
                far, at = d, i
        if at >= 0:
            keep.add(at)
            stack += [(a, at), (at, b)]
    return [line[i] for i in sorted(keep)]


def _grouped(rows: DataFrame, keys: list[str], solve: Callable[[list[dict]], list]) -> DataFrame:
    """``(*keys, geom)`` of each group's rows."""
    kinds = {f.name: f.dataType for f in rows.schema}
    schema = ", ".join(f"{k} {kinds[k].simpleString()}" for k in keys) + f", geom {_GEOM}"
    geom = pa.list_(pa.list_(pa.list_(_POINT)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [r for b in batches for r in b.to_pylist()]
        value = [[[{"x": x, "y": y} for x, y in ring] for ring in polygon] for polygon in solve(found)]
        yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], k.type) for k in key), pa.array([value], geom)], names=[*keys, "geom"])

    return rows.groupBy(*keys).applyInArrow(run, schema)


def dissolved(segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, geom)``: the union of each set ``members(*keys, idx)``."""
    edges = boundary_segments(segs, members, keys).select(*keys, "ax", "ay", "bx", "by")
    return _grouped(edges, keys, lambda rows: polygons(trace([((r["ax"], r["ay"]), (r["bx"], r["by"])) for r in rows])))


def hulls(segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, geom)``: the convex hull of each set, from its boundary's points."""
    points = boundary_segments(segs, members, keys).select(*keys, "ax", "ay").distinct()
    return _grouped(points, keys, lambda rows: [[hull([(r["ax"], r["ay"]) for r in rows])]])


def junctions(segs: DataFrame) -> DataFrame:
    """Vertices ``k`` at which more or fewer than two borders meet, a border being the segments between the same two sides."""
    ends = segs.select("ka", "kb").unionByName(segs.select(F.col("kb").alias("ka"), F.col("ka").alias("kb"))).distinct()
    return ends.groupBy(F.col("ka").alias("k")).agg(F.count("*").alias("n")).where("n <> 2").select("k")


def simplified_geoms(segs: DataFrame, tolerance: float) -> DataFrame:
    """``idx, geom`` with every border between junctions simplified once, so that neighbours still fit.

    A border is walked from its smaller end, whichever of its two units it is read for, and a loop without a
    junction from its smallest vertex.  Rings of fewer than four points go.  A tolerance of 0 changes nothing.
    """
    at = junctions(segs).withColumn("_j", F.lit(True))
    rows = segs.join(at, F.col("ka") == F.col("k"), "left").select("idx", "poly", "ring", "pos", "ax", "ay", F.coalesce("_j", F.lit(False)).alias("joint"))

    def solve(found: list[dict]) -> list:
        rings: dict[tuple, list] = {}
        for r in sorted(found, key=lambda r: (r["poly"], r["ring"], r["pos"])):
            rings.setdefault((r["poly"], r["ring"]), []).append(((r["ax"], r["ay"]), r["joint"]))
        out: dict[int, list] = {}
        for (poly, ring), points in rings.items():
            cuts = [i for i, (_, joint) in enumerate(points) if joint]
            first = cuts[0] if cuts else min(range(len(points)), key=lambda i: points[i][0])
            turned = [*points[first:], *points[:first], points[first]]
            line, done = [turned[0][0]], []
            for p, joint in turned[1:]:
                line.append(p)
                if joint or p == turned[0][0]:
                    ordered = line if (line[0], line[1]) <= (line[-1], line[-2]) else line[::-1]
                    short = simplified(ordered, tolerance)
                    done += (short if ordered is line else short[::-1])[:-1]
                    line = [p]
            if len(done) >= 3:
                out.setdefault(poly, []).append((ring, [*done, done[0]]))
        return [[r for _, r in sorted(rs)] for _, rs in sorted(out.items()) if sorted(rs)[0][0] == 0]

    return _grouped(rows, ["idx"], solve)
