"""Adjacency and measures of planar units from their polygons, as tables of segments and edges.

A segment is an edge of a ring with the unit to its left.  The segment that runs the other way belongs to the
neighbour: both have the same pair of vertex keys, so one shuffle by that pair finds all neighbours.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelloom.functions.measure import area_term, edge_length, in_polygons, signed_area, vertex_key
from parcelloom.operators.components import component_labels


def rings(geoms: DataFrame) -> DataFrame:
    """``idx, poly, ring, points``: outer rings (number 0) counter-clockwise and holes clockwise, closed.

    A ring of fewer than four points is an error.
    """
    r = geoms.select("idx", F.posexplode("geom").alias("poly", "p")).select("idx", "poly", F.posexplode("p").alias("ring", "points"))
    closed = F.when(F.element_at("points", 1) == F.element_at("points", -1), F.col("points")).otherwise(F.concat("points", F.slice("points", 1, 1)))
    r = r.withColumn("points", closed)
    right_way = (signed_area(F.col("points")) >= 0) == (F.col("ring") == 0)
    points = F.when(F.size("points") < 4, F.raise_error(F.lit("a ring needs four points"))).when(right_way, F.col("points")).otherwise(F.reverse("points"))
    return r.withColumn("points", points)


def segments(geoms: DataFrame) -> DataFrame:
    """``idx, poly, ring, pos, ax, ay, bx, by, ka, kb, len_m, twin_idx``.

    ``twin_idx`` is the unit across the segment, or null where there is none (the outside and gaps).
    """
    n = F.size("points") - 1
    pairs = F.zip_with(F.slice("points", 1, n), F.slice("points", 2, n), lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))
    s = rings(geoms).select("idx", "poly", "ring", F.posexplode(pairs).alias("pos", "e")).select("idx", "poly", "ring", "pos", "e.*")
    ax, ay, bx, by = (F.col(c) for c in ("ax", "ay", "bx", "by"))
    s = s.withColumns({"ka": vertex_key(ax, ay), "kb": vertex_key(bx, by), "len_m": edge_length(ax, ay, bx, by)}).where("ka <> kb")
    across = Window.partitionBy(F.least("ka", "kb"), F.greatest("ka", "kb"))
    way = F.when(F.col("ka") < F.col("kb"), 1).otherwise(-1)
    matched = (F.count("*").over(across) == 2) & (F.sum(way).over(across) == 0)
    return s.withColumn("twin_idx", F.when(matched, F.sum("idx").over(across) - F.col("idx")).cast("int"))


def overlapping(segs: DataFrame) -> DataFrame:
    """Directed segments that more than one unit has: overlapping inputs."""
    return segs.groupBy("ka", "kb").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx")).where("n > 1")


def rook_edges(segs: DataFrame) -> DataFrame:
    """``src, dst, w``: both directions, ``w`` the shared boundary in metres."""
    return segs.where("twin_idx is not null and twin_idx <> idx").groupBy(F.col("idx").alias("src"), F.col("twin_idx").alias("dst")).agg(F.sum("len_m").alias("w"))


def queen_edges(segs: DataFrame) -> DataFrame:
    """``src, dst``: units that have a vertex in common."""
    at = segs.select("idx", "ka").distinct()
    return at.alias("l").join(at.alias("r"), F.col("l.ka") == F.col("r.ka")).where("l.idx <> r.idx").select(F.col("l.idx").alias("src"), F.col("r.idx").alias("dst")).distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """``idx, degree`` of every unit with a neighbour."""
    return edges.groupBy(F.col("src").alias("idx")).agg(F.count("*").alias("degree"))


def forced_adjacency(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``edges(src, dst, w)`` with the pairs ``a, b`` both ways, at weight 0 where they weren't edges."""
    there = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    both = there.unionByName(there.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").withColumn("w", F.lit(0.0))
    return edges.unionByName(both).groupBy("src", "dst").agg(F.sum("w").alias("w"))


def numbered_edges(edges: DataFrame) -> DataFrame:
    """Edges with ``edge_id`` from 0 by source and destination."""
    from parcelloom.operators.rollup import row_index

    return row_index(edges, "src", ["dst"], "edge_id")


def unit_geometry(segs: DataFrame, subtract_holes: bool = True) -> DataFrame:
    """``idx, area, perimeter, ext_len, cx, cy, minx, miny, maxx, maxy, is_exterior``, in metres and square metres."""
    from parcelloom.functions.measure import M_PER_DEG

    term = area_term(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by"))
    by_ring = segs.groupBy("idx", "poly", "ring").agg(
        F.abs(F.sum(term)).alias("a"), F.sum(F.when(F.col("twin_idx").isNull() | (F.col("twin_idx") != F.col("idx")), F.col("len_m")).otherwise(0.0)).alias("p"), F.sum(F.when(F.col("twin_idx").isNull(), F.col("len_m")).otherwise(0.0)).alias("e"),
        F.sum("ax").alias("sx"), F.sum("ay").alias("sy"), F.count("*").alias("n"), F.min("ax").alias("minx"), F.min("ay").alias("miny"), F.max("ax").alias("maxx"), F.max("ay").alias("maxy"), F.bool_or(F.col("twin_idx").isNull()).alias("x"),
    )
    sign = F.when(F.col("ring") == 0, F.col("a")).otherwise(-F.col("a") if subtract_holes else F.lit(0.0))
    return by_ring.groupBy("idx").agg(
        (F.sum(sign) / 2 * M_PER_DEG * M_PER_DEG).alias("area"), F.sum("p").alias("perimeter"), F.sum("e").alias("ext_len"), (F.sum("sx") / F.sum("n")).alias("cx"), (F.sum("sy") / F.sum("n")).alias("cy"),
        F.min("minx").alias("minx"), F.min("miny").alias("miny"), F.max("maxx").alias("maxx"), F.max("maxy").alias("maxy"), F.bool_or("x").alias("is_exterior"),
    )


def geometry_stats(geoms: DataFrame, unit_geom: DataFrame) -> DataFrame:
    """``idx, polygons, holes`` (of each polygon) and ``is_exterior``."""
    return geoms.select("idx", F.size("geom").alias("polygons"), F.transform("geom", lambda p: F.size(p) - 1).alias("holes")).join(unit_geom.select("idx", "is_exterior"), "idx")


def in_envelope(unit_geom: DataFrame, minx: float, miny: float, maxx: float, maxy: float) -> DataFrame:
    """Units whose bounding box meets another box."""
    return unit_geom.where((F.col("maxx") >= minx) & (F.col("minx") <= maxx) & (F.col("maxy") >= miny) & (F.col("miny") <= maxy))


def units_at(points: DataFrame, geoms: DataFrame, unit_geom: DataFrame, cell: float) -> DataFrame:
    """``points(pid, x, y)`` with the smallest ``idx`` that contains each; null where none does.

    Units are listed in the grid cells of their boxes and points looked up by cell, then tested exactly.
    """
    cells = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    listed = unit_geom.select("idx", F.explode(cells("minx", "maxx")).alias("gx"), "miny", "maxy").select("idx", "gx", F.explode(cells("miny", "maxy")).alias("gy"))
    near = points.withColumns({"gx": F.floor(F.col("x") / cell), "gy": F.floor(F.col("y") / cell)}).join(listed, ["gx", "gy"]).join(geoms, "idx")
    hits = near.where(in_polygons(F.col("x"), F.col("y"), F.col("geom"))).groupBy("pid").agg(F.min("idx").alias("idx"))
    return points.select("pid").join(hits, "pid", "left")


def snap_pairs(segs: DataFrame, tolerance: float) -> DataFrame:
    """``a, b``: different vertices of different units no farther apart than ``tolerance`` degrees, from a grid of that size."""
    at = segs.select("idx", F.col("ka").alias("k"), F.col("ax").alias("x"), F.col("ay").alias("y")).distinct()
    gx, gy = F.floor(F.col("x") / tolerance), F.floor(F.col("y") / tolerance)
    near = F.explode(F.flatten(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda j: F.struct((F.col("gx") + i).alias("gx"), (F.col("gy") + j).alias("gy"))))))
    own = at.withColumns({"gx": gx, "gy": gy})
    wide = own.select(F.col("idx").alias("i2"), F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), near.alias("c")).select("i2", "k2", "x2", "y2", "c.*")
    dist = F.hypot(F.col("x") - F.col("x2"), F.col("y") - F.col("y2"))
    return own.join(wide, ["gx", "gy"]).where((F.col("idx") != F.col("i2")) & (F.col("k") < F.col("k2")) & (dist <= tolerance)).select(F.col("k").alias("a"), F.col("k2").alias("b")).distinct()


def snapped(segs: DataFrame, tolerance: float) -> DataFrame:
    """``k, x, y``: for every vertex the coordinates of the smallest vertex key of its group of near ones."""
    at = segs.select(F.col("ka").alias("node"), "ax", "ay").groupBy("node").agg(F.min("ax").alias("x"), F.min("ay").alias("y"))
    root = component_labels(at.select("node"), snap_pairs(segs, tolerance), [])
    of = at.select(F.col("node").alias("root"), "x", "y")
    return root.join(of, "root").select(F.col("node").alias("k"), "x", "y")


def snapped_geoms(geoms: DataFrame, tolerance: float) -> DataFrame:
    """``idx, geom`` with near vertices of different units in one place.

    Points that then repeat go, and so do rings of fewer than four points and polygons without an outer ring; a unit
    that loses all of them has an empty geometry.  Only vertices that move are joined.
    """
    moved = snapped(segments(geoms), tolerance).where(vertex_key(F.col("x"), F.col("y")) != F.col("k")).withColumnsRenamed({"x": "to_x", "y": "to_y"})
    at = rings(geoms).select("idx", "poly", "ring", F.posexplode("points").alias("pos", "p")).withColumn("k", vertex_key(F.col("p.x"), F.col("p.y"))).join(moved, "k", "left")
    point = F.struct("pos", F.coalesce("to_x", "p.x").alias("x"), F.coalesce("to_y", "p.y").alias("y"))
    by_ring = at.groupBy("idx", "poly", "ring").agg(F.transform(F.sort_array(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))).alias("points"))
    by_ring = by_ring.withColumn("points", F.filter("points", lambda p, i: (i == 0) | (p != F.get("points", i - 1)))).where(F.size("points") >= 4)
    by_poly = by_ring.groupBy("idx", "poly").agg(F.sort_array(F.collect_list(F.struct("ring", "points"))).alias("r")).where(F.col("r")[0]["ring"] == 0)
    by_unit = by_poly.groupBy("idx").agg(F.transform(F.sort_array(F.collect_list(F.struct("poly", F.col("r.points").alias("r")))), lambda p: p["r"]).alias("geom"))
    return geoms.select("idx").join(by_unit, "idx", "left").select("idx", F.coalesce("geom", F.array().cast(geoms.schema["geom"].dataType)).alias("geom"))


def validate(segs: DataFrame, edges: DataFrame, unit_geom: DataFrame) -> DataFrame:
    """``rule, n``: how many rows break each rule; all 0 for a sound region."""
    back = edges.select(F.col("src").alias("dst"), F.col("dst").alias("src"), F.col("w").alias("back"))
    one_way = edges.join(back, ["src", "dst"], "left").where("back is null or abs(back - w) > 1e-6")
    rules = {"one-way edge": one_way, "overlap": overlapping(segs), "negative area": unit_geom.where("area < 0"), "loop": edges.where("src = dst")}
    out = None
    for name, df in rules.items():
        row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("rule"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def subset_perimeter(segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, perimeter)`` of the sets ``members(*keys, idx)``: the segments whose other side is not in the set."""
    inside = segs.join(members, "idx")
    other = members.select(*keys, F.col("idx").alias("twin_idx"))
    return inside.join(other, [*keys, "twin_idx"], "left_anti").groupBy(*keys).agg(F.sum("len_m").alias("perimeter"))


def subset_geometry(unit_geom: DataFrame, segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``(*keys, area, ext_len, minx, miny, maxx, maxy, perimeter, compactness)`` of the sets ``members(*keys, idx)``."""
    sums = unit_geom.join(members, "idx").groupBy(*keys).agg(*(F.sum(c).alias(c) for c in ("area", "ext_len")), *(F.min(c).alias(c) for c in ("minx", "miny")), *(F.max(c).alias(c) for c in ("maxx", "maxy")))
    out = sums.join(subset_perimeter(segs, members, keys), keys)
    return out.withColumn("compactness", F.when(F.col("perimeter") > 0, F.col("area") * (4 * math.pi) / (F.col("perimeter") * F.col("perimeter"))).otherwise(0.0))


def common_segments(segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """``p, q, ka, kb, len_m``: the segments that the outlines of two sets ``members(key, idx)`` have in common, each from ``p`` to ``q > p``."""
    (key,) = keys
    p = members.select(F.col("idx"), F.col(key).alias("p"))
    q = members.select(F.col("idx").alias("twin_idx"), F.col(key).alias("q"))
    return segs.where("twin_idx is not null").join(p, "idx").join(q, "twin_idx").where("p < q").select("p", "q", "idx", "twin_idx", "ka", "kb", "len_m")


def boundary_segments(segs: DataFrame, members: DataFrame, keys: list[str]) -> DataFrame:
    """The segments between a set and what is not in it, with the set's keys."""
    other = members.select(*keys, F.col("idx").alias("twin_idx"))
    return segs.join(members, "idx").join(other, [*keys, "twin_idx"], "left_anti")


def boundary_between(edges: DataFrame, a: Column, b: Column) -> Column:
    """Aggregate: metres of boundary from units of one set to units of another, given predicates on ``src`` and ``dst``."""
    return F.coalesce(F.sum(F.when(a & b, F.col("w"))), F.lit(0.0))
