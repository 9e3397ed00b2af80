import math

import pytest
from pyspark.sql import functions as F

from parcelloom.functions.measure import M_PER_DEG
from parcelloom.operators import districts, outline, topology
from tests.shapes import DONUT, GRID3, box, frame, plan, sets, squares


def test_two_squares_merge_to_six_outer_edges(spark):
    segs = topology.segments(squares(spark, [(0, 0), (1, 0)])).cache()
    members = spark.createDataFrame([(1, 0), (1, 1)], "k int, idx int")
    assert topology.boundary_segments(segs, members, ["k"]).count() == 6
    ring = outline.dissolved(segs, members, ["k"]).first()["geom"]
    assert len(ring) == 1 and len(ring[0]) == 1 and len(ring[0][0]) == 7
    total = topology.subset_perimeter(segs, members, ["k"]).first()["perimeter"]
    assert total == pytest.approx(segs.where("twin_idx is null").agg(F.sum("len_m")).first()[0])


def test_corner_neighbours_are_queen_only(spark):
    segs = topology.segments(squares(spark, [(0, 0), (1, 0), (0, 1)])).cache()
    rook, queen = sets(topology.rook_edges(segs), "src", "dst"), sets(topology.queen_edges(segs), "src", "dst")
    assert (1, 2) in queen and (1, 2) not in rook and rook < queen
    found = districts.components(topology.rook_edges(segs), plan(spark, [0, 1, 1])).where("district = 1")
    assert found.select("component").distinct().count() == 2


def test_centre_of_a_grid_is_inside_and_its_ring_encloses_it(spark):
    segs = topology.segments(squares(spark, GRID3)).cache()
    geom = topology.unit_geometry(segs).cache()
    inner = {r["idx"]: r for r in geom.collect()}
    assert inner[4]["ext_len"] == 0 and not inner[4]["is_exterior"] and sum(r["is_exterior"] for r in inner.values()) == 8
    members = spark.createDataFrame([(0, i) for i in range(9) if i != 4], "chain int, idx int")
    found = districts.enclaves(topology.rook_edges(segs), members, geom.select("idx", "is_exterior")).collect()
    assert [(r["component"], r["units"]) for r in found] == [(4, 1)]


def test_donut(spark):
    geoms = frame(spark, DONUT)
    segs = topology.segments(geoms).cache()
    geom = {r["idx"]: r for r in topology.unit_geometry(segs).collect()}
    assert {r["idx"]: r["holes"] for r in topology.geometry_stats(geoms, topology.unit_geometry(segs)).collect()}[0] == [1, 1, 1] or topology.geometry_stats(geoms, topology.unit_geometry(segs)).where("idx = 0").first()["holes"] == [3]
    rook = sets(topology.rook_edges(segs), "src", "dst")
    assert {(0, 1), (2, 3)} <= rook and (1, 2) not in rook and (1, 3) not in rook
    assert all((b, a) in rook for a, b in rook)
    gap = segs.where("idx = 0 and twin_idx is null and ax >= 12 and ax <= 13 and ay >= 2 and ay <= 8 and ring > 0").count()
    assert gap == 4
    assert geom[0]["area"] < geom[0]["area"] + geom[1]["area"] and topology.overlapping(segs).count() == 0
    whole = topology.unit_geometry(segs, subtract_holes=False).where("idx = 0").first()["area"]
    assert whole > geom[0]["area"]


def test_a_round_polygon_is_compact(spark):
    ring = [(1 + 0.5 * math.cos(2 * math.pi * i / 64), 1 + 0.5 * math.sin(2 * math.pi * i / 64)) for i in range(64)]
    row = topology.unit_geometry(topology.segments(frame(spark, [[[[*ring, ring[0]]]]]))).first()
    assert 0.98 < 4 * math.pi * row["area"] / row["perimeter"] ** 2 <= 1.0


def test_winding_closing_and_short_rings(spark):
    open_clockwise = box(0, 0, 1, 1)[::-1][:-1]
    r = topology.rings(frame(spark, [[[open_clockwise]]])).first()["points"]
    assert r[0] == r[-1] and outline.twice_area([(p["x"], p["y"]) for p in r]) == 2.0
    with pytest.raises(Exception, match="four points"):
        topology.rings(frame(spark, [[[[(0, 0), (1, 1)]]]])).collect()


def test_snapping_joins_near_vertices(spark):
    geoms = frame(spark, [[[box(0, 0, 1, 1)]], [[box(1.0005, 0, 2, 1)]], [[box(3, 0, 4, 1)]]])
    segs = topology.segments(geoms)
    assert topology.snap_pairs(segs, 1e-3).count() == 2 and topology.snap_pairs(segs, 1e-5).count() == 0
    moved = topology.snapped(segs, 1e-3)
    assert moved.select("x", "y").distinct().count() == 10 and moved.count() == 12


def test_forced_adjacency_keeps_weights(spark):
    segs = topology.segments(squares(spark, [(0, 0), (1, 0), (5, 5)]))
    pairs = spark.createDataFrame([(0, 1), (0, 2)], "a int, b int")
    e = {(r["src"], r["dst"]): r["w"] for r in topology.forced_adjacency(topology.rook_edges(segs), pairs).collect()}
    assert e[0, 2] == e[2, 0] == 0 and e[0, 1] == pytest.approx(M_PER_DEG)


def test_points_and_boxes(spark):
    geoms = frame(spark, DONUT)
    geom = topology.unit_geometry(topology.segments(geoms)).cache()
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 2.0, 5.0), (2, 12.5, 5.0), (3, 50.0, 50.0)], "pid int, x double, y double")
    assert sets(topology.units_at(points, geoms, geom, 2.0), "pid", "idx") == {(0, 0), (1, 1), (2, None), (3, None)}
    assert sets(topology.in_envelope(geom, 9, 3, 9.5, 4), "idx") == {(0,), (3,)}


def test_dissolve_hull_and_simplify(spark):
    segs = topology.segments(frame(spark, DONUT)).cache()
    whole = spark.createDataFrame([(1, i) for i in range(4)], "k int, idx int")
    geom = outline.dissolved(segs, whole, ["k"]).first()["geom"]
    assert len(geom) == 1 and len(geom[0]) == 2  # the gap stays a hole
    corner = outline.hulls(segs, whole, ["k"]).first()["geom"][0][0]
    assert len(corner) == 5
    wavy = [(0, 0), (0.5, 0.01), (1, 0), (1, 1), (0.5, 1.01), (0, 1), (0, 0)]
    two = topology.segments(frame(spark, [[[wavy]], [[[(0, 1), (0.5, 1.01), (1, 1), (1, 2), (0, 2), (0, 1)]]]]))
    same = {r["idx"]: len(r["geom"][0][0]) for r in outline.simplified_geoms(two, 0.0).collect()}
    less = {r["idx"]: r["geom"][0][0] for r in outline.simplified_geoms(two, 0.05).collect()}
    assert same == {0: 7, 1: 6} and len(less[0]) < 7 and len(less[1]) == 5
    shared = lambda ring: {frozenset(((p["x"], p["y"]), (q["x"], q["y"]))) for p, q in zip(ring, ring[1:])}
    assert frozenset(((0.0, 1.0), (1.0, 1.0))) in shared(less[0]) & shared(less[1])


def test_validate(spark):
    segs = topology.segments(squares(spark, GRID3))
    assert {r["n"] for r in topology.validate(segs, topology.rook_edges(segs), topology.unit_geometry(segs)).collect()} == {0}
    twice = topology.segments(squares(spark, [(0, 0), (0, 0)]))
    assert topology.overlapping(twice).count() == 4


def test_empty_map(spark):
    segs = topology.segments(frame(spark, []))
    assert topology.rook_edges(segs).count() == 0 and topology.unit_geometry(segs).count() == 0
