import json
import random

import pytest
from pyspark.sql import functions as F

from parcelloom.functions.metrics import Metric, Objective
from parcelloom.operators import districts, search, topology
from parcelloom.plans.api import Map, Plan
from tests.shapes import plan, squares

SIDE = 6


@pytest.fixture(scope="module")
def grid(spark):
    cells = [(x, y) for y in range(SIDE) for x in range(SIDE)]
    blocks = spark.createDataFrame([(i, f"17{'001' if x < 3 else '003'}0001001{i:03d}", f"b{i}", 10 + i % 5, 5 + i % 3, 4 + i % 4, 1.0e10) for i, (x, y) in enumerate(cells)], "idx int, geo_id string, name string, pop long, dem long, rep long, area_m2 double")
    for level, n in (("state", 2), ("county", 5), ("tract", 11), ("group", 12)):
        blocks = blocks.withColumn(f"parent_{level}", F.substring("geo_id", 1, n))
    blocks = blocks.withColumn("centroid_lon", F.col("idx") % SIDE + 0.5).withColumn("centroid_lat", F.floor(F.col("idx") / SIDE) + 0.5)
    return Map.build(spark, blocks, squares(spark, cells), [])


@pytest.fixture(scope="module")
def halves(spark, grid):
    return Plan(grid, 2, plan(spark, [1 if i % SIDE < 3 else 2 for i in range(SIDE * SIDE)]))


@pytest.fixture(scope="module")
def graph(grid):
    return grid.graph(["pop", "dem", "rep", "area_m2"])


def test_levels_add_up(grid):
    total = sum(10 + i % 5 for i in range(36))
    assert grid.units("state").first()["pop"] == total and grid.units("county").agg(F.sum("pop")).first()[0] == total
    assert [r["idx"] for r in grid.units("county").orderBy("idx").collect()] == [0, 1]


def test_plan_measures(halves, graph):
    chain = search.Chain(graph, 2, random.Random(0), [1 if i % SIDE < 3 else 2 for i in range(36)])
    totals = {r["district"]: r["pop"] for r in halves.district_totals("pop").collect()}
    assert [totals[1], totals[2]] == chain.total["pop"][1:]
    matrix = {(r["p"], r["q"]): r["perimeter"] for r in halves.perimeter_matrix().collect()}
    assert matrix[1, 2] == pytest.approx(matrix[2, 1]) and sum(v for (p, _), v in matrix.items() if p == 1) == pytest.approx(chain.perimeter[1])
    for m in (Metric.compactness(), Metric.schwartzberg(), Metric.deviation("pop"), Metric.deviation_smooth("pop"), Metric.deviation_sharp("pop"), Metric.deviation_absolute("pop"), Metric.lean("dem", "rep"), Metric.binary("dem", "rep", 0.05), Metric.quadratic("dem", "rep", 0.1), Metric.gaussian("dem", "rep", 0.2)):
        region = {s: sum(v) for s, v in graph.series.items()}
        ours = {r["district"]: r["value"] for r in halves.metric(m).collect()}
        assert ours == pytest.approx({d: search._metric(m, chain, d, region) for d in (1, 2)}), str(m)
    o = Objective([Metric.deviation_sharp("pop"), Metric.compactness()], [2.0, 1.0])
    assert halves.objective(o).first()["objective"] == pytest.approx(search.Scorer(o, chain).value())
    assert halves.objective(Objective(o.metrics, [0.0, 0.0])).first()["objective"] == 0.0
    with pytest.raises(ValueError):
        Objective(o.metrics, [1.0])


def test_empty_districts_count_as_zero(halves):
    wide = Plan(halves.map, 4, halves.rows)
    assert {r["district"]: r["pop"] for r in wide.district_totals("pop").collect()}[4] == 0
    assert {r["value"] for r in wide.metric(Metric.compactness()).where("district > 2").collect()} == {float("inf")}


def test_changes(spark, halves):
    moved = halves.move([0], 2)
    assert moved.contiguity().where("district = 2").first()["components"] == 2
    fixed = {r["idx"]: r["district"] for r in moved.ensure_contiguity().rows.collect()}
    assert fixed[0] == 1
    assert {r["district"] for r in halves.merge(1, 2).rows.collect()} == {1}
    county = halves.assign_unit("county", "17003", 1)
    assert county.rows.where("district = 2").count() == 0
    with pytest.raises(ValueError):
        halves.assign_units("county", ["99999"], 1)


def test_plan_csv_round_trip(spark, halves, tmp_path):
    from parcelloom.sources import tables

    holes = halves.move([3], 0)
    tables.write_plan(halves.map.units(), holes.rows, str(tmp_path / "plan"))
    back = tables.read_plan(spark, str(tmp_path / "plan"), halves.map.units())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, holes.rows.collect()))
    with pytest.raises(ValueError):
        tables.read_plan(spark, str(tmp_path / "plan"), halves.map.units(), strict=True)
    assert holes.to_csv().count("\n") == 36
    with pytest.raises(ValueError):
        holes.set_assignments(spark.createDataFrame([("x", 1)], "geo_id string, district int"))


def test_pack_round_trip(spark, grid, tmp_path):
    from parcelloom.sources import tables

    for fmt in tables.FORMATS:
        path = str(tmp_path / f"pack_{fmt}")
        manifest = grid.to_pack(path, fmt)
        assert manifest["counts"]["block"] == 36 and tables.validate_pack(spark, path) == []
        back = Map.from_pack(spark, path)
        a = sorted(map(tuple, grid.units().select("idx", "geo_id", "parent_county", "pop").collect()))
        assert a == sorted(map(tuple, back.units().select(F.col("idx").cast("int"), "geo_id", "parent_county", F.col("pop").cast("long")).collect()))
        assert back.edges().count() == grid.edges().count()


def test_exports(halves):
    doc = json.loads(halves.to_geojson())
    assert len(doc["features"]) == 36 and doc["features"][0]["geometry"]["coordinates"][0][0][0] == [0.0, 0.0]
    assert doc["features"][0]["properties"]["_hash"].endswith(":1")
    assert halves.to_svg().count("<path") == 2 and halves.map.to_svg(series="pop", edges=True).count("<line") == 60
    from parcelloom.sources import wkb

    for r in halves.geometries_wkb().collect():
        geom = wkb.decode(bytes(r["wkb"]))
        assert len(geom) == 1 and wkb.encode(geom) == bytes(r["wkb"])


def check(chain):
    size, total, perimeter = chain.check()
    assert size == chain.size and perimeter == pytest.approx(chain.perimeter, abs=1e-6)
    assert all(total[s] == pytest.approx(chain.total[s], abs=1e-6) for s in total)
    cross = [sum(chain.of[v] != d for v, _ in chain.g.near[u]) for u, d in enumerate(chain.of)]
    assert cross == chain.cross
    assert all(sorted(f) == [u for u, c in enumerate(cross) if c and chain.of[u] == d] for d, f in enumerate(chain.frontier))


@pytest.mark.parametrize("seed", range(3))
def test_searches_keep_their_books(graph, seed):
    chain = search.Chain(graph, 4, random.Random(seed))
    chain.randomize()
    check(chain)
    assert chain.size[0] == 0 and chain.contiguous()
    chain.equalize("pop", 0.05, 200)
    check(chain)
    assert chain.contiguous() and max(abs(x - sum(chain.total["pop"]) / 4) for x in chain.total["pop"][1:]) < 60
    before = chain.balance_cost("pop", 0.0)
    chain.tabu_balance("pop", 60, 5, 0.0, 6)
    assert chain.balance_cost("pop", 0.0) <= before + 1e-9
    chain.anneal_balance("pop", 500, 10.0, 0.01, 0.2)
    chain.recombine_some(10, "pop")
    check(chain)
    assert chain.contiguous()
    o = Objective([Metric.deviation_sharp("pop"), Metric.compactness()], [2.0, 1.0])
    start = search.Scorer(o, chain).value()
    trace = search.anneal(chain, [search.Phase(o, 0.3, 0.02, 0.2)], search.AnnealOptions(max_iter=1500))
    check(chain)
    assert chain.contiguous() and search.Scorer(o, chain).value() >= start - 1e-9 and trace[-1][0] <= 1500


def test_contiguity_checks_agree_with_components(graph):
    rng = random.Random(5)
    for _ in range(20):
        chain = search.Chain(graph, 3, rng)
        chain.randomize()
        for u in rng.sample(range(36), 8):
            d = chain.of[u]
            cut = chain.pieces_without(u)
            chain.of[u] = 0
            parts = chain.components(d)
            chain.of[u] = d
            assert sorted(map(len, cut)) == sorted(map(len, parts))[:-1]
            to = chain.random_neighbour(u)
            if to:
                assert chain.allowed([u], to) == (len(parts) <= 1)


def test_trees_span_and_cut_near_half(graph):
    chain = search.Chain(graph, 2, random.Random(1), [1] * 18 + [2] * 18)
    order, parent = chain.spanning_tree(list(range(36)))
    assert sorted(order) == list(range(36)) and all(p < i for i, p in enumerate(parent) if i)
    part = chain.balanced_cut(order, parent, graph.series["pop"])
    assert 0 < len(part) < 36
    assert not chain.recombine(1, 3, "pop") if chain.n > 2 else True


def test_same_seed_same_chains(spark, grid, graph):
    run = lambda: sorted(map(tuple, search.plans_of(search.ensemble(spark, graph, 3, 2, 9, lambda c: c.recombine_some(5, "pop"))).collect()))
    a = run()
    assert a == run() and len(a) == 72
    plans = Plan(grid, 3).randomize(seed=4, chains=2)
    assert plans.contiguity().where("not contiguous").count() == 0
    annealed, trace = plans.anneal([search.Phase(Objective([Metric.deviation_sharp("pop")]), 0.3, 0.05, 0.2)], search.AnnealOptions(max_iter=300), chains=2)
    assert annealed.rows.count() == 72 and trace.count() > 0


def test_null_and_unknown_units(spark, grid):
    edges = topology.rook_edges(grid.segments())
    assert districts.cross_edges(edges, plan(spark, [1])).count() == 0
    assert districts.contiguity(edges, plan(spark, []), 2).count() == 0


def test_configured_run(spark, grid, tmp_path):
    from parcelloom.plans import experiment

    phase = {"start_prob": 0.3, "end_prob": 0.1, "cooling_rate": 0.2, "weights": {"population": 2.0, "compactness": 1.0}}
    config = {"num_districts": 3, "max_iter": 300, "init_temp": 1.0, "batch_size": 50, "temp_search_batch_size": 25, "competitiveness_threshold": 0.05, "phases": [phase, {**phase, "end_prob": None, "early_stop_iters": 100}]}
    plans, scores, log = experiment.run(grid, json.dumps(config), "pop", "dem", "rep", chains=2, equalize_iter=50)
    assert plans.contiguity().where("not contiguous").count() == 0 and scores.count() == 2 and log.select("phase").distinct().count() >= 1
    experiment.save(plans, str(tmp_path / "plans"))
    assert spark.read.option("header", True).csv(str(tmp_path / "plans")).count() == 72
    with pytest.raises(ValueError):
        experiment.objective_of({"beauty": 1.0}, "pop", "dem", "rep", 0.05)


def test_chains_go_on_from_their_own_plans(grid):
    start = Plan(grid, 3).randomize(seed=5, chains=4)
    out = start.equalize("pop", 0.3, 1)
    before, after = ({r["chain"]: r["districts"] for r in x.dense().collect()} for x in (start, out))
    assert sorted(after) == sorted(before) == [0, 1, 2, 3]
    assert len({tuple(v) for v in before.values()}) > 1 and len({tuple(v) for v in after.values()}) > 1
    same = start.equalize("pop", 100.0, 1)  # nothing to do
    assert {r["chain"]: r["districts"] for r in same.dense().collect()} == before
    more = start.equalize("pop", 100.0, 1, chains=6)
    assert {r["chain"]: r["districts"] for r in more.dense().collect()} == {k: before[k % 4] for k in range(6)}
    assert {r["chain"]: r["met"] for r in start.within("pop", 100.0).collect()} == dict.fromkeys(range(4), True)


def test_dense_plans_and_files(grid, halves, tmp_path):
    from parcelloom.sources import tables

    tables.write_plan(grid.units(), halves.rows, str(tmp_path / "plan.csv"))
    districts_ = halves.dense().first()["districts"]
    assert Plan(grid, 2).load_csv(str(tmp_path / "plan.csv")).dense().first()["districts"] == districts_
    assert Plan(grid, 2).set_dense(districts_).dense().first()["districts"] == districts_
    with pytest.raises(ValueError):
        Plan(grid, 2).set_dense([3] * 36)
    one = json.loads(grid.to_geojson(("pop",), (0.1, 0.1, 0.9, 0.9)))
    assert len(one["features"]) < 36


def test_moves_that_break_a_district(grid, halves):
    ask = lambda units, d: districts.movable(grid.edges(), halves.rows, units, d).first().asDict()
    assert ask([2], 2)["allowed"] and not ask([0], 2)["contiguous"]
    assert not ask([2, 3], 2)["one_part"] and not ask([6, 7, 8], 2)["contiguous"]


def test_layers_have_outlines_and_parents(grid):
    county = grid.layers["county"]
    assert {r["parent_state"] for r in county["units"].collect()} == {"17"} and "parent_county" not in county["units"].columns
    boxes = {(r["minx"], r["miny"], r["maxx"], r["maxy"]) for r in grid.geometry("county").collect()}
    assert boxes == {(0.0, 0.0, 3.0, 6.0), (3.0, 0.0, 6.0, 6.0)}
    assert grid.to_svg(level="county").count("<path d") == 2
    assert len(json.loads(grid.to_geojson(("pop",), (0.0, 0.0, 2.5, 1.0), "county"))["features"]) == 1
    assert {(r["src"], r["dst"]) for r in grid.edges("county").collect()} == {(0, 1), (1, 0)}
    assert grid.centroids().where("isnan(centroid_lon)").count() == 0 and grid.centroids("county").where("isnan(centroid_lon)").count() == 2


def test_build_snaps(spark):
    from tests.shapes import box, frame

    geoms = frame(spark, [[[box(0, 0, 1, 1)]], [[box(1.0001, 0, 2, 1)]], [[box(5, 5, 5.0001, 5.0001)]]])
    blocks = spark.createDataFrame([(i, f"17001000100100{i}", f"b{i}", 1, "17") for i in range(3)], "idx int, geo_id string, name string, pop long, parent_state string")
    assert Map.build(spark, blocks, geoms, []).edges().count() == 0
    assert {(r["src"], r["dst"]) for r in Map.build(spark, blocks, geoms, [], snap=0.001).edges().collect()} == {(0, 1), (1, 0)}


def test_runs_go_on_across_spans(spark):
    from parcelloom.operators.trace import islands

    phases = [0, 0, 0, 1, 1, 1, 1, 1, 0, 2, None, None, None]
    trace = spark.createDataFrame([(c, i, p) for c in (0, 1) for i, p in enumerate(phases)], "chain int, iter long, phase int")
    want = {(c, *x) for c in (0, 1) for x in ((0, 0, 2, 3), (1, 3, 7, 5), (0, 8, 8, 1), (2, 9, 9, 1), (None, 10, 12, 3))}
    for span in (1, 2, 3, 100):
        assert {tuple(r) for r in islands(trace, span).select("chain", "phase", "first_iter", "last_iter", "rows").collect()} == want


def test_archive_has_every_tile(spark, grid, tmp_path, monkeypatch):
    from parcelloom.sources import archive

    assert [archive.tile_id(1, x, y) for x, y in ((0, 0), (0, 1), (1, 1), (1, 0))] == [1, 2, 3, 4]
    assert sorted(archive.tile_id(3, x, y) for x in range(8) for y in range(8)) == list(range(21, 85))
    whole = grid.tiles(range(4, 9)).collect()
    for most, leaf in ((16384, 4096), (0, 5)):
        monkeypatch.setattr(archive, "ROOT_MOST", most)
        monkeypatch.setattr(archive, "LEAF", leaf)
        path = tmp_path / f"{leaf}.pmtiles"
        assert grid.to_archive(str(path), range(4, 9)) == len(whole) > 5
        assert archive.read_archive(path.read_bytes()) == {archive.tile_id(r["zoom"], r["x"], r["y"]): bytes(r["tile"]) for r in whole}
