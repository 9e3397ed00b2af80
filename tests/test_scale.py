"""What large maps need: rounds, tasks and memory that don't grow with their shape."""

import pickle
import random
import tracemalloc

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parcelloom.operators import components, rollup, search
from parcelloom.sources import wkb

PATHS = [list(range(200)), list(range(499, 299, -1))]  # one in the order of its numbers, one against it


@pytest.mark.parametrize("local", [0, 10**6])
def test_long_paths_are_one_component(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    edges = spark.createDataFrame([(k, *e) for k in (0, 1) for path in PATHS for e in zip(path, path[1:])], "chain int, a int, b int")
    nodes = spark.range(600).selectExpr("cast(id as int) as node").crossJoin(spark.createDataFrame([(0,), (1,), (2,)], "chain int"))
    found = components.component_labels(nodes, edges, ["chain"], most_rounds=12)
    assert found.dtypes == [("chain", "int"), ("node", "int"), ("root", "int")]
    want = lambda k, v: v if k == 2 else 0 if v < 200 else 300 if 300 <= v < 500 else v
    rows = found.collect()
    assert len(rows) == 1800 and all(r["root"] == want(r["chain"], r["node"]) for r in rows)


@pytest.mark.parametrize("local", [0, 50])
def test_components_of_random_edges(spark, monkeypatch, local):
    monkeypatch.setattr(components, "LOCAL_EDGES", local)
    rng = random.Random(local)
    edges = [(rng.randrange(400) * 10**12, rng.randrange(400) * 10**12) for _ in range(230)]
    least = {v * 10**12: v * 10**12 for v in range(400)}
    for _ in range(400):
        for a, b in edges:
            least[a] = least[b] = min(least[a], least[b])
    nodes = spark.createDataFrame([(v,) for v in least], "node long")
    found = components.component_labels(nodes, spark.createDataFrame(edges, "a long, b long"), [])
    assert {r["node"]: r["root"] for r in found.collect()} == least


def test_rows_are_numbered_in_many_tasks(spark):
    keys = [None, *(("a", "b", "b", "b")[i % 4] for i in range(3000))]  # most rows are of one group
    df = spark.createDataFrame([(k, (i * 7919) % 3001, f"x{i}") for i, k in enumerate(keys)], "k string, v int, name string").repartition(7)
    held = {"spark.sql.shuffle.partitions": "8", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {c: spark.conf.get(c) for c in held}
    for c, v in held.items():
        spark.conf.set(c, v)
    try:
        out = rollup.row_index(df, "k", ["v"], "n")
        assert out.dtypes == [*df.dtypes, ("n", "int")]
        tasks = out.groupBy(F.input_file_name()).count().collect()
        assert len(tasks) >= 7 and max(r["count"] for r in tasks) < 1000
        assert rollup.row_index(df.where("v < 0"), "k", ["v"]).count() == 0
    finally:
        for c, v in was.items():
            spark.conf.set(c, v)
    rows = sorted(out.collect(), key=lambda r: r["n"])
    assert [r["n"] for r in rows] == list(range(3001))
    assert [(r["k"], r["v"]) for r in rows] == sorted(((r["k"], r["v"]) for r in rows), key=lambda r: (r[0] is not None, r[0] or "", r[1]))


def test_a_map_is_not_joined_in_one_task(spark):
    # numbers of groups are offsets of a single task: the map must not be joined to them there
    from parcelloom.operators import topology
    from parcelloom.plans.gridmap import grid_map

    plan = topology.rook_edges(grid_map(spark, "/root/testdata/sf0.001").segments())._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Exchange hashpartitioning(_w0" in plan


def _geoms(rng, n):
    ring = lambda: [{"x": rng.uniform(-180, 180), "y": rng.uniform(-90, 90)} for _ in range(rng.randint(0, 9))]
    return [None if i % 7 == 3 else [[ring() for _ in range(rng.randint(0, 3))] for _ in range(rng.randint(0, 3))] for i in range(n)]


def test_wkb_columns_are_those_of_single_values():
    geoms = pa.array(_geoms(random.Random(1), 200), pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
    for part in (geoms, geoms.slice(5, 60), geoms.slice(3, 1), geoms.slice(0, 0)):
        raw = wkb.encoded(part)
        assert raw.to_pylist() == [None if g is None else wkb.encode(g) for g in part.to_pylist()]
        assert wkb.decoded(raw).to_pylist() == part.to_pylist()
    with pytest.raises(ValueError):
        wkb.encoded(pa.array([[[None]]], geoms.type))


def test_wkb_columns_take_no_object_for_each_point():
    # 2 M points are 32 MB; a tuple and two floats for each were 200 MB and more
    geoms = pa.array([[[[(float(i), float(j)) for j in range(50)]]] for i in range(400)], pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))))
    geoms = pa.concat_arrays([geoms] * 100)
    tracemalloc.start()
    try:
        raw = wkb.encoded(geoms)
        wkb.decoded(raw)
        assert tracemalloc.get_traced_memory()[1] < 190e6
    finally:
        tracemalloc.stop()


def test_a_graph_is_sent_as_a_place_in_the_shared_folder(spark):
    n = 3000
    units = spark.range(n).selectExpr("cast(id as int) as idx", "id % 9 as pop").repartition(3)
    one = spark.range(n - 1).selectExpr("cast(id as int) as src", "cast(id + 1 as int) as dst", "cast(id as double) as w")
    edges = one.unionByName(one.selectExpr("dst as src", "src as dst", "w")).repartition(3)
    outer = units.where("idx % 2 = 0").selectExpr("idx", "2.0D as outer_perimeter_m")
    graph = search.Graph.collect(units, edges, outer, ["pop"])
    assert len(pickle.dumps(graph)) < 1000 and not {"near", "outer", "series"} & set(vars(graph))
    assert [graph.near[i] for i in (0, 1, 2998, 2999)] == [[(1, 0.0)], [(0, 0.0), (2, 1.0)], [(2997, 2997.0), (2999, 2998.0)], [(2998, 2998.0)]]
    assert list(graph.outer) == [2.0, 0.0] * 1500 and list(graph.series["pop"]) == [float(i % 9) for i in range(n)]
    assert len(pickle.dumps(graph)) < 1000
    with pytest.raises(ValueError):
        search.Graph.collect(units.where("idx <> 7"), edges, outer, ["pop"])
    assert list(search.Graph.collect(units.where("idx = 0"), edges.where("src < 0"), outer, []).near[0]) == []
