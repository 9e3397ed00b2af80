"""Queries over the grid map, and SQL for each that derives the same rows from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelloom.functions import ids, measure, metrics
from parcelloom.functions.metrics import Metric, Objective
from parcelloom.operators import districts, rollup, topology
from parcelloom.plans import scoring
from parcelloom.plans.gridmap import Derived, GridMap, grid_map, grid_plan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# ---- the same map in SQL: integer grid coordinates, neighbours by offsets ----
_MAP = """
WITH c0 AS (SELECT CAST(row_number() OVER (ORDER BY c_nationkey, c_custkey) - 1 AS INTEGER) AS idx, c_custkey, c_name AS name, c_acctbal AS acctbal, n_nationkey, n_regionkey,
  lpad(CAST(n_regionkey + 1 AS VARCHAR), 2, '0') || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') || lpad(CAST(c_custkey AS VARCHAR), 10, '0') AS geo_id FROM customer JOIN nation ON c_nationkey = n_nationkey),
wd AS (SELECT CAST(ceil(sqrt(count(*))) AS INTEGER) AS w FROM c0),
oc AS (SELECT o_custkey, count(*) AS pop, count(*) FILTER (WHERE o_orderstatus = 'F') AS dem, count(*) FILTER (WHERE o_orderstatus = 'O') AS rep FROM orders GROUP BY 1),
u AS (SELECT c0.*, CAST(idx // w AS INTEGER) AS gy, CAST(CASE WHEN (idx // w) % 2 = 0 THEN idx % w ELSE w - 1 - idx % w END AS INTEGER) AS gx, CAST(coalesce(pop, 0) AS BIGINT) AS pop, CAST(coalesce(dem, 0) AS BIGINT) AS dem, CAST(coalesce(rep, 0) AS BIGINT) AS rep,
  substr(geo_id, 1, 2) AS parent_state, substr(geo_id, 1, 5) AS parent_county, substr(geo_id, 1, 11) AS parent_tract, substr(geo_id, 1, 12) AS parent_group, substr(geo_id, 1, 5) || lpad(CAST(c_custkey % 7 AS VARCHAR), 6, '0') AS parent_vtd
  FROM c0 CROSS JOIN wd LEFT JOIN oc ON c_custkey = o_custkey),
sides AS (SELECT * FROM (VALUES (0, 0, -1), (1, 1, 0), (2, 0, 1), (3, -1, 0)) t(pos, dx, dy)),
s AS (SELECT a.idx, pos, b.idx AS twin_idx, CASE WHEN dx = 0 THEN 0.01::DOUBLE * cos(radians(40::DOUBLE + 0.01::DOUBLE * (a.gy + CASE WHEN dy > 0 THEN 1 ELSE 0 END))) * 111320 ELSE 0.01::DOUBLE * 111320 END AS len_m
  FROM u a CROSS JOIN sides LEFT JOIN u b ON b.gx = a.gx + dx AND b.gy = a.gy + dy),
e AS (SELECT idx AS src, twin_idx AS dst, len_m AS w FROM s WHERE twin_idx IS NOT NULL),
ug AS (SELECT idx, sum(len_m) AS perimeter, coalesce(sum(len_m) FILTER (WHERE twin_idx IS NULL), 0) AS ext_len, bool_or(twin_idx IS NULL) AS is_exterior FROM s GROUP BY 1),
p AS (SELECT idx, CAST({district} AS INTEGER) AS district FROM u),
pe AS (SELECT src, dst, w, a.district AS p, b.district AS q FROM e JOIN p a ON src = a.idx JOIN p b ON dst = b.idx),
pm AS (SELECT p, q, sum(m) AS perimeter FROM (SELECT p, q, w AS m FROM pe WHERE p <> q UNION ALL SELECT district, 0, ext_len FROM p JOIN ug USING (idx) WHERE district > 0 AND ext_len > 0 UNION ALL SELECT 0, district, ext_len FROM p JOIN ug USING (idx) WHERE district > 0 AND ext_len > 0) GROUP BY 1, 2),
dt AS (SELECT CAST(d AS INTEGER) AS district, CAST(coalesce(sum(pop), 0) AS BIGINT) AS pop, CAST(coalesce(sum(dem), 0) AS BIGINT) AS dem, CAST(coalesce(sum(rep), 0) AS BIGINT) AS rep, count(u.idx) AS units FROM range(0, {n} + 1) t(d) LEFT JOIN p ON district = d LEFT JOIN u ON u.idx = p.idx GROUP BY 1)
"""
_RULE = {"nation": ("n_nationkey + 1", 25), "region": ("n_regionkey + 1", 5), "stripe": ("gy // 5 + 1", 8), "holes": ("CASE WHEN idx % 7 = 0 THEN 0 ELSE n_nationkey + 1 END", 25), "empty": ("n_nationkey + 1", 27)}


def _sql(body: str, rule: str = "nation", recursive: bool = False) -> str:
    district, n = _RULE[rule]
    text = _MAP.replace("{district}", district).replace("{n}", str(n)) + body
    return text.replace("WITH c0", "WITH RECURSIVE c0", 1) if recursive else text


def query(sql: str | None = None, rule: str = "nation", recursive: bool = False, plain: bool = False):
    """Register a function of a map (and what is derived from it) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(grid_map(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql if plain else _sql(sql, rule, recursive)
        return f

    return register


def _plan(g: GridMap, rule: str = "nation") -> DataFrame:
    return grid_plan(g, "nation" if rule == "empty" else rule)


# ---- sources, ids, merges, roll-ups ----


@query("SELECT idx, geo_id, name, gx, gy, pop, dem, rep FROM u")
def units(g):
    return g.units.select("idx", "geo_id", "name", "gx", "gy", "pop", "dem", "rep")


@query("SELECT idx, parent_state, parent_county, parent_tract, parent_group FROM u")
def parent_prefix(g):
    return g.units.select("idx", *(ids.parent(F.col("geo_id"), x).alias(f"parent_{x}") for x in ids.LEVELS[:4]))


@query("SELECT geo_id, substr(geo_id, 1, 5) || CAST(c_custkey % 7 AS VARCHAR) AS parent_vtd FROM u WHERE c_custkey % 11 <> 0")
def vtd_crosswalk(g):
    rows = g.units.select(F.col("geo_id").alias("BLOCKID"), F.when(F.col("c_custkey") % 11 != 0, (F.col("c_custkey") % 7).cast("string")).alias("DISTRICT"))
    return ids.crosswalk(rows)


@query("SELECT idx, lpad(ltrim(geo_id, '0'), CAST((SELECT max(length(ltrim(geo_id, '0'))) FROM u) AS INTEGER), '0') AS geo_id, parent_state, CASE WHEN idx % 5 = 0 THEN NULL ELSE parent_county END AS parent_county FROM u")
def csv_normalize(g):
    raw = g.units.select("idx", F.ltrim(F.col("geo_id"), F.lit("0")).alias("geo_id"), F.ltrim(F.col("parent_state"), F.lit("0")).alias("parent_state"), F.when(F.col("idx") % 5 == 0, " ").otherwise(F.ltrim(F.col("parent_county"), F.lit("0"))).alias("parent_county"))
    return ids.normalised(raw)


@query("SELECT idx, lpad(CAST(CAST(geo_id AS BIGINT) AS VARCHAR), 15, '0') AS geo_id FROM u")
def geoid_pad(g):
    return g.units.select("idx", ids.padded(F.col("geo_id").cast("long")).alias("geo_id"))


@query("SELECT idx, geo_id, pop, CAST(c_custkey * 2 AS BIGINT) AS extra FROM u")
def merge_data(g):
    data = g.units.select("geo_id", (F.col("c_custkey") * 2).alias("extra"))
    return rollup.merge_attributes(g.units.select("idx", "geo_id", "pop"), data)


@query("SELECT geo_id, CASE WHEN idx % 3 = 0 THEN 'left' ELSE 'right' END AS side FROM u WHERE idx % 3 = 0 OR idx % 3 = 1 AND idx % 2 = 0")
def merge_unmatched(g):
    return rollup.unmatched(g.units.where("idx % 3 = 0 or idx % 3 = 2"), g.units.where("idx % 3 = 2 or idx % 3 = 1 and idx % 2 = 0"))


_LEVEL_SUM = " UNION ALL ".join(f"SELECT '{x}' AS layer, parent_{x} AS geo_id, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(dem) AS BIGINT) AS dem, CAST(sum(rep) AS BIGINT) AS rep, round(sum(acctbal), 2) AS acctbal FROM u GROUP BY 2" for x in ids.LEVELS[:5])


@query(_LEVEL_SUM)
def layer_rollup(g):
    parents = [f"parent_{x}" for x in ids.LEVELS[:5]]
    return rollup.roll_up(g.units.select("pop", "dem", "rep", "acctbal", *parents)).withColumn("acctbal", F.round("acctbal", 2))


@query("SELECT 'idx' AS name, 'long' AS kind WHERE false UNION ALL SELECT * FROM (VALUES ('acctbal', 'double'), ('pop', 'bigint'), ('dem', 'bigint'), ('rep', 'bigint')) t(name, kind)", plain=True)
def series_list(g):
    w = rollup.weights(g.units.select("idx", "geo_id", "pop", "dem", "rep", "acctbal"))
    return g.units.sparkSession.createDataFrame([(n, t) for n, t in w.dtypes if n != "idx"], "name string, kind string")


@query("SELECT u.idx, u.geo_id, parent_state, parent_county, parent_tract, parent_group, parent_vtd FROM u")
def attach_parents(g):
    vtd = g.units.select("geo_id", "parent_vtd")
    return rollup.attach_parents(g.units.select("idx", "geo_id"), vtd)


@query("SELECT n_name AS name, upper(substr(n_name, 1, 2)) AS postal FROM nation WHERE false UNION ALL SELECT * FROM (VALUES ('Illinois', '17'), ('Texas', '48'), (NULL, NULL)) t(name, postal)", plain=True)
def state_lookup(g):
    df = g.units.sparkSession.createDataFrame([("il",), ("TX",), ("??",)], "p string")
    fips, name = ids.state_lookup(F.col("p"))
    return df.select(name.alias("name"), fips.alias("postal"))


# ---- topology ----


@query("SELECT idx, pos, coalesce(twin_idx, -1) AS twin_idx, round(len_m, 2) AS len_m FROM s")
def segments(g):
    return g.segments().select("idx", "pos", F.coalesce("twin_idx", F.lit(-1)).alias("twin_idx"), F.round("len_m", 2).alias("len_m"))


@query("SELECT idx, count(*) AS n FROM s WHERE twin_idx IS NULL GROUP BY 1")
def twin_exterior(g):
    return g.segments().where("twin_idx is null").groupBy("idx").agg(F.count("*").alias("n"))


@query("SELECT src, dst, round(w, 2) AS w FROM e")
def rook_edges(g):
    return topology.rook_edges(g.segments()).withColumn("w", F.round("w", 2))


_QUEEN = "SELECT a.idx AS src, b.idx AS dst FROM u a CROSS JOIN (SELECT x, y FROM range(-1, 2) r1(x) CROSS JOIN range(-1, 2) r2(y) WHERE x <> 0 OR y <> 0) JOIN u b ON b.gx = a.gx + x AND b.gy = a.gy + y"


@query(_QUEEN)
def queen_edges(g):
    return topology.queen_edges(g.segments())


@query("SELECT src AS idx, count(*) AS degree FROM e GROUP BY 1")
def degrees(g):
    return topology.degrees(topology.rook_edges(g.segments()))


@query("SELECT src, dst, CAST(row_number() OVER (ORDER BY src, dst) - 1 AS INTEGER) AS edge_id FROM e")
def edge_ids(g):
    return topology.numbered_edges(topology.rook_edges(g.segments()).select("src", "dst"))


_GEOM = """SELECT u.idx, round(perimeter, 2) AS perimeter, round(ext_len, 2) AS ext_len, is_exterior,
  round(abs((x0 * y0 - x1 * y0) * cos(radians(y0)) + (x1 * y1 - x1 * y0) * cos(radians((y0 + y1) / 2)) + (x1 * y1 - x0 * y1) * cos(radians(y1)) + (x0 * y0 - x0 * y1) * cos(radians((y0 + y1) / 2))) / 2 * 111320 * 111320 / 1000000, 3) AS area_km2
  FROM (SELECT idx, -90::DOUBLE + 0.01::DOUBLE * gx AS x0, -90::DOUBLE + 0.01::DOUBLE * (gx + 1) AS x1, 40::DOUBLE + 0.01::DOUBLE * gy AS y0, 40::DOUBLE + 0.01::DOUBLE * (gy + 1) AS y1 FROM u) u JOIN ug USING (idx)"""


@query(_GEOM)
def unit_geometry(g):
    d = Derived.of(g).geom
    return d.select("idx", F.round("perimeter", 2).alias("perimeter"), F.round("ext_len", 2).alias("ext_len"), "is_exterior", F.round(F.col("area") / 1000000, 3).alias("area_km2"))


@query("SELECT idx, round(-90 + 0.01::DOUBLE * (gx + 0.5::DOUBLE), 6) AS cx, round(40 + 0.01::DOUBLE * (gy + 0.5::DOUBLE), 6) AS cy, round(-90 + 0.01::DOUBLE * gx, 6) AS minx, round(40 + 0.01::DOUBLE * (gy + 1), 6) AS maxy FROM u")
def unit_centroid_bounds(g):
    d = Derived.of(g).geom
    return d.select("idx", *(F.round(c, 6).alias(c) for c in ("cx", "cy", "minx", "maxy")))


@query("SELECT idx, CAST(1 AS INTEGER) AS polygons, CAST(0 AS INTEGER) AS holes, is_exterior FROM ug")
def geometry_stats(g):
    return topology.geometry_stats(g.geoms, Derived.of(g).geom).withColumn("holes", F.aggregate("holes", F.lit(0), lambda a, x: a + x))


@query("SELECT idx, round(ext_len, 2) AS outer_perimeter_m FROM ug")
def outer_perimeter(g):
    return Derived.of(g).outer().withColumn("outer_perimeter_m", F.round("outer_perimeter_m", 2))


_FORCED = "SELECT src, dst, round(sum(w), 2) AS w FROM (SELECT src, dst, w FROM e UNION ALL SELECT idx, idx + 5, 0 FROM u WHERE idx % 50 = 0 AND idx + 5 < (SELECT count(*) FROM u) UNION ALL SELECT idx + 5, idx, 0 FROM u WHERE idx % 50 = 0 AND idx + 5 < (SELECT count(*) FROM u)) GROUP BY 1, 2"


@query(_FORCED)
def forced_adjacency(g):
    n = g.units.count()
    pairs = g.units.where((F.col("idx") % 50 == 0) & (F.col("idx") + 5 < n)).select(F.col("idx").alias("a"), (F.col("idx") + 5).alias("b"))
    return topology.forced_adjacency(topology.rook_edges(g.segments()), pairs).withColumn("w", F.round("w", 2))


def _shaken(g: GridMap) -> DataFrame:
    """The grid with units of even columns moved by a ten-thousandth of a degree."""
    shift = lambda p: F.struct((p["x"] + F.when(F.col("gx") % 2 == 0, 1e-4).otherwise(0.0)).alias("x"), p["y"].alias("y"))
    moved = F.transform("geom", lambda poly: F.transform(poly, lambda ring: F.transform(ring, shift)))
    return g.geoms.join(g.units.select("idx", "gx"), "idx").select("idx", moved.alias("geom"))


_SNAP = """, v AS (SELECT DISTINCT gx + dx AS vx, gy + dy AS vy, gx % 2 AS k FROM u CROSS JOIN (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) t(dx, dy))
SELECT CAST(count(*) AS BIGINT) AS pairs FROM v a JOIN v b ON a.vx = b.vx AND a.vy = b.vy AND a.k = 0 AND b.k = 1"""


@query(_SNAP)
def snap_pairs(g):
    return topology.snap_pairs(topology.segments(_shaken(g)), 2e-4).agg(F.count("*").alias("pairs"))


@query("SELECT count(DISTINCT (gx + dx, gy + dy)) AS vertices FROM u CROSS JOIN (VALUES (0, 0), (1, 0), (1, 1), (0, 1)) t(dx, dy)")
def snapped_vertices(g):
    return topology.snapped(topology.segments(_shaken(g)), 2e-4).agg(F.count_distinct("x", "y").alias("vertices"))


@query("SELECT src, dst FROM e")
def snapped_edges(g):
    """Neighbours of units that no longer fit, once their vertices are snapped: those of the whole grid."""
    return topology.rook_edges(topology.segments(topology.snapped_geoms(_shaken(g), 2e-4))).select("src", "dst")


@query("SELECT 'overlap' AS rule, CAST(4 * count(*) AS BIGINT) AS n FROM u WHERE gx % 5 = 0 HAVING count(*) > 0")
def validate_overlaps(g):
    """Every cell of each fifth column a second time, under another number: the rules that this breaks."""
    again = g.geoms.join(g.units.where("gx % 5 = 0").select("idx"), "idx").select((-1 - F.col("idx")).alias("idx"), "geom")
    segs = topology.segments(g.geoms.unionByName(again))
    return topology.validate(segs, topology.rook_edges(segs), topology.unit_geometry(segs)).where("n > 0")


@query("SELECT parent_county AS geo_id, parent_state, CAST(sum(pop) AS BIGINT) AS pop, count(*) AS blocks FROM u GROUP BY 1, 2")
def layer_geometry(g):
    """Counties of a built map with their parents and sums, and the blocks in their outlines, by area."""
    from parcelloom.functions.measure import signed_area
    from parcelloom.plans.api import Map
    from parcelloom.plans.gridmap import SIDE

    blocks = g.units.select("idx", "geo_id", "name", "pop", "centroid_lon", "centroid_lat", *(f"parent_{x}" for x in ("state", "county")))
    m = Map.build(g.units.sparkSession, blocks, g.geoms, [])
    areas = F.aggregate(F.flatten("geom"), F.lit(0.0), lambda a, r: a + signed_area(r))
    cells = m.layers["county"]["geoms"].select("idx", F.round(areas / (2 * SIDE * SIDE)).cast("long").alias("blocks"))
    return m.units("county").join(cells, "idx").select("geo_id", "parent_state", "pop", "blocks")


@query("SELECT * FROM (VALUES ('one-way edge', CAST(0 AS BIGINT)), ('overlap', CAST(0 AS BIGINT)), ('negative area', CAST(0 AS BIGINT)), ('loop', CAST(0 AS BIGINT))) t(rule, n)", plain=True)
def validate_region(g):
    d = Derived.of(g)
    return topology.validate(d.segs, d.edges, d.geom)


@query("SELECT idx FROM u WHERE -90 + 0.01::DOUBLE * (gx + 1) >= -89.985 AND -90 + 0.01::DOUBLE * gx <= -89.925 AND 40 + 0.01::DOUBLE * (gy + 1) >= 40.015 AND 40 + 0.01::DOUBLE * gy <= 40.035")
def units_in_envelope(g):
    return topology.in_envelope(Derived.of(g).geom, -89.985, 40.015, -89.925, 40.035).select("idx")


@query("SELECT idx AS pid, CAST(CASE WHEN idx % 4 = 0 THEN -1 ELSE idx END AS INTEGER) AS idx FROM u")
def unit_at(g):
    return _units_at(g, g.units)


def _units_at(g: GridMap, units: DataFrame) -> DataFrame:
    # every fourth point is off the map
    far = F.when(F.col("idx") % 4 == 0, 500.0).otherwise(0.0)
    points = units.select(F.col("idx").alias("pid"), (F.col("centroid_lon") + far).alias("x"), F.col("centroid_lat").alias("y"))
    return topology.units_at(points, g.geoms, Derived.of(g).geom, 0.02).na.fill(-1, ["idx"])


@query("SELECT n_nationkey, round(sum(len_m), 2) AS perimeter FROM (SELECT a.n_nationkey, len_m FROM s JOIN u a USING (idx) LEFT JOIN u b ON s.twin_idx = b.idx WHERE b.idx IS NULL OR b.n_nationkey <> a.n_nationkey) GROUP BY 1")
def subset_perimeter(g):
    members = g.units.select("idx", "n_nationkey")
    return topology.subset_perimeter(g.segments(), members, ["n_nationkey"]).withColumn("perimeter", F.round("perimeter", 2))


@query("SELECT s.idx, pos FROM s JOIN u a USING (idx) LEFT JOIN u b ON s.twin_idx = b.idx WHERE a.n_nationkey = 3 AND (b.idx IS NULL OR b.n_nationkey <> 3)")
def subset_boundary_segments(g):
    members = g.units.where("n_nationkey = 3").select("idx", F.lit(3).alias("k"))
    return topology.boundary_segments(g.segments(), members, ["k"]).select("idx", "pos")


@query("SELECT round(coalesce(sum(w), 0), 2) AS length FROM pe WHERE p = 3 AND q = 4")
def boundary_between(g):
    c = districts.cross_edges(topology.rook_edges(g.segments()), _plan(g))
    return c.agg(topology.boundary_between(c, F.col("p") == 3, F.col("q") == 4).alias("length")).withColumn("length", F.round("length", 2))


# ---- plans ----


@query("SELECT district, pop, dem, rep FROM dt WHERE district > 0", "empty")
def district_totals(g):
    return districts.totals(g.units, _plan(g), ["pop", "dem", "rep"], 27).drop("chain")


@query("SELECT district, pop, dem, rep FROM dt", "holes")
def all_part_totals(g):
    return districts.totals(g.units, _plan(g, "holes"), ["pop", "dem", "rep"], 25, unassigned=True).drop("chain")


@query("SELECT CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(dem) AS BIGINT) AS dem FROM u")
def region_totals(g):
    # the rows of the state level
    return rollup.roll_up(g.units.select("pop", "dem", "parent_state")).where("layer = 'state'").agg(F.sum("pop").alias("pop"), F.sum("dem").alias("dem"))


@query("SELECT p, q, round(perimeter, 2) AS perimeter FROM pm", "holes")
def part_perimeters(g):
    d = Derived.of(g)
    return districts.perimeter_matrix(d.edges, _plan(g, "holes"), d.outer()).select("p", "q", F.round("perimeter", 2).alias("perimeter"))


@query("SELECT p AS district, round(sum(perimeter), 2) AS perimeter FROM pm GROUP BY 1")
def total_perimeters(g):
    d = Derived.of(g)
    return districts.perimeters(districts.perimeter_matrix(d.edges, _plan(g), d.outer())).select("district", F.round("perimeter", 2).alias("perimeter"))


@query("SELECT district, idx FROM p WHERE idx IN (SELECT src FROM pe WHERE p <> q) OR idx IN (SELECT idx FROM ug WHERE is_exterior)")
def frontier_units(g):
    d = Derived.of(g)
    return districts.frontier_units(d.edges, _plan(g), d.exterior()).drop("chain")


@query("SELECT src, dst FROM pe WHERE p <> q")
def frontier_edges(g):
    return districts.cross_edges(topology.rook_edges(g.segments()), _plan(g)).select("src", "dst")


@query("SELECT DISTINCT p, q FROM pm WHERE p <> 0 AND q <> 0", "holes")
def neighbor_parts(g):
    d = Derived.of(g)
    return districts.perimeter_matrix(d.edges, _plan(g, "holes"), d.outer()).where("p <> 0 and q <> 0").select("p", "q")


@query("SELECT arg_min(district, (pop, district)) AS district FROM dt WHERE district > 0")
def min_weight_part(g):
    return districts.min_weight(districts.totals(g.units, _plan(g), ["pop"], 25), "pop").drop("chain")


_CC = """, start AS (SELECT idx AS node, idx AS seen FROM u),
r AS (SELECT node, seen FROM start UNION SELECT r.node, pe.dst FROM r JOIN pe ON pe.src = r.seen AND pe.p = pe.q),
cc AS (SELECT p.idx, district, CAST(min(seen) AS INTEGER) AS component FROM r JOIN p ON p.idx = r.node GROUP BY 1, 2)
"""


@query(_CC + "SELECT district, idx, component FROM cc", "region", recursive=True)
def district_components(g):
    return districts.components(topology.rook_edges(g.segments()), _plan(g, "region")).drop("chain")


@query(_CC + "SELECT CAST(d AS INTEGER) AS district, count(DISTINCT component) AS components, count(DISTINCT component) <= 1 AS contiguous FROM range(1, 6) t(d) LEFT JOIN cc ON district = d GROUP BY 1", "region", recursive=True)
def is_contiguous(g):
    return districts.contiguity(topology.rook_edges(g.segments()), _plan(g, "region"), 5).drop("chain")


_RING = "gx BETWEEN 2 AND 6 AND gy BETWEEN 2 AND 6 AND NOT (gx BETWEEN 3 AND 5 AND gy BETWEEN 3 AND 5)"


@query("SELECT CAST(min(idx) AS INTEGER) AS component, count(*) AS units FROM u WHERE gx BETWEEN 3 AND 5 AND gy BETWEEN 3 AND 5")
def enclaves(g):
    d = Derived.of(g)
    members = g.units.where(_RING).select(F.lit(0).alias("chain"), "idx")
    return districts.enclaves(d.edges, members, d.geom.select("idx", "is_exterior")).drop("chain")


_REPAIR = (
    _CC
    + """, sz AS (SELECT district, component, count(*) AS n FROM cc WHERE district > 0 GROUP BY 1, 2),
rk AS (SELECT *, row_number() OVER (PARTITION BY district ORDER BY n DESC, component) AS r FROM sz),
ar AS (SELECT cc.component, pe.q, sum(pe.w) AS w FROM pe JOIN cc ON pe.src = cc.idx JOIN rk ON rk.component = cc.component AND rk.r > 1 WHERE pe.p <> pe.q GROUP BY 1, 2),
best AS (SELECT component, q, row_number() OVER (PARTITION BY component ORDER BY (q = 0) DESC, round(w, 6) DESC, q) AS k FROM ar)
SELECT cc.idx, CAST(coalesce(best.q, cc.district) AS INTEGER) AS district FROM cc LEFT JOIN best ON best.component = cc.component AND k = 1"""
)


@query(_REPAIR, "region", recursive=True)
def ensure_contiguity(g):
    edges = topology.rook_edges(g.segments()).withColumn("w", F.round("w", 6))
    return districts.repaired(edges, _plan(g, "region")).drop("chain")


@query("SELECT idx, CAST(CASE WHEN idx = 10 THEN 7 ELSE district END AS INTEGER) AS district FROM p")
def move_node(g):
    return districts.moved(_plan(g), [10], 7).drop("chain")


@query("SELECT idx, CAST(CASE WHEN idx IN (3, 4, 5) THEN 2 ELSE district END AS INTEGER) AS district FROM p")
def move_subgraph(g):
    return districts.moved(_plan(g), [3, 4, 5], 2).drop("chain")


@query("SELECT idx, CAST(CASE WHEN district IN (3, 4) AND (SELECT count(*) FROM pm WHERE p = 3 AND q = 4) > 0 THEN (SELECT CASE WHEN count(*) FILTER (WHERE district = 3) >= count(*) FILTER (WHERE district = 4) THEN 3 ELSE 4 END FROM p) ELSE district END AS INTEGER) AS district FROM p")
def merge_parts(g):
    d = Derived.of(g)
    return districts.merged(_plan(g), districts.perimeter_matrix(d.edges, _plan(g), d.outer()), 3, 4).drop("chain")


@query("SELECT p.idx, CAST(CASE WHEN parent_state = '02' THEN 9 ELSE district END AS INTEGER) AS district FROM p JOIN u USING (idx)")
def assign_units(g):
    return districts.assigned_by_parent(_plan(g), g.units, "parent_state", ["02"], 9).drop("chain")


@query("SELECT geo_id, district FROM p JOIN u USING (idx) WHERE district <> 0", "holes")
def plan_csv_rows(g):
    from parcelloom.sources.tables import plan_rows

    return plan_rows(g.units, _plan(g, "holes"))


# ---- metrics ----

_METRICS = {
    "population_deviation": (Metric.deviation("pop"), "dev"),
    "population_deviation_absolute": (Metric.deviation_absolute("pop"), "abs(dev)"),
    "population_deviation_smooth": (Metric.deviation_smooth("pop"), "(1 - dev * dev / (lim * lim)) / (1 + dev * dev)"),
    "population_deviation_sharp": (Metric.deviation_sharp("pop"), "least(1 - abs(dev), 1)"),
    "polsby_popper": (Metric.compactness(), "4 * pi() * area / (per * per)"),
    "schwartzberg": (Metric.schwartzberg(), "2 * pi() * sqrt(area / pi()) / per"),
    "partisan_lean": (Metric.lean("dem", "rep"), "lean"),
    "competitiveness_binary": (Metric.binary("dem", "rep", 0.02), "CASE WHEN abs(lean) / 2 <= 0.02 THEN 1::DOUBLE ELSE 0::DOUBLE END"),
    "competitiveness_quadratic": (Metric.quadratic("dem", "rep", 0.05), "CASE WHEN abs(lean) / 2 <= 0.05 THEN 1 - 2 / 0.05::DOUBLE * power(abs(lean) / 2, 2) ELSE 2 / 0.45::DOUBLE * power(0.5::DOUBLE - abs(lean) / 2, 2) END"),
    "competitiveness_gaussian": (Metric.gaussian("dem", "rep", 0.1), "exp(-power(abs(lean) / 2, 2) / (2 * 0.01::DOUBLE))"),
}
# a unit's area in the tables of the map: the square at its middle latitude
_AREA = "power(0.01::DOUBLE * 111320, 2) * cos(radians(40.005::DOUBLE + 0.01::DOUBLE * gy))"
_MV = f""", ar AS (SELECT district, sum({_AREA}) AS area FROM p JOIN u USING (idx) GROUP BY 1),
pl AS (SELECT p AS district, sum(perimeter) AS per FROM pm GROUP BY 1),
mv AS (SELECT district, pop::DOUBLE / ((SELECT sum(pop) FROM u) / 25::DOUBLE) - 1 AS dev, CASE WHEN pop::DOUBLE / ((SELECT sum(pop) FROM u) / 25::DOUBLE) - 1 <= 0 THEN 1::DOUBLE ELSE 24::DOUBLE END AS lim, area, per, CASE WHEN dem + rep = 0 THEN 0 ELSE (dem - rep)::DOUBLE / (dem + rep) END AS lean FROM dt JOIN ar USING (district) JOIN pl USING (district) WHERE district > 0)
"""


def _with_area(g: GridMap) -> DataFrame:
    from parcelloom.functions.measure import M_PER_DEG

    side = 0.01 * M_PER_DEG
    return g.units.withColumn("area_m2", F.cos(F.radians(F.col("centroid_lat"))) * (side * side))


def _table(g: GridMap, found: list[Metric]) -> DataFrame:
    d = Derived.of(g)
    return scoring.district_table(_with_area(g), d.edges, _plan(g), 25, found, d.outer())


def _register_metrics() -> None:
    for name, (metric, expression) in _METRICS.items():

        def run(g, name=name, metric=metric):
            return scoring.metric_values(_table(g, [metric]), {"value": metric}).select("district", (F.round("value", 6) + 0.0).alias("value"))

        run.__name__ = f"metric_{name}"
        query(_MV + f"SELECT district, round({expression}, 6) + 0 AS value FROM mv")(run)


_register_metrics()


@query("SELECT district, CASE WHEN pop = 0 THEN 0 ELSE round(dem::DOUBLE / pop, 6) END AS value FROM dt WHERE district > 0", "empty")
def metric_minority_opportunity(g):
    t = districts.totals(g.units, _plan(g), ["pop", "dem"], 27)
    return t.select("district", F.round(metrics.minority_opportunity(F.col("dem"), F.col("pop")), 6).alias("value"))


@query(_MV + "SELECT " + ", ".join(f"round(avg({x}), 6) + 0 AS {n}" for n, (_, x) in _METRICS.items()) + " FROM mv")
def metric_scores(g):
    found = {n: m for n, (m, _) in _METRICS.items()}
    s = scoring.metric_scores(scoring.metric_values(_table(g, list(found.values())), found), list(found))
    return s.select(*((F.round(c, 6) + 0.0).alias(c) for c in found))


@query(_MV + "SELECT round((2 * avg(least(1 - abs(dev), 1)) + 1 * avg(4 * pi() * area / (per * per)) + 0.5::DOUBLE * avg(exp(-power(abs(lean) / 2, 2) / (2 * 0.01::DOUBLE)))) / 3.5::DOUBLE, 6) AS objective FROM mv")
def objective_score(g):
    o = Objective([Metric.deviation_sharp("pop"), Metric.compactness(), Metric.gaussian("dem", "rep", 0.1)], [2.0, 1.0, 0.5])
    return scoring.objective_values(_table(g, o.metrics), o).select(F.round("objective", 6).alias("objective"))


@query(", t AS (SELECT sum(pop) / 25::DOUBLE AS t FROM u) SELECT round((SELECT sum(power(pop - t, 2) / t) FROM dt CROSS JOIN t WHERE district > 0) * 0.5::DOUBLE + (SELECT sum(w) / 2 FROM pe WHERE p <> q) * 0.5::DOUBLE, 2) AS cost")
def plan_cost_tabu(g):
    return scoring.tabu_cost(g.units, topology.rook_edges(g.segments()), _plan(g), "pop", 25, 0.5).select(F.round("cost", 2).alias("cost"))


@query("SELECT idx, CASE WHEN acctbal / 10000 - 1e-10 > 0 THEN 1::DOUBLE ELSE round(exp((acctbal / 10000 - 1e-10) / 0.3::DOUBLE), 6) END AS prob FROM u")
def acceptance_prob(g):
    return g.units.select("idx", F.round(scoring.acceptance(F.col("acctbal") / 10000, F.lit(0.3)), 6).alias("prob"))


@query("SELECT CAST(i AS BIGINT) AS i, round(100 * power(0.0001::DOUBLE, i / 50::DOUBLE), 6) AS temperature FROM range(0, 51) t(i)", plain=True)
def temp_schedule(g):
    return g.units.sparkSession.range(51).select(F.col("id").alias("i"), F.round(scoring.temperature_at(100.0, 0.01, F.col("id"), 50), 6).alias("temperature"))


# ---- export columns ----


@query("SELECT idx, geo_id, name, pop, geo_id AS hash, district, CASE WHEN district > 0 THEN 'hsl(' || CAST(district * 57 % 360 AS VARCHAR) || ' 70% 50%)' END AS district_color FROM u JOIN p USING (idx)", "holes")
def geojson_props(g):
    return g.units.join(_plan(g, "holes"), "idx").select("idx", "geo_id", "name", "pop", F.col("geo_id").alias("hash"), "district", measure.district_colour(F.col("district")).alias("district_color"))


_BREAKS = "".join(f" WHEN x < {measure.PARTISAN[i + 1][0]} THEN '#{r:02x}{gr:02x}{b:02x}'" for i, (_, r, gr, b) in enumerate(measure.PARTISAN[:-1]))


@query(f"SELECT idx, CASE{_BREAKS} ELSE '#0571b0' END AS colour FROM (SELECT idx, round((dem - rep)::DOUBLE / greatest(dem + rep, 1), 9) AS x FROM u)")
def partisan_color(g):
    lean = F.round((F.col("dem") - F.col("rep")) / F.greatest(F.col("dem") + F.col("rep"), F.lit(1)), 9)
    return g.units.select("idx", measure.partisan_colour(lean).alias("colour"))


@query("SELECT idx, format('#{:02x}{:02x}{:02x}', CAST(round(222 + t * -214) AS INTEGER), CAST(round(235 + t * -154) AS INTEGER), CAST(round(247 + t * -91) AS INTEGER)) AS colour FROM (SELECT idx, (pop - min(pop) OVER ())::DOUBLE / (max(pop) OVER () - min(pop) OVER ()) AS t FROM u)")
def choropleth_color(g):
    low = g.units.agg(F.min("pop").alias("lo"), F.max("pop").alias("hi"))
    return g.units.crossJoin(F.broadcast(low)).select("idx", measure.choropleth_colour(F.col("pop").cast("double"), F.col("lo"), F.col("hi")).alias("colour"))


@query("SELECT CAST(d AS INTEGER) AS district, printf('hsl(%.1f,70%%,55%%)', (d * 137.50776405::DOUBLE) % 360) AS colour FROM range(1, 26) t(d)", plain=True)
def golden_color(g):
    return g.units.sparkSession.range(1, 26).select(F.col("id").cast("int").alias("district"), measure.golden_colour(F.col("id")).alias("colour"))


_TILE = """SELECT idx, CAST(tx AS INTEGER) AS x, CAST(ty AS INTEGER) AS y FROM (SELECT idx,
  unnest(range(CAST(floor((90 + 0.01::DOUBLE * gx) / 360 * 4096) AS BIGINT), CAST(floor((90 + 0.01::DOUBLE * (gx + 1)) / 360 * 4096) AS BIGINT) + 1)) AS tx, gy FROM u) CROSS JOIN LATERAL (SELECT
  unnest(range(CAST(floor((1 - asinh(tan(radians(40 + 0.01::DOUBLE * (gy + 1)))) / pi()) / 2 * 4096) AS BIGINT), CAST(floor((1 - asinh(tan(radians(40 + 0.01::DOUBLE * gy))) / pi()) / 2 * 4096) AS BIGINT) + 1)) AS ty)"""


@query(_TILE)
def tile_cover(g):
    from parcelloom.sources.tiles import tile_cover as cover

    return cover(Derived.of(g).geom, 12).select("idx", "x", "y")


@query("SELECT idx, printf('M %.3f,%.3f L %.3f,%.3f L %.3f,%.3f L %.3f,%.3f Z', x, y + 10, x + 10, y + 10, x + 10, y, x, y) AS path FROM (SELECT idx, gx * 10::DOUBLE AS x, ((SELECT max(gy) FROM u) - gy) * 10::DOUBLE AS y FROM u)")
def svg_paths(g):
    from parcelloom.sources.render import Viewport, svg_path

    top = g.units.agg(F.max("gy")).first()[0] + 1
    view = Viewport(-90.0, 40.0 + 0.01 * top, 1000.0)
    return g.geoms.select("idx", svg_path(F.col("geom"), view).alias("path"))


@query("SELECT idx, CAST(9 + 9 + 4 + 5 * 16 AS INTEGER) AS bytes FROM u")
def wkb_rows(g):
    from parcelloom.sources.wkb import wkb_column

    return g.geoms.select("idx", F.octet_length(wkb_column(F.col("geom"))).alias("bytes"))


@query("SELECT parent_county AS parent, count(DISTINCT district) - 1 AS splits FROM p JOIN u USING (idx) WHERE district > 0 GROUP BY 1", "stripe")
def county_splits(g):
    from parcelloom.plans.experiment import county_splits as splits

    return splits(g.units, _plan(g, "stripe")).drop("chain")


@query("SELECT least(a.n_nationkey, b.n_nationkey) AS p, greatest(a.n_nationkey, b.n_nationkey) AS q, count(*) AS segments, round(sum(len_m), 2) AS length FROM s JOIN u a USING (idx) JOIN u b ON twin_idx = b.idx WHERE a.n_nationkey < b.n_nationkey GROUP BY 1, 2")
def common_segments(g):
    found = topology.common_segments(g.segments(), g.units.select("idx", "n_nationkey"), ["n_nationkey"])
    return found.groupBy("p", "q").agg(F.count("*").alias("segments"), F.round(F.sum("len_m"), 2).alias("length"))


_SUBSET = f"""SELECT n_nationkey, round(sum(area_km2), 2) AS area_km2, round(sum(ug.ext_len), 2) AS ext_len, round(min(-90 + 0.01::DOUBLE * gx), 6) AS minx, round(max(40 + 0.01::DOUBLE * (gy + 1)), 6) AS maxy
  FROM u JOIN ({_GEOM.replace("round(abs", "(abs").replace("/ 1000000, 3)", "/ 1000000)")}) g USING (idx) JOIN ug USING (idx) GROUP BY 1"""


@query(_SUBSET)
def subset_geometry(g):
    d = Derived.of(g)
    found = topology.subset_geometry(d.geom, d.segs, g.units.select("idx", "n_nationkey"), ["n_nationkey"])
    return found.select("n_nationkey", F.round(F.col("area") / 1000000, 2).alias("area_km2"), F.round("ext_len", 2).alias("ext_len"), F.round("minx", 6).alias("minx"), F.round("maxy", 6).alias("maxy"))


_BROKEN = """SELECT * FROM (SELECT 'one-way edge' AS rule, count(*) AS n FROM e WHERE dst % 10 = 0 AND dst < src
UNION ALL SELECT 'overlap', 4 * count(*) FROM u WHERE idx % 20 = 0 UNION ALL SELECT 'negative area', count(*) FROM u WHERE idx % 30 = 0 UNION ALL SELECT 'loop', count(*) FROM u WHERE idx % 25 = 0)"""


@query(_BROKEN)
def validate_broken_region(g):
    d = Derived.of(g)
    edges = d.edges.where("not (src % 10 = 0 and src < dst)").unionByName(g.units.where("idx % 25 = 0").select(F.col("idx").alias("src"), F.col("idx").alias("dst"), F.lit(0.0).alias("w")))
    return topology.validate(d.segs.unionByName(d.segs.where("idx % 20 = 0")), edges, d.geom.withColumn("area", F.when(F.col("idx") % 30 == 0, -1.0).otherwise(F.col("area"))))


@query("SELECT CAST(0 AS INTEGER) AS chain, true AS one_part, (SELECT count(*) FROM u) > 0 AS contiguous, true AS allowed")
def move_allowed(g):
    # the last unit of the snake is at an end of its district
    last = g.units.agg(F.max("idx")).first()[0]
    return districts.movable(topology.rook_edges(g.segments()), _plan(g), [last], 25)


# ---- files, written to the shared folder and read back ----


def _folder(g: GridMap, name: str) -> str:
    from parcelloom.storage import shared_folder

    return f"{shared_folder(g.units.sparkSession)}/{name}"


_BASE = "SELECT idx, geo_id, name, pop, parent_county FROM u"


def _base(g: GridMap) -> DataFrame:
    return g.units.select("idx", "geo_id", "name", "pop", "parent_county")


@query(_BASE)
def csv_round_trip(g):
    from parcelloom.sources.tables import read_csv

    path = _folder(g, "units.csv")
    _base(g).write.option("header", True).csv(path)
    return read_csv(g.units.sparkSession, path, "idx int, geo_id string, name string, pop long, parent_county string")


@query("SELECT CAST(n_nationkey AS INTEGER) AS key, n_name AS name FROM nation", plain=True)
def csv_text(g):
    from parcelloom.sources.tables import read_csv_text

    spark = g.units.sparkSession
    names = g.units.select("n_nationkey").distinct().count()
    rows = sorted((r["n_nationkey"], r["n_name"]) for r in spark.read.parquet(f"{g.folder}/nation.parquet").collect())
    assert names <= len(rows)
    return read_csv_text(spark, "key,name\n" + "".join(f"{k},{n}\n" for k, n in rows), "key int, name string")


@query("SELECT CAST(idx AS VARCHAR) AS idx, geo_id, name, CAST(pop AS VARCHAR) AS pop, parent_county FROM u")
def pipe_round_trip(g):
    from parcelloom.sources.tables import read_pipe

    path = _folder(g, "units.txt")
    _base(g).write.option("header", True).option("sep", "|").csv(path)
    return read_pipe(g.units.sparkSession, path)


@query("SELECT idx, district FROM p", "holes")
def plan_csv_round_trip(g):
    from parcelloom.sources.tables import read_plan, write_plan

    path = _folder(g, "plan.csv")
    write_plan(g.units, _plan(g, "holes"), path)
    return read_plan(g.units.sparkSession, path, g.units).drop("chain")


def _pack(g: GridMap, fmt: str) -> tuple[str, dict]:
    from parcelloom.sources.tables import write_pack

    path = _folder(g, "map")
    sums = rollup.roll_up(g.units.select("pop", "dem", "rep", "parent_state"))
    states = rollup.row_index(sums.where("layer = 'state'").drop("layer").withColumn("_k", F.lit(0)), "_k", ["geo_id"]).drop("_k")
    blocks = g.units.select("idx", "geo_id", "name", "pop", "parent_state", "parent_county")
    return path, write_pack(g.units.sparkSession, {"state": {"units": states}, "block": {"units": blocks, "geoms": g.geoms, "edges": topology.rook_edges(g.segments())}}, path, fmt)


_PACK = "SELECT 'block' AS level, idx, geo_id, pop FROM u UNION ALL SELECT 'state', CAST(row_number() OVER (ORDER BY parent_state) - 1 AS INTEGER), parent_state, CAST(sum(pop) AS BIGINT) FROM u GROUP BY parent_state"


def _unpacked(g: GridMap, fmt: str) -> DataFrame:
    from parcelloom.sources.tables import read_pack

    layers = read_pack(g.units.sparkSession, _pack(g, fmt)[0])
    one = lambda x: layers[x]["units"].select(F.lit(x).alias("level"), F.col("idx").cast("int").alias("idx"), "geo_id", F.col("pop").cast("long").alias("pop"))
    return one("block").unionByName(one("state"))


@query(_PACK)
def pack_parquet(g):
    return _unpacked(g, "parquet")


@query(_PACK)
def pack_csv(g):
    return _unpacked(g, "csv")


@query("SELECT 'block' AS level, count(*) AS n, true AS hashed, true AS valid FROM u UNION ALL SELECT 'state', count(DISTINCT parent_state), true, true FROM u")
def pack_manifest(g):
    from parcelloom.sources.tables import exists, read_manifest, validate_pack

    spark = g.units.sparkSession
    path, _ = _pack(g, "parquet")
    manifest = read_manifest(spark, path)
    valid = not validate_pack(spark, path) and exists(spark, f"{path}/manifest.json")
    hashed = all(len(x["sha256"]) == 64 for x in manifest["files"].values())
    return spark.createDataFrame([(k, n, hashed, valid) for k, n in manifest["counts"].items()], "level string, n long, hashed boolean, valid boolean")


_CORNERS = "(VALUES (0, 0, 0), (1, 1, 0), (2, 1, 1), (3, 0, 1), (4, 0, 0)) t(pos, dx, dy)"
_POINTS = f"SELECT idx, CAST(pos AS INTEGER) AS pos, round(-90 + 0.01::DOUBLE * (gx + dx), 6) AS x, round(40 + 0.01::DOUBLE * (gy + dy), 6) AS y FROM u CROSS JOIN {_CORNERS}"


@query(_POINTS)
def wkb_round_trip(g):
    from parcelloom.sources.wkb import parsed, wkb_column

    raw = g.geoms.select("idx", wkb_column(F.col("geom")).alias("wkb"))
    back = raw.mapInArrow(parsed("wkb"), g.geoms.schema)
    return back.select("idx", F.posexplode(F.col("geom")[0][0]).alias("pos", "p")).select("idx", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_FEATURE = f"SELECT idx, geo_id, name, CAST(pop AS VARCHAR) AS pop, CAST(district AS VARCHAR) AS district, CASE WHEN district > 0 THEN 'hsl(' || CAST(district * 57 % 360 AS VARCHAR) || ' 70% 50%)' END AS color, 'MultiPolygon' AS kind, round(-90 + 0.01::DOUBLE * gx, 6) AS x, round(40 + 0.01::DOUBLE * gy, 6) AS y FROM u JOIN p USING (idx)"


@query(_FEATURE, "holes")
def geojson_features(g):
    from parcelloom.sources.render import features

    found = features(g.units, g.geoms, _plan(g, "holes"), ("pop",))
    get = lambda path: F.get_json_object("feature", path)
    corner = lambda n: F.round(get(f"$.geometry.coordinates[0][0][0][{n}]").cast("double"), 6)
    return found.select("idx", *(get(f"$.properties.{x}").alias(x) for x in ("geo_id", "name", "pop", "district")), get("$.properties.district_color").alias("color"), get("$.geometry.type").alias("kind"), corner(0).alias("x"), corner(1).alias("y"))


# ---- outlines: areas of traced rings in square degrees, which add up cell by cell ----


def _areas(geoms: DataFrame, key: str) -> DataFrame:
    rings = geoms.select(key, F.explode(F.flatten("geom")).alias("ring"))
    return rings.groupBy(key).agg(F.round(F.sum(measure.signed_area(F.col("ring"))) / 2, 6).alias("area"), F.count("*").alias("rings"))


@query("SELECT district, round(count(*) * 0.0001::DOUBLE, 6) AS area FROM p GROUP BY 1")
def district_outlines(g):
    from parcelloom.operators.outline import dissolved

    return _areas(dissolved(g.segments(), _plan(g), ["chain", "district"]), "district").drop("rings")


@query("SELECT CAST(1 AS INTEGER) AS k, round(16 * 0.0001::DOUBLE, 6) AS area, CAST(2 AS BIGINT) AS rings FROM u WHERE idx = 0")
def outline_with_hole(g):
    from parcelloom.operators.outline import dissolved

    members = g.units.where(_RING).select("idx", F.lit(1).alias("k"))
    return _areas(dissolved(g.segments(), members, ["k"]), "k")


@query("SELECT CAST(1 AS INTEGER) AS k, round(25 * 0.0001::DOUBLE, 6) AS area FROM u WHERE idx = 0")
def outline_hull(g):
    from parcelloom.operators.outline import hulls

    members = g.units.where(_RING).select("idx", F.lit(1).alias("k"))
    return _areas(hulls(g.segments(), members, ["k"]), "k").drop("rings")


# the hull of a run of cells: full rows, and a slope to each row that isn't full
_HULLS = """SELECT district, round(0.0001::DOUBLE * CASE WHEN max(c) = max(w) THEN sum(CASE WHEN c = w THEN w ELSE (w + c) / 2 END) WHEN count(*) = 2 THEN max(c) + sum(c) / 2 ELSE sum(c) END, 6) AS area
FROM (SELECT district, gy, count(*)::DOUBLE AS c FROM p JOIN u USING (idx) GROUP BY 1, 2) CROSS JOIN (SELECT w::DOUBLE AS w FROM wd) GROUP BY 1"""


@query(_HULLS)
def district_hulls(g):
    from parcelloom.operators.outline import hulls

    return _areas(hulls(g.segments(), _plan(g), ["chain", "district"]), "district").drop("rings")


# in every full block of 5 x 5 cells the 16 on its rim are a set
_IN_RIM = "(gx % 5 IN (0, 4) OR gy % 5 IN (0, 4))"


def _rims(g: GridMap) -> DataFrame:
    cells = g.units.select("idx", "gx", "gy", F.expr("cast(gy div 5 * 100000 + gx div 5 as int)").alias("k"))
    full = cells.groupBy("k").count().where("count = 25").select("k")
    return cells.where(_IN_RIM).join(full, "k").select("k", "idx")


@query(f"SELECT CAST(gy // 5 * 100000 + gx // 5 AS INTEGER) AS k, round(count(*) FILTER (WHERE {_IN_RIM}) * 0.0001::DOUBLE, 6) AS area, CAST(2 AS BIGINT) AS rings FROM u GROUP BY gy // 5, gx // 5 HAVING count(*) = 25")
def block_outlines_with_holes(g):
    from parcelloom.operators.outline import dissolved

    return _areas(dissolved(g.segments(), _rims(g), ["k"]), "k")


@query(f"SELECT CAST(min(idx) FILTER (WHERE NOT {_IN_RIM}) AS INTEGER) AS component, count(*) FILTER (WHERE NOT {_IN_RIM}) AS units FROM u GROUP BY gy // 5, gx // 5 HAVING count(*) = 25")
def block_enclaves(g):
    d = Derived.of(g)
    members = _rims(g).select(F.lit(0).alias("chain"), "idx")
    return districts.enclaves(d.edges, members, d.geom.select("idx", "is_exterior")).drop("chain")


@query("SELECT idx, round(0.0001::DOUBLE, 6) AS area FROM u")
def simplified_units(g):
    from parcelloom.operators.outline import simplified_geoms

    return _areas(simplified_geoms(g.segments(), 1e-5), "idx").drop("rings")


@query("SELECT zoom, x, y, features FROM (SELECT CAST(10 AS INTEGER) AS zoom, x, y, CAST(count(*) AS INTEGER) AS features FROM (" + _TILE.replace("4096", "1024") + ") GROUP BY x, y)")
def vector_tiles(g):
    from parcelloom.sources.tiles import tiles

    return tiles(g.units, g.geoms, Derived.of(g).geom, "block", 10).select("zoom", "x", "y", "features")


# ---- searches: chains are random, so what must hold of any plan is returned ----


#: What holds of any search on this map, whatever it draws: each chain keeps all units, and each district is in one piece.
_ANY = "SELECT CAST(c AS INTEGER) AS chain, CAST(6 AS BIGINT) AS districts, (SELECT count(*) FROM u) AS units, (SELECT CAST(sum(pop) AS BIGINT) FROM u) AS pop, true AS contiguous, true AS none_empty FROM range(0, 4) t(c)"


def searched(g: GridMap, n: int, search) -> DataFrame:
    """``chain, district, units, pop, components`` of four chains from random plans."""
    from parcelloom.operators import search as s
    from parcelloom.storage import table

    d = Derived.of(g)
    area = _with_area(g)
    edges = table(d.edges, "edges")
    graph = s.Graph.collect(area, edges, d.outer(), ["pop", "dem", "rep", "area_m2"])
    found = table(s.ensemble(g.units.sparkSession, graph, n, 4, 7, search), "chains")
    plan = s.plans_of(found)
    sums = districts.totals(g.units.withColumn("units", F.lit(1)), plan, ["units", "pop"], n)
    return sums.join(districts.contiguity(edges, plan, n).select("chain", "district", "components"), ["chain", "district"])


def _searched(g: GridMap, n: int, search) -> DataFrame:
    rows = searched(g, n, search)
    return rows.groupBy("chain").agg(F.count("*").alias("districts"), F.sum("units").alias("units"), F.sum("pop").alias("pop"), F.bool_and(F.col("components") <= 1).alias("contiguous"), F.bool_and(F.col("units") > 0).alias("none_empty"))


@query(_ANY)
def search_randomize(g):
    return _searched(g, 6, lambda c: None)


@query(_ANY)
def search_equalize(g):
    return _searched(g, 6, lambda c: c.equalize("pop", 0.02, 200) and None)


@query(_ANY)
def search_anneal_balance(g):
    return _searched(g, 6, lambda c: c.anneal_balance("pop", 3000, 100.0, 0.01, 0.01))


@query(_ANY)
def search_tabu_balance(g):
    return _searched(g, 6, lambda c: c.tabu_balance("pop", 200, 20, 0.05, 8))


@query(_ANY)
def search_recombine(g):
    return _searched(g, 6, lambda c: c.recombine_some(20, "pop"))


@query(_ANY)
def search_anneal(g):
    from parcelloom.operators.search import AnnealOptions, Phase, anneal

    o = Objective([Metric.deviation_sharp("pop"), Metric.compactness()], [3.0, 1.0])
    return _searched(g, 6, lambda c: anneal(c, [Phase(o, 0.4, 0.05, 0.1)], AnnealOptions(max_iter=3000)))


# ---- logs and streams ----

_RUNS = """SELECT CAST(phase AS INTEGER) AS phase, CAST(min(event_id) AS BIGINT) AS first_event, count(*) AS events FROM (SELECT *, sum(new) OVER (ORDER BY event_id) AS run FROM (SELECT event_id, phase, CASE WHEN phase = lag(phase) OVER (ORDER BY event_id) THEN 0 ELSE 1 END AS new FROM (SELECT event_id, event_id // 100 % 3 AS phase FROM events))) GROUP BY phase, run"""


def phase_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelloom.operators.trace import islands

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.lit(0).alias("chain"), F.col("event_id").alias("iter"), F.expr("cast(event_id div 100 % 3 as int)").alias("phase"))
    return islands(rows).select("phase", F.col("first_iter").alias("first_event"), F.col("rows").alias("events"))


QUERIES["phase_islands"], SQL["phase_islands"] = phase_islands, _RUNS


def _round_trip(e: DataFrame) -> DataFrame:
    from parcelloom.operators.trace import log_line, parsed

    rows = e.select(F.lit(0).alias("chain"), F.col("event_id").alias("iter"), F.lit(1).alias("phase"), F.col("value").alias("obj"), F.col("value").alias("best"), F.lit(0.5).alias("temp"), F.lit(0.25).alias("prob"), F.create_map(F.lit("m"), F.col("value")).alias("metrics"))
    return parsed(log_line(rows)).select("iter", "phase", F.round("obj", 2).alias("obj"), "temp", "prob")


def log_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark.read.parquet(f"{sf_dir}/events.parquet"))


QUERIES["log_parse"] = log_parse
SQL["log_parse"] = "SELECT event_id AS iter, CAST(1 AS INTEGER) AS phase, round(value, 2) AS obj, 0.5::DOUBLE AS temp, 0.25::DOUBLE AS prob FROM events"


def move_log_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    from parcelloom.streaming.moves import move_totals

    moves = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("user_id").cast("int").alias("idx"), (F.col("event_id") % 5).cast("int").alias("src"), (F.col("event_id") % 3 + 5).cast("int").alias("dst"))
    units = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("int").alias("idx"), F.col("c_nationkey").cast("long").alias("pop"))
    return move_totals(moves, units, "pop", every="1 day").withColumn("start", F.date_format("start", "yyyy-MM-dd"))


QUERIES["move_log_totals"] = move_log_totals
SQL["move_log_totals"] = """SELECT strftime(ts, '%Y-%m-%d') AS start, district, CAST(sum(w) AS BIGINT) AS gain, count(*) AS moves FROM (
  SELECT ts, CAST(event_id % 5 AS INTEGER) AS district, -c_nationkey AS w FROM events JOIN customer ON c_custkey = user_id UNION ALL SELECT ts, CAST(event_id % 3 + 5 AS INTEGER), c_nationkey FROM events JOIN customer ON c_custkey = user_id) GROUP BY 1, 2"""


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compactness and population deviation of each district of a plan, from polygons."""
    g = grid_map(spark, sf_dir)
    found = {"polsby_popper": Metric.compactness(), "population_deviation": Metric.deviation("pop")}
    out = scoring.metric_values(_table(g, list(found.values())), found)
    return out.select("district", *(F.round(c, 6).alias(c) for c in found)).orderBy("district")


QUERIES["district_compactness"] = flagship
SQL["district_compactness"] = _sql(_MV + "SELECT district, round(4 * pi() * area / (per * per), 6) AS polsby_popper, round(dev, 6) AS population_deviation FROM mv")
