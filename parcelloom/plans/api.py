"""Maps and plans as objects over tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelloom.functions import ids
from parcelloom.functions.measure import zoom_tolerance
from parcelloom.functions.metrics import Metric, Objective
from parcelloom.operators import districts, outline, rollup, search, topology
from parcelloom.plans import scoring
from parcelloom.sources import archive, render, tables, tiles
from parcelloom.sources.wkb import wkb_column
from parcelloom.storage import table


@dataclass
class Map:
    """The layers of a map by level, each with ``units`` and ``geoms``; the base level is ``block``."""

    spark: SparkSession
    layers: dict[str, dict[str, DataFrame]]
    base: str = "block"
    _derived: dict[str, DataFrame] = field(default_factory=dict)

    @staticmethod
    def from_pack(spark: SparkSession, path: str) -> "Map":
        return Map(spark, tables.read_pack(spark, path))

    def to_pack(self, path: str, fmt: str = "parquet") -> dict:
        return tables.write_pack(self.spark, self.layers, path, fmt)

    @staticmethod
    def build(spark: SparkSession, blocks: DataFrame, geoms: DataFrame, data: list[DataFrame], bridges: DataFrame | None = None, snap: float | None = None) -> "Map":
        """All levels from blocks ``idx, geo_id, ...`` with their parents, their polygons, and attribute tables by ``geo_id``.

        Attributes and the outer perimeter are summed up the levels, outlines of levels are the unions of their blocks
        and a unit above the blocks is named by its id.  ``bridges`` (``a, b``) are forced neighbours.  ``snap`` puts
        vertices of different blocks that are no farther apart (degrees) in one place first.
        """
        if snap:
            geoms = table(topology.snapped_geoms(geoms, snap), "snapped")
        out = Map(spark, {"block": {"units": blocks, "geoms": geoms}})
        units = blocks
        for d in data:
            units = rollup.merge_attributes(units, d)
        units = units.join(out.outer(), "idx", "left").na.fill(0.0, ["outer_perimeter_m"])
        sums = rollup.roll_up(units.drop("centroid_lon", "centroid_lat"))
        out.layers["block"]["units"] = units
        out.layers["block"]["edges"] = out.edges() if bridges is None else topology.forced_adjacency(out.edges(), bridges)
        for level in ("state", "county", "tract", "group", "vtd"):
            if f"parent_{level}" in units.columns:
                layer = sums.where(F.col("layer") == level).drop("layer").withColumns({"name": F.col("geo_id"), "_prefix": F.substring("geo_id", 1, 2)})
                for above in ids.ABOVE[level]:
                    layer = layer.withColumn(f"parent_{above}", ids.parent(F.col("geo_id"), above))
                layer = rollup.row_index(layer, "_prefix", ["geo_id"]).drop("_prefix")
                blocks_of = units.select("idx", F.col(f"parent_{level}").alias("geo_id")).where("geo_id is not null")
                outlines = outline.dissolved(out.segments(), blocks_of, ["geo_id"])
                out.layers[level] = {"units": layer, "geoms": outlines.join(layer.select("idx", "geo_id"), "geo_id").select("idx", "geom")}
        return out

    def units(self, level: str | None = None) -> DataFrame:
        return self.layers[level or self.base]["units"]

    def series(self, level: str | None = None) -> list[str]:
        return sorted(rollup.numeric_columns(self.units(level)))

    def _once(self, name: str, make) -> DataFrame:
        if name not in self._derived:
            self._derived[name] = table(make(), name)
        return self._derived[name]

    def segments(self, level: str | None = None) -> DataFrame:
        level = level or self.base
        return self._once(f"segments_{level}", lambda: topology.segments(self.layers[level]["geoms"]))

    def edges(self, level: str | None = None) -> DataFrame:
        level = level or self.base
        if "edges" in self.layers[level]:
            return self.layers[level]["edges"]
        return self._once(f"edges_{level}", lambda: topology.rook_edges(self.segments(level)))

    def geometry(self, level: str | None = None) -> DataFrame:
        level = level or self.base
        return self._once(f"geometry_{level}", lambda: topology.unit_geometry(self.segments(level)))

    def centroids(self, level: str | None = None) -> DataFrame:
        """``idx, centroid_lon, centroid_lat`` as the layer's table has them, NaN where it has none."""
        units = self.units(level)
        have = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) if c in units.columns else F.lit(float("nan"))
        return units.select("idx", *(have(c).alias(c) for c in ("centroid_lon", "centroid_lat")))

    def outer(self) -> DataFrame:
        return self.geometry().select("idx", F.col("ext_len").alias("outer_perimeter_m"))

    def geometry_stats(self) -> DataFrame:
        return topology.geometry_stats(self.layers[self.base]["geoms"], self.geometry())

    def to_svg(self, width: float = 1000.0, margin: float = 10.0, series: str | None = None, edges: bool = False, level: str | None = None) -> str:
        view, height = self._view(width, margin)
        rows = render.layer_svg_rows(self.units(level), self.layers[level or self.base]["geoms"], view, series)
        if edges:
            rows = rows.unionByName(render.edge_svg_rows(self.units(), self.edges(), view))
        return render.svg_document(rows, width, height)

    def _view(self, width: float, margin: float) -> tuple[render.Viewport, float]:
        b = self.geometry().agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
        view = render.Viewport.fit(*b, width, margin)
        return view, (b[3] - b[1]) * view.scale + 2 * margin

    def to_geojson(self, series: tuple[str, ...] = (), bounds: tuple[float, float, float, float] | None = None, level: str | None = None) -> str:
        """All units of a level, or those whose box meets ``bounds`` (west, south, east, north)."""
        units = self.units(level)
        if bounds:
            units = units.join(topology.in_envelope(self.geometry(level), *bounds).select("idx"), "idx", "left_semi")
        return render.feature_collection(render.features(units, self.layers[level or self.base]["geoms"], None, series))

    def tiles(self, zooms: range, level: str | None = None) -> DataFrame:
        """``zoom, x, y, tile, features`` of a level; borders are simplified by zoom, the largest has them whole."""
        level = level or self.base
        out = None
        for zoom in zooms:
            geoms = outline.simplified_geoms(self.segments(level), zoom_tolerance(zoom, zooms[-1])) if zoom < zooms[-1] else self.layers[level]["geoms"]
            rows = tiles.tiles(self.units(level), geoms, self.geometry(level), level, zoom)
            out = rows if out is None else out.unionByName(rows)
        return out

    def to_archive(self, path: str, zooms: range, level: str | None = None) -> int:
        """The level's tiles as one file; returns how many there are."""
        b = self.geometry().agg(F.min("minx"), F.min("miny"), F.max("maxx"), F.max("maxy")).first()
        return archive.write_archive(table(self.tiles(zooms, level), "tiles"), path, tuple(b))

    def graph(self, series: list[str]) -> search.Graph:
        return search.Graph.collect(self.units(), self.edges(), self.outer(), series)


class Plan:
    """Districts 1 to ``n`` of the base units of a map; 0 is unassigned.  Search returns plans of one or many chains."""

    def __init__(self, of: Map, n: int, rows: DataFrame | None = None) -> None:
        self.map, self.n = of, n
        self.rows = rows if rows is not None else of.units().select(F.lit(0).alias("chain"), "idx", F.lit(0).alias("district"))

    def with_rows(self, rows: DataFrame) -> "Plan":
        return Plan(self.map, self.n, rows)

    # ---- assignments ----

    def assignments(self) -> DataFrame:
        """``chain, geo_id, district`` of every unit."""
        return districts.attach(self.map.units().select("idx", "geo_id"), self.rows).select("chain", "geo_id", "district")

    def load_csv(self, path: str, strict: bool = False) -> "Plan":
        """From a file of ``geo_id, district``; units without a row are unassigned, or an error with ``strict``."""
        return self.with_rows(tables.read_plan(self.map.spark, path, self.map.units(), strict=strict))

    def dense(self) -> DataFrame:
        """``chain, districts``: the district of each unit in the order of ``idx``."""
        return search.starts(self.rows)

    def set_dense(self, districts: list[int]) -> "Plan":
        """From the district of each unit in the order of ``idx``."""
        if len(districts) != (n := self.map.units().count()) or not all(0 <= d <= self.n for d in districts):
            raise ValueError(f"{n} districts from 0 to {self.n} are needed")
        return self.with_rows(self.map.spark.createDataFrame([(0, i, d) for i, d in enumerate(districts)], "chain int, idx int, district int"))

    def set_assignments(self, rows: DataFrame) -> "Plan":
        """From ``geo_id, district``; units without a row are unassigned."""
        return self.with_rows(tables.plan_of_rows(rows, self.map.units()))

    def assign_unit(self, level: str, geo_id: str, district: int) -> "Plan":
        return self.assign_units(level, [geo_id], district)

    def assign_units(self, level: str, geo_ids: list[str], district: int) -> "Plan":
        column = "geo_id" if level == self.map.base else f"parent_{level}"
        return self.with_rows(districts.assigned_by_parent(self.rows, self.map.units(), column, geo_ids, district))

    def move(self, units: list[int], district: int) -> "Plan":
        return self.with_rows(districts.moved(self.rows, units, district))

    def merge(self, a: int, b: int) -> "Plan":
        return self.with_rows(districts.merged(self.rows, self.perimeter_matrix(), a, b))

    def ensure_contiguity(self) -> "Plan":
        return self.with_rows(districts.repaired(self.map.edges(), self.rows))

    # ---- measures ----

    def series(self) -> list[str]:
        return self.map.series()

    def district_totals(self, series: str) -> DataFrame:
        return districts.totals(self.map.units(), self.rows, [series], self.n)

    def all_part_totals(self, series: str) -> DataFrame:
        return districts.totals(self.map.units(), self.rows, [series], self.n, unassigned=True)

    def perimeter_matrix(self) -> DataFrame:
        return districts.perimeter_matrix(self.map.edges(), self.rows, self.map.outer())

    def contiguity(self) -> DataFrame:
        return districts.contiguity(self.map.edges(), self.rows, self.n)

    def metric(self, m: Metric) -> DataFrame:
        """``chain, district, value``."""
        return scoring.metric_values(self._table([m]), {"value": m})

    def metric_score(self, m: Metric) -> DataFrame:
        return scoring.metric_scores(self.metric(m), ["value"])

    def objective(self, o: Objective) -> DataFrame:
        return scoring.objective_values(self._table(o.metrics), o)

    def _table(self, found: list[Metric]) -> DataFrame:
        return scoring.district_table(self.map.units(), self.map.edges(), self.rows, self.n, found, self.map.outer())

    # ---- search ----

    def _search(self, series: list[str], run, seed: int, chains: int | None, fresh: bool = False) -> tuple["Plan", DataFrame]:
        """Chain k goes on from chain k; ``chains`` says otherwise how many there are, and takes the plan's in turn."""
        first = None if fresh else search.starts(self.rows, chains)
        found = table(search.ensemble(self.map.spark, self.map.graph(series), self.n, chains or 1, seed, run, first), "chains")
        return self.with_rows(search.plans_of(found)), search.trace_of(found)

    def randomize(self, seed: int = 0, chains: int = 1) -> "Plan":
        return self._search([], lambda c: None, seed, chains, fresh=True)[0]

    def equalize(self, series: str, tolerance: float, max_iter: int, seed: int = 0, chains: int | None = None) -> "Plan":
        return self._search([series], lambda c: c.equalize(series, tolerance, max_iter) and None, seed, chains)[0]

    def equalize_step(self, series: str, tolerance: float, seed: int = 0, chains: int | None = None) -> "Plan":
        """One round of ``equalize``."""
        return self.equalize(series, tolerance, 1, seed, chains)

    def within(self, series: str, tolerance: float) -> DataFrame:
        """``chain, met``: whether every district's total is that near the mean, as a share of it."""
        t = self.district_totals(series)
        mean = F.sum(series) / self.n
        return t.groupBy("chain").agg((F.greatest(F.max(series) - mean, mean - F.min(series)) <= tolerance * mean).alias("met"))

    def recombine(self, a: int, b: int, series: str = "T_20_CENS_Total", seed: int = 0, chains: int | None = None) -> "Plan":
        return self._search([series], lambda c: c.recombine(a, b, series) and None, seed, chains)[0]

    def anneal_balance(self, series: str, iterations: int, hot: float, cold: float, boundary: float, seed: int = 0, chains: int | None = None) -> "Plan":
        return self._search([series], lambda c: c.anneal_balance(series, iterations, hot, cold, boundary), seed, chains)[0]

    def tabu_balance(self, series: str, iterations: int, tenure: int, boundary: float, candidates: int, seed: int = 0, chains: int | None = None) -> "Plan":
        return self._search([series], lambda c: c.tabu_balance(series, iterations, tenure, boundary, candidates), seed, chains)[0]

    def anneal(self, phases: list[search.Phase], options: search.AnnealOptions, seed: int = 0, chains: int | None = None) -> tuple["Plan", DataFrame]:
        series = sorted({s for p in phases for m in p.objective.metrics for s in m.series})
        return self._search(series, lambda c: search.anneal(c, phases, options), seed, chains)

    # ---- export ----

    def geometries(self) -> DataFrame:
        """``chain, district, geom``: the districts' outlines."""
        return outline.dissolved(self.map.segments(), self.rows.where("district > 0"), ["chain", "district"])

    def geometries_wkb(self) -> DataFrame:
        return self.geometries().select("chain", "district", wkb_column(F.col("geom")).alias("wkb"))

    def to_csv(self) -> str:
        return tables.plan_text(self.map.units(), self.rows)

    def to_geojson(self) -> str:
        return render.feature_collection(render.features(self.map.units(), self.map.layers[self.map.base]["geoms"], self.rows))

    def to_svg(self, width: float = 1000.0, margin: float = 10.0, dem: str | None = None, rep: str | None = None, state: int = 0) -> str:
        """Districts in golden-angle colours, or by lean if two series are given."""
        from parcelloom.functions.measure import golden_colour, partisan_colour
        from parcelloom.functions.metrics import partisan_lean

        view, height = self.map._view(width, margin)
        rows = self.geometries()
        fill = golden_colour(F.lit((state + 1) * 100) + F.col("district"))
        if dem and rep:
            rows = rows.join(districts.totals(self.map.units(), self.rows, [dem, rep], self.n), ["chain", "district"])
            fill = partisan_colour(partisan_lean(F.col(dem), F.col(rep)))
        path = F.format_string('<path d="%s" fill="%s"/>', render.svg_path(F.col("geom"), view), fill)
        return render.svg_document(rows.select(F.col("district").alias("idx"), path.alias("element")), width, height)
