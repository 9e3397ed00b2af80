"""A map over the driver's tables: customers are square units on a snake-ordered grid, nation by nation."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelloom.functions.ids import parent
from parcelloom.operators.rollup import row_index
from parcelloom.operators.topology import rook_edges, segments, unit_geometry

#: The grid's origin and the side of a cell, in degrees.
LON0, LAT0, SIDE = -90.0, 40.0, 0.01


@dataclass
class GridMap:
    """Tables of a map at one level: units, polygons and the grid's width; and the folder that it is from."""

    units: DataFrame
    geoms: DataFrame
    width: int
    folder: str = ""

    def segments(self) -> DataFrame:
        return segments(self.geoms)


def grid_map(spark: SparkSession, sf_dir: str) -> GridMap:
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    customers = read("customer").select("c_custkey", "c_name", "c_nationkey", "c_acctbal")
    width = max(1, math.ceil(math.sqrt(customers.count())))
    nations = read("nation").select("n_nationkey", "n_regionkey")
    u = row_index(customers, "c_nationkey", ["c_custkey"]).join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))
    two = lambda c, n: F.lpad(c.cast("string"), n, "0")
    u = u.withColumn("geo_id", F.concat(two(F.col("n_regionkey") + 1, 2), two(F.col("n_nationkey"), 3), two(F.col("c_custkey"), 10)))
    u = u.withColumn("gy", F.expr(f"cast(idx div {width} as int)")).withColumn("gx", F.when(F.col("gy") % 2 == 0, F.col("idx") % width).otherwise(width - 1 - F.col("idx") % width))
    orders = read("orders").groupBy("o_custkey").agg(F.count("*").alias("pop"), F.count_if(F.col("o_orderstatus") == "F").alias("dem"), F.count_if(F.col("o_orderstatus") == "O").alias("rep"))
    u = u.join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").na.fill(0, ["pop", "dem", "rep"])
    u = u.withColumn("parent_vtd", F.concat(F.substring("geo_id", 1, 5), two(F.col("c_custkey") % 7, 6)))
    for level in ("state", "county", "tract", "group"):
        u = u.withColumn(f"parent_{level}", parent(F.col("geo_id"), level))
    u = u.select("idx", "geo_id", F.col("c_name").alias("name"), "gx", "gy", (F.col("gx") * SIDE + (LON0 + SIDE / 2)).alias("centroid_lon"), (F.col("gy") * SIDE + (LAT0 + SIDE / 2)).alias("centroid_lat"), "n_nationkey", "n_regionkey", "c_custkey", "pop", "dem", "rep", F.col("c_acctbal").alias("acctbal"), "parent_state", "parent_county", "parent_tract", "parent_group", "parent_vtd")
    return GridMap(u, u.select("idx", cell(F.col("gx"), F.col("gy")).alias("geom")), width, sf_dir)


def cell(gx: Column, gy: Column) -> Column:
    """The square of a cell as one polygon with one closed ring."""
    at = lambda dx, dy: F.struct((LON0 + SIDE * (gx + dx)).alias("x"), (LAT0 + SIDE * (gy + dy)).alias("y"))
    return F.array(F.array(F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))))


def grid_plan(grid: GridMap, rule: str, chain: int = 0) -> DataFrame:
    """Plans ``nation``, ``region``, ``stripe`` (bands of 5 rows) and ``holes`` (every 7th unit unassigned)."""
    rules = {
        "nation": F.col("n_nationkey") + 1, "region": F.col("n_regionkey") + 1, "stripe": F.expr("cast(gy div 5 as int)") + 1,
        "holes": F.when(F.col("idx") % 7 == 0, 0).otherwise(F.col("n_nationkey") + 1),
    }
    return grid.units.select(F.lit(chain).alias("chain"), "idx", rules[rule].cast("int").alias("district"))


@dataclass
class Derived:
    """What queries need of a map: segments, rook edges and units' measures."""

    segs: DataFrame
    edges: DataFrame
    geom: DataFrame

    @staticmethod
    def of(grid: GridMap) -> "Derived":
        segs = grid.segments()
        return Derived(segs, rook_edges(segs), unit_geometry(segs))

    def outer(self) -> DataFrame:
        return self.geom.select("idx", F.col("ext_len").alias("outer_perimeter_m"))

    def exterior(self) -> DataFrame:
        return self.geom.where("is_exterior").select("idx")
