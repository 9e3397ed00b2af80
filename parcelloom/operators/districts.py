"""Aggregates, frontiers, contiguity and changes of plans.

A plan is a table ``chain, idx, district``; 0 is unassigned.  ``chain`` is a key of everything, so one plan and an ensemble
are the same query.  What the plan's units weigh and touch is derived by joins, never kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelloom.operators.components import component_labels


def attach(units: DataFrame, plan: DataFrame) -> DataFrame:
    """Every unit of every chain with its district, 0 where the plan has none."""
    chains = plan.select("chain").distinct()
    return units.crossJoin(F.broadcast(chains)).join(plan, ["chain", "idx"], "left").withColumn("district", F.coalesce("district", F.lit(0)))


def totals(units: DataFrame, plan: DataFrame, series: list[str], n: int, unassigned: bool = False) -> DataFrame:
    """``chain, district`` and the sums of the series, for districts 1 (or 0) to ``n``; an empty district has zeros."""
    sums = attach(units.select("idx", *series), plan).groupBy("chain", "district").agg(*(F.sum(c).alias(c) for c in series))
    every = plan.select("chain").distinct().select("chain", F.explode(F.sequence(F.lit(0 if unassigned else 1), F.lit(n))).alias("district"))
    return every.join(sums, ["chain", "district"], "left").na.fill(0, series)


def min_weight(sums: DataFrame, series: str) -> DataFrame:
    """``chain, district``: the district with the smallest total of a series; the first of equal ones."""
    return sums.groupBy("chain").agg(F.min_by("district", F.struct(series, "district")).alias("district"))


def cross_edges(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """``chain, src, dst, w, p, q``: the edges between different districts ``p`` and ``q``."""
    p = plan.select("chain", F.col("idx").alias("src"), F.col("district").alias("p"))
    q = plan.select("chain", F.col("idx").alias("dst"), F.col("district").alias("q"))
    return edges.join(p, "src").join(q, ["chain", "dst"]).where("p <> q")


def perimeter_matrix(edges: DataFrame, plan: DataFrame, outer: DataFrame) -> DataFrame:
    """``chain, p, q, perimeter``: boundary between districts; 0 is the outside too (``outer``: ``idx, outer_perimeter_m``)."""
    between = cross_edges(edges, plan).select("chain", "p", "q", F.col("w").alias("m"))
    out = plan.join(outer, "idx").where("district > 0 and outer_perimeter_m > 0")
    one = out.select("chain", F.col("district").alias("p"), F.lit(0).alias("q"), F.col("outer_perimeter_m").alias("m"))
    two = one.select("chain", F.col("q").alias("p"), F.col("p").alias("q"), "m")
    return between.unionByName(one).unionByName(two).groupBy("chain", "p", "q").agg(F.sum("m").alias("perimeter"))


def perimeters(matrix: DataFrame) -> DataFrame:
    """``chain, district, perimeter``."""
    return matrix.groupBy("chain", F.col("p").alias("district")).agg(F.sum("perimeter").alias("perimeter"))


def frontier_units(edges: DataFrame, plan: DataFrame, exterior: DataFrame) -> DataFrame:
    """``chain, district, idx`` with a neighbour in another district, or on the outside (``exterior``: ``idx``)."""
    cross = cross_edges(edges, plan).select("chain", F.col("p").alias("district"), F.col("src").alias("idx"))
    outside = plan.join(exterior.select("idx"), "idx", "left_semi").select("chain", "district", "idx")
    return cross.unionByName(outside).distinct()


def components(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """``chain, district, idx, component``: the smallest unit that is reached within the district."""
    p = plan.select("chain", F.col("idx").alias("src"), F.col("district").alias("p"))
    q = plan.select("chain", F.col("idx").alias("dst"), F.col("district").alias("q"))
    inner = edges.join(p, "src").join(q, ["chain", "dst"]).where("p = q and src < dst").select("chain", F.col("src").alias("a"), F.col("dst").alias("b"))
    roots = component_labels(plan.select("chain", F.col("idx").alias("node")), inner, ["chain"])
    return plan.join(roots.select("chain", F.col("node").alias("idx"), F.col("root").alias("component")), ["chain", "idx"])


def contiguity(edges: DataFrame, plan: DataFrame, n: int) -> DataFrame:
    """``chain, district, components, contiguous`` for districts 1 to ``n``."""
    found = components(edges, plan).where("district > 0").groupBy("chain", "district").agg(F.count_distinct("component").alias("components"))
    every = plan.select("chain").distinct().select("chain", F.explode(F.sequence(F.lit(1), F.lit(n))).alias("district"))
    return every.join(found, ["chain", "district"], "left").na.fill(0, ["components"]).withColumn("contiguous", F.col("components") <= 1)


def enclaves(edges: DataFrame, members: DataFrame, units: DataFrame) -> DataFrame:
    """``chain, component, units``: pieces of what is not in the set ``members(chain, idx)`` that don't reach the outside.

    ``units`` has ``idx, is_exterior``.
    """
    chains = members.select("chain").distinct()
    rest = units.crossJoin(F.broadcast(chains)).join(members, ["chain", "idx"], "left_anti").withColumn("district", F.lit(1))
    found = components(edges, rest.select("chain", "idx", "district")).join(units, "idx")
    return found.groupBy("chain", "component").agg(F.count("*").alias("units"), F.bool_or("is_exterior").alias("open")).where("not open").drop("open")


def repaired(edges: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan with every piece but each district's largest given away: to 0 if it touches 0, else to the district with the longest shared boundary.

    Of equally large pieces the one with the smallest unit stays; of equal boundaries the smallest district wins.
    """
    found = components(edges, plan)
    pieces = found.where("district > 0").groupBy("chain", "district", "component").agg(F.count("*").alias("n"))
    order = Window.partitionBy("chain", "district").orderBy(F.desc("n"), "component")
    lesser = pieces.withColumn("r", F.row_number().over(order)).where("r > 1").select("chain", "component")
    around = cross_edges(edges, plan).join(found.select("chain", F.col("idx").alias("src"), "component"), ["chain", "src"]).join(lesser, ["chain", "component"], "left_semi")
    shared = around.groupBy("chain", "component", "q").agg(F.sum("w").alias("w"))
    best = shared.groupBy("chain", "component").agg(F.max_by("q", F.struct(F.when(F.col("q") == 0, 1).otherwise(0), "w", -F.col("q"))).alias("to"))
    return found.join(best, ["chain", "component"], "left").select("chain", "idx", F.coalesce("to", "district").alias("district"))


def moved(plan: DataFrame, idx: list[int], district: int) -> DataFrame:
    """The plan with some units in another district."""
    return plan.withColumn("district", F.when(F.col("idx").isin(idx), F.lit(district)).otherwise(F.col("district")))


def movable(edges: DataFrame, plan: DataFrame, idx: list[int], district: int) -> DataFrame:
    """``chain, one_part, contiguous, allowed``: may these units move to a district together?

    They must be of one district, and neither what they leave nor the district that they join may be in pieces.
    """
    source = plan.where(F.col("idx").isin(idx)).groupBy("chain").agg(F.min("district").alias("p"), F.count_distinct("district").alias("parts"))
    after = moved(plan, idx, district)
    pieces = components(edges, after).join(source, "chain").where((F.col("district") > 0) & ((F.col("district") == F.col("p")) | (F.col("district") == district)))
    broken = pieces.groupBy("chain", "district").agg(F.count_distinct("component").alias("n")).where("n > 1").select("chain").distinct().withColumn("_broken", F.lit(True))
    out = source.join(broken, "chain", "left").select("chain", (F.col("parts") == 1).alias("one_part"), F.col("_broken").isNull().alias("contiguous"))
    return out.withColumn("allowed", F.col("one_part") & F.col("contiguous"))


def merged(plan: DataFrame, matrix: DataFrame, a: int, b: int) -> DataFrame:
    """The plan with the smaller of two bordering districts in the larger (ties: into the first), where they border."""
    size = plan.where(F.col("district").isin(a, b)).groupBy("chain").agg(F.count_if(F.col("district") == a).alias("na"), F.count_if(F.col("district") == b).alias("nb"))
    touch = matrix.where((F.col("p") == a) & (F.col("q") == b)).select("chain").distinct()
    into = size.join(touch, "chain").select("chain", F.when(F.col("na") >= F.col("nb"), a).otherwise(b).alias("_keep"))
    return plan.join(into, "chain", "left").withColumn("district", F.when(F.col("district").isin(a, b) & F.col("_keep").isNotNull(), F.col("_keep")).otherwise(F.col("district"))).drop("_keep")


def assigned_by_parent(plan: DataFrame, units: DataFrame, parent: str, ids: list[str], district: int, strict: bool = True) -> DataFrame:
    """The plan with all units below some parents in a district; an unknown parent is an error with ``strict``."""
    picked = units.where(F.col(parent).isin(ids))
    if strict and (gone := set(ids) - {r[0] for r in picked.select(parent).distinct().collect()}):
        raise ValueError(f"unknown {parent}: {sorted(gone)}")
    hit = picked.select("idx").withColumn("_hit", F.lit(True))
    return plan.join(hit, "idx", "left").select("chain", "idx", F.when(F.col("_hit"), district).otherwise(F.col("district")).alias("district"))
