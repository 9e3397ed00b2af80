"""Metric values, scores and objectives of plans, one query for any number of chains."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.functions.metrics import Metric, Objective
from parcelloom.operators.districts import perimeter_matrix, perimeters, totals


def district_table(units: DataFrame, edges: DataFrame, plan: DataFrame, n: int, metrics: list[Metric], outer: DataFrame) -> DataFrame:
    """``chain, district``, the totals and the region's totals of the series that the metrics read, ``perimeter`` and ``n``."""
    series = sorted({s for m in metrics for s in m.series})
    out = totals(units, plan, series, n)
    if any(m.kind.startswith("compactness") for m in metrics):
        length = perimeters(perimeter_matrix(edges, plan, outer)).where("district > 0")
        out = out.join(length, ["chain", "district"], "left").na.fill(0.0, ["perimeter"])
    region = units.agg(*(F.sum(s).alias(f"region_{s}") for s in series))
    return out.crossJoin(F.broadcast(region)).withColumn("n", F.lit(n))


def metric_values(table: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """``chain, district`` and each metric's value under its name."""
    return table.select("chain", "district", *(m.column().alias(name) for name, m in metrics.items()))


def metric_scores(values: DataFrame, names: list[str]) -> DataFrame:
    """``chain`` and each metric's mean over districts, 0 without any."""
    return values.groupBy("chain").agg(*(F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in names))


def objective_values(table: DataFrame, objective: Objective) -> DataFrame:
    """``chain, objective``."""
    named = {f"s{i}": m for i, m in enumerate(objective.metrics)}
    scores = metric_scores(metric_values(table, named), list(named))
    return scores.select("chain", objective.column().alias("objective"))


def tabu_cost(units: DataFrame, edges: DataFrame, plan: DataFrame, series: str, n: int, boundary: float) -> DataFrame:
    """``chain, cost``: squared deviations over the target, and the length of the cut, mixed by ``boundary``."""
    from parcelloom.operators.districts import cross_edges

    w = totals(units, plan, [series], n)
    target = w.groupBy("chain").agg((F.sum(series) / n).alias("t"))
    pop = w.join(target, "chain").groupBy("chain").agg(F.sum((F.col(series) - F.col("t")) ** 2 / F.col("t")).alias("pop_cost"))
    cut = cross_edges(edges, plan).groupBy("chain").agg((F.sum("w") / 2).alias("cut"))
    return pop.join(cut, "chain", "left").select("chain", (F.col("pop_cost") * (1 - boundary) + F.coalesce("cut", F.lit(0.0)) * boundary).alias("cost"))


def acceptance(delta, temperature):
    """The chance that a change of a maximised score is accepted."""
    over = delta - 1e-10
    return F.when(over > 0, 1.0).otherwise(F.exp(over / temperature))


def temperature_at(first: float, last: float, i, n: int):
    """The geometric schedule at step ``i`` of ``n``."""
    return first * F.pow(F.lit(last / first), i / F.lit(float(n)))
