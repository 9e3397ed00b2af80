"""Runs described by a configuration: random plans, equalised, annealed phase by phase, scored and saved."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parcelloom.functions.metrics import Metric, Objective
from parcelloom.operators import search
from parcelloom.plans.api import Map, Plan


def objective_of(weights: dict[str, float], pop: str, dem: str, rep: str, threshold: float) -> Objective:
    """An objective from weights by kind: ``population``, ``compactness``, ``competitiveness``."""
    kinds = {"population": Metric.deviation_smooth(pop), "compactness": Metric.compactness(), "competitiveness": Metric.quadratic(dem, rep, threshold)}
    if unknown := set(weights) - set(kinds):
        raise ValueError(f"unknown metrics {sorted(unknown)}")
    return Objective([kinds[k] for k in weights], list(weights.values()))


def run(of: Map, config: str | dict, pop: str, dem: str, rep: str, chains: int = 1, seed: int = 0, tolerance: float = 0.05, equalize_iter: int = 1000) -> tuple[Plan, DataFrame, DataFrame]:
    """The plans, their scores (``chain`` and each metric) and the traces of a configuration's chains, each chain from a plan of its own.

    The configuration (JSON or a dictionary) has ``num_districts``, ``max_iter``, ``init_temp``, ``batch_size``,
    ``temp_search_batch_size``, ``competitiveness_threshold`` and ``phases`` of ``start_prob``, ``end_prob`` (or null),
    ``cooling_rate``, ``early_stop_iters`` (optional) and ``weights``.
    """
    c = json.loads(config) if isinstance(config, str) else config
    phases = [search.Phase(objective_of(p["weights"], pop, dem, rep, c["competitiveness_threshold"]), p["start_prob"], p.get("end_prob"), p["cooling_rate"]) for p in c["phases"]]
    stop = max((p.get("early_stop_iters", 0) for p in c["phases"]), default=0) or 2000
    options = search.AnnealOptions(c["max_iter"], c["init_temp"], c["batch_size"], c["temp_search_batch_size"], stop)

    def chain(it: search.Chain) -> list[tuple]:
        it.equalize(pop, tolerance, equalize_iter)
        return search.anneal(it, phases, options) if it.size[0] == 0 else []

    plan, trace = Plan(of, c["num_districts"])._search([pop, dem, rep, "area_m2"], chain, seed, chains, fresh=True)
    found = {str(m.kind): m for p in phases for m in p.objective.metrics}
    from parcelloom.plans.scoring import district_table, metric_scores, metric_values

    rows = district_table(of.units(), of.edges(), plan.rows, plan.n, list(found.values()), of.outer())
    return plan, metric_scores(metric_values(rows, found), list(found)), trace


def save(plan: Plan, path: str) -> None:
    """A CSV folder for each chain."""
    rows = plan.rows.join(plan.map.units().select("idx", "geo_id"), "idx").where("district <> 0")
    rows.select("chain", "geo_id", "district").write.mode("overwrite").partitionBy("chain").option("header", True).csv(path)


def county_splits(units: DataFrame, plan: DataFrame, parent: str = "parent_county") -> DataFrame:
    """``chain, parent, splits``: how many districts a county has beyond the first."""
    rows = plan.where("district > 0").join(units.select("idx", parent), "idx")
    return rows.groupBy("chain", F.col(parent).alias("parent")).agg((F.count_distinct("district") - 1).alias("splits"))


__all__ = ["county_splits", "objective_of", "run", "save"]
