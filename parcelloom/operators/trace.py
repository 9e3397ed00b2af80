"""Run logs of searches: lines to columns, and runs of a phase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LINE = r"Iter\s+(\d+)\s*\|\s*Phase\s+(\d+)\s*\|\s*Obj:\s*([-+.\deE]+)\s*\|\s*Best:\s*([-+.\deE]+)\s*\|\s*Temp:\s*([-+.\deE]+)\s*\|\s*Prob:\s*([-+.\deE]+)"


def log_line(row: DataFrame) -> DataFrame:
    """A trace's rows as lines of text."""
    text = F.format_string("Iter %d | Phase %d | Obj: %.6f | Best: %.6f | Temp: %.6e | Prob: %.4f | %s", "iter", "phase", "obj", "best", "temp", "prob", F.array_join(F.transform(F.map_entries("metrics"), lambda e: F.concat(e["key"], F.lit("="), F.format_number(e["value"], 6))), ", "))
    return row.select("chain", text.alias("line"))


def parsed(lines: DataFrame) -> DataFrame:
    """``chain, iter, phase, obj, best, temp, prob, metrics`` from lines; lines of another form go."""
    part = lambda i, t: F.regexp_extract("line", _LINE, i).cast(t)
    rows = lines.where(F.col("line").rlike(_LINE))
    named = F.str_to_map(F.regexp_replace(F.regexp_extract("line", _LINE + r"\s*\|\s*(.*)$", 7), " ", ""), F.lit(","), F.lit("="))
    return rows.select("chain", part(1, "long").alias("iter"), part(2, "int").alias("phase"), part(3, "double").alias("obj"), part(4, "double").alias("best"), part(5, "double").alias("temp"), part(6, "double").alias("prob"), named.alias("metrics"))


def islands(trace: DataFrame, span: int = 1 << 16) -> DataFrame:
    """``chain, phase, first_iter, last_iter, rows`` of each unbroken run of a phase.

    Runs are found within spans of iterations, and those that go on across a border are then joined, so that the
    trace of one long chain is many tasks' work.
    """

    def runs(rows: DataFrame, keys: list[str], at: str, first: Column, last: Column, n: Column) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(at)
        new = F.when(F.col("phase").eqNullSafe(F.lag("phase").over(order)) & (F.row_number().over(order) > 1), 0).otherwise(1)
        marked = rows.withColumn("new", new).withColumn("run", F.sum("new").over(order))
        return marked.groupBy(*keys, "phase", "run").agg(first.alias("first_iter"), last.alias("last_iter"), n.alias("rows")).drop("run")

    pieces = runs(trace.withColumn("_span", F.expr(f"iter div {span}")), ["chain", "_span"], "iter", F.min("iter"), F.max("iter"), F.count("*"))
    return runs(pieces, ["chain"], "first_iter", F.min("first_iter"), F.max("last_iter"), F.sum("rows"))
