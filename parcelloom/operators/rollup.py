"""Row numbers, attribute merges and roll-ups over the levels of a map."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.functions.ids import LEVELS, parent
from parcelloom.storage import table

#: Bits of ``monotonically_increasing_id`` that number the rows of a task.
_RANK_BITS = 33


def numeric_columns(df: DataFrame, skip: tuple[str, ...] = ("idx",)) -> list[str]:
    """The series of a table: its integer and floating columns."""
    kinds = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and f.name not in skip]


def weights(df: DataFrame, key: str = "idx") -> DataFrame:
    """The series as LongType or DoubleType, nulls as 0."""
    whole = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
    kind = {f.name: "long" if isinstance(f.dataType, whole) else "double" for f in df.schema}
    return df.select(key, *(F.coalesce(F.col(c).cast(kind[c]), F.lit(0).cast(kind[c])).alias(c) for c in numeric_columns(df, (key,))))


def row_index(df: DataFrame, group: str, order: list[str], name: str = "idx") -> DataFrame:
    """Numbers from 0 in the order of ``group`` and then ``order``, nulls first.

    Rows are dealt to tasks by ranges of that order and sorted there, and tasks are offset by the tasks before: no task has
    the whole table or a whole group.  The sorted rows are written to the shared folder, so they are numbered once; what
    comes to the driver is a count for each task.
    """
    ranges = df.repartitionByRange(group, *order).sortWithinPartitions(group, *order)
    rows = table(ranges.withColumn("_at", F.monotonically_increasing_id()), "numbered")  # the task's number in the upper 31 bits, the row's below
    task, rank = F.shiftright("_at", _RANK_BITS), F.col("_at").bitwiseAND(F.lit(2**_RANK_BITS - 1))
    counts = {r["task"]: r["n"] for r in rows.groupBy(task.alias("task")).agg(F.count("*").alias("n")).collect()}
    before = list(itertools.accumulate((counts.get(i, 0) for i in range(max(counts, default=0))), initial=0))
    return rows.withColumn(name, (F.get(F.lit(before).cast("array<bigint>"), task.cast("int")) + rank).cast("int")).drop("_at")


def unmatched(left: DataFrame, right: DataFrame, key: str = "geo_id") -> DataFrame:
    """Keys of either table that the other lacks, with ``side``."""
    a = left.select(key).join(right.select(key), key, "left_anti").withColumn("side", F.lit("left"))
    b = right.select(key).join(left.select(key), key, "left_anti").withColumn("side", F.lit("right"))
    return a.unionByName(b)


def merge_attributes(units: DataFrame, data: DataFrame, key: str = "geo_id", strict: bool = True) -> DataFrame:
    """``units`` with the columns of ``data``; a key that either lacks is an error, or its row goes without ``strict``."""
    if strict and (row := unmatched(units, data, key).first()):
        raise ValueError(f"{row['side']} table alone has {key} {row[key]!r}")
    return units.join(data, key, "inner")


def attach_parents(units: DataFrame, vtd: DataFrame | None = None) -> DataFrame:
    """``units`` of blocks with ``parent_<level>``: prefixes of the id, and the vtd of a crosswalk ``geo_id, parent_vtd``."""
    out = units
    for level in LEVELS[:4]:
        out = out.withColumn(f"parent_{level}", parent(F.col("geo_id"), level))
    return out if vtd is None else out.join(vtd, "geo_id", "left")


def roll_up(units: DataFrame, levels: tuple[str, ...] = LEVELS[:5]) -> DataFrame:
    """``layer, geo_id`` and the sums of all series, for every level that ``units`` has a parent column of.

    Levels that don't nest (vtd) and those that do are grouping sets of one aggregation.  Rows without a parent of a
    level are not in that level's sums.
    """
    have = [x for x in levels if f"parent_{x}" in units.columns]
    series = numeric_columns(units)
    keys = [F.struct(F.lit(x).alias("layer"), F.col(f"parent_{x}").alias("geo_id")) for x in have]
    rows = units.select(*series, F.explode(F.array(*keys)).alias("p")).where("p.geo_id is not null")
    return rows.groupBy("p.layer", "p.geo_id").agg(*(F.sum(c).alias(c) for c in series))
