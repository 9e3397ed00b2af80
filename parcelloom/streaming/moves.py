"""District totals from a stream of plan changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def move_totals(moves: DataFrame, units: DataFrame, series: str, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """What districts gain in a window of time, from moves ``ts, idx, src, dst`` that may be late.

    Each move is a loss to one district and a gain to the other; ``units`` is a static table that the stream is joined with.
    """
    both = moves.withWatermark("ts", late).join(units.select("idx", F.col(series).alias("w")), "idx")
    parts = both.select("ts", F.explode(F.array(F.struct(F.col("src").alias("district"), (-F.col("w")).alias("w")), F.struct(F.col("dst").alias("district"), F.col("w").alias("w")))).alias("p"))
    return parts.groupBy(F.window("ts", every).alias("t"), "p.district").agg(F.sum("p.w").alias("gain"), F.count("*").alias("moves")).select(F.col("t.start").alias("start"), "district", "gain", "moves")
