"""Small maps of unit squares and other shapes, in degrees near the equator."""

from pyspark.sql import functions as F

GEOM = "idx int, geom array<array<array<struct<x:double,y:double>>>>"


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def frame(spark, units):
    """``units``: for each unit its polygons, each a list of rings."""
    return spark.createDataFrame([(i, [[[{"x": float(x), "y": float(y)} for x, y in r] for r in p] for p in u]) for i, u in enumerate(units)], GEOM)


def squares(spark, cells):
    return frame(spark, [[[box(x, y, x + 1, y + 1)]] for x, y in cells])


def sets(df, *columns):
    return {tuple(r[c] for c in columns) for r in df.select(*columns).collect()}


def plan(spark, districts, chain=0):
    return spark.createDataFrame([(chain, i, d) for i, d in enumerate(districts)], "chain int, idx int, district int")


GRID3 = [(x, y) for y in range(3) for x in range(3)]
DONUT = [
    [[box(0, 0, 14, 10), box(1, 2, 4, 8), box(5, 2, 11, 8), box(12, 2, 13, 8)]],  # the outer unit, with a gap at the right
    [[box(1, 2, 4, 8)]], [[box(5, 2, 8, 8)]], [[[(8, 2), (11, 2), (11, 8), (8, 8), (8, 2)]]],
]
__all__ = ["DONUT", "F", "GRID3", "box", "frame", "plan", "sets", "squares"]
