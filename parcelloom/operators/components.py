"""Connected components of an edge table by random contraction."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from parcelloom.storage import table

#: Edges that one task joins up by itself; more are contracted first.
LOCAL_EDGES = 200_000


def _local(columns: list[str], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For ``mapInArrow`` over all edges ``columns`` (keys and both ends) in one task: ``(*keys, node, up)`` with the smallest node of each component."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[tuple, tuple] = {}

        def root(x: tuple) -> tuple:
            while (y := up.setdefault(x, x)) != x:
                up[x] = up[y]  # paths are halved on the way
                x = y
            return x

        for batch in batches:
            for *k, a, b in zip(*(batch.column(c).to_pylist() for c in columns)):
                x, y = root((*k, a)), root((*k, b))
                if x != y:
                    low, high = (x, y) if x[-1] < y[-1] else (y, x)
                    up[high] = low
        if up:
            rows = [(*x, root(x)[-1]) for x in list(up)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], names=schema.names)

    return run


def component_labels(nodes: DataFrame, edges: DataFrame, keys: list[str], most_rounds: int = 60) -> DataFrame:
    """``nodes(*keys, node)`` with ``root``: the smallest node that edges ``(*keys, a, b)`` reach under equal keys.

    Every round draws an order of the nodes anew (a hash with the round's number), hangs each node under the first of itself
    and its neighbours and follows that twice; nodes that meet go on as one, under the smallest's name, and edges within one
    go.  As the order is random, paths are short whatever the nodes' numbers are, so a round leaves a part of the nodes
    that doesn't depend on a component's shape or width.  State is written to the shared folder each round.  Once
    ``LOCAL_EDGES`` are left, one task joins them up.
    """
    live = table(edges.where("a <> b").select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    parents: list[DataFrame] = []  # (*keys, node, up) of every round
    for number in range(most_rounds):
        if not (left := live.count()):
            break
        if left <= LOCAL_EDGES:
            form = live.select(*keys, F.col("a").alias("node"), F.col("b").alias("up")).schema
            parents.append(table(live.repartition(1).mapInArrow(_local([*keys, "a", "b"], to_arrow_schema(form)), form), "parents"))
            break
        rank = lambda c: F.struct(F.xxhash64(F.lit(number), *keys, c).alias("h"), F.col(c).alias("v"))
        both = live.unionByName(live.select(*keys, F.col("b").alias("a"), F.col("a").alias("b")))
        up = both.groupBy(*keys, F.col("a").alias("node")).agg(F.min(rank("b")).alias("m")).select(*keys, "node", F.least("m", rank("node"))["v"].alias("up"))
        for _ in range(2):
            above = up.select(*keys, F.col("node").alias("up"), F.col("up").alias("higher"))
            up = up.join(above, [*keys, "up"]).select(*keys, "node", F.col("higher").alias("up"))
        up = table(up.select(*keys, "node", F.min("node").over(Window.partitionBy(*keys, "up")).alias("up")), "parents")
        parents.append(up)
        a = up.select(*keys, F.col("node").alias("a"), F.col("up").alias("x"))
        b = up.select(*keys, F.col("node").alias("b"), F.col("up").alias("y"))
        live = live.join(a, [*keys, "a"]).join(b, [*keys, "b"]).where("x <> y")
        live = table(live.select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    # from the last round back, as each has far fewer nodes than the one before
    found = None
    for up in reversed(parents):
        if found is not None:
            above = found.select(*keys, F.col("node").alias("up"), F.col("up").alias("higher"))
            up = up.join(above, [*keys, "up"], "left").select(*keys, "node", F.coalesce("higher", "up").alias("up"))
        found = up
    if found is None:
        return nodes.select(*keys, "node", F.col("node").alias("root"))
    return nodes.join(found, [*keys, "node"], "left").select(*keys, "node", F.coalesce("up", "node").alias("root"))
