"""Mixing sources to target weights by pivotal dependent rounding.

A source's target over its size is how often each of its documents should be taken.  The whole part is
taken by all; the fraction is a probability that must become 0 or 1 for each document while the source's
words stay at the target.  Two documents meet, and a random amount of expected words goes from one to the
other until one of them is decided; either outcome keeps the sum and both expectations.  The other one
meets the next, from long documents to short ones, so that what stays undecided is short.  A bucket of some thousand documents leaves one undecided; these meet in buckets of
buckets, and so on up a tree whose last residual of a source is drawn.  All masses are integers, so a
source's words differ from the target by less than one document's (and the rounding of one rate).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelloom.llm import textkernel as tk
from parcelloom.llm.shared import numbered, restored, small_batches, written

#: Probabilities are multiples of 1 / ONE.
ONE = 1 << 30
BUCKET, FAN_IN = 8192, 256
#: Buckets of a task, about, and copies of a repeated row that are written by one.
BUCKETS_A_TASK, LOT = 2, 4096
MAX_SOURCES = 100_000


def cyclic_weights(sources: list) -> dict:
    """Weights 1, 2, 3, repeating, for sources by code point, null last."""
    names = sorted(x for x in sources if x is not None) + [None] * (None in sources)
    return {s: i % 3 + 1 for i, s in enumerate(names)}


def targets(sizes: dict, weights: dict, most: int = 3) -> dict:
    """Shares of all sizes by weight; none above ``most`` times its size, the excess reshared by weight."""
    left, open_ = Fraction(sum(sizes.values())), {s for s in sizes if weights.get(s, 0) > 0}
    out = {s: Fraction(0) for s in sizes}
    while open_:
        total = sum(Fraction(weights[s]) for s in open_)
        over = {s for s in open_ if left * Fraction(weights[s]) > most * sizes[s] * total}
        if not over:
            for s in open_:
                out[s] = left * Fraction(weights[s]) / total
            break
        for s in over:
            out[s] = Fraction(most * sizes[s])
            left -= out[s]
        open_ -= over
    return out


def _count_words(column: pa.Array) -> pa.Array:
    return pa.array(tk.word_counts(column))


def n_words(text: Column) -> Column:
    """The number of words ``[^\\x20\\x09-\\x0D]+`` of a text (null: 0).  Only texts go to Python and only numbers come back."""
    return F.arrow_udf(_count_words, "long")(text.cast("string"))


def _row_hash(docs: DataFrame) -> Column:
    """A fingerprint of a row: rows that agree in it and in their document's id are the same."""
    return F.xxhash64(F.lit(29), *(c.name for c in docs.schema if not isinstance(c.dataType, (T.MapType, T.VariantType))))


def _groups(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    """Equal rows as one: ``_id, _source, _size, _hash`` and ``_n``, how many there are."""
    narrow = docs.select(F.col(doc_id).cast("string").alias("_id"), F.col(source).alias("_source"), n_words(F.col(text)).alias("_size"), _row_hash(docs).alias("_hash"))
    return written(narrow.groupBy("_id", "_source", "_size", "_hash").agg(F.count("*").alias("_n")), "groups")


def _draw(*key) -> int:
    return int.from_bytes(hashlib.blake2b(repr(key).encode(), digest_size=8).digest(), "big")


def _pivot(seed: int, names: list[str]):
    """Decide all rows of a bucket but one.  Rows hold ``_src, _bucket, _key, _size, _mass, _copies`` and more.

    A mass is a document's size times its probability times ``ONE``; it is null once the document is decided.
    """
    i_src, i_bucket, i_key, i_size, i_mass, i_copies = (names.index(x) for x in ("_src", "_bucket", "_key", "_size", "_mass", "_copies"))

    def again(row: pa.RecordBatch, mass: list, copies: list) -> pa.RecordBatch:
        columns = list(row.columns)
        columns[i_mass], columns[i_copies] = pa.array(mass, pa.int64()), pa.array(copies, pa.int64())
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # (row, group, key, size, mass, copies), as its batch has been sent
        for batch in batches:
            src, bucket, key, size, mass, copies = (batch.column(i).to_pylist() for i in (i_src, i_bucket, i_key, i_size, i_mass, i_copies))
            out: list = list(mass)
            local = None  # the undecided row, if of this batch
            if held:
                group, a_key, a_size, a_mass, a_copies = held[1:]
            else:
                group = None
            for n in range(len(src)):
                s, m = size[n], mass[n]
                if m is None or m == 0 or m == s * ONE:
                    if m is not None:
                        copies[n] += m > 0
                        out[n] = None
                    continue
                if group != (src[n], bucket[n]):
                    if held:
                        yield again(held[0], [a_mass], [a_copies])
                        held = None
                    elif local is not None:
                        out[local], copies[local] = a_mass, a_copies
                    group, local = (src[n], bucket[n]), n
                    a_key, a_size, a_mass, a_copies = key[n], s, m, copies[n]
                    continue
                up = min(a_mass, s * ONE - m)  # from the held one to this
                down = min(m, a_size * ONE - a_mass)
                if _draw(seed, group, a_key, key[n]) * (up + down) < down << 64:
                    a_new, b_new = a_mass - up, m + up
                else:
                    a_new, b_new = a_mass + down, m - down
                if 0 < a_new < a_size * ONE:  # this row is decided
                    a_mass = a_new
                    copies[n] += b_new > 0
                    out[n] = None
                    continue
                a_copies += a_new > 0  # the held one is decided
                if held:
                    yield again(held[0], [None], [a_copies])
                    held = None
                else:
                    out[local], copies[local] = None, a_copies
                if 0 < b_new < s * ONE:
                    local, a_key, a_size, a_mass, a_copies = n, key[n], s, b_new, copies[n]
                else:
                    copies[n] += b_new > 0
                    out[n] = None
                    group, local = None, None
            if local is not None:
                rest = pa.array([n != local for n in range(len(src))])
                held = (batch.slice(local, 1), group, a_key, a_size, a_mass, a_copies)
                yield again(batch, out, copies).filter(rest)
            else:
                if held:
                    held = (held[0], group, a_key, a_size, a_mass, a_copies)
                yield again(batch, out, copies)
        if held:
            yield again(held[0], [held[4]], [held[5]])

    return run


def mix(docs: DataFrame, weights=cyclic_weights, most: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source`` of every row, ``_copies`` (how often the mix takes it), ``_size``, ``_source_size`` and ``_target``.

    ``weights`` maps the list of sources to a weight for each.  Sizes are words; a null, empty or blank text
    has none and is taken as its source's whole part says, which adds no words.  A null source is a source.
    Outcomes depend on the seed, the id, the size and the content of a row, so reruns agree; equal rows share the
    copies of all of them, as evenly as can be.  Other columns are not returned.  An empty table gives an empty result.
    Up to ``MAX_SOURCES`` sources are planned on the driver.  Beyond, cyclic weights are planned in Spark, with the same
    results; other weights, which need a list of all sources, raise a ValueError there.
    """
    spark, kind = docs.sparkSession, docs.schema[doc_id].dataType
    small_batches(spark)
    docs, names = numbered(docs)
    taken = _mixed(spark, _groups(docs, names[doc_id], names[text], names[source]), weights, most, seed)
    # a row for each of the equal rows; the first of them have what does not divide
    each = taken.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    share = F.floor(F.col("_copies") / F.col("_n")) + F.when(F.col("_i") < F.col("_copies") % F.col("_n"), 1).otherwise(0)
    return each.select(F.col("_id").cast(kind).alias(doc_id), F.col("_source").alias(source), share.cast("long").alias("_copies"), "_size", "_source_size", "_target")


_PLAN = "_s string, _src int, _source_size long, _target double, _whole long, _part long, _buckets int"


def _planned(s, n: int, size: int, rows: int, goal: Fraction, bucket: int) -> tuple:
    rate = goal / size if size else Fraction(0)
    return s, n, size, float(goal), int(rate), int((rate - int(rate)) * ONE), -(-rows // bucket)


def _plan_of_many(totals: DataFrame, most: int) -> DataFrame:
    """The plan of ``cyclic_weights`` and ``targets`` from aggregates over the weights: sources stay in Spark.

    Of a weight's sources the small ones are above ``most`` times their size, so a size that bounds them says which.
    """
    spark, bucket = totals.sparkSession, BUCKET
    ordered = written(totals, "totals").orderBy(F.col("s").asc_nulls_last()).rdd.zipWithIndex()
    named = written(spark.createDataFrame(ordered.map(lambda x: (x[0]["s"], x[1], x[0]["size"], x[0]["rows"], x[1] % 3 + 1)), "s string, n long, size long, rows long, w long"), "sources")
    weights = {r["w"]: r for r in named.groupBy("w").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()}
    open_, left = {w: r["n"] for w, r in weights.items()}, Fraction(sum(r["size"] for r in weights.values()))
    cut, unit = dict.fromkeys(open_, -1), Fraction(0)
    while total := sum(w * n for w, n in open_.items()):
        # the largest size with most * size * total < left * w
        to = {w: max(cut[w], -(-left * w // (most * total)) - 1) for w in open_}
        over = named.where(" or ".join(f"w = {w} and size > {cut[w]} and size <= {to[w]}" for w in open_)).groupBy("w").agg(F.count("*").alias("n"), F.sum("size").alias("size")).collect()
        if not over:
            unit = left / total
            break
        for r in over:
            open_[r["w"]] -= r["n"]
            left -= most * r["size"]
        cut = to

    def planned(r) -> tuple:
        goal = Fraction(most * r["size"]) if r["size"] <= cut[r["w"]] else unit * r["w"]
        return _planned(r["s"], r["n"], r["size"], r["rows"], goal, bucket)

    return written(spark.createDataFrame(named.rdd.map(planned), _PLAN), "plan")


def _mixed(spark, groups: DataFrame, weights, most: int, seed: int) -> DataFrame:
    """The ``groups`` with ``_source_size, _target`` and ``_copies``, how often the rows of a group are taken in all."""
    totals = groups.groupBy(F.col("_source").alias("s")).agg(F.sum(F.col("_size") * F.col("_n")).alias("size"), F.count("*").alias("rows"))
    found = totals.limit(MAX_SOURCES + 1).collect()
    if len(found) > MAX_SOURCES:
        if weights is not cyclic_weights:
            raise ValueError(f"more than {MAX_SOURCES} sources, and other weights than cyclic ones")
        table = _plan_of_many(totals, most)
        # a source has one bucket at least
        n_buckets, deep = table.agg(F.sum("_buckets"), F.max("_buckets")).first()
    else:
        sizes = {r["s"]: r["size"] for r in found}
        goal = targets(sizes, weights(list(sizes)), most)
        plan = [_planned(r["s"], n, r["size"], r["rows"], goal[r["s"]], BUCKET) for n, r in enumerate(sorted(found, key=lambda r: (r["s"] is None, r["s"])))]
        n_buckets, deep = sum(p[6] for p in plan), max([p[6] for p in plan], default=1)
        table = F.broadcast(spark.createDataFrame(plan, _PLAN))
    rows = groups.join(table, F.col("_source").eqNullSafe(F.col("_s")))
    # of n equal rows whole copies are taken for sure, and the rest is the fraction of one row
    key, parts = F.concat_ws(":", F.coalesce("_id", F.lit("")), F.col("_hash").cast("string")), F.col("_part") * F.col("_n")
    left = F.pmod(parts, F.lit(ONE))
    mass = F.when(left * F.col("_size") > 0, left * F.col("_size"))
    sure = F.col("_whole") * F.col("_n") + F.when(F.col("_size") > 0, F.shiftright(parts, ONE.bit_length() - 1)).otherwise(0)
    rows = rows.select(*groups.columns, "_source_size", "_target", "_src", F.pmod(F.xxhash64(key, "_size"), F.col("_buckets")).cast("int").alias("_bucket"), key.alias("_key"), mass.alias("_mass"), sure.alias("_copies"))
    levels = []
    while True:
        # some buckets to a task, however many there are
        n = max(1, -(-n_buckets // BUCKETS_A_TASK))
        run = _pivot(seed + len(levels), rows.columns)
        done = rows.repartition(n, "_src", "_bucket").sortWithinPartitions("_src", "_bucket", F.desc("_size"), "_key").mapInArrow(run, rows.schema)
        done = written(done, "level")
        levels.append(done.where("_mass is null"))
        rest = done.where("_mass is not null")
        if deep <= 1:
            # the last residual of a source: one row a source
            draw = F.pmod(F.xxhash64(F.lit(seed), "_src", "_key"), F.lit(ONE))
            levels.append(rest.withColumn("_copies", F.col("_copies") + F.when(draw * F.col("_size") < F.col("_mass"), 1).otherwise(0)))
            break
        rows = rest.withColumn("_bucket", F.floor(F.col("_bucket") / FAN_IN).cast("int"))
        deep = -(-deep // FAN_IN)
        n_buckets = max(len(found), -(-n_buckets // FAN_IN))
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    return out.drop("_src", "_bucket", "_key", "_mass")


def mixed_rows(docs: DataFrame, weights=cyclic_weights, most: int = 3, seed: int = 17, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with their columns (see ``mix``).

    What is taken is decided on narrow rows; texts move once, to the decisions, and only within the JVM.  Equal rows
    are taken together: one of them is written as often as all are taken.  Null ids and texts are values like others,
    columns keep their names, and an empty table stays empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs, names = numbered(docs)
    key = names[doc_id]
    taken = _mixed(spark, _groups(docs, key, names[text], names[source]), weights, most, seed).where("_copies > 0")
    taken = written(taken.select("_id", F.col("_hash").alias("_row"), "_copies", "_n"), "taken")
    hashed = docs.withColumn("_h", _row_hash(docs))
    same = (F.col("_h") == F.col("_row")) & F.col(key).cast("string").eqNullSafe(F.col("_id"))
    # the decisions are the side that is held in memory, a partition at a time
    found = hashed.join(taken.where("_n = 1").hint("shuffle_hash"), same)
    out = found.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int")))).drop("col")
    if not taken.where("_n > 1").isEmpty():
        # equal rows become one before they meet, and its copies are spread in lots
        one = hashed.join(taken.where("_n > 1").hint("shuffle_hash"), same).groupBy("_row", "_id", "_copies").agg(*(F.first(c).alias(c) for c in docs.columns))
        lots = one.withColumn("_lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_copies") - 1) / LOT)))).repartition("_row", "_lot")
        here = F.least(F.lit(LOT), F.col("_copies") - F.col("_lot") * LOT).cast("int")
        out = out.unionByName(lots.select(*docs.columns, F.explode(F.array_repeat(F.lit(1), here))).drop("col"))
    return restored(out, names)


def op9_pivotal_mixing(spark, sf_dir: str) -> DataFrame:
    """Weights 1, 2, 3 over the sources of all documents, none taken more than three times over."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"))
