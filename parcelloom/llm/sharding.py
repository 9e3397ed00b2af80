"""Uniform sharding by a hypergeometric communication matrix.

Rows lie in partitions by a hash of their key.  How many rows of each partition go to each shard is drawn
exactly, without replacement, from the partitions' and shards' sizes: the matrix's rows add up to the
partitions' counts and its columns to the shards' sizes.  Each partition permutes its rows and deals them
out in that order by its row of the matrix; each shard permutes what it receives.  Every assignment of rows
to shards of these sizes is then equally likely, and the sizes are exact.

Permutations are ranks by seeded hashes.  A shard's permutation is done in buckets of the hash range, and
slots come from the buckets' counts, so that no task sorts a whole shard.
"""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parcelloom.llm.shared import numbered, parts_for, restored, written

#: Rows of a partition or of a bucket, about, and the most of either; the matrix has shards times partitions entries.
EACH, MOST = 16384, 65536


def _hypergeometric(rng: random.Random, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` drawn from ``good + bad`` are good: exact inversion from the mode outwards."""
    total = good + bad
    low, high = max(0, draws - bad), min(draws, good)
    if low == high:
        return low
    from math import exp, lgamma

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    mode = min(high, max(low, (draws + 1) * (good + 1) // (total + 2)))
    p = exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(total, draws))
    u = rng.random() - p
    left = right = mode
    p_left = p_right = p
    while u > 0 and (left > low or right < high):
        if right < high:
            p_right *= (good - right) * (draws - right) / ((right + 1) * (bad - draws + right + 1))
            right += 1
            u -= p_right
            if u <= 0:
                return right
        if left > low:
            p_left *= left * (bad - draws + left) / ((good - left + 1) * (draws - left + 1))
            left -= 1
            u -= p_left
            if u <= 0:
                return left
    return mode


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> list[list[int]]:
    """Rows for each of each partition's counts dealt to the shards; columns add up to ``sizes``."""
    rng, left, out = random.Random(seed), list(sizes), []
    for n in counts:
        row, rest, pool = [], n, sum(left)
        for s in range(len(left)):
            k = _hypergeometric(rng, left[s], pool - left[s], rest)
            pool -= left[s]
            left[s] -= k
            rest -= k
            row.append(k)
        out.append(row)
    return out


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def told_apart(df: DataFrame, key: list[str]) -> DataFrame:
    """``df`` with ``_copy``, written: numbers from 0 of the rows that agree in ``key``.

    A key that many rows have is counted input partition by input partition, and each partition's numbers go on
    from those before, so no task sees all of its rows and the numbers don't depend on how the input is split.
    """
    at = written(df.withColumns({"_from": F.spark_partition_id(), "_h": F.xxhash64(*key)}), "split")
    before = F.sum("_n").over(Window.partitionBy("_h").orderBy("_from").rowsBetween(Window.unboundedPreceding, -1))
    counts = at.groupBy("_h", "_from").agg(F.count("*").alias("_n")).select("_h", "_from", before.alias("_before")).where("_before is not null")
    copy = F.row_number().over(Window.partitionBy("_h", "_from").orderBy("_from")) - 1
    out = at.withColumn("_copy", copy).join(counts, ["_h", "_from"], "left").withColumn("_copy", F.col("_copy") + F.coalesce("_before", F.lit(0)))
    return written(out.drop("_from", "_h", "_before"), "told_apart")


def uniform_shards(df: DataFrame, shards: int, key: list, seed: int = 11) -> DataFrame:
    """``df`` with ``shard`` (0 to ``shards - 1``, counts at most one apart) and ``slot`` (gapless from 0 in a shard).

    ``key`` names columns that tell rows apart; rows that agree in them are spread like any others but are
    interchangeable.  Nulls in ``key`` are values.  Columns named ``shard`` and ``slot`` are replaced.  An empty
    table gives an empty result.
    """
    spark = df.sparkSession
    df, names = numbered(df)
    key = [names[c] for c in key]
    df = told_apart(df, key)
    key = [*key, "_copy"]
    parts = parts_for(df.count(), EACH, 24, MOST)
    at = F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(parts)).cast("int")
    counts = {r["_part"]: r["n"] for r in df.select(at.alias("_part")).groupBy("_part").agg(F.count("*").alias("n")).collect()}
    matrix = communication_matrix([counts.get(p, 0) for p in range(parts)], shard_sizes(sum(counts.values()), shards), seed)
    bounds = []
    for p, row in enumerate(matrix):
        upto, ends = 0, []
        for n in row:
            upto += n
            ends.append(upto)
        bounds.append((p, ends))
    table = spark.createDataFrame(bounds, "_part int, _ends array<long>")
    local = Window.partitionBy("_part").orderBy("_r1", *key)
    dealt = df.withColumn("_part", at).withColumn("_r1", F.xxhash64(F.lit(seed + 1), *key)).withColumn("_rank", F.row_number().over(local))
    dealt = dealt.join(F.broadcast(table), "_part").withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_rank"))).cast("int"))
    buckets = max(1, parts // shards)
    # the shard's own permutation: by a second hash that the first does not determine
    dealt = dealt.withColumn("_r2", F.xxhash64(F.lit(seed + 2), "_part", "_rank")).withColumn("_bucket", F.pmod("_r2", F.lit(buckets)).cast("int")).drop("_ends", "_r1")
    dealt = written(dealt, "dealt")
    sums = dealt.groupBy("shard", "_bucket").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)))
    sums = sums.select("shard", "_bucket", F.coalesce("_before", F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("_r2", "_part", "_rank"))
    # at most a row for each bucket: no more than MOST in all
    placed = dealt.withColumn("_in", within).join(F.broadcast(sums), ["shard", "_bucket"])
    return restored(placed.withColumn("slot", (F.col("_before") + F.col("_in") - 1).cast("long")), names, "shard", "slot")


def write_shards(df: DataFrame, path: str, shards: int, key: list, seed: int = 11) -> None:
    """The rows of ``df`` as Parquet, a folder for each shard; within a file rows are in the order of their slots."""
    out = uniform_shards(df, shards, key, seed)
    out.repartition("shard", F.floor(F.col("slot") / EACH)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op4_hypergeometric_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents into 24 shards by the law ``rows``."""
    text = F.coalesce("text", F.lit(""))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    out = uniform_shards(docs, 24, ["doc_id", "size", "text_crc32"])
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
