"""Samples, shards and orders that come out the same every time."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import checkpointed


def numbered(df: DataFrame, order: list[str], out: str = "index") -> DataFrame:
    """A running number from 0 in the given order, by sums over ranges, so that no task sorts everything."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = checkpointed(ranged.withColumn("sievewright_part", F.spark_partition_id()).withColumn("sievewright_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = ranged.groupBy("sievewright_part").agg(F.count("*").alias("sievewright_n"))
    before = F.sum("sievewright_n").over(Window.orderBy("sievewright_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("sievewright_part", F.coalesce(before, F.lit(0)).alias("sievewright_before"))
    return ranged.join(sizes, "sievewright_part").withColumn(out, F.col("sievewright_before") + F.col("sievewright_at")).drop("sievewright_part", "sievewright_at", "sievewright_n", "sievewright_before")


def running_sum(df: DataFrame, order: list[str], weight: str, out: str = "before") -> DataFrame:
    """The sum of the weights of the rows before each row in the given order; only a range of rows is sorted by one task."""
    ranged = checkpointed(df.repartitionByRange(*order).withColumn("sievewright_part", F.spark_partition_id()))
    sizes = ranged.groupBy("sievewright_part").agg(F.sum(weight).alias("sievewright_n"))
    before = F.sum("sievewright_n").over(Window.orderBy("sievewright_part").rowsBetween(Window.unboundedPreceding, -1))
    sizes = sizes.select("sievewright_part", F.coalesce(before, F.lit(0)).alias("sievewright_before"))
    own = F.coalesce(F.sum(weight).over(Window.partitionBy("sievewright_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.join(sizes, "sievewright_part").withColumn(out, F.col("sievewright_before") + own).drop("sievewright_part", "sievewright_n", "sievewright_before")


def round_robin(index: Column, shards: int) -> Column:
    """The shard of the row with this number."""
    return F.pmod(index, F.lit(shards)).cast("int")


def hash_sample(df: DataFrame, key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows, those with the least hash of seed and key."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(k)


def seeded_indices(n: int, k: int, seed: int) -> list[int]:
    """The row numbers that Python's generator draws, sorted; all if k is n or more."""
    return list(range(n)) if k >= n else sorted(random.Random(seed).sample(range(n), k))


def stratified(df: DataFrame, key: str, score: str, k: int, seed: int = 42) -> DataFrame:
    """About k rows, a fifth from each quarter of the scores and from the rows without one; what does not divide goes to the first.

    A quarter has max(1, n div 4) rows, the last takes the rest. Within a stratum the least hashes win.
    """
    n = df.agg(F.count(score)).first()[0]
    ranked = numbered(df.withColumn("sievewright_none", F.col(score).isNull()), ["sievewright_none", score, key], "sievewright_place").drop("sievewright_none")
    stratum = F.when(F.col(score).isNull(), 4).otherwise(F.least(F.lit(3), F.floor(F.col("sievewright_place") / max(1, n // 4)))).cast("int")
    rank = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    out = ranked.withColumn("stratum", stratum).withColumn("sievewright_rank", rank).where(F.col("sievewright_rank") <= k // 5 + k % 5)  # a constant, so that tasks drop the rest before they shuffle
    return out.where((F.col("stratum") == 0) | (F.col("sievewright_rank") <= k // 5)).drop("sievewright_rank", "sievewright_place")


def sample_rows(df: DataFrame, order: list[str], k: int, seed: int = 42) -> DataFrame:
    """k rows, those whose numbers in the given order Python's generator draws; all if there are k or fewer."""
    if (n := df.count()) <= k:
        return df
    drawn = df.sparkSession.createDataFrame([(i,) for i in seeded_indices(n, k, seed)], "sievewright_index long")
    return numbered(df, order, "sievewright_index").join(F.broadcast(drawn), "sievewright_index", "left_semi").drop("sievewright_index")


def striped(df: DataFrame, group: str, order: str) -> DataFrame:
    """A column `turn`: groups take turns, in the order in which they are met first. order: distinct values."""
    placed = numbered(df, [group, order], "sievewright_place")
    firsts = placed.groupBy(group).agg(F.min("sievewright_place").alias("sievewright_base"), F.min(order).alias("sievewright_first"))
    own = placed.join(firsts, placed[group].eqNullSafe(firsts[group])).select(placed["*"], "sievewright_first", (F.col("sievewright_place") - F.col("sievewright_base")).alias("sievewright_own"))
    return numbered(own, ["sievewright_own", "sievewright_first"], "turn").drop("sievewright_own", "sievewright_first", "sievewright_place")


def endpoint(prefix: Column, n: int, replicas: int = 1, index: Column | None = None) -> Column:
    """Of n endpoints that of a prefix; with replicas, requests go round that many from it on."""
    home = F.pmod(F.xxhash64(prefix), F.lit(n))
    return (F.pmod(home + F.pmod(index, F.lit(replicas)), F.lit(n)) if index is not None else home).cast("int")
