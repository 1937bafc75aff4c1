"""Sampling and ordering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from temblor.operators.components import numbered


def stratified(cat: DataFrame, target: int) -> DataFrame:
    """Every k-th row of each whole-magnitude bin, in input order, ``target`` rows at most.

    A bin of n rows gives max(1, floor(target * n / N)) at a step of max(1, floor(n /
    that)); bins follow in order of first appearance, and the last ones are cut at the
    target.  The catalogue itself if it is no larger; nothing for a target of 0 or less.
    Rows are numbered in ranges of bin and input order, so a bin that holds nearly all
    of them is shared by tasks; only the sampled rows, about ``target``, are sorted together.
    """
    if target <= 0:
        return cat.limit(0)
    total = cat.count()
    if total <= target:
        return cat
    binned = cat.withColumn("_bin", F.floor("magnitude"))
    plan = binned.groupBy("_bin").agg(F.count("*").alias("_n"), F.min("row_idx").alias("_first"))
    plan = plan.withColumn("_want", F.greatest(F.lit(1), F.floor(F.lit(float(target)) * F.col("_n") / total).cast("bigint")))
    plan = plan.withColumn("_step", F.greatest(F.lit(1), F.floor(F.col("_n") / F.col("_want")).cast("bigint")))
    lower = Window.partitionBy(F.lit(1)).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as magnitude classes
    plan = plan.withColumn("_base", F.coalesce(F.sum("_n").over(lower), F.lit(0)))
    ranked = numbered(binned, [F.col("_bin"), F.col("row_idx")], "_pos")
    picked = ranked.join(F.broadcast(plan), "_bin").withColumn("_rn", F.col("_pos") - F.col("_base") + 1).filter((F.col("_rn") - 1) % F.col("_step") == 0)  # as many rows as magnitude classes
    picked = picked.orderBy("_first", "_rn").limit(target)
    return picked.drop("_bin", "_n", "_first", "_want", "_step", "_rn", "_base", "_pos")


def uniform(cat: DataFrame, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` rows, repeatable by seed: the smallest hashes of the row index."""
    return cat.orderBy(F.xxhash64(F.lit(seed), "row_idx"), "row_idx").limit(size)


def device_limit(base: int, tier: str = "mid") -> int:
    """Row limit of a view by device tier: twice for high, half for low."""
    return int(base * {"high": 2.0, "mid": 1.0, "low": 0.5}[tier])


def by_time(cat: DataFrame, newest_first: bool = False) -> DataFrame:
    return cat.orderBy(F.desc("timeMs"), F.desc("row_idx")) if newest_first else cat.orderBy("timeMs", "row_idx")


def by_magnitude(cat: DataFrame) -> DataFrame:
    return cat.orderBy(F.desc("magnitude"), "row_idx")


def largest(cat: DataFrame, k: int = 10) -> DataFrame:
    return by_magnitude(cat).limit(k)
