"""Filtered splits: what of a training set may be kept, with an account of everything removed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinsieve.plans.lineage import lookup

#: Groups of more rows than this, and than a two-hundredth of all, are hot.
HOT_ROWS = 20_000


def judged(tasks: DataFrame, group: str, order: str, suspect: str, bench: DataFrame) -> DataFrame:
    """``tasks`` (unique in ``order``) with ``verdict``: kept, removed_benchmark, removed_suspect or removed_duplicate.

    Tasks of groups that the benchmark has are removed; of each other group the first that isn't suspect is kept, and its others
    are duplicates; a group of suspects only is removed as such. A null group is a group of its own kind and never in the benchmark.
    """
    return _judged(tasks, group, order, suspect, bench).drop("group_order")


def _judged(tasks: DataFrame, group: str, order: str, suspect: str, bench: DataFrame) -> DataFrame:
    """Groups are summed up first, and their few values then reach the tasks, so that no group is sorted in one task.

    A group without a bug is a key like any other here, as a struct that holds a null.
    """
    keyed = tasks.withColumn("__key", F.struct(group))
    listed = bench.where(F.col(group).isNotNull()).select(F.struct(group).alias("__key")).distinct().withColumn("__bench", F.lit(True))
    rank = F.struct(F.col(suspect), F.col(order))
    per = keyed.groupBy("__key").agg(F.min(rank).alias("__first"), F.min(order).alias("group_order"), F.count(F.lit(1)).alias("weight")).join(listed, "__key", "left")
    total, hottest = per.agg(F.sum("weight"), F.max("weight")).head()
    known = lookup(keyed, per, "__key", max(HOT_ROWS, (total or 0) // 200), hottest or 0)
    verdict = F.when(F.col("__bench"), "removed_benchmark").when(F.col(f"__first.{suspect}"), "removed_suspect").when(rank == F.col("__first"), "kept").otherwise("removed_duplicate")
    return known.withColumn("verdict", verdict).drop("__key", "__first", "__bench")


def filtered_split(tasks: DataFrame, group: str, order: str, suspect: str, bench: DataFrame) -> DataFrame:
    """The kept tasks, with ``group_order``: where the group first appears."""
    return _judged(tasks, group, order, suspect, bench).where("verdict = 'kept'").drop("verdict")


def accounting(judged_tasks: DataFrame) -> DataFrame:
    """One row: kept, removed_benchmark, removed_suspect, removed_duplicates, total; the parts add up to the total."""
    count = lambda v: F.count_if(F.col("verdict") == v)
    return judged_tasks.agg(count("kept").alias("kept"), count("removed_benchmark").alias("removed_benchmark"), count("removed_suspect").alias("removed_suspect"), count("removed_duplicate").alias("removed_duplicates"), F.count(F.lit(1)).alias("total"))


def residual_members(kept: DataFrame, key: str, listed: DataFrame, ids: str, separator: str = ";") -> DataFrame:
    """One row: how many kept keys another list, with ids joined by a separator, still names."""
    named = listed.select(F.explode(F.split(F.col(ids), separator)).alias(key)).where(F.col(key) != "").distinct()
    return kept.select(key).distinct().join(named, key, "left_semi").agg(F.count(F.lit(1)).alias("still_listed"))


def outside(rows: DataFrame, pool: DataFrame, key: str) -> DataFrame:
    """The keys of rows that a pool lacks: none if the pool contains them all."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct().join(pool.select(key), key, "left_anti")


def is_injective(mapping: DataFrame, old: str = "old_id", new: str = "new_id") -> DataFrame:
    """One row: rows, distinct old and new ids, and whether no two old ids share a new one."""
    counts = mapping.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(old).alias("olds"), F.count_distinct(new).alias("news"))
    return counts.withColumn("injective", F.col("olds") == F.col("news"))
