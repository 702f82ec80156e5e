"""Repository-held-out splits. Folds are columns keyed by repository, never positions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


GROUPS_PER_CELL = 100_000


def group_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, group: str = "full_name") -> DataFrame:
    """Adds is_test: the ceil(test_size * groups) groups of smallest seeded hash.

    Only distinct groups are ordered; rows get the flag by a join on the group.
    """
    groups = df.select(group).distinct().withColumn("_h", F.xxhash64(F.lit(seed), group))
    n = groups.count()
    chosen = groups.orderBy("_h", group).limit(math.ceil(test_size * n)).select(F.col(group), F.lit(True).alias("is_test"))
    return df.join(chosen, group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def group_folds(df: DataFrame, k: int = 5, group: str = "full_name") -> DataFrame:
    """Adds fold: groups in order of size, largest first, are dealt to and fro over the folds: 0 1 2, 2 1 0, 0 ...

    One rule for any number of groups. A group's place is its number within its cell (equal size and hash) and
    the sizes of the cells before; only one row a cell, a hundred thousand groups or a size, is ordered at once.
    A null group is dropped.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    groups = sizes.count()
    k = min(k, groups)
    if k < 2:
        raise ValueError("at least two groups are needed")
    cell = sizes.withColumn("_cell", F.pmod(F.xxhash64(group), F.lit(-(-groups // GROUPS_PER_CELL))))
    before = F.sum("_c").over(W.orderBy(F.desc("_n"), "_cell").rowsBetween(W.unboundedPreceding, -1))
    starts = cell.groupBy("_n", "_cell").agg(F.count(F.lit(1)).alias("_c")).withColumn("_start", F.coalesce(before, F.lit(0)))
    place = F.row_number().over(W.partitionBy("_n", "_cell").orderBy(group)) - 1
    placed = cell.withColumn("_k", place).join(starts.select("_n", "_cell", "_start"), ["_n", "_cell"]).withColumn("_place", F.col("_start") + F.col("_k"))
    turn, at = F.floor(F.col("_place") / k), F.col("_place") % k
    fold = F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int")
    return df.join(placed.select(group, fold.alias("fold")), group)


def overlap_report(df: DataFrame, group: str = "full_name") -> DataFrame:
    """One row: rows and groups of each side, shared groups, leakage_free; from one row a group."""
    per = df.groupBy(group).agg(F.count_if("is_test").alias("te"), F.count_if(~F.col("is_test")).alias("tr"))
    return per.agg(
        F.sum("tr").alias("train_rows"), F.sum("te").alias("test_rows"), F.count_if(F.col("tr") > 0).alias("train_repos"), F.count_if(F.col("te") > 0).alias("test_repos"),
        F.count_if((F.col("tr") > 0) & (F.col("te") > 0)).alias("overlap"), (F.count_if((F.col("tr") > 0) & (F.col("te") > 0)) == 0).alias("leakage_free"),
    )


def eligible(df: DataFrame, label: str, least: int, is_train: str = "NOT is_test") -> DataFrame:
    """Rows whose class has at least so many training rows."""
    classes = df.where(is_train).groupBy(label).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    return df.join(classes.select(label), label, "left_semi")


def stratified_sample(df: DataFrame, label: str, total: int, classes: int, seed: int = 42, row_id: str = "row_id") -> DataFrame:
    """min(total // classes, size) rows a class, chosen by seeded hash (a sampling operator)."""
    k = F.row_number().over(W.partitionBy(label).orderBy(F.xxhash64(F.lit(seed), row_id), row_id))
    return df.withColumn("_k", k).where(F.col("_k") <= total // classes).drop("_k")


def first_per_class(df: DataFrame, label: str, n: int = 1, least_response: int = 40, row_id: str = "row_id") -> DataFrame:
    """Exemplars: the first n rows a class among those with a long response, or among all if there is none."""
    long = F.length(F.coalesce("agent_response", F.lit(""))) > least_response
    any_long = F.max(long).over(W.partitionBy(label))
    pool = df.withColumn("_any", any_long).where(long | ~F.col("_any"))
    return pool.withColumn("_k", F.row_number().over(W.partitionBy(label).orderBy(row_id))).where(F.col("_k") <= n).drop("_any", "_k")
