"""Numbering of rows without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from variantloom.session import cut


def _placed(df: DataFrame, order: list[str | Column]) -> tuple[DataFrame, DataFrame]:
    """``df`` range-sorted and written with ``_vl_part`` and ``_vl_at``, and the first number of each partition, a row each."""
    placed = cut(df.orderBy(*order).withColumns({"_vl_part": F.spark_partition_id(), "_vl_at": F.monotonically_increasing_id()}))
    sizes = placed.groupBy("_vl_part").agg(F.count("*").alias("_vl_size"), F.min("_vl_at").alias("_vl_least"))
    before = Window.orderBy("_vl_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    return placed, F.broadcast(sizes.select("_vl_part", "_vl_least", F.coalesce(F.sum("_vl_size").over(before), F.lit(0)).alias("_vl_first")))


def numbered(df: DataFrame, order: list[str | Column], name: str = "_n") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 in the given order.

    Rows are range-sorted once and written to the checkpoint folder with the partition they came to lie in;
    the partitions' sizes, a small table, give each its first number. Give it keys and what orders them, not
    texts, and join those afterwards. Ties in the order are numbered in some order that no longer changes
    afterwards. An empty table stays empty.
    """
    placed, firsts = _placed(df, order)
    return placed.join(firsts, "_vl_part").withColumn(name, F.col("_vl_first") + F.col("_vl_at") - F.col("_vl_least")).drop("_vl_part", "_vl_at", "_vl_least", "_vl_first")


def numbered_in_turn(df: DataFrame, group: list[str], order: list[str | Column], name: str = "_i", whole: str = "_n") -> DataFrame:
    """``df`` with ``whole``, its number from 0 in the order, and ``name``, its number from 0 within its group, from one range sort.

    A group is counted in each partition of the sort; running sums of these counts, a row for each group and
    partition it lies in, start the numbers within (group, partition), so that a group that holds most rows is
    numbered in as many tasks as the sort has. Null group values form groups of their own.
    """
    placed, firsts = _placed(df, order)
    keys = [F.col(g).alias(f"_vl_g{k}") for k, g in enumerate(group)]
    names = [f"_vl_g{k}" for k in range(len(group))]
    parts = placed.groupBy(*keys, F.col("_vl_part").alias("_vl_p")).agg(F.count("*").alias("_vl_size"))
    before = Window.partitionBy(*names).orderBy("_vl_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.withColumn("_vl_start", F.coalesce(F.sum("_vl_size").over(before), F.lit(0))).drop("_vl_size")
    same = F.col("_vl_part") == F.col("_vl_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_vl_g{k}"))
    own = placed.withColumn("_vl_own", F.row_number().over(Window.partitionBy("_vl_part", *group).orderBy("_vl_at")) - 1)
    out = own.join(firsts, "_vl_part").join(starts, same)
    return out.withColumns({whole: F.col("_vl_first") + F.col("_vl_at") - F.col("_vl_least"), name: F.col("_vl_start") + F.col("_vl_own")}).drop("_vl_part", "_vl_at", "_vl_least", "_vl_first", "_vl_own", "_vl_start", "_vl_p", *names)


def numbered_within(df: DataFrame, group: list[str], order: list[str | Column], name: str = "_i") -> DataFrame:
    """``df`` with ``name``, the row's number from 0 within its group; a group may be larger than a task.

    Null group values form groups of their own. Rows are sorted by group, so most groups lie in one partition.
    """
    return numbered_in_turn(df, group, [*group, *order], name, "_vl_whole").drop("_vl_whole")
