"""Running sums over groups that may be larger than one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Slices a group is cut into.
SLICES = 512


def running_sum(df: DataFrame, group: list[str], place: Column, order: list, value: Column, name: str, slices: int = SLICES) -> DataFrame:
    """``df`` with the running sum ``name`` of ``value`` within ``group``, in the order of ``place`` then ``order``.

    ``place`` is a number in [0, 1) that rises with the wanted order. Each group is cut into ``slices`` by
    it; the sums of slices are made with partial aggregation (at most ``slices`` rows a group), their own
    running sum gives each slice its start, and rows are only ever sorted within a slice. A group that
    holds a third of all rows is thus spread over ``slices`` windows.
    """
    cut = df.withColumn("_slice", F.least(F.floor(place * slices), F.lit(slices - 1)).cast("int"))
    sums = cut.groupBy(*group, "_slice").agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(*group).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*(F.col(c).alias(f"_g_{c}") for c in group), F.col("_slice").alias("_g_slice"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    within = Window.partitionBy(*group, "_slice").orderBy(place, *order).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_slice") == F.col("_g_slice")
    for c in group:
        same = same & F.col(c).eqNullSafe(F.col(f"_g_{c}"))
    summed = cut.withColumn(name, F.sum(value).over(within))
    return summed.join(starts, same).withColumn(name, F.col(name) + F.col("_start")).drop("_slice", "_g_slice", "_start", *(f"_g_{c}" for c in group))


def slices_for(rows: int, least: int = SLICES, size: int = 200_000) -> int:
    """Slices that leave about ``size`` rows to each window where one group holds all rows."""
    return max(least, rows // size)


def shuffled(*columns: str, seed: int = 0) -> Column:
    """A number in [0, 1) for each row that depends on its columns and the seed only."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *columns), 11).cast("double")) / F.lit(float(1 << 53))


def bounded_sample(df: DataFrame, size: int) -> list:
    """At most ``size`` distinct rows, those of least hash, so that the same rows give the same sample and copies of one fill no more than its place.

    Rows are made distinct by their hash, which is aggregated before it is shuffled. A count of them sets a threshold on the hash first; each task then hands over its part of about 1.5 times
    ``size`` rows in all, not ``size`` rows of its own.
    """
    placed = df.withColumn("_vl_at", shuffled(*df.columns, seed=11))
    n = placed.select("_vl_at").agg(F.approx_count_distinct("_vl_at", 0.02)).first()[0]
    share = min(1.0, (1.6 * size + 50) / max(n, 1))
    few = placed.where(F.col("_vl_at") <= share).groupBy("_vl_at").agg(F.first(F.struct(*df.columns)).alias("_vl_row"))
    return [tuple(r[1]) for r in few.orderBy("_vl_at").limit(size).collect()]
