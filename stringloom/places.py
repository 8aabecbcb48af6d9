"""Places of rows within groups, counted without a group ever meeting in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stringloom.session import cut


def positions(df: DataFrame, group: str, order: Sequence[Column], name: str = "position", facts: DataFrame | None = None) -> DataFrame:
    """``df`` with each row's place, from 1, in its group: sorted ranges, then offsets from the ranges' counts.

    ``df`` is read twice and should be narrow and cut. Only (range, group, count) rows of one group meet in one
    place. ``facts`` are further columns by ``_group``; they reach the rows through the (range, group) offsets,
    so that no join deals all rows of a group to one task.
    """
    ranged = df.repartitionByRange(F.col(group).asc_nulls_last(), *order).withColumn("_range", F.spark_partition_id())
    ranged = cut(ranged)
    counts = ranged.groupBy("_range", group).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_range").alias("_r"), F.col(group).alias("_g"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    if facts is not None:
        offsets = offsets.join(facts, F.col("_g").eqNullSafe(F.col("_group"))).drop("_group")
    inside = Window.partitionBy("_range", group).orderBy(*order)
    numbered = ranged.withColumn("_inside", F.row_number().over(inside))
    joined = numbered.join(offsets, (F.col("_range") == F.col("_r")) & F.col(group).eqNullSafe(F.col("_g")))
    return joined.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_range", "_inside", "_r", "_g", "_offset")
