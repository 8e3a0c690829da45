"""Numbering rows of a group in order, without a task that holds a group.

Rows are dealt out by ranges of (group, order), numbered within each range's part of a group, and moved by what lies
before it, of which there is one row for each part of a group."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..tables import new_folder, stored


def _same(a: list[str], b: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(p).eqNullSafe(F.col(q)) for p, q in zip(a, b, strict=True)])


def place(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with `name`, the place of each row in its group from 0, by `order` (nulls first; rows that are equal there in any
    order). Null groups are groups."""
    cols = df.columns
    dealt = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    dealt = stored(dealt, new_folder(df.sparkSession, "place"))
    names = [f"_g{i}" for i in range(len(group))]
    counts = dealt.groupBy(*[F.col(g).alias(n) for g, n in zip(group, names, strict=True)], F.col("_part").alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*names).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    moved = counts.select(*names, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*group, "_part").orderBy(*order)) - 1)
    met = own.join(moved, _same(group, names) & (F.col("_part") == F.col("_p")))
    return met.select(*cols, (F.col("_own") + F.col("_before")).alias(name))
