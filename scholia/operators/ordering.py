"""Positions in very long ordered groups.

A plain ``row_number`` window sends each group to one task. ``positions``
numbers groups of any size: rows are range-partitioned by group and order, so
a hot group spreads over many partitions, and each partition's rows start from
the count of the group's rows in earlier partitions. The slice number of a row
is stored in the shared checkpoint folder before it is used twice, so both uses
see the same slices even when tasks are run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scholia.session import cut_lineage


def slices(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_slice") -> DataFrame:
    """Tag rows with an ordered slice number: the range partition they fall in."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return cut_lineage(ranged.withColumn(name, F.spark_partition_id()))


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """0-based position of each row in its group, for groups of any size.

    ``order`` must be total within a group (end it with a unique column).
    """
    sliced = slices(df, keys, order)
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count("*").alias("_rows"))
    before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_rows").over(before), F.lit(0))).drop("_rows")
    inside = W.partitionBy(*keys, "_slice").orderBy(*order)
    numbered = sliced.withColumn("_inside", F.row_number().over(inside) - 1)
    safe = [numbered[k].eqNullSafe(offsets[k]) for k in keys]
    condition = numbered["_slice"] == offsets["_slice"]
    for clause in safe:
        condition = condition & clause
    return numbered.join(offsets, condition).select(
        *[numbered[c] for c in df.columns],
        (F.col("_inside") + F.col("_before")).cast("long").alias(name),
    )
