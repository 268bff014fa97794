"""Running sums and row numbers in a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from lorewell.shared import cut


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and including each row, in the order of columns that identify a row.

    Rows are range-partitioned by the order; only the partitions' sums (one row
    each) are added up in one task.
    """
    part, base, own = "__part", "__base", "__own"
    ranged = cut(df.withColumn(own, value).repartitionByRange(*order).withColumn(part, F.spark_partition_id()))
    sums = ranged.groupBy(part).agg(F.sum(own).alias(base))
    before = sums.select(part, F.coalesce(F.sum(base).over(W.orderBy(part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias(base))
    inside = F.sum(own).over(W.partitionBy(part).orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    joined = ranged.withColumn(name, inside).join(F.broadcast(before), part)  # a row for each partition
    return joined.withColumn(name, F.col(name) + F.col(base)).drop(part, base, own)


def row_numbers(df: DataFrame, order: list[str], name: str = "row_number") -> DataFrame:
    return running_sum(df, order, F.lit(1).cast("long"), name)
