"""Running totals within groups of any size, without a task that holds a group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.session import store

PART, PRIOR = "_part", "_prior"


def running_total(rows: DataFrame, group: str, order: list[str], value: str, out: str) -> DataFrame:
    """`rows` with `out`: the sum of `value` over the rows of the same group that come before in `order`.

    Rows are range-partitioned by group and order and stored, so a large group lies in many partitions; sums per
    (group, partition) give each partition's start, and only the rows of one partition and group meet in a task.
    Null groups are a group. `order` must tell rows apart, up to rows that are equal."""
    keys = [group, *order]
    ranged = store(rows.repartitionByRange(*keys).withColumn(PART, F.spark_partition_id()))
    sums = ranged.groupBy(PART, group).agg(F.sum(value).alias("_sum"))
    before = Window.partitionBy(group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(F.col(PART).alias("_p"), F.col(group).alias("_g"),
                         F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias(PRIOR))
    joined = ranged.join(starts, (F.col(PART) == F.col("_p")) & F.col(group).eqNullSafe(F.col("_g"))).drop("_p", "_g")
    inside = Window.partitionBy(PART, group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.withColumn(out, F.col(PRIOR) + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop(PART, PRIOR)
