"""Running positions without a single-task window.

A window without a partition key sorts all rows in one task.  Here rows are range-partitioned by the order columns,
each partition is numbered by itself, and the partitions' totals (one small row for each partition and group) give
the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.session import stable, tasks_for


def running_total(
    df: DataFrame,
    order: Sequence[str],
    value: Column | None = None,
    by: Sequence[str] = (),
    name: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` (1 if none) over the rows before this one, in its group ``by``, in ``order``.

    The order columns should identify a row; rows that tie get distinct, consecutive positions.  Nulls order first.
    An empty frame stays empty.  Offsets are joined by broadcast: they hold one row for each range partition and
    group, a number that the caller's partition count bounds.
    """
    n = partitions or tasks_for(df)
    base = df.withColumn("_v", F.lit(1).cast("long") if value is None else value.cast("long"))
    base = base.repartitionByRange(n, *[F.col(c).asc_nulls_first() for c in order])
    keys = ["_pid", *by]
    # Each partition is sorted where it lies: the window's exchange below moves whole groups of one partition.
    base = stable(base.withColumn("_pid", F.spark_partition_id()))
    rows = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    local = base.withColumn("_before", F.sum("_v").over(rows.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_v"))
    totals = base.groupBy(*keys).agg(F.sum("_v").alias("_sum"))
    before = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_off"))
    right = offsets.select(F.col("_pid").alias("_p2"), "_off", *[F.col(c).alias(f"_b_{c}") for c in by])
    on = F.col("_pid") == F.col("_p2")
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_b_{c}"))
    joined = local.join(F.broadcast(right), on)
    return joined.withColumn(name, (F.col("_before") + F.col("_off")).cast("long")).select(*df.columns, name)
