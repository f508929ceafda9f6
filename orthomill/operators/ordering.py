"""Row numbers over whole tables and within groups, without one-task windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.session import cut_lineage

_POSITION_BITS = (1 << 33) - 1


def global_row_number(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_no",
                      partitions: int | None = None) -> DataFrame:
    """0-based position of every row under ``order_by`` (which must be a total order).

    Rows are range-partitioned and sorted within partitions; a row's position is
    its offset in the partition plus the row counts of the partitions before it.
    The ranges are materialised first, so both readings see the same cut. Only
    one row per partition reaches the running sum.
    """
    order_by = list(order_by)
    ranged = df.repartitionByRange(*([partitions] if partitions else []), *order_by)
    ranged = cut_lineage(
        ranged.sortWithinPartitions(*order_by)
        .withColumn("_gr_part", F.spark_partition_id())
        .withColumn("_gr_pos", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)))
    )
    before = Window.orderBy("_gr_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        ranged.groupBy("_gr_part").agg((F.max("_gr_pos") + 1).alias("_n"))
        .withColumn("_gr_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .select("_gr_part", "_gr_before")
    )
    return (
        ranged.join(F.broadcast(offsets), "_gr_part")
        .withColumn(name, F.col("_gr_before") + F.col("_gr_pos"))
        .drop("_gr_part", "_gr_pos", "_gr_before")
    )


def blocked_row_number(df: DataFrame, group: Sequence[str], block: str, within: Sequence[str],
                       name: str = "row_no") -> DataFrame:
    """0-based row number per ``group`` ordered by (``block``, ``within``).

    Numbering happens inside small blocks (one raster row of windows, say) and
    the blocks' counts are accumulated per group, so a group that owns a third
    of the table is still spread over many tasks.
    """
    group = list(group)
    inner = Window.partitionBy(*group, block).orderBy(*within)
    outer = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.groupBy(*group, block).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_gr_before", F.coalesce(F.sum("_n").over(outer), F.lit(0)))
        .drop("_n")
    )
    return (
        df.withColumn("_rn", F.row_number().over(inner) - 1)
        .join(offsets, [*group, block])
        .withColumn(name, F.col("_rn") + F.col("_gr_before"))
        .drop("_rn", "_gr_before")
    )
