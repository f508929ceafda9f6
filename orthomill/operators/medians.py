"""Exact medians of groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.session import cut_lineage

#: Distinct values of one group that are ranked in one task.
RANKED = 10_000
#: Parts into which a larger group's distinct values are split in a round, and the accuracy of the split points.
PARTS, ACCURACY = 64, 1000


def _before(counts: str, window: Window) -> Column:
    return F.coalesce(F.sum(counts).over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _holds(rank: str) -> Column:
    return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_c"))


def narrowed(counted: DataFrame, keys: Sequence[str], value: str, most: int = RANKED) -> tuple[DataFrame, DataFrame]:
    """``(left, settled)``: at most ``most`` distinct values per key that hold the middle ranks, and medians found on the way.

    ``counted`` has ``keys``, the distinct values and their number ``_c``. A group with more values is split at approximate
    quantiles of its distinct values, so however they are spread, outliers and all, a part has about 1 in ``PARTS`` of them;
    the part with the middle ranks goes on. A group of d values takes about log(d / ``most``) / log(50) rounds. Where
    the two middle ranks fall into two parts, the median follows from the parts' ends.
    """
    keys = list(keys)
    totals = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count(F.lit(1)).alias("_d")).select(
        *keys, F.expr("(_n - 1) div 2").alias("_low"), F.expr("_n div 2").alias("_high"), F.lit(0).cast("long").alias("_base"), "_d")
    live = counted.join(totals, keys)
    left, settled = live.filter(F.col("_d") <= most), counted.select(*keys, F.lit(0.0).alias("median")).limit(0)
    while True:
        wide = live.filter(F.col("_d") > most)
        if wide.isEmpty():
            return left, settled
        splits = wide.groupBy(*keys).agg(F.percentile_approx(value, [i / PARTS for i in range(1, PARTS)], ACCURACY).alias("_splits"))
        parts = wide.join(splits, keys).withColumn("_part", F.size(F.filter("_splits", lambda s: s < F.col(value)))).drop("_splits", "_d")
        middle = (parts.groupBy(*keys, "_low", "_high", "_base", "_part")
                  .agg(F.sum("_c").alias("_c"), F.count(F.lit(1)).alias("_d"), F.min(value).alias("_least"), F.max(value).alias("_most"))
                  .withColumn("_before", F.col("_base") + _before("_c", Window.partitionBy(*keys).orderBy("_part")))
                  .filter(_holds("_low") | _holds("_high"))
                  .groupBy(*keys).agg(
                      F.count(F.lit(1)).alias("_parts"), F.max("_part").alias("_part"), F.max("_before").alias("_base"), F.max("_d").alias("_d"),
                      ((F.min("_most") + F.max("_least")) / 2.0).alias("median")))
        middle = cut_lineage(middle)
        settled = settled.unionByName(middle.filter("_parts = 2").select(*keys, "median"))
        live = cut_lineage(parts.drop("_base").join(middle.filter("_parts = 1").select(*keys, "_part", "_base", "_d"), [*keys, "_part"]).drop("_part"))
        left = left.unionByName(live.filter(F.col("_d") <= most))


def grouped_median(values: DataFrame, keys: Sequence[str], value: str, name: str = "median",
                   weight: str | None = None, most: int = RANKED) -> DataFrame:
    """Exact median of ``value`` per key without holding a group in one task.

    Equal values are counted first, once; groups are then :func:`narrowed` to ``most`` distinct values, which are ranked. With
    ``weight`` a row stands for that many equal values. Null values are left out, and so are groups with a null key.
    """
    keys = list(keys)
    counted = cut_lineage(values.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(
        (F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")))
    left, settled = narrowed(counted, keys, value, most)
    ranked = left.withColumn("_before", F.col("_base") + _before("_c", Window.partitionBy(*keys).orderBy(value)))
    return ranked.filter(_holds("_low") | _holds("_high")).groupBy(*keys).agg(
        ((F.min(value) + F.max(value)) / 2.0).alias("median")).unionByName(settled).withColumnRenamed("median", name)
