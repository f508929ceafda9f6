"""Variance filters over pixels: how flat is a tile, and is it worth keeping.

Sums are kept as integers (band values are bytes) and combined on the map side;
a window's variance comes from its blocks' sums. Overlapped windows share the sums of
small cells, so a pixel is read into one sum only, whatever the overlap.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.operators.medians import grouped_median
from orthomill.operators.ordering import blocked_row_number
from orthomill.operators.tiling import assign_windows
from orthomill.session import cut_lineage

_WIDE = "decimal(38,0)"


def _variance(n: Column, s: Column, q: Column, scale: float) -> Column:
    """Population variance from exact sums; ``scale`` is the square of the value's divisor."""
    wide_n = n.cast(_WIDE)
    spread = (wide_n * q - s.cast(_WIDE) * s.cast("decimal(20,0)")).cast("double")
    return spread / (F.lit(scale) * n.cast("double") * n.cast("double"))


def gray_sum() -> Column:
    """Three times the mean gray value, as an integer."""
    return (F.col("b0") + F.col("b1") + F.col("b2")).cast("long")


def luma() -> Column:
    """Rounded luma of an RGB pixel."""
    return F.floor(F.lit(0.299) * F.col("b0") + F.lit(0.587) * F.col("b1") + F.lit(0.114) * F.col("b2") + 0.5) \
        .cast("long")


def global_variance(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Population variance of mean gray per tile."""
    v = gray_sum()
    sums = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    return sums.select(*keys, _variance(F.col("n"), F.col("s"), F.col("q"), 9.0).alias("global_variance"))


def tile_variance(pixels: DataFrame, keys: Sequence[str], window: int = fixed.LOCAL_WINDOW,
                  whole_tile: bool = False) -> DataFrame:
    """Global variance and median block variance per tile, in one pass over the pixels.

    ``row``/``col`` count from the tile's corner. Only full ``window`` x
    ``window`` blocks enter the median; a tile too small for any falls back to
    its global variance. The keys are rasters of any size: the block table is materialised and its
    median taken without one-task groups. ``whole_tile`` says that every key is tile-sized and takes its median in one go.
    """
    v = gray_sum()
    blocks = pixels.groupBy(*keys, F.expr(f"row div {window}").alias("_br"), F.expr(f"col div {window}").alias("_bc")) \
        .agg(F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    block_var = F.when(F.col("n") == window * window, _variance(F.col("n"), F.col("s"), F.col("q"), 9.0))
    sums = [F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")]
    if whole_tile:
        tiles = blocks.groupBy(*keys).agg(*sums, F.median(block_var).alias("_local"))
    else:
        blocks = cut_lineage(blocks.withColumn("_var", block_var))
        tiles = blocks.groupBy(*keys).agg(*sums).join(grouped_median(blocks, keys, "_var", "_local"), list(keys), "left")
    overall = _variance(F.col("n"), F.col("s"), F.col("q"), 9.0)
    return tiles.select(*keys, overall.alias("global_variance"),
                        F.coalesce(F.col("_local"), overall).alias("local_variance"))


def padded_window_variance(pixels: DataFrame, keys: Sequence[str], size: int, stride: int,
                           window: int) -> DataFrame:
    """Variances of zero-padded sliding windows of a raster.

    Padding counts as black pixels: the window always has ``size``^2 pixels and
    ``(size // window)``^2 blocks, absent ones having variance 0. The block list
    of a window is bounded by that constant. Every edge of a window or block lies on the grid
    of the largest common divisor of ``size``, ``stride`` and ``window``: pixels are summed
    into that grid's cells once, and only cells are copied to the windows that cover
    them. With a divisor of 1 a cell is a pixel.
    """
    per_side = size // window
    unit = math.gcd(size, stride, window)
    v = gray_sum()
    corner = [(F.expr(f"{c} div {unit}") * unit).cast(pixels.schema[c].dataType).alias(c) for c in ("row", "col")]
    cells = pixels.groupBy(*keys, *corner).agg(F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    # One exchange by window serves both sums that follow.
    assigned = assign_windows(cells, size, stride).repartition(*keys, "row_off", "col_off")
    inner = [F.expr(f"(row - row_off) div {window}").alias("_br"), F.expr(f"(col - col_off) div {window}").alias("_bc")]
    blocks = assigned.groupBy(*keys, "row_off", "col_off", *inner).agg(F.sum("s").alias("s"), F.sum("q").alias("q"))
    inside = (F.col("_br") < per_side) & (F.col("_bc") < per_side)
    block_var = _variance(F.lit(window * window), F.col("s"), F.col("q"), 9.0)
    tiles = blocks.groupBy(*keys, "row_off", "col_off").agg(
        F.sum("s").alias("s"), F.sum("q").alias("q"),
        F.collect_list(F.when(inside, block_var)).alias("_vars"))
    n_blocks = per_side * per_side
    overall = _variance(F.lit(size * size), F.col("s"), F.col("q"), 9.0)
    if n_blocks == 0:
        local = overall
    else:
        padded = F.array_sort(F.concat(
            F.col("_vars"), F.array_repeat(F.lit(0.0), (F.lit(n_blocks) - F.size("_vars")).cast("int"))))
        local = (F.get(padded, F.lit((n_blocks - 1) // 2)) + F.get(padded, F.lit(n_blocks // 2))) / 2.0
    return tiles.select(*keys, "row_off", "col_off", overall.alias("global_variance"),
                        local.alias("local_variance"))


def variance_decision(stats: DataFrame, global_min: float = fixed.GLOBAL_VARIANCE_MIN,
                      local_min: float = fixed.LOCAL_VARIANCE_MIN) -> DataFrame:
    """Add ``accepted`` and ``reason``; a tile is rejected only if both variances are low."""
    low = (F.col("global_variance") < global_min) & (F.col("local_variance") < local_min)
    return stats.withColumn("accepted", ~low).withColumn(
        "reason", F.when(low, F.lit("low_variance")).otherwise(F.lit("accepted")))


def with_load_errors(decided: DataFrame, spine: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per tile of the spine; tiles without pixels become ``load_error`` rows."""
    return spine.select(*keys).join(decided, list(keys), "left") \
        .withColumn("accepted", F.coalesce("accepted", F.lit(False))) \
        .withColumn("reason", F.coalesce("reason", F.lit("load_error")))


def variance_summary(decided: DataFrame) -> DataFrame:
    """Totals of a filter run."""
    return decided.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("reason") == "load_error").alias("load_errors"))


def gatekeeper(pixels: DataFrame, keys: Sequence[str], threshold: float = fixed.LUMA_VARIANCE_MIN) -> DataFrame:
    """Luma variance per tile and whether it reaches ``threshold``."""
    y = luma()
    sums = pixels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(y).alias("s"), F.sum(y * y).alias("q"))
    variance = _variance(F.col("n"), F.col("s"), F.col("q"), 1.0)
    return sums.select(*keys, variance.alias("luma_variance"), (variance >= threshold).alias("keep"))


def valid_data_filter(pixels: DataFrame, keys: Sequence[str], share_min: float = fixed.VALID_SHARE_MIN,
                      variance_min: float = fixed.STACKED_VARIANCE_MIN) -> DataFrame:
    """Share of pixels with any positive band, variance over all bands, and the verdict."""
    bands = [F.col(f"b{i}").cast("long") for i in range(3)]
    total = bands[0] + bands[1] + bands[2]
    squares = bands[0] * bands[0] + bands[1] * bands[1] + bands[2] * bands[2]
    sums = pixels.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.greatest(*bands) > 0).alias("valid"),
        F.sum(total).alias("s"), F.sum(squares).alias("q"))
    share = F.col("valid") / F.col("n")
    variance = _variance(F.col("n") * 3, F.col("s"), F.col("q"), 1.0)
    reason = F.when(share < share_min, "empty").when(variance < variance_min, "flat").otherwise("accepted")
    return sums.select(*keys, share.alias("valid_share"), variance.alias("stacked_variance"), reason.alias("reason"))


def number_accepted(tiles: DataFrame, source: str = "source_id", row: str = "row_off", col: str = "col_off",
                    max_tiles: int = 0) -> DataFrame:
    """Number accepted tiles per source in row-major order, from 0; keep the first ``max_tiles`` if set.

    Numbering runs per raster row with accumulated offsets, so one huge raster
    does not end up in one task.
    """
    numbered = blocked_row_number(tiles.filter("accepted"), [source], row, [col], "accepted_index")
    return numbered.filter(F.col("accepted_index") < max_tiles) if max_tiles > 0 else numbered


def preprocess_summary(windows: DataFrame, source: str = "source_id") -> DataFrame:
    """Windows, accepted, rejected and with-ground-truth counts per source and in total (null source)."""
    return windows.rollup(source).agg(
        F.count(F.lit(1)).alias("total_windows"),
        F.count_if("accepted").alias("accepted"),
        F.count_if(~F.col("accepted")).alias("rejected"),
        F.count_if(F.col("accepted") & (F.coalesce("gt_sum", F.lit(0)) > 0)).alias("with_gt"))
