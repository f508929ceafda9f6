"""Raster preprocessing as one plan: windows, islands, variance filter, numbering."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import ids
from orthomill.operators import morphology, tiling, variance


def windowed_preprocess(pixels: DataFrame, rasters: DataFrame, size: int = fixed.TILE_SIZE,
                        stride: int = fixed.STRIDE, local_window: int = fixed.LOCAL_WINDOW,
                        global_min: float = fixed.GLOBAL_VARIANCE_MIN, local_min: float = fixed.LOCAL_VARIANCE_MIN,
                        factor: int = 32, valid_above: int = 0, source: str = "source_id") -> DataFrame:
    """Every usable window of every raster with its variances, verdict, transform and bounds.

    The pixels are read once for the islands, where only sampled rows and columns go
    on, and once for the variances, where tasks send block sums. Slivers and windows
    off the islands drop out in the join of the window table with the statistics.
    """
    windows = tiling.drop_slivers(tiling.padded_windows(rasters, size, stride, source))
    sampled = morphology.valid_first_band(morphology.overview(pixels, rasters, factor, source=source), valid_above)
    cells = sampled.select(source, F.col("over_row").alias("row"), F.col("over_col").alias("col"), "over_h", "over_w")
    on_land = morphology.windows_on_islands(
        windows, morphology.close_mask(cells, source=source), size, stride, factor, source)
    stats = variance.padded_window_variance(pixels, [source], size, stride, local_window)
    judged = variance.variance_decision(on_land.join(stats, [source, "row_off", "col_off"]), global_min, local_min)
    return tiling.with_tile_bounds(tiling.with_tile_transform(judged))


def accepted_tiles(judged: DataFrame, max_tiles: int = 0, source: str = "source_id") -> DataFrame:
    """Accepted windows, numbered per source among the accepted ones and named after that number."""
    numbered = variance.number_accepted(judged, source, max_tiles=max_tiles)
    return numbered.withColumn("tile_id", ids.window_id(F.col(source), F.col("accepted_index"))).withColumn(
        "tile_index", F.col("accepted_index"))


def ground_truth_sums(judged: DataFrame, mask: DataFrame, size: int, stride: int,
                      source: str = "source_id") -> DataFrame:
    """Add ``gt_sum``: the sum of class ids of the ground-truth cells inside each window."""
    sums = tiling.assign_windows(mask, size, stride).groupBy(source, "row_off", "col_off").agg(
        F.sum("class_id").alias("gt_sum"))
    return judged.join(sums, [source, "row_off", "col_off"], "left")


def tile_documents(tiles: DataFrame, crs: str = fixed.DEFAULT_CRS) -> DataFrame:
    """Tile metadata documents with the fields a downstream reader expects."""
    return tiles.select(
        "tile_id", F.col("source_id").alias("source_file"), "tile_index",
        F.array("col_off", "row_off").alias("pixel_offset"), "tile_size", "stride", F.lit(crs).alias("crs"),
        F.col("tile_transform").alias("transform"), F.col("transform").alias("original_transform"),
        F.array(F.array("bounds.min_y", "bounds.min_x"), F.array("bounds.max_y", "bounds.max_x")).alias("bounds"),
        "padded")


