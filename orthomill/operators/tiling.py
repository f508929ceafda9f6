"""Window grids over rasters and the assignment of pixels to windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.functions import ids


def padded_windows(rasters: DataFrame, size: int | Column = fixed.TILE_SIZE, stride: int = fixed.STRIDE,
                   source: str = "source_id") -> DataFrame:
    """Zero-padded window grid of every raster ``(source, height, width)``.

    Origins step by ``stride`` from 0; the index counts row-major and is plain
    arithmetic, so numbering needs no shuffle.
    """
    size = F.lit(size) if isinstance(size, int) else size
    per_row = F.ceil(F.col("width") / F.lit(float(stride))).cast("long")
    grid = (
        rasters
        .withColumn("row_off", F.explode(F.sequence(F.lit(0), F.col("height").cast("int") - 1, F.lit(stride))))
        .withColumn("col_off", F.explode(F.sequence(F.lit(0), F.col("width").cast("int") - 1, F.lit(stride))))
    )
    index = F.expr(f"row_off div {stride}") * per_row + F.expr(f"col_off div {stride}")
    return (
        grid
        .withColumn("tile_index", index)
        .withColumn("tile_id", ids.window_id(F.col(source), F.col("tile_index")))
        .withColumn("tile_size", size)
        .withColumn("stride", F.lit(stride))
        .withColumn("win_h", F.least(size, F.col("height") - F.col("row_off")))
        .withColumn("win_w", F.least(size, F.col("width") - F.col("col_off")))
        .withColumn("padded", (F.col("win_h") < size) | (F.col("win_w") < size))
    )


def multi_size_windows(rasters: DataFrame, sizes: Sequence[int] = fixed.TILE_SIZES,
                       stride: int = fixed.STRIDE, source: str = "source_id") -> DataFrame:
    """The padded grid for each tile size (the sizes are a literal array, exploded in place)."""
    sized = rasters.withColumn("_size", F.explode(F.array(*[F.lit(s) for s in sizes])))
    return padded_windows(sized, F.col("_size"), stride, source).drop("_size")


def window_counts(windows: DataFrame) -> DataFrame:
    """Number of windows per tile size."""
    return windows.groupBy("tile_size").agg(F.count(F.lit(1)).alias("tiles"))


def clamped_windows(rasters: DataFrame, size: int = fixed.TILE_SIZE, overlap: int = fixed.OVERLAP) -> DataFrame:
    """Sliding windows moved back inside the raster, without duplicates, numbered row-major."""
    stride = size - overlap

    def starts(extent: Column) -> Column:
        last = F.greatest(F.lit(1), extent - size + stride) - 1
        clamp = F.greatest(F.lit(0), extent - size)
        raw = F.sequence(F.lit(0), last.cast("int"), F.lit(stride))
        return F.array_sort(F.array_distinct(F.transform(raw, lambda v: F.least(v, clamp.cast("int")))))

    return (
        rasters
        .withColumn("_rows", starts(F.col("height"))).withColumn("_cols", starts(F.col("width")))
        .select("*", F.posexplode("_rows").alias("_r", "row_off"))
        .select("*", F.posexplode("_cols").alias("_c", "col_off"))
        .withColumn("window_no", F.col("_r") * F.size("_cols") + F.col("_c"))
        .withColumn("win_h", F.least(F.lit(size), F.col("height") - F.col("row_off")))
        .withColumn("win_w", F.least(F.lit(size), F.col("width") - F.col("col_off")))
        .drop("_rows", "_cols", "_r", "_c")
    )


def drop_slivers(windows: DataFrame, min_side: int | None = None) -> DataFrame:
    """Drop edge windows with a side below ``min_side`` (half the tile size by default)."""
    limit = F.lit(min_side) if min_side is not None else F.expr("tile_size div 2")
    return windows.filter((F.col("win_h") >= limit) & (F.col("win_w") >= limit))


def overlap_crops(images: DataFrame, size: int = fixed.CROP_SIZE, overlap: int = fixed.CROP_OVERLAP,
                  source: str = "source_id") -> DataFrame:
    """Overlapped padded crops named ``{image}_{y}_{x}``."""
    return padded_windows(images, size, size - overlap, source).withColumn(
        "crop_name", F.concat_ws("_", F.col(source), F.col("row_off"), F.col("col_off")))


def covering_origins(position: Column, size: int, stride: int) -> Column:
    """Array of all window origins (multiples of ``stride``) whose window covers ``position``."""
    first = F.greatest(F.lit(0), F.floor((position - size) / F.lit(float(stride))) + 1)
    last = F.floor(position / F.lit(float(stride)))
    return F.when(first <= last, F.transform(F.sequence(first.cast("int"), last.cast("int")),
                                             lambda i: i * F.lit(stride))
                  ).otherwise(F.array().cast("array<int>"))


def assign_windows(pixels: DataFrame, size: int, stride: int) -> DataFrame:
    """One row per (pixel, window that covers it); pure arithmetic, no join."""
    return (
        pixels
        .withColumn("row_off", F.explode(covering_origins(F.col("row"), size, stride)))
        .withColumn("col_off", F.explode(covering_origins(F.col("col"), size, stride)))
    )


def shared_stretch(size: int, stride: int) -> list[Column]:
    """Grouping columns for pixels at ``row``, ``col``: pixels that agree in them lie under the same windows."""
    def edge(position: str, shift: int) -> Column:
        return F.floor((F.col(position) - shift) / F.lit(float(stride)))

    return [edge(p, s).alias(f"_{p}_{n}") for p in ("row", "col") for n, s in (("last", 0), ("first", size))]


def with_tile_transform(windows: DataFrame, transform: str = "transform") -> DataFrame:
    """Add the window's own transform."""
    return windows.withColumn(
        "tile_transform", geo.shift_transform(F.col(transform), F.col("col_off"), F.col("row_off")))


def with_tile_bounds(windows: DataFrame, transform: str = "transform") -> DataFrame:
    """Add the window's extent ``struct<min_y,min_x,max_y,max_x>``."""
    return windows.withColumn("bounds", geo.window_bounds(
        F.col(transform), F.col("col_off"), F.col("row_off"), F.col("win_w"), F.col("win_h")))
