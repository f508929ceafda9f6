"""Regions: neighbouring tiles of one class, their canvas and their polygons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import ids
from orthomill.operators.components import label_cells
from orthomill.operators.ordering import global_row_number
from orthomill.operators.vectorize import polygonize


def dominant_class(class_id: Column, distribution: Column) -> Column:
    """Class of the most confident entry of a distribution (the first of equals), else the fused class."""
    best = F.aggregate(
        F.slice(distribution, 2, F.greatest(F.size(distribution) - 1, F.lit(0))), F.get(distribution, 0),
        lambda acc, e: F.when(e["confidence"] > acc["confidence"], e).otherwise(acc))
    return F.when(F.size(distribution) > 0, best["class_id"]).otherwise(F.coalesce(class_id, F.lit(0)))


def grid_coords(bounds: Column, tile_id: Column, tile_size: float = fixed.TILE_SIZE,
                id_pattern: str = r"(?:^|_)([+-]?\d+)$") -> Column:
    """Grid position ``struct<gx,gy>`` of a tile.

    From its bounds where it has any; else from the number that ends its id, read
    on a grid ten tiles wide; else (0, 0). The default pattern takes the whole
    text after the last underscore; pass ``r"_t(\\d+)$"`` for window ids.
    """
    number = F.regexp_extract(tile_id, id_pattern, 1).try_cast("long")
    by_bounds = lambda c: F.floor(F.abs(bounds[c]) / F.lit(float(tile_size)))
    return F.struct(
        F.when(bounds.isNotNull(), by_bounds("min_x")).otherwise(F.coalesce(F.pmod(number, F.lit(10)), F.lit(0)))
        .cast("long").alias("gx"),
        F.when(bounds.isNotNull(), by_bounds("min_y"))
        .otherwise(F.coalesce(F.floor(number / 10.0), F.lit(0))).cast("long").alias("gy"))


def cluster_tiles(tiles: DataFrame, tile_size: float = fixed.TILE_SIZE, chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """Regions of 8-neighbouring tiles per class: ``(members, regions)``.

    ``tiles`` has ``tile_id, class_id, bounds, gx, gy``; background tiles are
    left out. Grid cells are labelled block-wise like raster cells, so only block
    borders enter the global step. Region numbers follow (class, smallest tile
    id). The members stay a table; a region of any size is never one array.
    """
    active = tiles.filter(F.col("class_id") > 0)
    cells = active.select("class_id", F.col("gy").alias("row"), F.col("gx").alias("col")).distinct() \
        .withColumn("_on", F.lit(1))
    labelled = label_cells(cells, ["class_id"], "_on", 8, chunk).select(
        "class_id", F.col("row").alias("gy"), F.col("col").alias("gx"), "component")
    placed = active.join(labelled, ["class_id", "gy", "gx"])
    size = float(tile_size)
    table = placed.groupBy("class_id", "component").agg(
        F.min("tile_id").alias("first_tile"), F.count(F.lit(1)).alias("num_tiles"),
        F.coalesce(F.min("bounds.min_y"), F.lit(0.0)).alias("min_y"),
        F.coalesce(F.min("bounds.min_x"), F.lit(0.0)).alias("min_x"),
        F.coalesce(F.max("bounds.max_y"), F.lit(size)).alias("max_y"),
        F.coalesce(F.max("bounds.max_x"), F.lit(size)).alias("max_x"))
    numbered = global_row_number(table, ["class_id", "first_tile"], "_no") \
        .withColumn("region_id", ids.region_id(F.col("_no") + 1)).drop("_no")
    members = placed.join(numbered.select("class_id", "component", "region_id"), ["class_id", "component"])
    return members.drop("component"), numbered.drop("component")


def member_lists(members: DataFrame, per_list: int = 10_000) -> DataFrame:
    """Tile id lists per region in parts of about ``per_list`` ids: ``region_id, part, tile_ids``."""
    sizes = members.groupBy("region_id").agg(F.count(F.lit(1)).alias("_n"))
    parts = F.ceil(F.col("_n") / F.lit(float(per_list)))
    return members.join(sizes, "region_id") \
        .withColumn("part", F.pmod(F.xxhash64("tile_id"), parts)) \
        .groupBy("region_id", "part").agg(F.array_sort(F.collect_list("tile_id")).alias("tile_ids"))


def region_canvas(members: DataFrame, transforms: DataFrame, tile_size: int = fixed.TILE_SIZE) -> DataFrame:
    """Canvas per region: grid extent, size in tiles, and the transform of its top-left tile.

    A region whose top-left grid cell holds no tile gets the identity transform.
    """
    extent = members.groupBy("region_id").agg(
        F.min("gx").alias("min_c"), F.max("gx").alias("max_c"), F.min("gy").alias("min_r"), F.max("gy").alias("max_r"))
    corner = members.join(extent, "region_id").filter((F.col("gx") == F.col("min_c")) & (F.col("gy") == F.col("min_r"))) \
        .join(transforms, "tile_id").groupBy("region_id").agg(F.min_by("transform", "tile_id").alias("_corner"))
    identity = F.array(*[F.lit(v) for v in fixed.IDENTITY_TRANSFORM])
    return extent.join(corner, "region_id", "left").select(
        "region_id", "min_c", "min_r", (F.col("max_c") - F.col("min_c") + 1).alias("w_tiles"),
        (F.col("max_r") - F.col("min_r") + 1).alias("h_tiles"),
        ((F.col("max_c") - F.col("min_c") + 1) * tile_size).alias("width"),
        ((F.col("max_r") - F.col("min_r") + 1) * tile_size).alias("height"),
        F.coalesce("_corner", identity).alias("transform"))


def tile_offsets(members: DataFrame, canvas: DataFrame, tile_size: int = fixed.TILE_SIZE) -> DataFrame:
    """Pixel offset of each member tile on its region's canvas."""
    return members.join(canvas.select("region_id", "min_c", "min_r"), "region_id").select(
        "region_id", "tile_id", ((F.col("gx") - F.col("min_c")) * tile_size).alias("x_offset"),
        ((F.col("gy") - F.col("min_r")) * tile_size).alias("y_offset"))


def region_polygons(masks: DataFrame, regions: DataFrame, canvas: DataFrame,
                    min_area: float = fixed.REGION_MIN_AREA, tolerance: float = fixed.SIMPLIFY_TOLERANCE) -> DataFrame:
    """Polygons of refined region masks ``(region_id, row, col, quality)`` with the region's class.

    A canvas can be far larger than a tile, so components are labelled block-wise
    and rings traced by joins.
    """
    cells = masks.select("region_id", "row", "col").withColumn("_on", F.lit(1))
    shapes = polygonize(cells, ["region_id"], canvas, "_on", min_area, tolerance, whole_tile=False)
    quality = masks.groupBy("region_id").agg(F.coalesce(F.max("quality"), F.lit(0.8)).alias("confidence"))
    return shapes.drop("_on").join(regions.select("region_id", "class_id"), "region_id").join(quality, "region_id") \
        .withColumn("source_masks", F.array(F.lit(fixed.REFINED_REGION_TAG)))
