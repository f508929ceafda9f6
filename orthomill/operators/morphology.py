"""Overviews, validity masks, closing, islands and region crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.functions import ids
from orthomill.operators.components import ROW_STEP, component_boxes, label_cells
from orthomill.operators.ordering import blocked_row_number


def _sampled(position: Column, scale: Column) -> Column:
    """Overview index whose nearest-neighbour sample is ``position``; null if it is not sampled."""
    guess = F.floor(position / scale)
    hit = lambda i: F.floor((i + 0.5) * scale) == position
    return F.when(hit(guess), guess).when(hit(guess + 1), guess + 1)


def overview_shape(rasters: DataFrame, factor: int | None = None, max_side: int = 2000) -> DataFrame:
    """Add overview size ``over_h``/``over_w`` and the sampling scales.

    Either decimation by ``factor``, or the long side is brought down to ``max_side``.
    """
    if factor is not None:
        shrink = lambda v: F.floor(v / F.lit(float(factor)))
    else:
        share = F.least(F.lit(1.0), F.lit(float(max_side)) / F.greatest("width", "height"))
        shrink = lambda v: F.floor(v * share)
    sized = rasters.withColumn("over_h", shrink(F.col("height"))).withColumn("over_w", shrink(F.col("width")))
    return sized.withColumn("scale_r", F.col("height") / F.col("over_h")) \
        .withColumn("scale_c", F.col("width") / F.col("over_w"))


def overview(pixels: DataFrame, rasters: DataFrame, factor: int | None = None, max_side: int = 2000,
             source: str = "source_id") -> DataFrame:
    """Nearest-neighbour decimation: the sampled pixels with their overview position."""
    shape = overview_shape(rasters, factor, max_side).select(source, "over_h", "over_w", "scale_r", "scale_c")
    return (
        pixels.join(shape, source)
        .withColumn("over_row", _sampled(F.col("row"), F.col("scale_r")))
        .withColumn("over_col", _sampled(F.col("col"), F.col("scale_c")))
        .filter(F.col("over_row").isNotNull() & F.col("over_col").isNotNull()
                & (F.col("over_row") < F.col("over_h")) & (F.col("over_col") < F.col("over_w")))
    )


def valid_first_band(df: DataFrame, above: int = 0) -> DataFrame:
    """Keep pixels whose first band exceeds ``above``."""
    return df.filter(F.col("b0") > above)


def valid_any_band(df: DataFrame, above: int = 10) -> DataFrame:
    """Keep pixels where any band exceeds ``above``."""
    return df.filter(F.greatest("b0", "b1", "b2") > above)


def close_mask(cells: DataFrame, size: int = 5, source: str = "source_id") -> DataFrame:
    """Morphological closing with a ``size`` x ``size`` square.

    ``cells`` lists the set cells ``(source, row, col, over_h, over_w)``. Cells
    outside the raster are ignored by both steps. Both steps run per axis, so a
    cell is repeated ``size`` times instead of ``size``^2.
    """
    reach = size // 2
    keys = [source, "row", "col", "over_h", "over_w"]
    offsets = F.array(*[F.lit(d).cast("long") for d in range(-reach, reach + 1)])

    def spread(df: DataFrame, axis: str, extent: str) -> DataFrame:
        moved = df.withColumn("_d", F.explode(offsets)).withColumn(axis, F.col(axis) + F.col("_d")).drop("_d")
        return moved.filter((F.col(axis) >= 0) & (F.col(axis) < F.col(extent)))

    grown = cells.select(source, F.col("row").cast("long"), F.col("col").cast("long"), "over_h", "over_w")
    for axis, extent in (("row", "over_h"), ("col", "over_w")):
        grown = spread(grown, axis, extent).distinct()
    kept = grown
    for axis, extent in (("row", "over_h"), ("col", "over_w")):
        reachable = F.least(F.col(extent) - 1, F.col(axis) + reach) - F.greatest(F.lit(0), F.col(axis) - reach) + 1
        kept = spread(kept, axis, extent).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) \
            .filter(F.col("_n") == reachable).drop("_n")
    return kept


def islands(closed: DataFrame, min_share: float | None = None, source: str = "source_id",
            chunk: int = 256) -> tuple[DataFrame, DataFrame]:
    """Connected valid regions: ``(labelled cells, island table)``.

    Islands are numbered per source by their first cell in row-major order. With
    ``min_share`` only islands larger than that share of the source's largest stay.
    """
    cells = label_cells(closed.withColumn("class_id", F.lit(1)), [source], "class_id", 4, chunk)
    boxes = component_boxes(cells, [source]).drop("class_id").withColumn("_line", F.floor(F.col("component") / ROW_STEP))
    table = blocked_row_number(boxes, [source], "_line", ["component"], "_no").drop("_line") \
        .withColumn("island_id", ids.island_id(F.col("_no") + 1)).drop("_no")
    if min_share is not None:
        largest = table.groupBy(source).agg((F.max("pixels") * min_share).alias("_least"))
        table = table.join(largest, source).filter(F.col("pixels") > F.col("_least")).drop("_least")
    return cells.drop("class_id"), table


def windows_on_islands(windows: DataFrame, cells: DataFrame, size: int, stride: int, factor: int,
                       source: str = "source_id") -> DataFrame:
    """Windows that touch an island; a source without islands keeps all its windows.

    An island cell is turned into the windows it meets by arithmetic (touching
    counts), so there is no spatial join and no pair per cell.
    """
    def met(position: str) -> Column:
        low, high = F.col(position) * factor, (F.col(position) + 1) * factor
        first = F.greatest(F.lit(0), F.ceil((low - size) / F.lit(float(stride))))
        last = F.floor(high / F.lit(float(stride)))
        return F.explode(F.transform(F.sequence(first.cast("int"), last.cast("int")), lambda i: i * stride))

    hits = (
        cells.select(source, "row", "col")
        .withColumn("row_off", met("row")).select(source, "row_off", "col").distinct()
        .withColumn("col_off", met("col")).select(source, "row_off", "col_off").distinct()
    )
    with_islands = cells.select(source).distinct()
    return windows.join(hits, [source, "row_off", "col_off"], "left_semi").unionByName(
        windows.join(with_islands, source, "left_anti"))


def crop_regions(pixels: DataFrame, shape: DataFrame, cells: DataFrame, table: DataFrame,
                 source: str = "source_id") -> DataFrame:
    """Pixels of each island with positions relative to the island's bounding box.

    Pixels outside every kept island are left out (they are 0 in a cropped raster).
    """
    kept = cells.join(table.select(source, "component", "island_id", "min_row", "min_col"), [source, "component"]) \
        .select(source, F.col("row").alias("_or"), F.col("col").alias("_oc"), "island_id", "min_row", "min_col")
    placed = pixels.join(shape.select(source, "scale_r", "scale_c"), source) \
        .withColumn("_or", F.floor((F.col("row") + 0.5) / F.col("scale_r"))) \
        .withColumn("_oc", F.floor((F.col("col") + 0.5) / F.col("scale_c")))
    return placed.join(kept, [source, "_or", "_oc"]) \
        .withColumn("region_row", F.col("row") - F.ceil(F.col("min_row") * F.col("scale_r") - 0.5)) \
        .withColumn("region_col", F.col("col") - F.ceil(F.col("min_col") * F.col("scale_c") - 0.5)) \
        .drop("_or", "_oc", "min_row", "min_col", "scale_r", "scale_c")


def slice_masks(tiles: DataFrame, mask: DataFrame, region: str = "region", block: int = 512) -> DataFrame:
    """Cells of a region mask inside each tile's ``pixel_bounds`` ``[y1,x1,y2,x2]``, tile-relative.

    Cells that are absent count as class 0 padding. Tiles and cells meet on
    blocks of ``block`` pixels, so a join key never holds more than a block.
    """
    bound = lambda i: F.get("pixel_bounds", F.lit(i))
    keyed_tiles = (
        tiles.select("tile_id", region, bound(0).alias("y1"), bound(1).alias("x1"),
                     bound(2).alias("y2"), bound(3).alias("x2"))
        .filter((F.col("y2") > F.col("y1")) & (F.col("x2") > F.col("x1")))
        .withColumn("_br", F.explode(F.expr(f"sequence(y1 div {block}, (y2 - 1) div {block})")))
        .withColumn("_bc", F.explode(F.expr(f"sequence(x1 div {block}, (x2 - 1) div {block})")))
    )
    keyed_cells = mask.withColumn("_br", F.expr(f"row div {block}")).withColumn("_bc", F.expr(f"col div {block}"))
    inside = ((F.col("row") >= F.col("y1")) & (F.col("row") < F.col("y2"))
              & (F.col("col") >= F.col("x1")) & (F.col("col") < F.col("x2")))
    return keyed_tiles.join(keyed_cells, [region, "_br", "_bc"]).filter(inside).select(
        "tile_id", region, (F.col("row") - F.col("y1")).alias("row"), (F.col("col") - F.col("x1")).alias("col"),
        "class_id")
