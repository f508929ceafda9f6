"""Corrections of a tile's decision from detections, spectra and heights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.operators.medians import grouped_median
from orthomill.operators.variance import _variance, luma
from orthomill.session import cut_lineage


def detector_override(decisions: DataFrame, det_summary: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Any detected box makes the tile an accepted building with at least the best box's confidence."""
    joined = decisions.join(det_summary.select(tile, "count", "max_confidence"), tile, "left")
    hit = F.coalesce(F.col("count"), F.lit(0)) > 0
    lifted = F.greatest(F.col("confidence_val"), F.coalesce("max_confidence", F.lit(fixed.OVERRIDE_CONFIDENCE)))
    return joined \
        .withColumn("class_id", F.when(hit, F.lit(1)).otherwise(F.col("class_id"))) \
        .withColumn("confidence_val", F.when(hit, lifted).otherwise(F.col("confidence_val"))) \
        .withColumn("accept_val", F.when(hit, F.lit(1.0)).otherwise(F.col("accept_val"))) \
        .drop("count", "max_confidence")


def box_cells(dets: DataFrame, height: int, width: int, tile: str = "tile_id") -> DataFrame:
    """Cells painted by filled rectangles whose end corner is included, each cell once."""
    clip = lambda v, hi: F.least(F.greatest(F.col(v).cast("int"), F.lit(0)), F.lit(hi))
    runs = dets.select(
        tile, clip("y1", height).alias("y1"), clip("y2", height).alias("y2"),
        clip("x1", width).alias("x1"), clip("x2", width).alias("x2")).distinct()
    runs = runs.withColumn("y2", F.least("y2", F.lit(height - 1))).withColumn("x2", F.least("x2", F.lit(width - 1))) \
        .filter((F.col("y1") <= F.col("y2")) & (F.col("x1") <= F.col("x2")))
    rows = runs.select(tile, F.explode(F.sequence("y1", "y2")).alias("row"), "x1", "x2").distinct()
    return rows.select(tile, "row", F.explode(F.sequence("x1", "x2")).alias("col")).distinct()


def burn_boxes(mask: DataFrame, dets: DataFrame, height: int, width: int, tile: str = "tile_id") -> DataFrame:
    """The mask with all detected boxes painted as buildings."""
    painted = box_cells(dets, height, width, tile).withColumn("_one", F.lit(1))
    return mask.join(painted, [tile, "row", "col"], "left") \
        .withColumn("class_id", F.coalesce("_one", "class_id")).drop("_one")


def zonal_stats(decisions: DataFrame, pixels: DataFrame, tile: str = "tile_id",
                min_pixels: int = fixed.MIN_MASK_PIXELS) -> DataFrame:
    """Mean colour and gray variance over the pixels of the decided class, for vegetation and water tiles.

    ``pixels`` has the segmentation class as ``mask_class``. Tiles with
    ``min_pixels`` or fewer such pixels have no row.
    """
    wanted = decisions.filter(F.col("class_id").isin(3, 4)).select(tile, F.col("class_id").alias("mask_class"))
    y = luma()
    sums = pixels.join(wanted, [tile, "mask_class"]).groupBy(tile).agg(
        F.count(F.lit(1)).alias("mask_pixels"), F.avg("b0").alias("mean_r"), F.avg("b1").alias("mean_g"),
        F.avg("b2").alias("mean_b"), F.sum(y).alias("_s"), F.sum(y * y).alias("_q"))
    return sums.filter(F.col("mask_pixels") > min_pixels).withColumn(
        "texture", _variance(F.col("mask_pixels"), F.col("_s"), F.col("_q"), 1.0)).drop("_s", "_q")


def spectral_rules(decisions: DataFrame, stats: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Green or textured water becomes vegetation; bluish smooth vegetation becomes water."""
    d = decisions.join(stats.select(tile, "mean_g", "mean_b", "texture"), tile, "left")
    to_vegetation = (F.col("class_id") == 4) & (
        (F.col("mean_g") > F.col("mean_b") * fixed.WATER_GREEN_RATIO) | (F.col("texture") > fixed.WATER_TEXTURE_MAX))
    to_water = (F.col("class_id") == 3) & (
        (F.col("mean_b") > F.col("mean_g") * fixed.VEGETATION_BLUE_RATIO)
        & (F.col("texture") < fixed.VEGETATION_TEXTURE_MAX))
    return d.withColumn("class_id", F.when(to_vegetation, 3).when(to_water, 4).otherwise(F.col("class_id"))) \
        .drop("mean_g", "mean_b", "texture")


def low_confidence_rule(decisions: DataFrame, limit: float = fixed.LOW_CONFIDENCE) -> DataFrame:
    """Unsure foreground becomes 'other'."""
    unsure = (F.col("confidence_val") < limit) & (F.col("class_id") != 0)
    return decisions.withColumn("class_id", F.when(unsure, F.lit(5)).otherwise(F.col("class_id")))


def _height_measures(samples: DataFrame, tile: str, source: str, bounded: bool) -> DataFrame:
    """Height statistics from ``(tile, z, n)`` with n samples of each height."""
    z, n = F.col("z"), F.col("n")
    sums = [F.sum("n").alias("_n"), F.sum(z * n).alias("_s"), F.sum(z * z * n).alias("_q"),
            F.min(z).alias("z_min"), F.max(z).alias("z_max")]
    if bounded:
        stats = samples.groupBy(tile).agg(*sums, F.percentile(z, F.lit(0.5), n).alias("z_median"))
    else:
        samples = cut_lineage(samples)
        stats = samples.groupBy(tile).agg(*sums).join(grouped_median(samples, [tile], "z", "z_median", "n"), tile)
    mean = F.col("_s") / F.col("_n")
    spread = F.greatest(F.col("_q") / F.col("_n") - mean * mean, F.lit(0.0))
    return stats.select(tile, mean.alias("z_mean"), "z_median", F.sqrt(spread).alias("z_std"), "z_min", "z_max",
                        F.lit(source).alias("source"))


def heights_from_points(points: DataFrame, mask: DataFrame, transform: Column | None = None,
                        tile: str = "tile_id", bounded: bool = False) -> DataFrame:
    """Height statistics of the points that fall on mask cells.

    Points are counted per (cell, height) before the join, and per height after
    it, so a tile with very many points is combined early, and no tile's heights meet in one task. Heights stored with
    a fixed step have few distinct values: ``bounded`` says so, and the exact median sees one entry of each.
    """
    if transform is None:
        col, row = F.col("x"), F.col("y")
    else:
        a, _, c, _, e, f = (F.get(transform, i) for i in range(6))
        col, row = (F.col("x") - c) / a, (F.col("y") - f) / e
    counted = points.groupBy(tile, F.floor(row).alias("row"), F.floor(col).alias("col"), "z").agg(
        F.count(F.lit(1)).alias("n"))
    inside = counted.join(mask.select(tile, "row", "col").distinct(), [tile, "row", "col"], "left_semi")
    return _height_measures(inside.groupBy(tile, "z").agg(F.sum("n").alias("n")), tile, "las", bounded)


def heights_from_elevation(dsm: DataFrame, dtm: DataFrame, mask: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Height statistics of surface minus terrain on mask cells; a tile's cells are bounded by its size."""
    cell = [tile, "row", "col"]
    z = (F.col("surface") - F.col("terrain")).alias("z")
    inside = dsm.join(dtm, cell).join(mask.select(*cell).distinct(), cell, "left_semi").select(tile, z)
    return _height_measures(inside.groupBy(tile, "z").agg(F.count(F.lit(1)).alias("n")), tile, "dsm_dtm", True)


def with_heights(spine: DataFrame, *sources: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Heights for every tile: the first source that has the tile wins, else nulls with source ``none``."""
    names = ["z_mean", "z_median", "z_std", "z_min", "z_max", "source"]
    out = spine.select(tile)
    for i, heights in enumerate(sources):
        out = out.join(heights.select(tile, F.struct(*names).alias(f"_h{i}")), tile, "left")
    best = F.coalesce(*[F.col(f"_h{i}") for i in range(len(sources))])
    return out.select(tile, *[best[n].alias(n) for n in names[:-1]],
                      F.coalesce(best["source"], F.lit("none")).alias("source"))


def _fixed_point(value: Column, digits: int) -> Column:
    """Decimal text of a number with ties to even."""
    scale = float(10**digits)
    return F.format_string(f"%.{digits}f", F.rint(value * scale) / scale)


def height_rules(decisions: DataFrame, heights: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Water that stands too high becomes background; buildings that are too tall are flagged.

    ``class_id`` keeps the decision before these rules, ``final_class_id`` has
    their result. A missing height counts as 0.
    """
    d = decisions.join(heights.select(tile, "z_mean", "z_max"), tile, "left")
    z_mean = F.coalesce("z_mean", F.lit(0.0))
    z_max = F.coalesce("z_max", F.lit(0.0))
    shadow = (F.col("class_id") == 4) & (z_mean > fixed.SHADOW_HEIGHT)
    tall = (F.col("class_id") == 1) & (z_max > fixed.TALL_HEIGHT)
    # Wording of the two reasons.
    shadow_text = F.concat(F.lit("Water rejected: mean height "), _fixed_point(z_mean, 2),
                           F.lit("m > 0.5m threshold"))
    tall_text = F.concat(F.lit("Building flagged: height "), _fixed_point(z_max, 1),
                         F.lit("m > 12m (possible G+3 or higher)"))
    return d \
        .withColumn("final_class_id", F.when(shadow, F.lit(0)).otherwise(F.col("class_id"))) \
        .withColumn("shadow_killed", shadow) \
        .withColumn("shadow_reason", F.when(shadow, shadow_text)) \
        .withColumn("illegal_height_flag", tall) \
        .withColumn("height_reason", F.when(tall, tall_text))


def decide(decisions: DataFrame, det_summary: DataFrame, stats: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Override, spectral and confidence rules in their fixed order.

    ``stats`` must have been taken for the classes after the override.
    """
    return low_confidence_rule(spectral_rules(detector_override(decisions, det_summary, tile), stats, tile))
