"""One row per tile: batch alignment, polygon sources, diagnostics, tile outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators.vectorize import polygonize


def align_metadata(tiles: DataFrame, metadata: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tiles with their metadata; a tile without any gets the identity transform."""
    identity = F.array(*[F.lit(v) for v in fixed.IDENTITY_TRANSFORM])
    return tiles.join(metadata, tile, "left").withColumn("transform", F.coalesce("transform", identity))


def refined_cells(decisions: DataFrame, refined: DataFrame, tile: str = "tile_id",
                  accept_min: float = fixed.ACCEPT_MIN, quality_min: float = fixed.MASK_QUALITY_MIN) -> DataFrame:
    """Cells of good refined masks of accepted tiles: ``(tile, cand, row, col)`` with the decision's class."""
    accepted = decisions.filter(F.col("accept_val") >= accept_min).select(
        tile, "class_id", F.col("confidence_val").alias("confidence"))
    return refined.filter(F.col("quality") > quality_min).join(accepted, tile)


def segmentation_cells(decisions: DataFrame, mask: DataFrame, covered: DataFrame | None = None, tile: str = "tile_id",
                       num_classes: int = fixed.NUM_CLASSES, min_pixels: float = fixed.MIN_POLYGON_AREA,
                       accept_min: float = fixed.ACCEPT_MIN) -> DataFrame:
    """Cells of the segmentation mask that become polygons.

    Only accepted tiles, only tiles that refinement has not ``covered``, only
    foreground classes with at least ``min_pixels`` pixels in the tile.
    """
    wanted = decisions.filter(F.col("accept_val") >= accept_min).select(tile)
    if covered is not None:
        wanted = wanted.join(covered.select(tile).distinct(), tile, "left_anti")
    foreground = mask.filter((F.col("class_id") >= 1) & (F.col("class_id") < num_classes)) \
        .join(wanted, tile, "left_semi")
    large = foreground.groupBy(tile, "class_id").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_pixels)
    return foreground.join(large.select(tile, "class_id"), [tile, "class_id"], "left_semi")


def tile_polygons(decisions: DataFrame, mask: DataFrame, seg_confidence: DataFrame, refined: DataFrame | None = None,
                  transforms: DataFrame | None = None, tile: str = "tile_id",
                  min_area: float = fixed.MIN_POLYGON_AREA, tolerance: float = fixed.SIMPLIFY_TOLERANCE) -> DataFrame:
    """Final polygons per tile: from refined masks where they yield any, else from the segmentation.

    Refined polygons carry the decision's class and confidence; segmentation
    polygons carry the mask's class and the segmentation confidence.
    """
    columns = [tile, "class_id", "confidence", "source_masks", "rings", "area", "perimeter", "valid"]

    covered, parts = None, []
    if refined is not None:
        cells = refined_cells(decisions, refined, tile).withColumn("_on", F.lit(1))
        shapes = polygonize(cells.select(tile, "cand", "row", "col", "_on"), [tile, "cand"], transforms, "_on", min_area, tolerance, whole_tile=True)
        info = decisions.select(tile, "class_id", F.col("confidence_val").alias("confidence"))
        covered = shapes.join(info, tile).withColumn("source_masks", F.array(F.lit(fixed.REFINED_TAG)))
        parts.append(covered.select(*columns))
    shapes = polygonize(segmentation_cells(decisions, mask, covered, tile), [tile], transforms, "class_id", min_area, tolerance, whole_tile=True)
    parts.append(shapes.join(seg_confidence.select(tile, "confidence"), tile, "left")
                 .withColumn("confidence", F.coalesce("confidence", F.lit(fixed.DEFAULT_CONFIDENCE)))
                 .withColumn("source_masks", F.array(F.lit(fixed.SEG_TAG))).select(*columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def diagnostics(spine: DataFrame, load_errors: DataFrame, gate: DataFrame, segmented: DataFrame, detected: DataFrame,
                heights: DataFrame, decisions: DataFrame, tile: str = "tile_id", polygons: DataFrame | None = None,
                meta: DataFrame | None = None, timing: DataFrame | None = None) -> DataFrame:
    """Exactly one diagnostics row per tile of the spine ``(run_id, tile)``.

    A load error ends in ``error``, a gatekeeper rejection in ``skipped``, anything
    else is ``complete``; errors and used models are listed in order. ``polygons`` (one row each) are counted for complete
    tiles, ``meta`` gives ``bounds`` and ``crs``, ``timing`` a ``timing`` map of seconds per step (see :func:`timing_map`); what is not given is null.
    """
    bounds = "struct<min_y:double,min_x:double,max_y:double,max_x:double>"
    spark = spine.sparkSession
    kind = spine.schema[tile].dataType.simpleString()
    meta = spark.createDataFrame([], f"{tile} {kind}, bounds {bounds}, crs string") if meta is None else meta
    timing = spark.createDataFrame([], f"{tile} {kind}, timing map<string,double>") if timing is None else timing
    counts = (spark.createDataFrame([], f"{tile} {kind}, _n long") if polygons is None
              else polygons.groupBy(tile).agg(F.count(F.lit(1)).alias("_n")))
    joined = (
        spine
        .join(counts, tile, "left")
        .join(meta.select(tile, "bounds", "crs"), tile, "left")
        .join(timing.select(tile, "timing"), tile, "left")
        .join(load_errors.select(tile, F.col("message").alias("_load")), tile, "left")
        .join(gate.select(tile, F.col("keep").alias("_keep")), tile, "left")
        .join(segmented.select(tile).distinct().withColumn("_seg", F.lit(True)), tile, "left")
        .join(detected.select(tile).distinct().withColumn("_det", F.lit(True)), tile, "left")
        .join(heights.select(tile, F.struct("z_mean", "z_max", "source").alias("depth_stats")), tile, "left")
        .join(decisions.select(tile, F.struct("accept_val", "refine_flag", "class_id", "confidence_val")
                               .alias("fusion_decision")), tile, "left")
    )
    failed = F.col("_load").isNotNull()
    skipped = ~failed & ~F.coalesce("_keep", F.lit(True))
    done = ~failed & ~skipped
    used = F.array_compact(F.array(
        F.when(F.col("_seg"), F.lit(fixed.SEG_TAG)), F.when(F.col("_det"), F.lit(fixed.DET_TAG)),
        F.when(F.coalesce(F.col("depth_stats.source"), F.lit("none")) != "none", F.lit(fixed.DEPTH_TAG))))
    return joined.select(
        *spine.columns,
        F.when(failed, "error").when(skipped, "skipped").otherwise("complete").alias("status"),
        F.array_compact(F.array(
            F.when(failed, F.concat(F.lit(fixed.LOAD_ERROR), F.col("_load"))),
            F.when(skipped, F.lit(fixed.GATE_ERROR)))).alias("errors"),
        F.when(done, used).otherwise(F.array().cast("array<string>")).alias("models_used"),
        F.when(done, F.col("fusion_decision")).alias("fusion_decision"),
        F.when(done, F.col("depth_stats")).alias("depth_stats"), "timing", "bounds", "crs",
        F.when(done, F.coalesce("_n", F.lit(0))).alias("num_polygons") if polygons is not None
        else F.lit(None).cast("long").alias("num_polygons"))


def timing_map(**steps: Column) -> Column:
    """Seconds per step as a map; steps without a value are left out."""
    entries = F.array_compact(F.array(*[
        F.when(v.isNotNull(), F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")))
        for k, v in steps.items()]))
    return F.map_from_entries(entries)


def tile_outputs(spine: DataFrame, polygons: DataFrame, heights: DataFrame, det_counts: DataFrame,
                 seg_confidence: DataFrame, decisions: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Nested output document per tile; polygons are ordered by class, then geometry text."""
    item = F.struct(
        "class_id", geo.to_wkt(F.col("rings")).alias("geometry_wkt"), "confidence", "source_masks",
        "z_mean", "area", "perimeter")
    nested = polygons.join(heights.select(tile, "z_mean"), tile, "left") \
        .groupBy(tile).agg(F.array_sort(F.collect_list(item)).alias("polygons"))
    none = F.array().cast(nested.schema["polygons"].dataType)
    return (
        spine.join(nested, tile, "left").join(det_counts.select(tile, F.col("count").alias("_n")), tile, "left")
        .join(seg_confidence.select(tile, F.col("confidence").alias("_conf")), tile, "left")
        .join(decisions.select(tile, "accept_val"), tile, "left")
        .withColumn("polygons", F.coalesce("polygons", none))
        .select(*spine.columns, "polygons", F.size("polygons").alias("num_polygons"),
                F.coalesce("_conf", F.lit(0.0)).alias("swin_confidence"),
                F.coalesce("_n", F.lit(0)).alias("yolo_count"),
                F.coalesce("accept_val", F.lit(0.0)).alias("fusion_accept"))
    )
