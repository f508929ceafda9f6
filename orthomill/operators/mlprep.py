"""Dataset preparation: pairing, splits, sampling weights, labels, fusion records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import arrays
from orthomill.functions import ids
from orthomill.operators import tiling
from orthomill.operators.components import component_boxes, label_cells
from orthomill.operators.ordering import blocked_row_number, global_row_number
from orthomill.session import cut_lineage


def pair_masks(tiles: DataFrame, files: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Every tile with its mask file, or an empty path.

    ``files`` has ``folder`` (``ann`` or ``tile``), ``stem`` and ``path``. In order of
    preference: ``{tile}_mask`` among the annotations, ``{tile}`` there,
    ``{tile}_mask`` beside the tile. A file offers itself to at most two tiles, so
    pairing is one equi-join.
    """
    masked = F.col("stem").endswith("_mask")
    base = F.expr("substring(stem, 1, length(stem) - 5)")
    offers = F.array_compact(F.array(
        F.when((F.col("folder") == "ann") & masked, F.struct(base.alias("t"), F.lit(1).alias("prio"))),
        F.when(F.col("folder") == "ann", F.struct(F.col("stem").alias("t"), F.lit(2).alias("prio"))),
        F.when((F.col("folder") == "tile") & masked, F.struct(base.alias("t"), F.lit(3).alias("prio")))))
    best = files.select("path", F.explode(offers).alias("o")).groupBy(F.col("o.t").alias(tile)).agg(
        F.min(F.struct("o.prio", "path")).alias("_b")).select(tile, F.col("_b.path").alias("mask_path"))
    return tiles.join(best, tile, "left").withColumn("mask_path", F.coalesce("mask_path", F.lit("")))


def paired_only(tiles: DataFrame, masks: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tiles that have an annotation mask, with it."""
    return tiles.join(masks, tile)


def mask_driven(tiles: DataFrame, masks: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Masks whose tile exists."""
    return masks.join(tiles.select(tile), tile, "left_semi")


def _fold_sides(numbered: DataFrame, total: int, size: int, fold: int) -> DataFrame:
    start = fold * size
    end = min(start + size, total)
    inside = (F.col("row_no") >= start) & (F.col("row_no") < end)
    return numbered.withColumn("side", F.when(inside, "val").otherwise("train"))


def k_fold(items: DataFrame, order_by: Sequence[str], k: int, fold: int) -> DataFrame:
    """Contiguous folds over the sorted items: adds ``row_no`` and ``side`` (train/val).

    The fold size is the floor of n / k, so the last n mod k items are never in a
    validation part.
    """
    numbered = global_row_number(items, order_by)
    total = numbered.count()
    return _fold_sides(numbered, total, total // k if k > 0 else total, fold)


def fusion_folds(records: DataFrame, order_by: Sequence[str], k: int, fold: int) -> DataFrame:
    """Folds of at least one record; a side that would be empty gets all records.

    Rows are labelled by ``side`` and repeated for both sides where needed.
    """
    numbered = global_row_number(records, order_by)
    total = numbered.count()
    sided = _fold_sides(numbered, total, max(total // k, 1), fold)
    start = fold * max(total // k, 1)
    n_val = max(0, min(start + max(total // k, 1), total) - start)
    if n_val == 0:
        return sided.unionByName(numbered.withColumn("side", F.lit("val")))
    if n_val == total:
        return sided.unionByName(numbered.withColumn("side", F.lit("train")))
    return sided


def fold_count(k: int, n: int) -> int:
    """Number of folds actually run."""
    return min(k, max(n, 1))


def _draw(*parts: Column) -> Column:
    """A repeatable 32-bit number from text parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 8), 16, 10).cast("long")


def shuffled_split(items: DataFrame, key: str, val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Seeded random split: adds ``side``; the order comes from a hash of seed and key."""
    mixed = items.withColumn("_draw", _draw(F.lit(str(seed)), F.col(key).cast("string")))
    numbered = global_row_number(mixed, ["_draw", key])
    cut = int(numbered.count() * (1 - val_ratio))
    return numbered.withColumn("side", F.when(F.col("row_no") < cut, "train").otherwise("val")).drop("_draw")


def every_fifth(tiles: DataFrame, order_by: Sequence[str], masks: DataFrame | None = None,
                tile: str = "tile_id", step: int = 5) -> DataFrame:
    """Validation split by position among all sorted tiles; tiles without a mask still count in the numbering."""
    numbered = global_row_number(tiles, order_by).withColumn(
        "side", F.when(F.col("row_no") % step == 0, "val").otherwise("train"))
    return numbered if masks is None else numbered.join(masks.select(tile).distinct(), tile, "left_semi")


def sample_weights(tiles: DataFrame, mask: DataFrame, tile: str = "tile_id",
                   weight: int = fixed.OVERSAMPLE_WEIGHT) -> DataFrame:
    """Weight ``weight`` for tiles whose mask shows a building or road, else 1."""
    rich = mask.groupBy(tile).agg(F.bool_or(F.col("class_id").isin(1, 2)).alias("_rich"))
    return tiles.join(rich, tile, "left").withColumn(
        "weight", F.when(F.coalesce("_rich", F.lit(False)), weight).otherwise(1)).drop("_rich")


def weighted_draw(weighted: DataFrame, tile: str = "tile_id", weight: int = fixed.OVERSAMPLE_WEIGHT,
                  seed: int = 42) -> DataFrame:
    """As many weighted draws with replacement as there are tiles: ``(draw, tile)``.

    Tiles are numbered within their weight class, so a drawn ticket points at a
    (class, position) pair and is resolved by an equi-join.
    """
    high = F.col("weight") > 1
    numbered = global_row_number(weighted.select((~high).alias("_low"), tile), ["_low", tile], "_pos")
    counts = numbered.agg(F.count(F.lit(1)), F.count_if(~F.col("_low"))).first()
    total, n_high = counts[0], counts[1]
    tickets = n_high * weight + (total - n_high)
    draws = weighted.sparkSession.range(total).select(
        F.col("id").alias("draw"), (_draw(F.lit(str(seed)), F.col("id").cast("string")) % tickets).alias("_t"))
    position = F.when(F.col("_t") < n_high * weight, F.expr(f"_t div {weight}")) \
        .otherwise(F.col("_t") - n_high * weight + n_high)
    return draws.select("draw", position.alias("_pos")).join(numbered.select("_pos", tile), "_pos").select("draw", tile)


def box_labels(mask: DataFrame, height: int | None = None, width: int | None = None, sizes: DataFrame | None = None,
               tile: str = "tile_id", min_area: int = fixed.BOX_LABEL_MIN_AREA) -> DataFrame:
    """Normalised boxes of the 8-connected components of classes 1 to 4, with the label line.

    Tiles have one ``height`` and ``width``, or their own in ``sizes`` (tile, height,
    width). Label classes count from 0.
    """
    foreground = mask.filter((F.col("class_id") >= 1) & (F.col("class_id") <= 4))
    boxes = component_boxes(label_cells(foreground, [tile], "class_id", 8, None), [tile]) \
        .filter(F.col("pixels") >= min_area)
    if sizes is not None:
        boxes = boxes.join(sizes.select(tile, F.col("height").alias("_h"), F.col("width").alias("_w")), tile)
    else:
        boxes = boxes.withColumn("_h", F.lit(height)).withColumn("_w", F.lit(width))
    bw, bh = F.col("max_col") - F.col("min_col") + 1, F.col("max_row") - F.col("min_row") + 1
    out = boxes.select(
        tile, (F.col("class_id") - 1).cast("int").alias("label"), ((F.col("min_col") + bw / 2) / F.col("_w")).alias("cx"),
        ((F.col("min_row") + bh / 2) / F.col("_h")).alias("cy"), (bw / F.col("_w")).alias("w"),
        (bh / F.col("_h")).alias("h"))
    return out.withColumn("line", F.format_string("%d %.6f %.6f %.6f %.6f", "label", "cx", "cy", "w", "h"))


def label_totals(labels: DataFrame) -> DataFrame:
    """Boxes per label class."""
    return labels.groupBy("label").agg(F.count(F.lit(1)).alias("boxes"))


def ground_truth_tiles(windows: DataFrame, cells: DataFrame, size: int, stride: int, source: str = "source_id",
                       min_sum: int = fixed.GT_TILE_MIN_SUM, max_tiles: int = 0) -> DataFrame:
    """Windows rich in ground truth, numbered per source in row-major order.

    A window counts when the sum of its class ids reaches ``min_sum`` (the sum of
    ids, not of pixels; ``gt_pixels`` has the pixel count). Cells under the same windows
    are summed once, then by window.
    """
    parts = cells.groupBy(source, *tiling.shared_stretch(size, stride)).agg(
        F.min("row").alias("row"), F.min("col").alias("col"), F.sum("class_id").alias("class_sum"), F.count_if(F.col("class_id") > 0).alias("gt_pixels"))
    sums = tiling.assign_windows(parts, size, stride).groupBy(source, "row_off", "col_off").agg(
        F.sum("class_sum").alias("class_sum"), F.sum("gt_pixels").alias("gt_pixels"))
    # Numbering reads them twice; the cells behind them are worked out once.
    rich = cut_lineage(windows.join(sums.filter(F.col("class_sum") >= min_sum), [source, "row_off", "col_off"]))
    numbered = blocked_row_number(rich, [source], "row_off", ["col_off"], "gt_index") \
        .withColumn("tile_id", ids.gt_tile_id(F.col("gt_index")))
    return numbered.filter(F.col("gt_index") < max_tiles) if max_tiles > 0 else numbered


def pixel_pseudo_labels(classified: DataFrame, tile: str = "tile_id", prob_min: float = fixed.PSEUDO_LABEL_MIN,
                        min_pixels: int = fixed.PSEUDO_MIN_PIXELS) -> tuple[DataFrame, DataFrame]:
    """Confident pixels keep their class, others become background: ``(labels, verdicts)``.

    Tiles with fewer than ``min_pixels`` foreground pixels are discarded.
    """
    kept = classified.withColumn("class_id", F.when(F.col("max_prob") >= prob_min, F.col("class_id")).otherwise(F.lit(0)))
    verdicts = kept.groupBy(tile).agg(F.count_if(F.col("class_id") != 0).alias("foreground")) \
        .withColumn("accepted", F.col("foreground") >= min_pixels)
    return kept.join(verdicts.filter("accepted").select(tile), tile, "left_semi"), verdicts


def tile_pseudo_labels(stats: DataFrame, classified: DataFrame, tile: str = "tile_id",
                       conf_min: float = fixed.PSEUDO_LABEL_MIN) -> DataFrame:
    """Predicted masks of the tiles whose confidence reaches ``conf_min``."""
    sure = stats.filter(F.col("confidence") >= conf_min).select(tile)
    return classified.join(sure, tile, "left_semi")


def ground_truth_info(tiles: DataFrame, mask: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Ground-truth fields per tile: from its mask, or the defaults of a tile without one."""
    best = mask.groupBy(tile).agg(F.max("class_id").alias("_max"))
    known = F.col("_max").isNotNull()
    return tiles.select(tile).join(best, tile, "left").select(
        tile, F.when(known, F.col("_max")).otherwise(1).cast("int").alias("gt_label"),
        F.when(known, F.col("_max") > 0).otherwise(True).alias("gt_has_object"),
        F.when(known, 1.0).otherwise(0.0).alias("gt_iou"), (~known).alias("gt_needs_refinement"))


def fusion_records(tiles: DataFrame, seg: DataFrame, dets: DataFrame, det_summary: DataFrame, heights: DataFrame,
                   mask_stats: DataFrame, truth: DataFrame, tile: str = "tile_id") -> DataFrame:
    """One fusion training record per tile; missing parts are zero."""
    depth = heights.select(tile, F.array(*[F.coalesce(c, F.lit(0.0)) for c in ("z_mean", "z_median", "z_std")])
                           .cast("array<float>").alias("depth_features"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    stats = mask_stats.select(tile, "confidence", F.array(
        zero("mask_area"), zero("mask_perimeter"), zero("confidence"), F.lit(1.0)).cast("array<float>").alias("mask_stats"))
    blank = F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).cast("array<float>")
    joined = tiles.select(tile)
    for part in (seg.select(tile, "seg_features"), dets.select(tile, "det_features"),
                 det_summary.select(tile, "count", "max_confidence"), depth, stats, truth):
        joined = joined.join(part, tile, "left")
    return joined.select(
        tile, F.coalesce("seg_features", arrays.zeros(fixed.SEG_DIM)).alias("swin_features"),
        F.coalesce("confidence", F.lit(0.0)).alias("swin_confidence"),
        F.coalesce("det_features", arrays.zeros(fixed.DET_DIM)).alias("yolo_features"),
        F.coalesce("count", F.lit(0)).alias("yolo_count"), F.coalesce("max_confidence", F.lit(0.0)).alias("yolo_max_conf"),
        F.coalesce("depth_features", arrays.zeros(fixed.DEPTH_DIM)).alias("depth_features"),
        F.coalesce("mask_stats", blank).alias("mask_stats"), "gt_label", "gt_has_object", "gt_iou", "gt_needs_refinement")


def checked_record(records: DataFrame) -> DataFrame:
    """Records as training rows: wrong-length parts become zeros, labels get their defaults."""
    part = lambda c, n: F.coalesce(arrays.fit_length(F.col(c).cast("array<float>"), n), arrays.zeros(n))
    loose = lambda c, n: F.coalesce(F.col(c).cast("array<float>"), arrays.zeros(n))
    return records.select(
        "tile_id", F.concat(part("swin_features", fixed.SEG_DIM), part("yolo_features", fixed.DET_DIM),
                            loose("depth_features", fixed.DEPTH_DIM), loose("mask_stats", fixed.MASK_DIM)).alias("features"),
        F.when(F.coalesce("gt_has_object", F.lit(True)), 1.0).otherwise(0.0).alias("accept"),
        F.when(F.coalesce("gt_needs_refinement", F.lit(False)), 1.0).otherwise(0.0).alias("refine"),
        F.coalesce("gt_label", F.lit(1)).alias("class_id"), F.coalesce("gt_iou", F.lit(0.5)).alias("confidence"))


def clamp_classes(mask: DataFrame, num_classes: int = fixed.NUM_CLASSES, value: str = "class_id") -> DataFrame:
    """Class ids forced into ``[0, num_classes)``."""
    return mask.withColumn(value, F.greatest(F.lit(0), F.least(F.col(value), F.lit(num_classes - 1))))


def flagged_tiles(diagnostics: DataFrame, feedback: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Tiles to label again: flagged for refinement, or corrected by a reviewer and not yet processed."""
    unsure = diagnostics.filter("refine_flag").select(tile)
    corrected = feedback.filter(~F.col("processed") & (F.col("original_class") != F.col("corrected_class"))).select(tile)
    return unsure.unionByName(corrected).distinct()
