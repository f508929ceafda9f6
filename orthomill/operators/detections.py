"""Detected boxes: suppression, summaries, feature vectors, refinement candidates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import arrays
from orthomill.functions import geometry as geo
from orthomill.session import cut_lineage

BOX = ["x1", "y1", "x2", "y2"]
#: Groups up to this many distinct boxes are folded in one array; larger ones go round by round.
FOLD_LIMIT = 512


def best_first() -> list[Column]:
    """Confidence descending, then the box itself: total up to identical rows."""
    return [F.desc("confidence"), *[F.col(c) for c in BOX], F.col("class_id")]


def suppress(dets: DataFrame, conf_min: float = fixed.DETECTION_CONFIDENCE_MIN,
             iou_max: float = fixed.DETECTION_IOU_MAX, max_det: int = fixed.DETECTION_MAX,
             keys: Sequence[str] = ("tile_id", "class_id"), tile: str = "tile_id",
             fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Confidence filter, greedy non-maximum suppression per tile and class, cap per tile.

    Copies of a box collapse first: only the most confident copy can survive, and
    whatever suppresses it suppresses all. Ordinary groups are folded inside an
    array expression; a group too large for that is decided in rounds of joins,
    with the same result.
    """
    keys = list(keys)
    boxes = cut_lineage(dets.filter(F.col("confidence") >= conf_min).groupBy(*keys, *BOX).agg(
        F.max("confidence").alias("confidence")))
    large = boxes.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_limit).select(*keys)
    if large.isEmpty():
        kept = _fold(boxes, keys, iou_max)
    else:
        kept = _fold(boxes.join(large, keys, "left_anti"), keys, iou_max).unionByName(
            suppress_in_rounds(boxes.join(large, keys, "left_semi"), keys, iou_max))
    rank = F.row_number().over(Window.partitionBy(tile).orderBy(*best_first()))
    return kept.withColumn("rank", rank).filter(F.col("rank") <= max_det)


def _fold(boxes: DataFrame, keys: list[str], iou_max: float) -> DataFrame:
    order = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("minus"), *BOX)))
    kept = F.aggregate(
        F.slice("_boxes", 2, F.greatest(F.size("_boxes") - 1, F.lit(0))), F.slice("_boxes", 1, 1),
        lambda acc, b: F.when(F.exists(acc, lambda a: geo.box_iou(a, b) > iou_max), acc)
        .otherwise(F.concat(acc, F.array(b))))
    return boxes.groupBy(*keys).agg(order.alias("_boxes")).select(*keys, F.explode(kept).alias("b")).select(
        *keys, *[F.col(f"b.{c}").alias(c) for c in BOX], (-F.col("b.minus")).alias("confidence"))


def suppress_in_rounds(boxes: DataFrame, keys: Sequence[str], iou_max: float, max_rounds: int = 100_000) -> DataFrame:
    """Greedy suppression for groups of any size; ``boxes`` holds distinct boxes per key.

    Boxes that overlap by more than ``iou_max`` differ in size by a bounded factor.
    Each box is at home in the grid cells of its own size class and visits the
    cells of the next few coarser classes, so such a pair meets where the larger
    box is at home. A box wins a round if it is the best of its home cells and
    better than the residents of the cells it visits; then nothing better that is
    undecided can overlap it, and it is kept and removes what it overlaps. A cell
    has one resident winner at most and few visiting ones, so a round's work is
    linear in the boxes left, and distant winners are found in the same round.
    """
    keys = list(keys)
    reach = max(0, math.ceil(math.log2(1.0 / iou_max)))
    level = F.ceil(F.log2(F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.lit(1e-9)))).cast("int")
    cell = [*keys, "_m", "_gx", "_gy"]
    box = [*keys, *BOX]

    def listed(df: DataFrame) -> DataFrame:
        sized = df.withColumn("_m", F.explode(F.sequence(level, level + reach))) \
            .withColumn("_home", F.col("_m") == level).withColumn("_side", F.pow(F.lit(2.0), F.col("_m")))
        for axis in ("x", "y"):
            low = F.floor(F.col(f"{axis}1") / F.col("_side")).cast("long")
            high = F.floor(F.col(f"{axis}2") / F.col("_side")).cast("long")
            sized = sized.withColumn(f"_g{axis}", F.explode(F.sequence(low, high)))
        return sized.drop("_side")

    undecided = cut_lineage(boxes.withColumn("_me", F.struct((-F.col("confidence")).alias("minus"), *BOX)))
    kept: list[DataFrame] = []
    for _ in range(max_rounds):
        n_left = undecided.count()
        if n_left == 0:
            break
        cells = listed(undecided)
        best = cells.groupBy(*cell).agg(
            F.min("_me").alias("_best"), F.min(F.when(F.col("_home"), F.col("_me"))).alias("_resident"))
        # A busy cell's rows are one side of equi-joins, whose large partitions adaptive execution splits.
        judged = cells.join(best, cell)
        leads = F.when(F.col("_home"), F.col("_me") == F.col("_best")) \
            .otherwise(F.col("_resident").isNull() | (F.col("_me") < F.col("_resident")))
        winners = cut_lineage(judged.groupBy(*box, "confidence").agg(F.bool_and(leads).alias("_won")).filter("_won").drop("_won"))
        kept.append(winners)
        near = listed(winners).select(*cell, "_home", F.struct(*BOX).alias("_winner"))
        residents, visitors = (near.filter(c).drop("_home") for c in (F.col("_home"), ~F.col("_home")))
        met = cells.join(residents, cell).unionByName(cells.filter("_home").join(visitors, cell))
        gone = met.filter(geo.box_iou({c: F.col(c) for c in BOX}, F.col("_winner")) > iou_max).select(*box).distinct()
        undecided = cut_lineage(undecided.join(winners.select(*box).unionByName(gone), box, "left_anti"))
        if len(kept) >= 16:
            kept = [cut_lineage(_union(kept))]
    else:
        raise RuntimeError("suppression did not settle")
    return _union(kept) if kept else boxes.select(*box, "confidence").limit(0)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def summary(dets: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Box count, maximum and average confidence per tile."""
    return dets.groupBy(tile).agg(
        F.count(F.lit(1)).alias("count"), F.max("confidence").alias("max_confidence"),
        F.avg("confidence").alias("avg_confidence"))


def top_boxes(dets: DataFrame, k: int = fixed.REFINE_TOP_K, tile: str = "tile_id") -> DataFrame:
    """The ``k`` most confident boxes per tile; tasks keep only ``k`` rows per tile before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(tile).orderBy(*best_first()))
    return dets.withColumn("rank", rank).filter(F.col("rank") <= k)


def feature_vectors(spine: DataFrame, dets: DataFrame, k: int = fixed.FEATURE_DETECTIONS,
                    tile: str = "tile_id") -> DataFrame:
    """Detection features per tile of the spine: ``k`` x (x, y, w, h, conf, class), then count, max, avg."""
    per_box = F.array(*[c.cast("double") for c in (
        F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("confidence"),
        F.col("class_id"))])
    ranked = top_boxes(dets, k, tile).groupBy(tile).agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("rank", per_box.alias("v")))), lambda s: s["v"]))
        .alias("_boxes"))
    totals = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0))
                       for c in ("count", "max_confidence", "avg_confidence")])
    boxes = F.coalesce(F.col("_boxes"), F.array().cast("array<double>"))
    return spine.select(tile).join(ranked, tile, "left").join(summary(dets, tile), tile, "left").select(
        tile, F.concat(arrays.pad_to(boxes, 6 * k), totals).cast("array<float>").alias("det_features"))


def best_masks(candidates: DataFrame, keys: Sequence[str] = ("tile_id", "cand")) -> DataFrame:
    """Best-scored mask per candidate; the first of equal scores wins."""
    return candidates.groupBy(*keys).agg(
        F.max_by(F.struct("mask_no", "mask_area", "score"), F.struct("score", (-F.col("mask_no")).alias("_first")))
        .alias("m")).select(*keys, "m.*")


def box_mask_area(width: Column, height: Column) -> Column:
    """Pixel count of a box clamped to the tile, with coordinates truncated to whole pixels."""
    x1 = F.greatest(F.lit(0), F.col("x1").cast("int"))
    y1 = F.greatest(F.lit(0), F.col("y1").cast("int"))
    x2 = F.least(width, F.col("x2").cast("int"))
    y2 = F.least(height, F.col("y2").cast("int"))
    return F.when((x2 > x1) & (y2 > y1), (x2 - x1) * (y2 - y1)).otherwise(F.lit(0))


def quality_features(area: Column, iou: Column, stability: Column) -> Column:
    """``[area, iou, stability]`` as floats."""
    return F.array(*[F.coalesce(c.cast("float"), F.lit(0.0).cast("float")) for c in (area, iou, stability)])
