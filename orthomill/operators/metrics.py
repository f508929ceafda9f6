"""Segmentation and matching metrics, class statistics, evaluation losses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill import fixed


def class_iou(pixels: DataFrame, num_classes: int = fixed.NUM_CLASSES, keys: Sequence[str] = (),
              pred: str = "pred", target: str = "target") -> DataFrame:
    """IoU of every class per key; null where a class occurs in neither mask.

    One pass: hits, predictions and truths of all classes are counted side by
    side, so a key sends one row per task to the shuffle.
    """
    keys = list(keys)
    p, t = F.col(pred), F.col(target)
    counts = []
    for c in range(num_classes):
        counts += [F.count_if((p == c) & (t == c)).alias(f"tp{c}"), F.count_if(p == c).alias(f"p{c}"),
                   F.count_if(t == c).alias(f"t{c}")]
    rows = F.array(*[F.struct(F.lit(c).alias("class_id"), F.col(f"tp{c}").alias("tp"), F.col(f"p{c}").alias("p"),
                              F.col(f"t{c}").alias("t")) for c in range(num_classes)])
    union = F.col("p") + F.col("t") - F.col("tp")
    return pixels.groupBy(*keys).agg(*counts).select(*keys, F.explode(rows).alias("c")).select(*keys, "c.*") \
        .withColumn("iou", F.when(union > 0, F.col("tp") / union))


def mean_iou(ious: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean over the classes that occur; 0 if none does."""
    return ious.groupBy(*keys).agg(F.coalesce(F.avg("iou"), F.lit(0.0)).alias("miou"))


def validation_miou(pixels: DataFrame, image: str, num_classes: int = fixed.NUM_CLASSES) -> DataFrame:
    """Mean over images of the image's mean IoU."""
    per_image = mean_iou(class_iou(pixels, num_classes, [image]), [image])
    return per_image.agg(F.coalesce(F.avg("miou"), F.lit(0.0)).alias("miou"))


def pixel_accuracy(pixels: DataFrame, pred: str = "pred", target: str = "target") -> DataFrame:
    """Share of correct pixels in percent."""
    return pixels.agg((F.avg(F.when(F.col(pred) == F.col(target), 1.0).otherwise(0.0)) * 100).alias("accuracy_pct"))


def class_histogram(pixels: DataFrame, num_classes: int = fixed.NUM_CLASSES, value: str = "class_id") -> DataFrame:
    """Pixel count and percentage of every known class; other values are left out of the total."""
    counted = pixels.filter((F.col(value) >= 0) & (F.col(value) < num_classes)) \
        .groupBy(F.col(value).cast("int").alias("class_id")).agg(F.count(F.lit(1)).alias("n"))
    spine = counted.sparkSession.range(num_classes).select(
        F.col("id").cast("int").alias("class_id"), F.lit(0).cast("long").alias("n"))
    totals = counted.unionByName(spine).groupBy("class_id").agg(F.sum("n").alias("pixels"))
    whole = F.greatest(F.sum("pixels").over(Window.partitionBy(F.lit(1))), F.lit(1))
    return totals.withColumn("pct", F.col("pixels") / whole * 100)


def loss_weights(histogram: DataFrame) -> DataFrame:
    """Suggested weights of the foreground classes: inverse log frequency, scaled to a minimum of 1.

    The window spans the handful of class rows.
    """
    everything = Window.partitionBy(F.lit(1))
    fg = histogram.filter(F.col("class_id") > 0).withColumn("_all", F.sum("pixels").over(everything)) \
        .filter(F.col("_all") > 0)
    raw = F.lit(1.0) / (F.log1p(F.col("pixels") / F.col("_all") * 100) + 0.1)
    return fg.withColumn("_raw", raw).select(
        "class_id", (F.col("_raw") / F.min("_raw").over(everything)).alias("weight"))


def evaluation_loss(scored: DataFrame, image: str, num_classes: int = fixed.NUM_CLASSES,
                    alpha: float = fixed.LOSS_ALPHA, gamma: float | None = fixed.FOCAL_GAMMA,
                    probs: str = "probs", target: str = "target") -> DataFrame:
    """Dice loss, focal (or cross-entropy, ``gamma=None``) loss and their blend over all images.

    Dice is taken per image and class and averaged; all sums of an image come
    from one aggregation without exploding the probabilities.
    """
    p = [F.get(probs, c) for c in range(num_classes)]
    hit = [F.when(F.col(target) == c, 1.0).otherwise(0.0) for c in range(num_classes)]
    truth = F.get(probs, F.col(target).cast("int"))
    ce = -F.log(truth)
    pixel_loss = ce if gamma is None else F.pow(1.0 - truth, F.lit(gamma)) * ce
    sums = scored.groupBy(image).agg(
        *[F.sum(p[c] * hit[c]).alias(f"i{c}") for c in range(num_classes)],
        *[F.sum(p[c] + hit[c]).alias(f"u{c}") for c in range(num_classes)],
        F.sum(pixel_loss).alias("_loss"), F.count(F.lit(1)).alias("_n"))
    s = fixed.DICE_SMOOTH
    dice: Column = F.lit(0.0)
    for c in range(num_classes):
        dice = dice + (2 * F.col(f"i{c}") + s) / (F.col(f"u{c}") + s)
    out = sums.agg((1 - F.avg(dice / num_classes)).alias("dice_loss"),
                   (F.sum("_loss") / F.sum("_n")).alias("base_loss"))
    return out.withColumn("loss", alpha * F.col("dice_loss") + (1 - alpha) * F.col("base_loss"))
