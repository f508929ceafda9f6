"""Segmentation statistics, fusion vectors and fusion scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import arrays


def classify_pixels(logits: DataFrame, column: str = "logits") -> DataFrame:
    """Add class probabilities, the predicted class (first maximum) and its probability."""
    return logits.withColumn("probs", arrays.softmax(F.col(column))) \
        .withColumn("class_id", arrays.argmax(F.col(column))) \
        .withColumn("max_prob", F.array_max("probs"))


def segmentation_stats(classified: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Per tile: confidence, building area, mean building probability; perimeter and parts are placeholders."""
    return classified.groupBy(tile).agg(
        F.avg("max_prob").alias("confidence"),
        F.count_if(F.col("class_id") == 1).cast("double").alias("mask_area"),
        F.lit(0.0).alias("mask_perimeter"),
        F.avg(F.get("probs", 1)).alias("building_prob"),
        F.lit(1.0).alias("num_components"))


def mask_features() -> Column:
    """The four mask values of the fusion vector; 0 where a tile has no mask."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return F.array(zero("mask_area"), zero("mask_perimeter"), zero("building_prob"), F.lit(1.0)).cast("array<float>")


def assemble(features: DataFrame, seg_dim: int = fixed.SEG_DIM, det_dim: int = fixed.DET_DIM,
             depth_dim: int = fixed.DEPTH_DIM, mask_dim: int = fixed.MASK_DIM) -> DataFrame:
    """Add ``features``: segmentation, detection, depth and mask parts in one array.

    A missing part, or one of the wrong length, becomes zeros, so all vectors
    have the same length.
    """
    parts = [("seg_features", seg_dim), ("det_features", det_dim), ("depth_features", depth_dim),
             ("mask_stats", mask_dim)]
    fitted = [F.coalesce(arrays.fit_length(F.col(c).cast("array<float>"), n), arrays.zeros(n)) for c, n in parts]
    return features.withColumn("features", F.concat(*fitted))


def score(features: DataFrame, weights: Mapping[str, np.ndarray], tile: str = "tile_id") -> DataFrame:
    """Fusion decisions from a trained multi-layer perceptron.

    ``weights`` holds ``w0,b0,w1,b1,...`` for the hidden layers (ReLU) and
    ``accept``, ``refine``, ``class``, ``confidence`` pairs ``(W, b)`` under
    ``*_w`` / ``*_b``. They are a fixed few hundred kilobytes and travel with the
    task; rows are scored batch by batch.
    """
    layers = []
    while f"w{len(layers)}" in weights:
        layers.append((weights[f"w{len(layers)}"], weights[f"b{len(layers)}"]))
    heads = {h: (weights[f"{h}_w"], weights[f"{h}_b"]) for h in ("accept", "refine", "class", "confidence")}
    schema = f"{tile} {features.schema[tile].dataType.simpleString()}, accept_val double, refine_val double, " \
             "class_id int, confidence_val double"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def sigmoid(v: np.ndarray) -> np.ndarray:
            return 1.0 / (1.0 + np.exp(-v))

        for pdf in batches:
            if pdf.empty:
                continue
            h = np.stack(pdf["features"].to_numpy()).astype(np.float64)
            for w, b in layers:
                h = np.maximum(h @ w + b, 0.0)
            out = {k: h @ w + b for k, (w, b) in heads.items()}
            yield pd.DataFrame({
                tile: pdf[tile], "accept_val": sigmoid(out["accept"][:, 0]),
                "refine_val": sigmoid(out["refine"][:, 0]), "class_id": out["class"].argmax(axis=1),
                "confidence_val": sigmoid(out["confidence"][:, 0])})

    scored = features.select(tile, "features").mapInPandas(run, schema)
    return scored.withColumn("refine_flag", F.col("refine_val") > 0.5).drop("refine_val")


def with_default_decision(spine: DataFrame, decisions: DataFrame, tile: str = "tile_id") -> DataFrame:
    """A decision for every tile; tiles without a score get the pass-through default."""
    return spine.join(decisions, tile, "left") \
        .withColumn("accept_val", F.coalesce("accept_val", F.lit(fixed.DEFAULT_ACCEPT))) \
        .withColumn("refine_flag", F.coalesce("refine_flag", F.lit(True))) \
        .withColumn("class_id", F.coalesce("class_id", F.lit(fixed.DEFAULT_CLASS))) \
        .withColumn("confidence_val", F.coalesce("confidence_val", F.lit(fixed.DEFAULT_CONFIDENCE)))
