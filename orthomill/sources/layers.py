"""Vector layers: which layers count, and as which class."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill import fixed


def classify_layers(shapes: DataFrame, classes: Mapping[str, int] = fixed.LAYER_CLASSES) -> DataFrame:
    """Add ``class_id`` and ``layer_rank`` (position in name order); drop shapes of other layers.

    The map has a handful of entries, so it travels inside the expression and the
    filter on layer names can reach the scan.
    """
    table = F.create_map(*[F.lit(v) for item in classes.items() for v in item])
    ranks = F.create_map(*[F.lit(v) for item in zip(sorted(classes), range(len(classes))) for v in item])
    return shapes.filter(F.col("layer").isin(*classes)) \
        .withColumn("class_id", F.element_at(table, F.col("layer"))) \
        .withColumn("layer_rank", F.element_at(ranks, F.col("layer")))
