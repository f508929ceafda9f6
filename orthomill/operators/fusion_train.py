"""Cross-validated training of the fusion decision with Spark's own learners."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.operators.mlprep import fold_count, fusion_folds
from orthomill.session import cut_lineage

_EPS = 1e-7


def _cross_entropy(p, y):
    clipped = F.least(F.greatest(p, F.lit(_EPS)), F.lit(1 - _EPS))
    return -(y * F.log(clipped) + (1 - y) * F.log(1 - clipped))


def train_fold(rows: DataFrame, num_classes: int = fixed.NUM_CLASSES, hidden: int = 16, max_iter: int = 20,
               seed: int = 42) -> tuple[dict, DataFrame]:
    """Fit the four heads on the training side and measure the loss on the validation side.

    ``rows`` has ``features`` (array), ``accept``, ``refine``, ``class_id``,
    ``confidence`` and ``side``. The loss is the sum of two binary cross-entropies,
    the class cross-entropy and the squared confidence error.
    """
    vectors = rows.withColumn("x", array_to_vector(F.col("features").cast("array<double>"))) \
        .withColumn("class_label", F.col("class_id").cast("double"))
    train = cut_lineage(vectors.filter("side = 'train'").drop("features"))
    val = vectors.filter("side = 'val'").drop("features")
    width = len(train.select("x").first()["x"])
    models, scored = {}, val
    for head in ("accept", "refine"):
        model = LogisticRegression(featuresCol="x", labelCol=head, probabilityCol=f"p_{head}", rawPredictionCol=f"r_{head}",
                                   predictionCol=f"y_{head}", family="multinomial", regParam=0.01, maxIter=max_iter).fit(train)
        models[head] = model
        # A head trained on one label only has one probability column.
        scored = model.transform(scored).withColumn(
            f"p_{head}", F.coalesce(F.get(vector_to_array(f"p_{head}"), 1), F.lit(0.0)))
    models["class"] = MultilayerPerceptronClassifier(
        featuresCol="x", labelCol="class_label", probabilityCol="p_class", rawPredictionCol="r_class",
        predictionCol="y_class", layers=[width, hidden, num_classes], maxIter=max_iter, seed=seed).fit(train)
    models["confidence"] = LinearRegression(featuresCol="x", labelCol="confidence", predictionCol="y_confidence",
                                            regParam=0.01, maxIter=max_iter).fit(train)
    scored = models["confidence"].transform(models["class"].transform(scored))
    truth = F.get(vector_to_array("p_class"), F.col("class_id").cast("int"))
    error = F.col("y_confidence") - F.col("confidence")
    losses = scored.agg(
        F.count(F.lit(1)).alias("records"),
        F.avg(_cross_entropy(F.col("p_accept"), F.col("accept"))).alias("accept_loss"),
        F.avg(_cross_entropy(F.col("p_refine"), F.col("refine"))).alias("refine_loss"),
        F.avg(-F.log(F.greatest(truth, F.lit(_EPS)))).alias("class_loss"), F.avg(error * error).alias("confidence_loss"))
    return models, losses.withColumn(
        "val_loss", F.col("accept_loss") + F.col("refine_loss") + F.col("class_loss") + F.col("confidence_loss"))


def cross_validate(records: DataFrame, k: int = fixed.FOLDS, key: str = "tile_id", **settings) -> tuple[dict, DataFrame]:
    """Train every fold; returns the models of the fold with the lowest loss and one loss row per fold."""
    best, best_loss, rows = {}, float("inf"), []
    for fold in range(fold_count(k, records.count())):
        models, losses = train_fold(fusion_folds(records, [key], k, fold), **settings)
        row = losses.first().asDict()
        rows.append((fold, row["records"], *[float(row[c]) for c in (
            "accept_loss", "refine_loss", "class_loss", "confidence_loss", "val_loss")]))
        if row["val_loss"] < best_loss:
            best, best_loss = models, row["val_loss"]
    table = records.sparkSession.createDataFrame(
        rows, "fold int, records long, accept_loss double, refine_loss double, class_loss double, "
              "confidence_loss double, val_loss double")
    return best, table.withColumn("best", F.col("val_loss") == F.lit(best_loss))
