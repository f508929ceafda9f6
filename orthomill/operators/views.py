"""Read views: layer features, run detail, charts and run summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators.ordering import global_row_number


def geojson_geometry(rings: Column) -> Column:
    """GeoJSON polygon struct of rings."""
    return F.struct(F.lit("Polygon").alias("type"), F.transform(
        rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"], p["y"]))).alias("coordinates"))


def geojson_features(polygons: DataFrame, run_id: str | None = None, limit: int = 1000) -> DataFrame:
    """The first ``limit`` detected polygons as GeoJSON feature texts, optionally of one run."""
    chosen = polygons if run_id is None else polygons.filter(F.col("run_id") == run_id)
    top = chosen.select("id", "tile_id", "class_id", "confidence", "z_mean", "rings").orderBy("id").limit(limit)
    feature = F.struct(
        F.lit("Feature").alias("type"), geojson_geometry(F.col("rings")).alias("geometry"),
        F.struct("tile_id", "class_id", "confidence", F.col("z_mean").alias("height")).alias("properties"))
    return top.select("id", F.to_json(feature, {"ignoreNullFields": "false"}).alias("feature"))


def class_distribution(polygons: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Highest confidence per class and tile, as an array ordered by class."""
    best = polygons.groupBy(tile, "class_id").agg(F.max(F.coalesce("confidence", F.lit(0.0))).alias("confidence"))
    return best.groupBy(tile).agg(
        F.array_sort(F.collect_list(F.struct("class_id", "confidence"))).alias("class_distribution"))


def run_detail(diagnostics: DataFrame, distribution: DataFrame, tile: str = "tile_id",
               default_crs: str = fixed.DEFAULT_CRS) -> DataFrame:
    """Prediction rows of a run as the dashboard names them.

    The names are historic: ``swin_confidence`` is the accept value and
    ``yolo_count`` the number of polygons. Missing decisions count as 0; bounds
    that look projected come back in degrees.
    """
    d = F.col("fusion_decision")
    confidence = F.coalesce(d["confidence_val"], F.lit(0.0))
    b = F.coalesce(F.col("bounds"), F.struct(
        F.lit(0.0).alias("min_y"), F.lit(0.0).alias("min_x"), F.lit(512.0).alias("max_y"), F.lit(512.0).alias("max_x")))
    return diagnostics.join(distribution, tile, "left").select(
        tile, F.coalesce(d["class_id"], F.lit(0)).alias("final_class"), confidence.alias("final_confidence"),
        F.coalesce(d["accept_val"], F.lit(0.0)).alias("swin_confidence"),
        F.coalesce("num_polygons", F.lit(0)).alias("yolo_count"),
        F.greatest(F.lit(0.2), confidence).alias("yolo_max_conf"), F.col("depth_stats").alias("metrics"),
        F.when(F.coalesce(d["refine_flag"], F.lit(False)), "refine").otherwise("accept").alias("action"),
        F.coalesce("class_distribution", F.array().cast("array<struct<class_id:int,confidence:double>>"))
        .alias("class_distribution"),
        geo.bounds_to_wgs84(b, F.col("crs"), default_crs).alias("bounds"))


def class_chart(predictions: DataFrame) -> DataFrame:
    """Tiles per final class, background left out."""
    return predictions.filter(F.col("final_class") > 0).groupBy("final_class").agg(F.count(F.lit(1)).alias("tiles"))


def confidence_card(predictions: DataFrame) -> DataFrame:
    """Average confidence in percent over all predictions."""
    return predictions.agg(F.avg(F.col("final_confidence") * 100).alias("avg_confidence_pct"))


def confidence_series(predictions: DataFrame, tile: str = "tile_id") -> DataFrame:
    """Confidence in percent in tile order, with its position."""
    return global_row_number(predictions.select(tile, (F.col("final_confidence") * 100).alias("confidence_pct")),
                             [tile], "pos")


def progress_percent(done: Column, total: Column) -> Column:
    """Progress in percent; nothing to do counts as 0."""
    return F.coalesce(done / F.nullif(total, F.lit(0)) * 100, F.lit(0.0))


def run_summary(diagnostics: DataFrame, run: str = "run_id", device: str | None = None,
                versions: dict[str, str] | None = None) -> DataFrame:
    """Counts and times per run; only status ``error`` counts as error, ``failed`` is separate.

    ``device`` and ``model_versions`` are what the run was started with. A run is ``running`` while a tile is ``processing``, else ``complete``.
    """
    named = F.create_map(*[F.lit(x) for pair in (versions or {}).items() for x in pair]).cast("map<string,string>")
    return diagnostics.groupBy(run).agg(
        F.count(F.lit(1)).alias("num_tiles"), F.count_if(F.col("status") == "complete").alias("completed"),
        F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.sum("elapsed_s").alias("total_time_s"),
        (F.sum("elapsed_s") / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("avg_time_per_tile"),
        F.when(F.count_if(F.col("status") == "processing") > 0, "running").otherwise("complete").alias("status")) \
        .withColumn("device", F.lit(device).cast("string")).withColumn("model_versions", named)


def run_header(summary: DataFrame, regions: DataFrame, run: str = "run_id") -> DataFrame:
    """A run's summary as the dashboard reads it: ``processed_tiles`` and how many regions ``(run, region_id, class_id, ...)`` it has.

    The regions themselves stay a table under the run's id; a run has any number of them.
    """
    counts = regions.groupBy(run).agg(F.count(F.lit(1)).alias("num_regions"), F.count_distinct("class_id").alias("region_classes"))
    return summary.join(counts, run, "left").withColumns({
        "processed_tiles": F.col("completed"), "num_regions": F.coalesce("num_regions", F.lit(0)),
        "region_classes": F.coalesce("region_classes", F.lit(0))})


def throughput(diagnostics: DataFrame, run: str = "run_id", target_s: float = 180.0) -> DataFrame:
    """Tiles per second per run and whether a fully completed run met the time target."""
    spans = diagnostics.groupBy(run).agg(
        F.count(F.lit(1)).alias("tiles"), F.min("ts").alias("_a"), F.max("ts").alias("_b"),
        F.bool_and(F.col("status").isin("complete", "skipped")).alias("_done"))
    elapsed = F.timestamp_diff("MICROSECOND", F.col("_a"), F.col("_b")) / F.lit(1e6)
    spans = spans.withColumn("elapsed_s", elapsed)
    return spans.select(
        run, "tiles", "elapsed_s", (F.col("tiles") / F.nullif("elapsed_s", F.lit(0.0))).alias("tiles_per_s"),
        F.when(F.col("_done"), "COMPLETED").otherwise("FAILED").alias("state"),
        (F.col("_done") & (F.col("elapsed_s") < target_s)).alias("target_met"))
