"""Exports: features, layers, class rasters, detections, QA tables, merged villages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.functions import ids
from orthomill.operators.rasterize import export_raster, export_raster_frame

#: The columns of the QA table.
QA_COLUMNS = ["tile_id", "precision", "recall", "f1", "mIoU", "num_bboxes", "avg_confidence"]


def features(outputs: DataFrame, class_names: Sequence[str] | None = None) -> DataFrame:
    """One row per geometry of the tile outputs, parsed and with defaults filled in.

    POLYGON and MULTIPOLYGON texts, flat or with heights, are read: ``parts`` holds the rings of each part, ``rings`` those of all
    parts (even-odd filling gives the same cells). Only what has no readable, non-empty geometry is dropped.
    """
    names = list(class_names or fixed.CLASS_NAMES[:fixed.NUM_CLASSES])
    p = F.col("p")
    rows = outputs.select(F.coalesce("tile_id", F.lit("unknown")).alias("tile_id"), F.explode("polygons").alias("p"))
    parsed = rows.filter(p["geometry_wkt"].isNotNull()).withColumn("parts", geo.parts_from_wkt(p["geometry_wkt"])) \
        .withColumn("rings", F.flatten("parts"))
    class_id = F.coalesce(p["class_id"], F.lit(fixed.DEFAULT_CLASS))
    return parsed.filter(F.size("rings") > 0).select(
        "tile_id", class_id.alias("class_id"), ids.class_name(class_id, names).alias("class_name"),
        F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"),
        F.coalesce(p["source_masks"], F.array().cast("array<string>")).alias("source_masks"),
        p["z_mean"].alias("z_mean"), F.coalesce(p["area"], F.lit(0.0)).alias("area"),
        F.coalesce(p["perimeter"], F.lit(0.0)).alias("perimeter"), "rings", "parts")


def _gathered(rows: DataFrame, parts: Sequence[str], files: int = 32) -> DataFrame:
    """Rows by partition folder, each folder's rows dealt over at most ``files`` tasks, so not every task opens every folder."""
    deal = F.pmod(F.xxhash64(*[c for c in ("tile_id", "class_id") if c in rows.columns] or [F.lit(0)]), F.lit(files))
    return rows.repartition(*parts, deal)


def write_layers(rows: DataFrame, path: str, class_names: Sequence[str] | None = None) -> None:
    """Features split into one layer per class; the whole folder is the layer of all classes.

    An unknown class goes to layer ``class_{id}``.
    """
    names = list(class_names or fixed.CLASS_NAMES[:fixed.NUM_CLASSES])
    _gathered(rows.withColumn("layer", ids.class_name(F.col("class_id"), names, "class_")), ["layer"]) \
        .write.mode("overwrite").partitionBy("layer").parquet(path)


def read_layer(spark: SparkSession, path: str, layer: str = "all_classes") -> DataFrame:
    """One layer (only its folder is read) or all of them."""
    rows = spark.read.parquet(path)
    return rows if layer == "all_classes" else rows.filter(F.col("layer") == layer)


def write_json_features(outputs: DataFrame, path: str) -> None:
    """Plain feature records as JSON lines, unparsed, and their number beside them."""
    p = F.col("p")
    rows = outputs.select(F.coalesce("tile_id", F.lit("unknown")).alias("tile_id"), F.explode("polygons").alias("p")) \
        .select("tile_id", p["geometry_wkt"].alias("geometry_wkt"),
                F.coalesce(p["class_id"], F.lit(fixed.DEFAULT_CLASS)).alias("class_id"),
                F.coalesce(p["confidence"], F.lit(0.0)).alias("confidence"))
    rows.write.mode("overwrite").json(f"{path}/features")
    rows.sparkSession.read.json(f"{path}/features", schema=rows.schema).agg(F.count(F.lit(1)).alias("count")) \
        .write.mode("overwrite").json(f"{path}/count")


def write_class_raster(polygons: DataFrame, path: str, block: int = 256, order: str = "ord") -> None:
    """Class raster of all polygons in blocks; a reader of one block opens one folder.

    Cells are gathered by block before the write, so a block is one file, not one per task. The raster's frame
    (bounds, size and transform) goes beside it; see :func:`read_raster_frame`.
    """
    export_raster(polygons, order).withColumn("crow", F.expr(f"row div {block}")) \
        .withColumn("ccol", F.expr(f"col div {block}")).repartition("crow", "ccol") \
        .write.mode("overwrite").partitionBy("crow", "ccol").parquet(path)
    export_raster_frame(polygons).write.mode("overwrite").parquet(f"{path.rstrip('/')}.frame")


def read_raster_frame(spark: SparkSession, path: str) -> DataFrame:
    """The one-row frame written beside a class raster."""
    return spark.read.parquet(f"{path.rstrip('/')}.frame")


def detection_rows(polygons: DataFrame, crs: str | None = None, default_crs: str = fixed.EXPORT_CRS) -> DataFrame:
    """Detected polygons as stored: degrees, defaults for class and confidence, no null geometries."""
    source = F.lit(crs) if crs else (F.col("crs") if "crs" in polygons.columns else F.lit(default_crs))
    return polygons.filter(F.col("rings").isNotNull()).select(
        "run_id", "tile_id", F.coalesce("class_id", F.lit(0)).alias("class_id"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "z_mean", "z_max",
        F.coalesce("area", F.lit(0.0)).alias("area_sqm"),
        geo.reproject(F.col("rings"), source, default_crs).alias("rings"))


def persist_detections(rows: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Write detections under their run, and under the micro-batch if given.

    Only the partitions present in ``rows`` are replaced, so writing a run or a
    micro-batch again leaves one copy.
    """
    parts = ["run_id"]
    if batch_id is not None:
        rows, parts = rows.withColumn("batch_id", F.lit(batch_id)), ["run_id", "batch_id"]
    _gathered(rows, parts).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def persist_detections_jdbc(rows: DataFrame, url: str, table: str, properties: dict[str, str]) -> None:
    """Append detections to a database table with WKT geometry."""
    rows.withColumn("geom", F.concat(F.lit("SRID=4326;"), geo.to_wkt(F.col("rings")))).drop("rings") \
        .write.jdbc(url, table, mode="append", properties=properties)


def write_qa_csv(rows: DataFrame, path: str) -> None:
    """QA table with its fixed columns and a header; other columns are left out."""
    rows.select(*QA_COLUMNS).write.mode("overwrite").option("header", True).csv(path)


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def merge_villages(spark: SparkSession, paths: Sequence[str], default_crs: str = fixed.EXPORT_CRS) -> DataFrame:
    """All layers of all villages in one scan, with village and layer names, in degrees.

    Folders that do not exist are skipped. Columns missing in a village are null.
    """
    present = [p for p in paths if _exists(spark, p)]
    if not present:
        raise FileNotFoundError("none of the village folders exists")
    rows = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(*present)
    place = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/layer=([^/]+)/[^/]*$", 1)
    layer = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/layer=([^/]+)/[^/]*$", 2)
    crs = F.col("crs") if "crs" in rows.columns else F.lit("EPSG:4326")
    return rows.withColumn("village_name", F.regexp_replace(place, r"(?<=.)\.[^.]*$", "")) \
        .withColumn("source_layer", F.url_decode(layer)) \
        .withColumn("rings", geo.reproject(F.col("rings"), crs, default_crs))
