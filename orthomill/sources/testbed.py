"""Domain tables derived from the benchmark parquet tables.

Each adapter is a projection of a whole table, so the derived data grows with
its source. Integer arithmetic keeps results identical across engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.functions import geometry as geo


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8x8 three-band images, one per embedding: ``source_id, label, row, col, b0, b1, b2``."""
    levels = F.transform("embedding", lambda v: F.floor((v.cast("double") + 1.0) * 128.0).cast("int"))
    banded = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("source_id"), "label", levels.alias("q"))
    cells = banded.select(
        "source_id", "label",
        F.posexplode(F.arrays_zip(
            F.col("q").alias("b0"),
            F.concat(F.slice("q", 2, 63), F.slice("q", 1, 1)).alias("b1"),
            F.concat(F.slice("q", 3, 62), F.slice("q", 1, 2)).alias("b2"))).alias("pos", "px"))
    return cells.select("source_id", "label", "pos", F.expr("pos div 8").cast("int").alias("row"),
                        (F.col("pos") % 8).alias("col"), "px.b0", "px.b1", "px.b2")


def mosaic_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images laid out 20 abreast in rasters of 1000 images (160 pixels wide)."""
    inner = F.col("source_id") % 1000
    return pixels(spark, sf_dir).select(
        F.expr("source_id div 1000").alias("source_id"),
        (F.floor(inner / 20) * 8 + F.col("row")).cast("int").alias("row"),
        ((inner % 20) * 8 + F.col("col")).cast("int").alias("col"), "b0", "b1", "b2")


def mosaic_rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size and transform of each mosaic."""
    sized = table(spark, sf_dir, "embeddings").groupBy(F.expr("vec_id div 1000").alias("source_id")) \
        .agg(F.max(F.col("vec_id") % 1000).alias("last"))
    return sized.select(
        "source_id", (F.expr("(last div 20 + 1) * 8")).cast("int").alias("height"), F.lit(160).alias("width"),
        F.array(*[F.lit(v) for v in (2.0, 0.0, 500000.0, 0.0, -2.0, 2000000.0)]).alias("transform"))


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raster headers from customers: source file, size and north-up transform."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("v"), key.cast("string")).alias("source_id"),
        (200 + (key * 13) % 900).cast("int").alias("height"), (200 + (key * 29) % 1100).cast("int").alias("width"),
        F.array(F.lit(0.5), F.lit(0.0), (500000 + (key % 100) * 1000).cast("double"), F.lit(0.0), F.lit(-0.5),
                (2000000 + (key % 77) * 1000).cast("double")).alias("transform"))


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted and target class per pixel of the 8x8 images."""
    pred = F.col("b0") % 6
    return pixels(spark, sf_dir).select(
        "source_id", "label", "row", "col", "b0", "b1", "b2", pred.alias("pred"),
        F.when(F.col("pos") % 3 == 0, F.col("label") % 6).otherwise(pred).alias("target"))


def tile_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles on a 40-wide grid with bounds, class and confidence, from parts."""
    key = F.col("p_partkey")
    col, row = key % 40, F.floor(key / 40)
    return table(spark, sf_dir, "part").select(
        F.format_string("grid_t%05d", key).alias("tile_id"), key.alias("tile_no"),
        F.struct((row * 512.0).alias("min_y"), (col * 512.0).alias("min_x"),
                 ((row + 1) * 512.0).alias("max_y"), ((col + 1) * 512.0).alias("max_x")).alias("bounds"),
        (F.col("p_size") % 6).cast("int").alias("class_id"), ((key % 100) / 100.0).alias("confidence"))


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected boxes ``tile_id, x1, y1, x2, y2, confidence, class_id``, from line items."""
    x1, y1 = F.col("l_partkey") % 480, (F.col("l_suppkey") * 37) % 480
    w, h = F.col("l_quantity").cast("int"), 5 + 7 * F.col("l_linenumber")
    flag = F.when(F.col("l_returnflag") == "A", 0).when(F.col("l_returnflag") == "N", 1).otherwise(2)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), x1.cast("double").alias("x1"), y1.cast("double").alias("y1"),
        (x1 + w).cast("double").alias("x2"), (y1 + h).cast("double").alias("y2"),
        (F.round(F.col("l_discount") * 100) / 10.0).alias("confidence"), flag.alias("class_id"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height samples ``tile_id, x, y, z`` from line items."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), (F.col("l_partkey") % 512).cast("double").alias("x"),
        (F.col("l_suppkey") % 512).cast("double").alias("y"), (F.col("l_quantity") / 4.0).alias("z"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion decisions per tile, from orders."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("tile_id"), ((F.col("o_custkey") % 100) / 100.0).alias("accept_val"),
        (key % 2 == 0).alias("refine_flag"), (key % 6).cast("int").alias("class_id"),
        ((key % 97) / 96.0).alias("confidence_val"))


LAYERS = ["Built_Up_Area_type", "Road", "Road_Centre_Line", "Water_Body", "Water_Body_Line", "Waterbody_Point",
          "Utility_Poly", "Utility", "Bridge", "Railway", "Contour", "Survey_Grid"]


def layer_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles in layers, one per customer, in a 520 x 520 pixel frame per 1000 customers."""
    key = F.col("c_custkey")
    x, y, side = (key * 13) % 500, (key * 29) % 500, 5 + key % 20
    names = F.array(*[F.lit(n) for n in LAYERS])
    return table(spark, sf_dir, "customer").select(
        F.expr("c_custkey div 1000").alias("source_id"), key.alias("feature_id"),
        F.get(names, (F.col("c_nationkey") % 12).cast("int")).alias("layer"),
        x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + side).cast("double").alias("x2"), (y + side).cast("double").alias("y2"))


def layer_polygons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rectangles of :func:`layer_shapes` as polygons."""
    return layer_shapes(spark, sf_dir).withColumn("rings", geo.box_rings(
        F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")))


def triangles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triangles, one per customer, for tests beyond axis-parallel shapes."""
    shapes = layer_shapes(spark, sf_dir)
    ring = F.array(geo.point(F.col("x1"), F.col("y1")), geo.point(F.col("x2"), F.col("y1") + 3.0),
                   geo.point(F.col("x1") + 2.0, F.col("y2")), geo.point(F.col("x1"), F.col("y1")))
    return shapes.withColumn("rings", F.array(ring))


def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run diagnostics, from events: run = day, tile = user, status from the event type."""
    return diagnostics_of(table(spark, sf_dir, "events"))


def diagnostics_of(events: DataFrame) -> DataFrame:
    """The projection behind :func:`diagnostics`, usable on a stream as well."""
    kind = F.col("event_type")
    status = F.when(kind.isin("view", "click"), "complete").when(kind == "purchase", "skipped") \
        .when(kind == "error", "failed").otherwise("error")
    return events.select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"),
        F.concat(F.lit("tile_"), F.col("user_id").cast("string")).alias("tile_id"), "ts",
        (F.col("event_id") % 3).cast("int").alias("attempt"), status.alias("status"),
        F.col("value").alias("elapsed_s"), "event_id")


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewer corrections, from labels."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("tile_id"), F.col("quality").alias("original_class"),
        F.col("toxic").alias("corrected_class"), F.lit(False).alias("processed"))


def image_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fusion decisions per 8x8 image."""
    key = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        key.alias("tile_id"), ((key * 7 % 100) / 100.0).alias("accept_val"), (key % 2 == 0).alias("refine_flag"),
        (F.col("label") % 6).cast("int").alias("class_id"), ((key % 97) / 96.0).alias("confidence_val"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores per pixel of the 8x8 images."""
    scores = [((F.col("b0") * (7 * k + 3) + F.col("b1") * k) % 23) / 10.0 for k in range(6)]
    return pixels(spark, sf_dir).select(
        F.col("source_id").alias("tile_id"), "row", "col", "b0", "b1", "b2", F.array(*scores).alias("logits"))
