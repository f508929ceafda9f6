"""Queries on files, documents, exports and names. Written tables go to the shared folder and are read back."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.functions import ids
from orthomill.plans.base_sql import DIAG, LAYER, NAMES, PX
from orthomill.plans.registry import query, with_ctes
from orthomill.session import scratch_path
from orthomill.sources import files, layers, sinks
from orthomill.sources import testbed as tb

FILES = """
fl AS (SELECT o_orderkey, 'data/raw/' || o_orderstatus || '/Village ' || (o_orderkey % 40) || ' ' || o_orderkey ||
              ['.tif', '.TIFF', '.png', '.npy', ''][o_orderkey % 5 + 1] AS path, o_orderdate AS mtime FROM orders)
"""


def file_listing(spark, sf):
    """A listing of files: path, modification time, length."""
    key = F.col("o_orderkey")
    ends = F.array(*[F.lit(e) for e in (".tif", ".TIFF", ".png", ".npy", "")])
    return tb.table(spark, sf, "orders").select(
        key.alias("o_orderkey"), F.concat(F.lit("data/raw/"), "o_orderstatus", F.lit("/Village "), key % 40, F.lit(" "), key,
                                          F.get(ends, (key % 5).cast("int"))).alias("path"),
        F.col("o_orderdate").alias("modificationTime"), key.alias("length"))


@query("a1_inputs_by_extension", with_ctes(FILES, select="""
SELECT path FROM fl WHERE lower(path) LIKE '%.tif' OR lower(path) LIKE '%.tiff'"""))
def a1(spark, sf):
    return files.filter_inputs(file_listing(spark, sf), [".tif", ".tiff"]).select("path")


@query("a2_latest_artifacts", with_ctes(FILES, """
r AS (SELECT o_orderkey % 7 AS kind, path, row_number() OVER (PARTITION BY o_orderkey % 7 ORDER BY mtime DESC, path DESC) AS k FROM fl)""",
       select="""
SELECT kind, path, regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', '') AS version FROM r WHERE k = 1"""))
def a2(spark, sf):
    return files.latest_artifacts(file_listing(spark, sf).withColumn("kind", F.col("o_orderkey") % 7))


@query("a3_named_like", with_ctes(FILES, select="""
SELECT path FROM fl WHERE contains(lower(regexp_extract(path, '[^/]*$')), 'village 12')"""))
def a3(spark, sf):
    return files.named_like(file_listing(spark, sf), "VILLAGE 12").select("path")


def tile_documents(spark, sf):
    """Tile output documents of 50 shapes each: polygons, some with two parts or with heights, missing and broken geometries."""
    rings = geo.to_wkt(F.col("rings"))
    key = F.col("feature_id")
    body = F.substring(rings, F.lit(len("POLYGON ") + 1), F.length(rings))
    two_parts = F.concat(F.lit("MULTIPOLYGON ("), body, F.lit(", ((900 900, 901 900, 901 901, 900 900)))"))
    with_heights = F.concat(F.lit("POLYGON Z "), F.regexp_replace(body, "([0-9])(?=[,)])", "$1 12.5"))
    text = F.when(key % 10 == 3, F.lit(None)).when(key % 10 == 7, F.lit("POLYGON ((0 0, 1")).when(key % 10 == 1, two_parts) \
        .when(key % 10 == 2, with_heights).otherwise(rings)
    known = F.when(key % 8 != 5, (key % 7).cast("int"))
    item = F.struct(known.alias("class_id"), text.alias("geometry_wkt"),
                    F.when(key % 6 != 0, (key % 100) / 100.0).alias("confidence"),
                    F.array(F.lit("swin")).alias("source_masks"), F.lit(None).cast("double").alias("z_mean"),
                    geo.polygon_area(F.col("rings")).alias("area"), geo.polygon_length(F.col("rings")).alias("perimeter"))
    return tb.layer_polygons(spark, sf).withColumn("tile_id", F.concat(F.lit("tile"), F.expr("feature_id div 50"))) \
        .groupBy("tile_id").agg(F.collect_list(item).alias("polygons")) \
        .withColumn("num_polygons", F.size("polygons"))


@query("a4_tile_outputs", with_ctes(LAYER, select="""
SELECT 'tile' || (feature_id // 50) AS tile_id, count(*) AS polygons, count(*) FILTER (feature_id % 10 <> 3) AS with_geometry, false AS broken FROM lay GROUP BY 1
UNION ALL SELECT NULL, n_nationkey, 0, true FROM nation"""))
def a4(spark, sf):
    docs = tile_documents(spark, sf).select(
        F.concat(F.lit("out/tiles/"), "tile_id", F.lit("_output.json")).alias("path"),
        F.to_json(F.struct("tile_id", "polygons", "num_polygons")).alias("value"))
    nations = tb.table(spark, sf, "nation")
    broken = nations.select(
        F.concat(F.lit("out/tiles/"), "n_nationkey", F.lit("_output.json")).alias("path"), F.lit('{"tile_id": "x", ').alias("value"))
    other = nations.select(F.concat(F.lit("out/"), "n_name", F.lit(".json")).alias("path"), F.lit("{}").alias("value"))
    good, bad = files.parse_tile_outputs(docs.unionByName(broken).unionByName(other))
    counted = good.select(
        "tile_id", F.size("polygons").cast("long").alias("polygons"),
        F.size(F.filter("polygons", lambda p: p["geometry_wkt"].isNotNull())).cast("long").alias("with_geometry"),
        F.lit(False).alias("broken"))
    named = bad.select(F.lit(None).cast("string").alias("tile_id"), F.lit(0).cast("long").alias("with_geometry"),
                       F.regexp_extract("path", r"(\d+)_output", 1).cast("long").alias("polygons"), F.lit(True).alias("broken"))
    return counted.unionByName(named)


@query("a5_json_lines", with_ctes(LAYER, select="SELECT feature_id, layer, x1 * 1e0 AS x1 FROM lay"))
def a5(spark, sf):
    path = scratch_path(spark, "records")
    rows = tb.layer_shapes(spark, sf).select("feature_id", "layer", "x1")
    files.append_records(rows.filter("feature_id % 2 = 0"), path)
    files.append_records(rows.filter("feature_id % 2 = 1"), path)
    return files.load_records(spark, path, "feature_id long, layer string, x1 double")


@query("a6_split_metadata", """
SELECT CASE WHEN o_orderkey % 50 <> 0 THEN 'R' || o_orderkey END AS tile_id, o_orderkey * 1e0 AS min_y, o_orderkey % 7 + 0.5e0 AS min_x
FROM orders WHERE o_orderkey % 50 <> 0""")
def a6(spark, sf):
    key = F.col("o_orderkey")
    box = F.array(F.array(key.cast("double"), key % 7 + 0.5), F.array(key + 1.0, key % 7 + 1.5))
    entry = F.struct(F.when(key % 50 != 0, F.concat(F.lit("R"), key)).alias("tile_id"), F.lit("region_01").alias("region"),
                     F.when(key % 2 == 0, box).alias("bbox"), F.when(key % 2 == 1, box).alias("bounds"))
    docs = tb.table(spark, sf, "orders").groupBy(F.expr("o_orderkey div 50").alias("doc")).agg(
        F.to_json(F.collect_list(entry)).alias("json"))
    tiles = files.split_metadata(docs)
    first = F.get("bounds", F.lit(0))
    return tiles.select("tile_id", F.get(first, 0).alias("min_y"), F.get(first, 1).alias("min_x"))


@F.pandas_udf(BinaryType())
def _npy(values: pd.Series, key: pd.Series) -> pd.Series:
    out = []
    for v, k in zip(values, key):
        buffer = io.BytesIO()
        np.save(buffer, np.asarray(v, dtype=np.uint8).reshape(8, 8, 3))
        out.append(b"broken" if k % 50 == 0 else buffer.getvalue())
    return pd.Series(out)


@query("a7_array_tiles", with_ctes(PX, select="""
SELECT source_id AS tile_id, CASE WHEN source_id % 50 = 0 THEN NULL ELSE sum(b0 + b1 * 2 + b2 * 3 + r * c)::BIGINT END AS checksum, source_id % 50 = 0 AS failed
FROM px GROUP BY 1"""))
def a7(spark, sf):
    px = tb.pixels(spark, sf)
    bands = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "b0", "b1", "b2"))),
                                  lambda p: F.array(p["b0"], p["b1"], p["b2"])))
    stored = px.withColumn("pos", F.col("row") * 8 + F.col("col")).groupBy("source_id").agg(bands.alias("v"))
    content = stored.select(F.concat(F.lit("tiles/512/tile_"), "source_id", F.lit(".npy")).alias("path"),
                            _npy("v", "source_id").alias("content"))
    value = F.col("b0") + F.col("b1") * 2 + F.col("b2") * 3 + F.col("row") * F.col("col")
    return files.decode_arrays(content).groupBy(F.col("tile_id").cast("long").alias("tile_id")).agg(
        F.sum(value).alias("checksum"), F.bool_or(F.col("load_error").isNotNull()).alias("failed"))


@query("a8_layer_classes", with_ctes(LAYER, select="SELECT feature_id, layer, class_id FROM cls"))
def a8(spark, sf):
    return layers.classify_layers(tb.layer_shapes(spark, sf)).select("feature_id", "layer", "class_id")


FEATURES = LAYER.strip() + ",\n" + NAMES.strip() + """,
ft AS (SELECT feature_id, 'tile' || (feature_id // 50) AS tile_id, CASE WHEN feature_id % 10 = 1 THEN 2 ELSE 1 END AS parts, CASE WHEN feature_id % 8 <> 5 THEN feature_id % 7 ELSE 1 END AS class_id,
              CASE WHEN feature_id % 6 <> 0 THEN (feature_id % 100) / 100e0 ELSE 0 END AS confidence, ((x2 - x1) * (y2 - y1)) * 1e0 AS area
       FROM lay WHERE feature_id % 10 NOT IN (3, 7)),
fn AS (SELECT ft.*, coalesce(class_name, CAST(class_id AS VARCHAR)) AS class_name FROM ft LEFT JOIN cname USING (class_id))
"""


@query("a9_features", with_ctes(FEATURES, select="""
SELECT tile_id, class_id, class_name, confidence, area, parts FROM fn"""))
def a9(spark, sf):
    return sinks.features(tile_documents(spark, sf)).select("tile_id", "class_id", "class_name", "confidence", "area", F.size("parts").alias("parts"))


@query("a10_class_layers", with_ctes(FEATURES, select="""
SELECT CASE WHEN class_id > 5 THEN 'class_' || class_id ELSE class_name END AS layer, count(*) AS features, sum(area) AS area FROM fn GROUP BY 1
UNION ALL SELECT 'all_classes', count(*), sum(area) FROM fn"""))
def a10(spark, sf):
    path = scratch_path(spark, "layers")
    sinks.write_layers(sinks.features(tile_documents(spark, sf)), path)
    every = sinks.read_layer(spark, path)
    measures = [F.count(F.lit(1)).alias("features"), F.sum("area").alias("area")]
    return every.groupBy("layer").agg(*measures).unionByName(
        every.agg(*measures).select(F.lit("all_classes").alias("layer"), "features", "area"))


@query("a11_json_features", with_ctes(LAYER, select="""
SELECT CASE WHEN feature_id % 8 <> 5 THEN feature_id % 7 ELSE 1 END AS class_id, count(*) AS features, (SELECT count(*) FROM lay) AS total FROM lay GROUP BY 1"""))
def a11(spark, sf):
    path = scratch_path(spark, "json-features")
    sinks.write_json_features(tile_documents(spark, sf), path)
    rows = spark.read.json(f"{path}/features", schema="tile_id string, geometry_wkt string, class_id int, confidence double")
    total = spark.read.json(f"{path}/count", schema="count long").first()["count"]
    return rows.groupBy("class_id").agg(F.count(F.lit(1)).alias("features")).withColumn("total", F.lit(total))


@query("a12_class_raster_blocks", with_ctes(LAYER, """
f AS (SELECT min(x1) AS mx, min(y1) AS my, max(x2) AS xx, max(y2) AS xy FROM lay),
g AS (SELECT (xx - mx) / 1000e0 AS ex, (xy - my) / 1000e0 AS ey, mx, my, xx, xy FROM f),
h AS (SELECT *, least(greatest(CAST(floor(ex * 100) AS BIGINT), 256), 4096) AS w, least(greatest(CAST(floor(ey * 100) AS BIGINT), 256), 4096) AS ht FROM g),
p AS (SELECT feature_id, feature_id % 5 + 1 AS cls, (x1 - mx) / 1000e0 * (w / ex) AS px1, (x2 - mx) / 1000e0 * (w / ex) AS px2,
             (xy - y2) / 1000e0 * (ht / ey) AS py1, (xy - y1) / 1000e0 * (ht / ey) AS py2 FROM lay, h),
rr AS (SELECT feature_id, cls, px1, px2, unnest(range(CAST(ceil(py1 - 0.5e0) AS BIGINT), CAST(ceil(py2 - 0.5e0) AS BIGINT))) AS r FROM p),
cc AS (SELECT feature_id, cls, r, unnest(range(CAST(ceil(px1 - 0.5e0) AS BIGINT), CAST(ceil(px2 - 0.5e0) AS BIGINT))) AS c FROM rr),
b AS (SELECT r, c, max_by(cls, feature_id) AS cls FROM cc GROUP BY ALL)""", select="""
SELECT r // 64 AS crow, c // 64 AS ccol, cls AS class_id, count(*) AS cells FROM b GROUP BY ALL"""))
def a12_blocks(spark, sf):
    path = scratch_path(spark, "class-raster")
    scaled = F.transform("rings", lambda ring: F.transform(ring, lambda p: geo.point(p["x"] / 1000.0, p["y"] / 1000.0)))
    sinks.write_class_raster(tb.layer_polygons(spark, sf).select(
        F.col("feature_id").alias("ord"), (F.col("feature_id") % 5 + 1).alias("class_id"), scaled.alias("rings")), path, 64)
    return spark.read.parquet(path).groupBy("crow", "ccol", "class_id").agg(F.count(F.lit(1)).alias("cells"))


def stored_polygons(spark, sf):
    """Detected polygons of ten runs; some without geometry, class or confidence."""
    key = F.col("feature_id")
    return tb.layer_polygons(spark, sf).select(
        F.concat(F.lit("run"), key % 10).alias("run_id"), F.concat(F.lit("tile"), F.expr("feature_id div 50")).alias("tile_id"),
        F.when(key % 8 != 5, (key % 6).cast("int")).alias("class_id"), F.when(key % 6 != 0, F.lit(0.5)).alias("confidence"),
        F.lit(None).cast("double").alias("z_mean"), F.lit(1.5).alias("z_max"), F.lit(4.0).alias("area"),
        F.when(key % 9 != 4, F.col("rings")).alias("rings"), F.lit("EPSG:4326").alias("crs"))


@query("a13_persisted_detections", with_ctes(LAYER, select="""
SELECT 'run' || (feature_id % 10) AS run_id, CASE WHEN feature_id % 8 <> 5 THEN feature_id % 6 ELSE 0 END AS class_id, count(*) AS polygons,
       sum(CASE WHEN feature_id % 6 <> 0 THEN 0.5e0 ELSE 0 END) AS confidence FROM lay WHERE feature_id % 9 <> 4 GROUP BY ALL"""))
def a13(spark, sf):
    path = scratch_path(spark, "detections")
    rows = sinks.detection_rows(stored_polygons(spark, sf))
    sinks.persist_detections(rows, path)
    sinks.persist_detections(rows.filter("run_id = 'run3'"), path)  # a repeated run leaves one copy
    return spark.read.parquet(path).groupBy("run_id", "class_id").agg(
        F.count(F.lit(1)).alias("polygons"), F.sum("confidence").alias("confidence"))


@query("a14_qa_table", """
SELECT 't' || o_orderkey AS tile_id, (o_orderkey % 11) / 10e0 AS precision, (o_orderkey % 7) / 8e0 AS recall, o_custkey % 9 AS num_bboxes FROM orders""")
def a14(spark, sf):
    path = scratch_path(spark, "qa")
    key = F.col("o_orderkey")
    rows = tb.table(spark, sf, "orders").select(
        F.concat(F.lit("t"), key).alias("tile_id"), (key % 11 / 10.0).alias("precision"), (key % 7 / 8.0).alias("recall"),
        F.lit(0.5).alias("f1"), F.lit(0.5).alias("mIoU"), (F.col("o_custkey") % 9).alias("num_bboxes"),
        F.lit(0.5).alias("avg_confidence"), F.lit("left out").alias("note"))
    sinks.write_qa_csv(rows, path)
    return spark.read.option("header", True).schema(
        "tile_id string, precision double, recall double, f1 double, mIoU double, num_bboxes long, avg_confidence double") \
        .csv(path).select("tile_id", "precision", "recall", "num_bboxes")


@query("a15_merged_villages", with_ctes(FEATURES, select="""
SELECT CASE WHEN feature_id // 50 % 2 = 0 THEN 'north' ELSE 'south' END AS village_name, CASE WHEN class_id > 5 THEN 'class_' || class_id ELSE class_name END AS source_layer,
       count(*) AS features, count(*) FILTER (feature_id // 50 % 2 = 0) AS with_note
FROM fn GROUP BY ALL"""))
def a15(spark, sf):
    root = scratch_path(spark, "villages")
    rows = sinks.features(tile_documents(spark, sf))
    even = F.regexp_extract("tile_id", r"(\d+)$", 1).cast("long") % 2 == 0
    sinks.write_layers(rows.filter(even).withColumn("note", F.lit("n")), f"{root}/north.gpkg")
    sinks.write_layers(rows.filter(~even), f"{root}/south.gpkg")
    merged = sinks.merge_villages(spark, [f"{root}/north.gpkg", f"{root}/absent.gpkg", f"{root}/south.gpkg"])
    return merged.groupBy("village_name", "source_layer").agg(
        F.count(F.lit(1)).alias("features"), F.count("note").alias("with_note"))


@query("h1_names_from_paths", with_ctes(FILES, select="""
SELECT path, replace(replace(regexp_replace(regexp_extract(path, '[^/]*$'), '\\.[^.]*$', ''), ' ', '_'), '__', '_') AS source,
       'n' || o_orderkey AS tile_id FROM fl"""))
def h1(spark, sf):
    tile = F.concat(F.lit("tiles/tile_n"), F.col("o_orderkey"), F.lit(".png"))
    return file_listing(spark, sf).select("path", ids.source_name(F.col("path")).alias("source"),
                                          ids.tile_id_of(tile).alias("tile_id"))


@query("h3_class_names", with_ctes(NAMES, select="""
SELECT p_partkey, coalesce(class_name, CAST(p_size % 9 AS VARCHAR)) AS class_name, CASE WHEN p_partkey % 4 = 0 THEN 0e0 ELSE p_retailprice END AS price
FROM part LEFT JOIN cname ON class_id = p_size % 9"""))
def h3(spark, sf):
    price = F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice"))
    return tb.table(spark, sf, "part").select(
        "p_partkey", ids.class_name(F.col("p_size") % 9, fixed.CLASS_NAMES[:6]).alias("class_name"),
        ids.or_zero(price).alias("price"))


@query("h4_json_roundtrip", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 5 AS n FROM events""")
def h4(spark, sf):
    record = F.struct(F.from_json("props", "k long").alias("props"), (F.col("event_id") % 5).alias("n"))
    back = F.from_json(F.to_json(record), "props struct<k:long>, n long")
    return tb.table(spark, sf, "events").select("event_id", back.alias("r")).select("event_id", "r.props.k", "r.n")


@query("h5_elapsed_and_ids", with_ctes(DIAG, select="""
SELECT run_id, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds, count(DISTINCT event_id) AS distinct_ids FROM diag GROUP BY 1"""))
def h5(spark, sf):
    # Run ids are random, so only their number can be compared.
    d = tb.diagnostics(spark, sf).withColumn("uid", ids.new_run_id())
    return d.groupBy("run_id").agg(
        F.min("ts").alias("a"), F.max("ts").alias("b"), F.countDistinct("uid").alias("distinct_ids")).select(
        "run_id", F.round(ids.seconds_between(F.col("a"), F.col("b")), 6).alias("seconds"), "distinct_ids")
