"""Queries on detections, fusion, correction rules, tile assembly and regions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from orthomill.functions import ids
from orthomill.operators import assembly, detections, fusion, regions, rules
from orthomill.plans.base_sql import DEC, DETS, GRID, IDEC, LOGITS, MASKS, PTS
from orthomill.plans.registry import query, with_ctes
from orthomill.sources import testbed as tb

IOU_SQL = """(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))
  / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
     - greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"""

SUPPRESS = DETS.strip() + f""",
/*recursive*/
bx AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY confidence DESC, x1, y1, x2, y2) AS k
       FROM (SELECT tile_id, x1 % 60 AS x1, y1 % 60 AS y1, x1 % 60 + (x2 - x1) AS x2, y1 % 60 + (y2 - y1) AS y2,
                    max(confidence) AS confidence FROM det WHERE confidence >= 0.25e0 GROUP BY ALL)),
bad AS (SELECT a.tile_id, a.k AS ka, b.k AS kb FROM bx a JOIN bx b ON a.tile_id = b.tile_id AND a.k < b.k
        WHERE {IOU_SQL} > 0.2e0),
st AS (
  SELECT tile_id, 0::BIGINT AS k, []::BIGINT[] AS kept, max(k) AS n FROM bx GROUP BY 1
  UNION ALL
  SELECT st.tile_id, st.k + 1,
         CASE WHEN EXISTS (SELECT 1 FROM bad WHERE bad.tile_id = st.tile_id AND bad.kb = st.k + 1 AND list_contains(st.kept, bad.ka))
              THEN kept ELSE list_append(kept, st.k + 1) END, n
  FROM st WHERE st.k < n),
fin AS (SELECT tile_id, unnest(kept) AS k FROM st WHERE k = n)
"""


def crowded(spark, sf):
    """Detections moved into a 60-pixel corner so that many overlap; one class per tile."""
    d = tb.detections(spark, sf)
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    x, y = F.col("x1") % 60, F.col("y1") % 60
    return d.select("tile_id", x.alias("x1"), y.alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"), "confidence",
                    F.lit(0).alias("class_id"))


@query("d1_suppressed_boxes", with_ctes(SUPPRESS, select="""
SELECT tile_id, x1, y1, x2, y2, confidence FROM fin JOIN bx USING (tile_id, k)"""))
def d1(spark, sf):
    return detections.suppress(crowded(spark, sf), 0.25, 0.2).select("tile_id", "x1", "y1", "x2", "y2", "confidence")


@query("d2_detection_summary", with_ctes(DETS, select="""
SELECT tile_id, count(*) AS count, max(confidence) AS max_confidence, round(avg(confidence), 6) AS avg_confidence
FROM det GROUP BY 1"""))
def d2(spark, sf):
    return detections.summary(tb.detections(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


TOP = DETS.strip() + """,
rk AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY confidence DESC, x1, y1, x2, y2, class_id) AS rank FROM det)
"""


@query("d3_detection_features", with_ctes(TOP, """
v AS (SELECT tile_id, sum((6 * rank - 5) * x1 + (6 * rank - 4) * y1 + (6 * rank - 3) * (x2 - x1) + (6 * rank - 2) * (y2 - y1)
             + (6 * rank - 1) * CAST(CAST(confidence AS FLOAT) AS DOUBLE) + 6 * rank * class_id) AS s FROM rk WHERE rank <= 3 GROUP BY 1),
t AS (SELECT tile_id, count(*) AS n, max(confidence) AS m, avg(confidence) AS a FROM det GROUP BY 1)""", select="""
SELECT o_orderkey AS tile_id, 21 AS dims,
       round(coalesce(s, 0) + 19 * coalesce(n, 0) + 20 * CAST(CAST(coalesce(m, 0) AS FLOAT) AS DOUBLE) + 21 * CAST(CAST(coalesce(a, 0) AS FLOAT) AS DOUBLE), 2) AS weighted
FROM orders LEFT JOIN v ON v.tile_id = o_orderkey LEFT JOIN t ON t.tile_id = o_orderkey"""))
def d3(spark, sf):
    spine = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    vectors = detections.feature_vectors(spine, tb.detections(spark, sf), 3)
    weighted = F.aggregate(
        F.transform("det_features", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return vectors.select("tile_id", F.size("det_features").cast("long").alias("dims"),
                          F.round(weighted, 2).alias("weighted"))


@query("d4_pixel_classes", with_ctes(LOGITS, select="""
SELECT tile_id, r AS "row", c AS col, class_id, round(1 / es, 6) AS max_prob FROM sm"""))
def d4(spark, sf):
    return fusion.classify_pixels(tb.logits(spark, sf)).select(
        "tile_id", "row", "col", "class_id", F.round("max_prob", 6).alias("max_prob"))


@query("d5_mask_stats", with_ctes(LOGITS, select="""
SELECT tile_id, round(avg(1 / es), 6) AS confidence, CAST(count(*) FILTER (class_id = 1) AS DOUBLE) AS mask_area,
       0e0 AS mask_perimeter, round(avg(ez[2] / es), 6) AS building_prob, 1e0 AS num_components FROM sm GROUP BY 1"""))
def d5(spark, sf):
    stats = fusion.segmentation_stats(fusion.classify_pixels(tb.logits(spark, sf)))
    return stats.withColumn("confidence", F.round("confidence", 6)).withColumn(
        "building_prob", F.round("building_prob", 6))


VECTORS = """
vec AS (SELECT vec_id AS tile_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(range(768), lambda i: 0e0)
               ELSE list_transform(range(768), lambda i: CAST(embedding[i % 64 + 1] AS DOUBLE)) END AS seg,
               list_transform(range(63), lambda i: CAST((vec_id * 3 + i) % 5 AS DOUBLE)) AS dets FROM embeddings),
f AS (SELECT tile_id, seg || dets || [0e0, 0e0, 0e0] || [CAST(tile_id % 64 AS DOUBLE), 0e0, 0.5e0, 1e0] AS x FROM vec)
"""


def fusion_inputs(spark, sf):
    """Feature parts per tile; every seventh tile has a segmentation part of the wrong length, depth is missing."""
    key = F.col("vec_id")
    whole = F.flatten(F.array_repeat(F.col("embedding"), 12))
    return tb.table(spark, sf, "embeddings").select(
        key.alias("tile_id"), F.when(key % 7 == 0, F.col("embedding")).otherwise(whole).alias("seg_features"),
        F.transform(F.sequence(F.lit(0), F.lit(62)), lambda i: ((key * 3 + i) % 5).cast("float")).alias("det_features"),
        F.lit(None).cast("array<float>").alias("depth_features"),
        F.array((key % 64).cast("float"), F.lit(0).cast("float"), F.lit(0.5).cast("float"), F.lit(1).cast("float"))
        .alias("mask_stats"))


@query("d6_fusion_vector", with_ctes(VECTORS, select="""
SELECT tile_id, len(x) AS dims, round(list_sum(list_transform(x, lambda v, i: v * i)), 4) AS weighted FROM f"""))
def d6(spark, sf):
    weighted = F.aggregate(F.transform("features", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0),
                           lambda acc, v: acc + v)
    return fusion.assemble(fusion_inputs(spark, sf)).select(
        "tile_id", F.size("features").cast("long").alias("dims"), F.round(weighted, 4).alias("weighted"))


def demo_weights(dims: int = 838, hidden: tuple[int, ...] = (4, 3), classes: int = 6) -> dict[str, np.ndarray]:
    """Weights of a small fusion network from a formula, so that SQL can state the same network."""
    def matrix(n: int, m: int, seed: int) -> np.ndarray:
        i, j = np.meshgrid(np.arange(n), np.arange(m), indexing="ij")
        return np.sin(seed + 7.0 * i + 3.0 * j) / math.sqrt(n)

    weights, width = {}, dims
    for layer, size in enumerate(hidden):
        weights[f"w{layer}"], weights[f"b{layer}"] = matrix(width, size, layer + 1), np.full(size, 0.1)
        width = size
    for head, size, seed in (("accept", 1, 11), ("refine", 1, 12), ("class", classes, 13), ("confidence", 1, 14)):
        weights[f"{head}_w"], weights[f"{head}_b"] = matrix(width, size, seed), np.zeros(size)
    return weights


@query("d7_fusion_score", with_ctes(VECTORS, """
u AS (SELECT tile_id, unnest(x) AS v, unnest(range(838)) AS i FROM f),
h0 AS (SELECT tile_id, j, greatest(sum(v * sin(1e0 + 7e0 * i + 3e0 * j) / sqrt(838e0)) + 0.1e0, 0) AS v
       FROM u, range(4) t(j) GROUP BY ALL),
h1 AS (SELECT tile_id, k AS j, greatest(sum(v * sin(2e0 + 7e0 * j + 3e0 * k) / sqrt(4e0)) + 0.1e0, 0) AS v
       FROM h0, range(3) t(k) GROUP BY tile_id, k),
o AS (SELECT tile_id, sum(v * sin(11e0 + 7e0 * j) / sqrt(3e0)) AS a, sum(v * sin(12e0 + 7e0 * j) / sqrt(3e0)) AS rf,
             sum(v * sin(14e0 + 7e0 * j) / sqrt(3e0)) AS cf FROM h1 GROUP BY 1),
cl AS (SELECT tile_id, k, sum(v * sin(13e0 + 7e0 * j + 3e0 * k) / sqrt(3e0)) AS s FROM h1, range(6) t(k) GROUP BY ALL),
best AS (SELECT tile_id, arg_max(k, s) AS class_id FROM cl GROUP BY 1)""", select="""
SELECT tile_id, round(1 / (1 + exp(-a)), 5) AS accept_val, 1 / (1 + exp(-rf)) > 0.5e0 AS refine_flag, class_id,
       round(1 / (1 + exp(-cf)), 5) AS confidence_val FROM o JOIN best USING (tile_id)"""))
def d7(spark, sf):
    scored = fusion.score(fusion.assemble(fusion_inputs(spark, sf)), demo_weights())
    return scored.select("tile_id", F.round("accept_val", 5).alias("accept_val"), "refine_flag", "class_id",
                         F.round("confidence_val", 5).alias("confidence_val"))


@query("d8_default_decision", with_ctes(IDEC, select="""
SELECT o.o_orderkey AS tile_id, coalesce(accept_val, 0.5e0) AS accept_val, coalesce(refine_flag, true) AS refine_flag,
       coalesce(class_id, 1) AS class_id, round(coalesce(confidence_val, 0.5e0), 6) AS confidence_val
FROM orders o LEFT JOIN idec d ON d.tile_id = o.o_orderkey"""))
def d8(spark, sf):
    spine = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    return fusion.with_default_decision(spine, tb.image_decisions(spark, sf)).withColumn("confidence_val", F.round("confidence_val", 6))


OVER = DEC.strip() + ",\n" + DETS.strip() + """,
ds AS (SELECT tile_id, count(*) AS n, max(confidence) AS m FROM det WHERE confidence >= 0.25e0 GROUP BY 1),
ov AS (SELECT dec.tile_id, CASE WHEN n > 0 THEN 1 ELSE class_id END AS class_id,
              CASE WHEN n > 0 THEN 1e0 ELSE accept_val END AS accept_val,
              CASE WHEN n > 0 THEN greatest(confidence_val, m) ELSE confidence_val END AS confidence_val
       FROM dec LEFT JOIN ds USING (tile_id))
"""


@query("d9_detector_override", with_ctes(OVER, select="""
SELECT tile_id, class_id, accept_val, round(confidence_val, 6) AS confidence_val FROM ov"""))
def d9(spark, sf):
    boxes = detections.summary(tb.detections(spark, sf).filter("confidence >= 0.25"))
    return rules.detector_override(tb.decisions(spark, sf), boxes).select(
        "tile_id", "class_id", "accept_val", F.round("confidence_val", 6).alias("confidence_val"))


@query("d10_burned_boxes", with_ctes(MASKS, """
bx AS (SELECT l_orderkey AS source_id, l_partkey % 40 - 2 AS x1, l_suppkey % 40 - 2 AS y1,
              l_partkey % 40 - 2 + l_linenumber % 3 AS x2, l_suppkey % 40 - 2 + CAST(l_quantity AS BIGINT) % 4 AS y2 FROM lineitem),
hit AS (SELECT DISTINCT m.source_id, r, c FROM msk m JOIN bx USING (source_id)
        WHERE c BETWEEN greatest(x1, 0) AND least(greatest(x2, 0), 8) AND r BETWEEN greatest(y1, 0) AND least(greatest(y2, 0), 8))""", select="""
SELECT source_id AS tile_id, CASE WHEN hit.r IS NULL THEN pred ELSE 1 END AS class_id, count(*) AS pixels
FROM msk LEFT JOIN hit USING (source_id, r, c) GROUP BY ALL"""))
def d10(spark, sf):
    x, y = F.col("l_partkey") % 40 - 2, F.col("l_suppkey") % 40 - 2
    boxes = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), x.alias("x1"), y.alias("y1"),
        (x + F.col("l_linenumber") % 3).alias("x2"), (y + F.col("l_quantity").cast("long") % 4).alias("y2"))
    mask = tb.masks(spark, sf).select(F.col("source_id").alias("tile_id"), "row", "col", F.col("pred").alias("class_id"))
    return rules.burn_boxes(mask, boxes, 8, 8).groupBy("tile_id", "class_id").agg(F.count(F.lit(1)).alias("pixels"))


ZONAL = MASKS.strip() + ",\n" + IDEC.strip() + """,
zn AS (SELECT tile_id, count(*) AS n, avg(b0) AS mr, avg(b1) AS mg, avg(b2) AS mb,
              sum(CAST(floor(0.299e0 * b0 + 0.587e0 * b1 + 0.114e0 * b2 + 0.5e0) AS BIGINT)) AS s,
              sum(CAST(floor(0.299e0 * b0 + 0.587e0 * b1 + 0.114e0 * b2 + 0.5e0) AS BIGINT) ** 2) AS q
       FROM idec JOIN msk ON source_id = tile_id AND target = class_id WHERE class_id IN (3, 4) GROUP BY 1 HAVING count(*) > 8),
zs AS (SELECT *, (n * q - s * s) / (1e0 * n * n) AS tx FROM zn)
"""


def image_zones(spark, sf):
    """Image pixels with their mask class."""
    return tb.masks(spark, sf).select(
        F.col("source_id").alias("tile_id"), "b0", "b1", "b2", F.col("target").alias("mask_class"))


@query("d11_zonal_stats", with_ctes(ZONAL, select="""
SELECT tile_id, n AS mask_pixels, round(mr, 6) AS mean_r, round(mg, 6) AS mean_g, round(mb, 6) AS mean_b,
       round(tx, 6) AS texture FROM zs"""))
def d11(spark, sf):
    stats = rules.zonal_stats(tb.image_decisions(spark, sf), image_zones(spark, sf), min_pixels=8)
    return stats.select("tile_id", "mask_pixels", *[F.round(c, 6).alias(c)
                                                    for c in ("mean_r", "mean_g", "mean_b", "texture")])


@query("d12_spectral_rules", with_ctes(ZONAL, select="""
SELECT idec.tile_id, CASE WHEN class_id = 4 AND (mg > mb * 1.05e0 OR tx > 400) THEN 3
       WHEN class_id = 3 AND mb > mg * 1.1e0 AND tx < 150 THEN 4 ELSE class_id END AS class_id
FROM idec LEFT JOIN zs USING (tile_id)"""))
def d12(spark, sf):
    decisions = tb.image_decisions(spark, sf)
    stats = rules.zonal_stats(decisions, image_zones(spark, sf), min_pixels=8)
    return rules.spectral_rules(decisions, stats).select("tile_id", "class_id")


@query("d13_low_confidence", with_ctes(DEC, select="""
SELECT tile_id, CASE WHEN confidence_val < 0.6e0 AND class_id <> 0 THEN 5 ELSE class_id END AS class_id FROM dec"""))
def d13(spark, sf):
    return rules.low_confidence_rule(tb.decisions(spark, sf)).select("tile_id", "class_id")


HEIGHT = PTS.strip() + """,
ht AS (SELECT tile_id, avg(z) AS zm, median(z) AS zmed, stddev_pop(z) AS zs, min(z) AS zmin, max(z) AS zmax
       FROM pts WHERE (x * 3 + y) % 4 <> 0 GROUP BY 1)
"""


def heights(spark, sf):
    """Heights of the points on a mask that leaves out every cell with (3 col + row) divisible by 4."""
    pts = tb.points(spark, sf)
    on_mask = pts.select("tile_id", F.floor("y").alias("row"), F.floor("x").alias("col")) \
        .filter("(col * 3 + row) % 4 <> 0")
    return rules.heights_from_points(pts, on_mask, bounded=True)


@query("d14_heights", with_ctes(HEIGHT, select="""
SELECT o_orderkey AS tile_id, round(zm, 6) AS z_mean, zmed AS z_median, round(zs, 4) AS z_std, zmin AS z_min, zmax AS z_max,
       CASE WHEN zm IS NULL THEN 'none' ELSE 'las' END AS source FROM orders LEFT JOIN ht ON ht.tile_id = o_orderkey"""))
def d14(spark, sf):
    spine = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    return rules.with_heights(spine, heights(spark, sf)).withColumn("z_mean", F.round("z_mean", 6)).withColumn(
        "z_std", F.round("z_std", 4))


@query("d14_elevation_heights", with_ctes(MASKS, select="""
SELECT source_id AS tile_id, round(avg(b0 - b1), 6) AS z_mean, CAST(median(b0 - b1) AS DOUBLE) AS z_median,
       CAST(min(b0 - b1) AS DOUBLE) AS z_min, CAST(max(b0 - b1) AS DOUBLE) AS z_max FROM msk WHERE pred = 1 GROUP BY 1"""))
def d14_elevation(spark, sf):
    m = tb.masks(spark, sf).withColumnRenamed("source_id", "tile_id")
    surface = m.select("tile_id", "row", "col", F.col("b0").cast("double").alias("surface"))
    terrain = m.select("tile_id", "row", "col", F.col("b1").cast("double").alias("terrain"))
    out = rules.heights_from_elevation(surface, terrain, m.filter("pred = 1"))
    return out.select("tile_id", F.round("z_mean", 6).alias("z_mean"), "z_median", "z_min", "z_max")


RULED = HEIGHT.strip() + ",\n" + DEC.strip() + """,
ru AS (SELECT dec.tile_id, class_id, coalesce(zm, 0) AS zm, coalesce(zmax, 0) AS zmax FROM dec LEFT JOIN ht USING (tile_id))
"""


@query("d15_shadow_rule", with_ctes(RULED, select="""
SELECT tile_id, class_id, CASE WHEN class_id = 4 AND zm > 0.5e0 THEN 0 ELSE class_id END AS final_class_id,
       class_id = 4 AND zm > 0.5e0 AS shadow_killed,
       CASE WHEN class_id = 4 AND zm > 0.5e0 THEN 'Water rejected: mean height ' || printf('%.2f', zm) || 'm > 0.5m threshold' END AS shadow_reason
FROM ru"""))
def d15(spark, sf):
    return rules.height_rules(tb.decisions(spark, sf), heights(spark, sf)).select(
        "tile_id", "class_id", "final_class_id", "shadow_killed", "shadow_reason")


@query("d16_tall_buildings", with_ctes(RULED, select="""
SELECT tile_id, class_id = 1 AND zmax > 12 AS illegal_height_flag,
       CASE WHEN class_id = 1 AND zmax > 12 THEN 'Building flagged: height ' || printf('%.1f', zmax) || 'm > 12m (possible G+3 or higher)' END AS height_reason
FROM ru"""))
def d16(spark, sf):
    return rules.height_rules(tb.decisions(spark, sf), heights(spark, sf)).select(
        "tile_id", "illegal_height_flag", "height_reason")


def image_mask(spark, sf):
    """Segmentation mask of the images."""
    return tb.masks(spark, sf).select(F.col("source_id").alias("tile_id"), "row", "col", F.col("pred").alias("class_id"))


@query("d17_polygon_cells", with_ctes(MASKS, IDEC, """
ok AS (SELECT tile_id FROM idec WHERE accept_val >= 0.3e0 AND NOT refine_flag),
n AS (SELECT source_id, pred, count(*) AS n FROM msk WHERE pred BETWEEN 1 AND 5 GROUP BY ALL)""", select="""
SELECT source_id AS tile_id, pred AS class_id, n AS pixels FROM n WHERE n >= 10 AND source_id IN (SELECT tile_id FROM ok)"""))
def d17(spark, sf):
    decisions = tb.image_decisions(spark, sf)
    covered = decisions.filter("refine_flag")
    cells = assembly.segmentation_cells(decisions, image_mask(spark, sf), covered)
    return cells.groupBy("tile_id", "class_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("d17_tile_polygons", with_ctes(MASKS, IDEC, """/*recursive*/
reach AS (
  SELECT source_id, pred, r * 100 + c AS root, r, c FROM msk
  UNION
  SELECT n.source_id, n.pred, p.root, n.r, n.c FROM reach p JOIN msk n ON n.source_id = p.source_id AND n.pred = p.pred
   AND abs(n.r - p.r) + abs(n.c - p.c) = 1),
comp AS (SELECT source_id, pred, r, c, min(root) AS root FROM reach GROUP BY ALL),
nb AS (SELECT a.source_id, a.root, count(*) AS n FROM comp a JOIN comp b
       ON a.source_id = b.source_id AND a.root = b.root AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
sz AS (SELECT source_id, root, pred, count(*) AS n FROM comp GROUP BY ALL),
big AS (SELECT source_id, pred FROM comp GROUP BY ALL HAVING count(*) >= 10),
ok AS (SELECT * FROM idec WHERE accept_val >= 0.3e0),
refd AS (SELECT * FROM ok WHERE (tile_id % 10) / 10e0 > 0.3e0)""", select="""
SELECT tile_id, class_id, round(confidence_val, 6) AS confidence, 'geosam' AS source, 64e0 AS area, 32e0 AS perimeter FROM refd
UNION ALL
SELECT source_id, pred, round(confidence_val, 6), 'swin', sz.n * 1e0, sz.n * 4e0 - coalesce(nb.n, 0)
FROM sz JOIN ok ON tile_id = source_id JOIN big USING (source_id, pred) LEFT JOIN nb USING (source_id, root)
WHERE pred BETWEEN 1 AND 5 AND sz.n >= 4 AND source_id NOT IN (SELECT tile_id FROM refd)"""))
def d17_polygons(spark, sf):
    decisions, mask = tb.image_decisions(spark, sf), image_mask(spark, sf)
    confidence = decisions.select("tile_id", F.col("confidence_val").alias("confidence"))
    refined = mask.select(
        "tile_id", F.lit(0).alias("cand"), "row", "col", ((F.col("tile_id") % 10) / 10.0).alias("quality"))
    return assembly.tile_polygons(decisions, mask, confidence, refined, min_area=4.0, tolerance=0.0).select(
        "tile_id", "class_id", F.round("confidence", 6).alias("confidence"), F.get("source_masks", F.lit(0)).alias("source"),
        "area", "perimeter")


@query("d18_refinement_candidates", with_ctes(TOP, select="""
SELECT tile_id, x1, y1, x2, y2, confidence, rank FROM rk WHERE rank <= 2"""))
def d18(spark, sf):
    return detections.top_boxes(tb.detections(spark, sf), 2).select(
        "tile_id", "x1", "y1", "x2", "y2", "confidence", "rank")


@query("d19_best_masks", """
WITH c AS (SELECT l_orderkey AS tile_id, l_partkey % 480 - 20 + 0.5e0 AS x1, (l_suppkey * 37) % 480 AS y1, l_linenumber AS mask_no,
                  l_discount AS score, CAST(l_quantity AS BIGINT) AS w FROM lineitem),
a AS (SELECT *, greatest(0, CAST(trunc(x1) AS BIGINT)) AS ax, greatest(0, y1) AS ay, least(450, CAST(trunc(x1 + w * 3) AS BIGINT)) AS bx, least(450, y1 + w) AS bw FROM c),
m AS (SELECT tile_id, mask_no, max(CASE WHEN bx > ax AND bw > ay THEN (bx - ax) * (bw - ay) ELSE 0 END) AS mask_area, max(score) AS score FROM a GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY score DESC, mask_no) AS k FROM m)
SELECT tile_id, mask_no, mask_area, score, round(mask_area + 2 * score + 3 * score, 2) AS quality FROM b WHERE k = 1""")
def d19(spark, sf):
    w = F.col("l_quantity").cast("long")
    x1, y1 = F.col("l_partkey") % 480 - 20 + 0.5, (F.col("l_suppkey") * 37) % 480
    cands = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), F.col("l_linenumber").alias("mask_no"), F.col("l_discount").alias("score"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w * 3).alias("x2"), (y1 + w).alias("y2"))
    masks = cands.withColumn("mask_area", detections.box_mask_area(F.lit(450), F.lit(450))) \
        .groupBy("tile_id", "mask_no").agg(F.max("mask_area").alias("mask_area"), F.max("score").alias("score"))
    best = detections.best_masks(masks, ["tile_id"])
    q = detections.quality_features(F.col("mask_area"), F.col("score"), F.col("score"))
    total = F.get(q, 0).cast("double") + 2 * F.get(q, 1) + 3 * F.get(q, 2)
    return best.select("tile_id", "mask_no", F.col("mask_area").cast("long").alias("mask_area"), "score",
                       F.round(total, 2).alias("quality"))


@query("d20_tile_diagnostics", with_ctes(DEC, HEIGHT, DETS, """
dd AS (SELECT tile_id, count(*) AS boxes FROM det GROUP BY 1),
j AS (SELECT dec.*, boxes, dec.tile_id % 11 = 0 AS failed, dec.tile_id % 7 = 0 AS dull, dd.tile_id IS NOT NULL AS has_det, zm
      FROM dec LEFT JOIN dd USING (tile_id) LEFT JOIN ht USING (tile_id))""", select="""
SELECT tile_id, CASE WHEN failed THEN 'error' WHEN dull THEN 'skipped' ELSE 'complete' END AS status,
       CASE WHEN failed THEN 'load_error: no data' WHEN dull THEN 'gatekeeper_rejected_low_variance' ELSE '' END AS errors,
       CASE WHEN failed OR dull THEN '' ELSE concat_ws('+', CASE WHEN tile_id % 2 = 0 THEN 'swin' END, CASE WHEN has_det THEN 'yolo' END,
            CASE WHEN zm IS NOT NULL THEN 'depth' END) END AS models,
       CASE WHEN NOT (failed OR dull) THEN class_id END AS class_id, CASE WHEN NOT (failed OR dull) THEN coalesce(boxes, 0) END AS num_polygons,
       CASE WHEN tile_id % 5 > 0 THEN tile_id * 2e0 END AS max_x, CASE WHEN tile_id % 5 > 0 THEN 'EPSG:32643' END AS crs,
       CASE WHEN tile_id % 3 > 0 THEN (tile_id % 3) / 2e0 END AS total_s FROM j"""))
def d20(spark, sf):
    spine = tb.table(spark, sf, "orders").select(F.lit("r1").alias("run_id"), F.col("o_orderkey").alias("tile_id"))
    tiles = spine.select("tile_id")
    out = assembly.diagnostics(
        spine, tiles.filter("tile_id % 11 = 0").withColumn("message", F.lit("no data")),
        tiles.withColumn("keep", F.col("tile_id") % 7 != 0), tiles.filter("tile_id % 2 = 0"), tb.detections(spark, sf),
        rules.with_heights(tiles, heights(spark, sf)), tb.decisions(spark, sf), polygons=tb.detections(spark, sf).select("tile_id"),
        meta=tiles.filter("tile_id % 5 > 0").select("tile_id", F.struct(
            F.lit(0.0).alias("min_y"), F.lit(0.0).alias("min_x"), F.lit(1.0).alias("max_y"), (F.col("tile_id") * 2.0).alias("max_x")).alias("bounds"),
            F.lit("EPSG:32643").alias("crs")),
        timing=tiles.select("tile_id", assembly.timing_map(
            load=F.lit(0.1), total=F.when(F.col("tile_id") % 3 > 0, (F.col("tile_id") % 3) / 2.0)).alias("timing")))
    return out.select(
        "num_polygons", F.col("bounds.max_x").alias("max_x"), "crs", F.col("timing")["total"].alias("total_s"),"tile_id", "status", F.array_join("errors", "+").alias("errors"),
                      F.array_join("models_used", "+").alias("models"), F.col("fusion_decision.class_id").alias("class_id"))


@query("d21_aligned_metadata", """
SELECT o_orderkey AS tile_id, coalesce(p_size, 1) * 1e0 AS pixel_w, coalesce(-p_size, -1) * 1e0 AS pixel_h
FROM orders LEFT JOIN part ON p_partkey = o_orderkey""")
def d21(spark, sf):
    size = F.col("p_size").cast("double")
    meta = tb.table(spark, sf, "part").select(
        F.col("p_partkey").alias("tile_id"),
        F.array(size, F.lit(0.0), F.lit(0.0), F.lit(0.0), -size, F.lit(0.0)).alias("transform"))
    tiles = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    return assembly.align_metadata(tiles, meta).select(
        "tile_id", F.get("transform", F.lit(0)).alias("pixel_w"), F.get("transform", F.lit(4)).alias("pixel_h"))


@query("d22_tile_outputs", with_ctes(DEC, DETS, HEIGHT, """
pl AS (SELECT c_custkey // 20 AS tile_id, count(*) AS n, sum((5 + c_custkey % 20) ** 2) AS area FROM customer GROUP BY 1),
ds AS (SELECT tile_id, count(*) AS boxes FROM det GROUP BY 1)""", select="""
SELECT dec.tile_id, coalesce(n, 0) AS num_polygons, coalesce(area, 0e0) AS area, round(coalesce(confidence_val, 0), 6) AS swin_confidence,
       coalesce(boxes, 0) AS yolo_count, accept_val AS fusion_accept, CASE WHEN n > 0 THEN round(zm, 6) END AS z_mean
FROM dec LEFT JOIN pl USING (tile_id) LEFT JOIN ds USING (tile_id) LEFT JOIN ht USING (tile_id)"""))
def d22(spark, sf):
    polygons = tb.layer_polygons(spark, sf).select(
        F.expr("feature_id div 20").alias("tile_id"), (F.col("feature_id") % 6).alias("class_id"), "rings",
        F.lit(0.5).alias("confidence"), F.array(F.lit("swin")).alias("source_masks"),
        ((F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))).alias("area"), F.lit(0.0).alias("perimeter"))
    decisions = tb.decisions(spark, sf)
    out = assembly.tile_outputs(
        decisions.select("tile_id"), polygons, heights(spark, sf), detections.summary(tb.detections(spark, sf)),
        decisions.select("tile_id", F.col("confidence_val").alias("confidence")), decisions)
    area = F.aggregate(F.transform("polygons", lambda p: p["area"]), F.lit(0.0), lambda acc, v: acc + v)
    return out.select("tile_id", "num_polygons", area.alias("area"), F.round("swin_confidence", 6).alias("swin_confidence"),
                      "yolo_count", "fusion_accept", F.round(F.get("polygons", F.lit(0))["z_mean"], 6).alias("z_mean"))


@query("d23_dominant_class", """
WITH d AS (SELECT o_orderkey AS tile_id, o_orderkey % 6 AS class_id FROM orders),
e AS (SELECT l_orderkey AS tile_id, l_linenumber % 6 AS class_id, max(l_discount) AS confidence FROM lineitem GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY confidence DESC, class_id) AS k FROM e)
SELECT d.tile_id, coalesce(b.class_id, d.class_id) AS class_id FROM d LEFT JOIN b ON b.tile_id = d.tile_id AND k = 1
WHERE coalesce(b.class_id, d.class_id) <> 0""")
def d23(spark, sf):
    from orthomill.operators import views
    polygons = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), (F.col("l_linenumber") % 6).alias("class_id"),
        F.col("l_discount").alias("confidence"))
    d = tb.decisions(spark, sf).select("tile_id", "class_id").join(views.class_distribution(polygons), "tile_id", "left")
    dominant = regions.dominant_class(F.col("class_id"), F.col("class_distribution"))
    return d.select("tile_id", dominant.alias("class_id")).filter("class_id <> 0")


@query("d24_grid_coords", with_ctes(GRID, select="""
SELECT tile_id, CASE WHEN tile_no % 3 = 0 THEN gx WHEN tile_no % 3 = 1 THEN tile_no % 10 ELSE 0 END AS gx,
       CASE WHEN tile_no % 3 = 0 THEN gy WHEN tile_no % 3 = 1 THEN tile_no // 10 ELSE 0 END AS gy FROM grid"""))
def d24(spark, sf):
    t = tb.tile_grid(spark, sf)
    bounds = F.when(F.col("tile_no") % 3 == 0, F.col("bounds"))
    name = F.when(F.col("tile_no") % 3 == 1, F.concat(F.lit("v_"), F.col("tile_no"))).otherwise(F.col("tile_id"))
    return t.select("tile_id", regions.grid_coords(bounds, name).alias("g")).select("tile_id", "g.gx", "g.gy")


CLUSTER = GRID.strip() + """,
/*recursive*/
reach AS (
  SELECT tile_id AS root, tile_id, class_id, gx, gy FROM grid WHERE class_id > 0
  UNION
  SELECT p.root, n.tile_id, n.class_id, n.gx, n.gy FROM reach p JOIN grid n
    ON n.class_id = p.class_id AND abs(n.gx - p.gx) <= 1 AND abs(n.gy - p.gy) <= 1),
comp AS (SELECT tile_id, class_id, gx, gy, min(root) AS root FROM reach GROUP BY ALL),
ext AS (SELECT class_id, root, count(*) AS num_tiles, min(gx) AS min_c, max(gx) AS max_c, min(gy) AS min_r, max(gy) AS max_r
        FROM comp GROUP BY ALL),
reg AS (SELECT *, printf('R%04d', row_number() OVER (ORDER BY class_id, root)) AS region_id FROM ext)
"""


def clustered(spark, sf):
    """Regions of the part grid."""
    t = tb.tile_grid(spark, sf)
    placed = t.withColumn("g", regions.grid_coords(F.col("bounds"), F.col("tile_id"))).select(
        "tile_id", "class_id", "bounds", "g.gx", "g.gy")
    return regions.cluster_tiles(placed, chunk=16)


@query("d25_regions", with_ctes(CLUSTER, select="""
SELECT region_id, class_id, num_tiles, min_r * 512e0 AS min_y, min_c * 512e0 AS min_x, (max_r + 1) * 512e0 AS max_y,
       (max_c + 1) * 512e0 AS max_x FROM reg"""))
def d25(spark, sf):
    return clustered(spark, sf)[1].select("region_id", "class_id", "num_tiles", "min_y", "min_x", "max_y", "max_x")


@query("d25_region_members", with_ctes(CLUSTER, select="""
SELECT region_id, tile_id FROM comp JOIN reg USING (class_id, root)"""))
def d25_members(spark, sf):
    return clustered(spark, sf)[0].select("region_id", "tile_id")


@query("d26_region_canvas", with_ctes(CLUSTER, """
tl AS (SELECT region_id, min(tile_id) AS t FROM comp JOIN reg USING (class_id, root) WHERE gx = min_c AND gy = min_r GROUP BY 1)""", select="""
SELECT region_id, max_c - min_c + 1 AS w_tiles, max_r - min_r + 1 AS h_tiles, (max_c - min_c + 1) * 512 AS width,
       CASE WHEN t IS NULL THEN 0e0 ELSE min_c * 512e0 END AS origin_x, CASE WHEN t IS NULL THEN 0e0 ELSE min_r * 512e0 END AS origin_y
FROM reg LEFT JOIN tl USING (region_id)"""))
def d26(spark, sf):
    members, _ = clustered(spark, sf)
    transforms = members.select("tile_id", F.array(
        F.lit(1.0), F.lit(0.0), F.col("bounds.min_x"), F.lit(0.0), F.lit(-1.0), F.col("bounds.min_y")).alias("transform"))
    return regions.region_canvas(members, transforms).select(
        "region_id", "w_tiles", "h_tiles", "width", F.get("transform", F.lit(2)).alias("origin_x"),
        F.get("transform", F.lit(5)).alias("origin_y"))


@query("d26_tile_offsets", with_ctes(CLUSTER, select="""
SELECT region_id, tile_id, (gx - min_c) * 512 AS x_offset, (gy - min_r) * 512 AS y_offset FROM comp JOIN reg USING (class_id, root)"""))
def d26_offsets(spark, sf):
    members, _ = clustered(spark, sf)
    transforms = members.select("tile_id", F.array(F.lit(1.0)).alias("transform"))
    return regions.tile_offsets(members, regions.region_canvas(members, transforms))


@query("d27_region_polygons", with_ctes(CLUSTER, """
cells AS (SELECT region_id, class_id, gx, gy FROM comp JOIN reg USING (class_id, root)),
nb AS (SELECT a.region_id, count(*) AS n FROM cells a JOIN cells b ON a.region_id = b.region_id AND abs(a.gx - b.gx) + abs(a.gy - b.gy) = 1 GROUP BY 1),
sz AS (SELECT region_id, class_id, count(*) AS n FROM cells GROUP BY ALL)""", select="""
SELECT region_id, class_id, sz.n * 4e0 AS area, (sz.n * 4 - coalesce(nb.n, 0)) * 2e0 AS perimeter, 0.75e0 AS confidence
FROM sz LEFT JOIN nb USING (region_id)"""))
def d27(spark, sf):
    members, table = clustered(spark, sf)
    transforms = members.select("tile_id", F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, -2.0, 0.0)]).alias("transform"))
    canvas = regions.region_canvas(members, transforms)
    canvas = canvas.withColumn("transform", F.array(*[F.lit(v) for v in (2.0, 0.0, 0.0, 0.0, -2.0, 0.0)]))
    cells = members.select("region_id", F.col("gy").alias("row"), F.col("gx").alias("col"), F.lit(0.75).alias("quality"))
    shapes = regions.region_polygons(cells, table, canvas, min_area=1.0, tolerance=0.0)
    return shapes.groupBy("region_id", "class_id").agg(
        F.sum("area").alias("area"), F.sum("perimeter").alias("perimeter"), F.max("confidence").alias("confidence"))


@query("h2_numbered_ids", """
SELECT o_orderkey, printf('R%04d', o_orderkey) AS region, printf('region_%02d', o_orderkey) AS island,
       printf('real_gt_%05d', o_orderkey) AS gt_tile, o_orderstatus || printf('_%04d', o_orderkey) AS numbered FROM orders""")
def h2(spark, sf):
    key = F.col("o_orderkey")
    return tb.table(spark, sf, "orders").select(
        "o_orderkey", ids.region_id(key).alias("region"), ids.island_id(key).alias("island"),
        ids.gt_tile_id(key).alias("gt_tile"), ids.numbered(F.col("o_orderstatus"), 4, key, "_").alias("numbered"))
