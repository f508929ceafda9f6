"""Queries on metrics, run views and dataset preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators import (detections, fusion, fusion_train, matching, metrics, mlprep, rasterize, rules,
                                 spatial_join, tiling, views)
from orthomill.plans.base_sql import DEC, DETS, DIAG, FEEDBACK, HEIGHT_STATS, IDEC, LAYER, LOGITS, MASKS, PTS
from orthomill.plans.registry import query, with_ctes
from orthomill.sources import layers
from orthomill.sources import testbed as tb

CONF = MASKS.strip() + """,
c6 AS (SELECT i AS class_id FROM range(6) t(i)),
pc AS (SELECT source_id, pred AS class_id, count(*) AS p FROM msk GROUP BY ALL),
tc AS (SELECT source_id, target AS class_id, count(*) AS t FROM msk GROUP BY ALL),
hc AS (SELECT source_id, pred AS class_id, count(*) AS h FROM msk WHERE pred = target GROUP BY ALL),
im AS (SELECT DISTINCT source_id FROM msk),
ci AS (SELECT source_id, class_id, coalesce(h, 0) AS h, coalesce(p, 0) AS p, coalesce(t, 0) AS t
       FROM im CROSS JOIN c6 LEFT JOIN pc USING (source_id, class_id) LEFT JOIN tc USING (source_id, class_id) LEFT JOIN hc USING (source_id, class_id))
"""


@query("e1_class_iou", with_ctes(CONF, select="""
SELECT source_id, class_id, CASE WHEN p + t - h > 0 THEN round(h / (p + t - h), 6) END AS iou FROM ci"""))
def e1(spark, sf):
    return metrics.class_iou(tb.masks(spark, sf), keys=["source_id"]).select(
        "source_id", "class_id", F.round("iou", 6).alias("iou"))


@query("e1_total_iou", with_ctes(CONF, select="""
SELECT class_id, round(sum(h) / (sum(p) + sum(t) - sum(h)), 6) AS iou FROM ci GROUP BY 1"""))
def e1_total(spark, sf):
    return metrics.class_iou(tb.masks(spark, sf)).select("class_id", F.round("iou", 6).alias("iou"))


@query("e2_validation_miou", with_ctes(CONF, """
m AS (SELECT source_id, avg(h / (p + t - h)) AS miou FROM ci WHERE p + t - h > 0 GROUP BY 1)""", select="""
SELECT round(avg(miou), 6) AS miou FROM m"""))
def e2(spark, sf):
    return metrics.validation_miou(tb.masks(spark, sf), "source_id").select(F.round("miou", 6).alias("miou"))


MATCH = """
p0 AS (SELECT c_custkey // 16 AS tile_id, c_custkey AS idx, (c_custkey * 13) % 40 AS x1, (c_custkey * 29) % 40 AS y1,
              (c_custkey * 13) % 40 + 8 + c_custkey % 6 AS x2, (c_custkey * 29) % 40 + 8 + c_custkey % 5 AS y2 FROM customer),
g0 AS (SELECT o_orderkey // 160 AS tile_id, o_orderkey AS idx, (o_orderkey * 11) % 40 AS x1, (o_orderkey * 7) % 40 AS y1,
              (o_orderkey * 11) % 40 + 8 + o_orderkey % 5 AS x2, (o_orderkey * 7) % 40 + 8 + o_orderkey % 4 AS y2
       FROM orders),
pr AS (SELECT a.tile_id, a.idx AS i, b.idx AS j,
              greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS n,
              (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS tot
       FROM p0 a JOIN g0 b ON a.tile_id = b.tile_id),
ed AS (SELECT *, n / (tot - n) AS iou FROM pr WHERE n / (tot - n) >= 0.5e0),
od AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY iou DESC, i, j) AS k FROM ed),
/*recursive*/
st AS (
  SELECT tile_id, 0::BIGINT AS k, []::BIGINT[] AS ui, []::BIGINT[] AS uj, 0e0 AS s, max(k) AS n FROM od GROUP BY 1
  UNION ALL
  SELECT st.tile_id, st.k + 1, CASE WHEN hit THEN ui ELSE list_append(ui, i) END, CASE WHEN hit THEN uj ELSE list_append(uj, j) END,
         CASE WHEN hit THEN s ELSE s + iou END, n
  FROM (SELECT st.*, i, j, iou, list_contains(ui, i) OR list_contains(uj, j) AS hit FROM st JOIN od ON od.tile_id = st.tile_id AND od.k = st.k + 1) st),
fin AS (SELECT tile_id, len(ui) AS m, s FROM st WHERE k = n),
sp AS (SELECT DISTINCT o_orderkey // 150 AS tile_id FROM orders),
pc AS (SELECT tile_id, count(*) AS np FROM p0 GROUP BY 1),
gc AS (SELECT tile_id, count(*) AS ng FROM g0 GROUP BY 1),
al AS (SELECT tile_id, coalesce(m, 0) AS m, coalesce(s, 0) AS s, coalesce(np, 0) AS np, coalesce(ng, 0) AS ng
       FROM sp LEFT JOIN fin USING (tile_id) LEFT JOIN pc USING (tile_id) LEFT JOIN gc USING (tile_id)),
pf AS (SELECT *, CASE WHEN np + ng = 0 THEN 1e0 WHEN np = 0 THEN 0 ELSE m / np END AS pc, CASE WHEN np + ng = 0 THEN 1e0 WHEN ng = 0 THEN 0 ELSE m / ng END AS rc,
              CASE WHEN np + ng = 0 THEN 1e0 WHEN m = 0 THEN 0 ELSE s / m END AS mi FROM al)
"""


def match_inputs(spark, sf):
    """Predicted and true boxes per tile."""
    k, o = F.col("c_custkey"), F.col("o_orderkey")
    box = lambda x, y, w, h: [e.cast("double").alias(n) for n, e in (
        ("x1", x), ("y1", y), ("x2", x + w), ("y2", y + h))]
    pred = tb.table(spark, sf, "customer").select(
        F.expr("c_custkey div 16").alias("tile_id"), k.alias("idx"), *box((k * 13) % 40, (k * 29) % 40, 8 + k % 6, 8 + k % 5))
    gt = tb.table(spark, sf, "orders").select(
        F.expr("o_orderkey div 160").alias("tile_id"), o.alias("idx"), *box((o * 11) % 40, (o * 7) % 40, 8 + o % 5, 8 + o % 4))
    return pred, gt


@query("e3_object_matching", with_ctes(MATCH, select="""
SELECT tile_id, m AS matched, np AS total_pred, ng AS total_gt, round(pc, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0 END, 6) AS f1, round(mi, 6) AS mean_iou FROM pf"""))
def e3(spark, sf):
    pred, gt = match_inputs(spark, sf)
    spine = tb.table(spark, sf, "orders").select(F.expr("o_orderkey div 150").alias("tile_id")).distinct()
    out = matching.match_metrics(spine, pred, gt, matching.match(pred, gt, cell=32.0))
    return out.select("tile_id", "matched", "total_pred", "total_gt",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query("e3_polygon_matching", with_ctes(MATCH, select="""
SELECT tile_id, m AS matched, np AS total_pred, ng AS total_gt, round(pc, 6) AS precision, round(rc, 6) AS recall,
       round(CASE WHEN pc + rc > 0 THEN 2 * pc * rc / (pc + rc) ELSE 0 END, 6) AS f1, round(mi, 6) AS mean_iou FROM pf"""))
def e3_polygons(spark, sf):
    corners = [F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]
    pred, gt = (side.withColumn("rings", geo.box_rings(*corners)).drop("x1", "y1", "x2", "y2") for side in match_inputs(spark, sf))
    spine = tb.table(spark, sf, "orders").select(F.expr("o_orderkey div 150").alias("tile_id")).distinct()
    out = matching.match_metrics(spine, pred, gt, matching.match(pred, gt, cell=32.0, rings="rings"))
    return out.select("tile_id", "matched", "total_pred", "total_gt",
                      *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_iou")])


@query("e4_pixel_accuracy", with_ctes(MASKS, select="""
SELECT round(avg(CASE WHEN pred = target THEN 1e0 ELSE 0 END) * 100, 6) AS accuracy_pct FROM msk"""))
def e4(spark, sf):
    return metrics.pixel_accuracy(tb.masks(spark, sf)).select(F.round("accuracy_pct", 6).alias("accuracy_pct"))


HIST = MASKS.strip() + """,
hs AS (SELECT b0 % 9 AS class_id, count(*) AS pixels FROM msk WHERE b0 % 9 < 6 GROUP BY 1)
"""


def nine_classes(spark, sf):
    """Masks with values beyond the known classes."""
    return tb.masks(spark, sf).select((F.col("b0") % 9).alias("class_id"))


@query("e5_class_histogram", with_ctes(HIST, select="""
SELECT class_id, pixels, round(pixels / sum(pixels) OVER () * 100, 6) AS pct FROM hs"""))
def e5(spark, sf):
    return metrics.class_histogram(nine_classes(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("e6_loss_weights", with_ctes(HIST, """
w AS (SELECT class_id, 1 / (ln(1 + 100 * pixels / sum(pixels) OVER ()) + 0.1e0) AS w FROM hs WHERE class_id > 0)""", select="""
SELECT class_id, round(w / min(w) OVER (), 6) AS weight FROM w"""))
def e6(spark, sf):
    return metrics.loss_weights(metrics.class_histogram(nine_classes(spark, sf))).withColumn(
        "weight", F.round("weight", 6))


@query("e7_evaluation_loss", with_ctes(LOGITS, """
pr AS (SELECT tile_id, (b0 + b1) % 6 AS t, [ez[1] / es, ez[2] / es, ez[3] / es, ez[4] / es, ez[5] / es, ez[6] / es] AS p FROM sm),
px2 AS (SELECT tile_id, t, p[t + 1] AS pt, k, p[k + 1] AS pk FROM pr, range(6) r(k)),
dc AS (SELECT tile_id, k, (2 * sum(CASE WHEN t = k THEN pk ELSE 0 END) + 1e-6) / (sum(pk + CASE WHEN t = k THEN 1 ELSE 0 END) + 1e-6) AS d
       FROM px2 GROUP BY ALL),
dl AS (SELECT 1 - avg(d) AS dice_loss FROM dc),
bl AS (SELECT avg(-ln(p[t + 1]) * (1 - p[t + 1]) ** 2) AS base_loss FROM pr)""", select="""
SELECT round(dice_loss, 6) AS dice_loss, round(base_loss, 6) AS base_loss, round(0.5e0 * dice_loss + 0.5e0 * base_loss, 6) AS loss FROM dl, bl"""))
def e7(spark, sf):
    scored = fusion.classify_pixels(tb.logits(spark, sf)).withColumn("target", (F.col("b0") + F.col("b1")) % 6)
    out = metrics.evaluation_loss(scored, "tile_id")
    return out.select(*[F.round(c, 6).alias(c) for c in ("dice_loss", "base_loss", "loss")])


@query("e8_run_summary", with_ctes(DIAG, select="""
SELECT run_id, count(*) AS num_tiles, count(*) FILTER (status = 'complete') AS completed, count(*) FILTER (status = 'error') AS errors,
       count(*) FILTER (status = 'failed') AS failed, round(sum(elapsed_s), 4) AS total_time_s, round(avg(elapsed_s), 4) AS avg_time_per_tile,
       'complete' AS status, 'cluster' AS device, 'v2' AS seg_version FROM diag GROUP BY 1"""))
def e8(spark, sf):
    summary = views.run_summary(tb.diagnostics(spark, sf), device="cluster", versions={"seg": "v2", "det": "v1"})
    return summary.withColumn("seg_version", F.col("model_versions")["seg"]).drop("model_versions").withColumn(
        "total_time_s", F.round("total_time_s", 4)).withColumn("avg_time_per_tile", F.round("avg_time_per_tile", 4))


@query("e9_class_distribution", """
WITH b AS (SELECT l_orderkey AS tile_id, l_linenumber % 6 AS class_id, max(l_discount) AS c FROM lineitem GROUP BY ALL)
SELECT tile_id, string_agg(class_id || ':' || CAST(round(c * 100) AS BIGINT), ',' ORDER BY class_id) AS distribution FROM b GROUP BY 1""")
def e9(spark, sf):
    polygons = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), (F.col("l_linenumber") % 6).alias("class_id"),
        F.col("l_discount").alias("confidence"))
    text = F.array_join(F.transform("class_distribution", lambda e: F.concat_ws(
        ":", e["class_id"], F.round(e["confidence"] * 100).cast("long"))), ",")
    return views.class_distribution(polygons).select("tile_id", text.alias("distribution"))


def run_predictions(spark, sf):
    """Run detail over the decisions, with polygon counts from line items; some tiles have no decision."""
    d = tb.decisions(spark, sf)
    polygons = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), (F.col("l_linenumber") % 6).alias("class_id"),
        F.col("l_discount").alias("confidence"))
    counts = polygons.groupBy("tile_id").agg(F.count(F.lit(1)).alias("num_polygons"))
    known = F.col("tile_id") % 9 != 0
    diag = d.join(counts, "tile_id", "left").select(
        "tile_id", "num_polygons", F.when(known, F.struct("accept_val", "refine_flag", "class_id", "confidence_val"))
        .alias("fusion_decision"), F.lit(None).cast("struct<z_mean:double>").alias("depth_stats"),
        F.lit(None).cast("struct<min_y:double,min_x:double,max_y:double,max_x:double>").alias("bounds"),
        F.lit(None).cast("string").alias("crs"))
    return views.run_detail(diag, views.class_distribution(polygons))


DETAIL = DEC.strip() + """,
np AS (SELECT l_orderkey AS tile_id, count(*) AS n, count(DISTINCT l_linenumber % 6) AS k FROM lineitem GROUP BY 1),
rd AS (SELECT dec.tile_id, CASE WHEN dec.tile_id % 9 = 0 THEN 0 ELSE class_id END AS final_class, CASE WHEN dec.tile_id % 9 = 0 THEN 0 ELSE confidence_val END AS final_confidence,
              CASE WHEN dec.tile_id % 9 = 0 THEN 0 ELSE accept_val END AS swin_confidence, coalesce(n, 0) AS yolo_count, coalesce(k, 0) AS classes,
              CASE WHEN refine_flag AND dec.tile_id % 9 > 0 THEN 'refine' ELSE 'accept' END AS action FROM dec LEFT JOIN np USING (tile_id))
"""


@query("e10_run_detail", with_ctes(DETAIL, select="""
SELECT tile_id, final_class, round(final_confidence, 6) AS final_confidence, swin_confidence * 1e0 AS swin_confidence, yolo_count,
       round(greatest(0.2e0, final_confidence), 6) AS yolo_max_conf, action, classes, 512e0 AS max_y FROM rd"""))
def e10(spark, sf):
    return run_predictions(spark, sf).select(
        "tile_id", "final_class", F.round("final_confidence", 6).alias("final_confidence"), "swin_confidence", "yolo_count",
        F.round("yolo_max_conf", 6).alias("yolo_max_conf"), "action", F.size("class_distribution").alias("classes"),
        F.col("bounds.max_y").alias("max_y"))


@query("e10_run_header", with_ctes(DIAG, """
rg AS (SELECT strftime(ts, '%Y-%m-%d') AS run_id, count(*) AS num_regions, count(DISTINCT user_id % 6) AS region_classes FROM events WHERE event_type = 'purchase' GROUP BY 1)""", select="""
SELECT run_id, count(*) AS num_tiles, count(*) FILTER (status = 'complete') AS processed_tiles, coalesce(max(num_regions), 0) AS num_regions,
       coalesce(max(region_classes), 0) AS region_classes FROM diag LEFT JOIN rg USING (run_id) GROUP BY 1"""))
def e10_header(spark, sf):
    diag = tb.diagnostics(spark, sf)
    regions = tb.table(spark, sf, "events").filter("event_type = 'purchase'").select(
        F.date_format("ts", "yyyy-MM-dd").alias("run_id"), F.col("event_id").alias("region_id"), (F.col("user_id") % 6).alias("class_id"))
    return views.run_header(views.run_summary(diag), regions).select("run_id", "num_tiles", "processed_tiles", "num_regions", "region_classes")


@query("e11_class_chart", with_ctes(DETAIL, select="""
SELECT final_class, count(*) AS tiles FROM rd WHERE final_class > 0 GROUP BY 1"""))
def e11(spark, sf):
    return views.class_chart(run_predictions(spark, sf))


@query("e12_confidence_card", with_ctes(DETAIL, select="""
SELECT round(avg(final_confidence * 100), 6) AS avg_confidence_pct FROM rd"""))
def e12(spark, sf):
    return views.confidence_card(run_predictions(spark, sf)).select(
        F.round("avg_confidence_pct", 6).alias("avg_confidence_pct"))


@query("e12_confidence_series", with_ctes(DETAIL, select="""
SELECT tile_id, round(final_confidence * 100, 6) AS confidence_pct, row_number() OVER (ORDER BY tile_id) - 1 AS pos FROM rd"""))
def e12_series(spark, sf):
    return views.confidence_series(run_predictions(spark, sf)).withColumn(
        "confidence_pct", F.round("confidence_pct", 6))


@query("e12_progress", with_ctes(DIAG, select="""
SELECT run_id, round(coalesce(count(*) FILTER (status = 'complete') / nullif(count(*) FILTER (status <> 'failed'), 0) * 100, 0), 6) AS progress_pct
FROM diag GROUP BY 1"""))
def e12_progress(spark, sf):
    counts = tb.diagnostics(spark, sf).groupBy("run_id").agg(
        F.count_if(F.col("status") == "complete").alias("done"), F.count_if(F.col("status") != "failed").alias("total"))
    return counts.select("run_id", F.round(views.progress_percent(F.col("done"), F.col("total")), 6).alias("progress_pct"))


@query("e13_throughput", with_ctes(DIAG, select="""
SELECT run_id, count(*) AS tiles, round(epoch_us(max(ts) - min(ts)) / 1e6, 6) AS elapsed_s,
       round(count(*) / nullif(epoch_us(max(ts) - min(ts)) / 1e6, 0), 9) AS tiles_per_s,
       CASE WHEN bool_and(status IN ('complete', 'skipped')) THEN 'COMPLETED' ELSE 'FAILED' END AS state,
       bool_and(status IN ('complete', 'skipped')) AND epoch_us(max(ts) - min(ts)) / 1e6 < 180 AS target_met FROM diag GROUP BY 1""").replace(
    "epoch_us(max(ts) - min(ts))", "(epoch_us(max(ts)) - epoch_us(min(ts)))"))
def e13(spark, sf):
    return views.throughput(tb.diagnostics(spark, sf)).withColumn("elapsed_s", F.round("elapsed_s", 6)).withColumn(
        "tiles_per_s", F.round("tiles_per_s", 9))


PAIRS = """
tl AS (SELECT 't' || o_orderkey AS tile_id FROM orders),
fl AS (SELECT CASE WHEN l_linenumber % 3 = 0 THEN 'tile' ELSE 'ann' END AS folder, 't' || (l_orderkey % 4000) || CASE WHEN l_linenumber % 2 = 0 THEN '_mask' ELSE '' END AS stem
       FROM lineitem GROUP BY ALL),
fp AS (SELECT *, folder || '/' || stem || '.png' AS path FROM fl),
c AS (SELECT replace(stem, '_mask', '') AS tile_id, CASE WHEN folder = 'ann' AND stem LIKE '%_mask' THEN 1 WHEN folder = 'ann' THEN 2 WHEN stem LIKE '%_mask' THEN 3 END AS prio, path FROM fp),
b AS (SELECT tile_id, arg_min(path, prio) AS path FROM c WHERE prio IS NOT NULL GROUP BY 1)
"""


def mask_files(spark, sf):
    """Mask files in two folders."""
    n = F.col("l_linenumber")
    folder = F.when(n % 3 == 0, "tile").otherwise("ann")
    stem = F.concat(F.lit("t"), F.col("l_orderkey") % 4000, F.when(n % 2 == 0, "_mask").otherwise(""))
    files = tb.table(spark, sf, "lineitem").select(folder.alias("folder"), stem.alias("stem")).distinct()
    return files.withColumn("path", F.concat("folder", F.lit("/"), "stem", F.lit(".png")))


def order_tiles(spark, sf):
    """Tiles named after orders."""
    return tb.table(spark, sf, "orders").select(F.concat(F.lit("t"), "o_orderkey").alias("tile_id"))


@query("f1_mask_pairing", with_ctes(PAIRS, select="""
SELECT tl.tile_id, coalesce(path, '') AS mask_path FROM tl LEFT JOIN b ON b.tile_id = tl.tile_id"""))
def f1(spark, sf):
    return mlprep.pair_masks(order_tiles(spark, sf), mask_files(spark, sf))


@query("f2_paired_only", with_ctes(PAIRS, select="""
SELECT tl.tile_id, path FROM tl JOIN fp ON folder = 'ann' AND stem = tl.tile_id || '_mask'"""))
def f2(spark, sf):
    masks = mask_files(spark, sf).filter("folder = 'ann' AND stem LIKE '%_mask'").select(
        F.regexp_replace("stem", "_mask$", "").alias("tile_id"), "path")
    return mlprep.paired_only(order_tiles(spark, sf), masks)


@query("f2_mask_driven", with_ctes(PAIRS, select="""
SELECT path FROM fp WHERE folder = 'ann' AND stem LIKE '%_mask' AND replace(stem, '_mask', '') IN (SELECT 't' || c_custkey FROM customer)"""))
def f2_driven(spark, sf):
    masks = mask_files(spark, sf).filter("folder = 'ann' AND stem LIKE '%_mask'").select(
        F.regexp_replace("stem", "_mask$", "").alias("tile_id"), "path")
    tiles = tb.table(spark, sf, "customer").select(F.concat(F.lit("t"), "c_custkey").alias("tile_id"))
    return mlprep.mask_driven(tiles, masks).select("path")


@query("f3_k_fold", """
WITH n AS (SELECT 't' || o_orderkey AS tile_id, row_number() OVER (ORDER BY 't' || o_orderkey) - 1 AS row_no, (SELECT count(*) FROM orders) // 7 AS s FROM orders)
SELECT tile_id, row_no, CASE WHEN row_no >= 2 * s AND row_no < 3 * s THEN 'val' ELSE 'train' END AS side FROM n""")
def f3(spark, sf):
    return mlprep.k_fold(order_tiles(spark, sf), ["tile_id"], 7, 2)


@query("f4_fusion_folds", """
WITH n AS (SELECT c_custkey AS tile_id, row_number() OVER (ORDER BY c_custkey) - 1 AS row_no, greatest((SELECT count(*) FROM customer) // 5, 1) AS s FROM customer)
SELECT tile_id, row_no, CASE WHEN row_no >= 4 * s AND row_no < 5 * s THEN 'val' ELSE 'train' END AS side FROM n""")
def f4(spark, sf):
    records = tb.table(spark, sf, "customer").select(F.col("c_custkey").alias("tile_id"))
    return mlprep.fusion_folds(records, ["tile_id"], 5, 4)


HASH = "('0x' || substr(md5('42:' || {0}), 1, 8))::BIGINT"


@query("f5_shuffled_split", f"""
WITH n AS (SELECT o_orderkey AS tile_id, row_number() OVER (ORDER BY {HASH.format('o_orderkey')}, o_orderkey) - 1 AS row_no FROM orders)
SELECT tile_id, row_no, CASE WHEN row_no < CAST(floor((SELECT count(*) FROM orders) * 0.8e0) AS BIGINT) THEN 'train' ELSE 'val' END AS side FROM n""")
def f5(spark, sf):
    return mlprep.shuffled_split(tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id")), "tile_id")


@query("f6_every_fifth", with_ctes(PAIRS, """
n AS (SELECT tile_id, row_number() OVER (ORDER BY tile_id) - 1 AS row_no FROM tl)""", select="""
SELECT tile_id, row_no, CASE WHEN row_no % 5 = 0 THEN 'val' ELSE 'train' END AS side FROM n WHERE tile_id || '_mask' IN (SELECT stem FROM fp WHERE folder = 'ann')"""))
def f6(spark, sf):
    masks = mask_files(spark, sf).filter("folder = 'ann' AND stem LIKE '%_mask'").select(
        F.regexp_replace("stem", "_mask$", "").alias("tile_id"))
    return mlprep.every_fifth(order_tiles(spark, sf), ["tile_id"], masks)


RICH = """
m AS (SELECT l_orderkey AS tile_id, bool_or(l_linenumber IN (1, 2)) AS rich FROM lineitem GROUP BY 1),
wt AS (SELECT o_orderkey AS tile_id, CASE WHEN rich THEN 5 ELSE 1 END AS weight FROM orders LEFT JOIN m ON m.tile_id = o_orderkey)
"""


def weighted_tiles(spark, sf):
    """Tiles with sampling weights; line numbers stand for mask classes."""
    tiles = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    mask = tb.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("tile_id"), F.col("l_linenumber").alias("class_id"))
    return mlprep.sample_weights(tiles, mask)


@query("f7_sample_weights", with_ctes(RICH, select="SELECT * FROM wt"))
def f7(spark, sf):
    return weighted_tiles(spark, sf)


@query("f7_weighted_draw", with_ctes(RICH, f"""
nm AS (SELECT tile_id, row_number() OVER (ORDER BY weight = 1, tile_id) - 1 AS pos FROM wt),
k AS (SELECT count(*) AS n, count(*) FILTER (weight > 1) AS h FROM wt),
dr AS (SELECT i AS draw, {HASH.format('i')} % (h * 5 + n - h) AS t, h FROM k, LATERAL (SELECT unnest(range(n)) AS i) r)""", select="""
SELECT draw, tile_id FROM dr JOIN nm ON pos = CASE WHEN t < h * 5 THEN t // 5 ELSE t - h * 5 + h END"""))
def f7_draw(spark, sf):
    return mlprep.weighted_draw(weighted_tiles(spark, sf))


REACH8 = """/*recursive*/
reach AS (
  SELECT source_id, pred, r * 100 + c AS root, r, c FROM msk WHERE pred BETWEEN 1 AND 4
  UNION
  SELECT n.source_id, n.pred, p.root, n.r, n.c FROM reach p JOIN msk n ON n.source_id = p.source_id AND n.pred = p.pred
   AND abs(n.r - p.r) <= 1 AND abs(n.c - p.c) <= 1),
comp AS (SELECT source_id, pred, r, c, min(root) AS root FROM reach GROUP BY ALL),
bx AS (SELECT source_id, pred, count(*) AS n, min(r) AS r0, max(r) AS r1, min(c) AS c0, max(c) AS c1 FROM comp GROUP BY source_id, pred, root)
"""


@query("f8_box_labels", with_ctes(MASKS, REACH8, select="""
SELECT source_id AS tile_id, (pred - 1) || ' ' || printf('%.6f %.6f %.6f %.6f', (c0 + (c1 - c0 + 1) / 2) / 8, (r0 + (r1 - r0 + 1) / 2) / 8,
       (c1 - c0 + 1) / 8, (r1 - r0 + 1) / 8) AS line FROM bx WHERE n >= 4"""))
def f8(spark, sf):
    mask = tb.masks(spark, sf).select(F.col("source_id").alias("tile_id"), "row", "col", F.col("pred").alias("class_id"))
    return mlprep.box_labels(mask, 8, 8, min_area=4).select("tile_id", "line")


@query("f8_label_totals", with_ctes(MASKS, REACH8, select="""
SELECT pred - 1 AS label, count(*) AS boxes FROM bx WHERE n >= 4 GROUP BY 1"""))
def f8_totals(spark, sf):
    mask = tb.masks(spark, sf).select(F.col("source_id").alias("tile_id"), "row", "col", F.col("pred").alias("class_id"))
    return mlprep.label_totals(mlprep.box_labels(mask, 8, 8, min_area=4))


@query("f9_ground_truth_tiles", with_ctes(LAYER, """
cells AS (SELECT source_id, r, c, max_by(class_id, feature_id) AS class_id FROM cls,
          LATERAL (SELECT unnest(range(y1, least(y2, 520))) AS r) a, LATERAL (SELECT unnest(range(x1, least(x2, 520))) AS c) b GROUP BY ALL),
w AS (SELECT source_id, y * 50 AS row_off, x * 50 AS col_off FROM (SELECT DISTINCT source_id FROM lay), range(11) a(y), range(11) b(x)
      WHERE least(64, 520 - y * 50) >= 40 AND least(64, 520 - x * 50) >= 40),
s AS (SELECT w.source_id, row_off, col_off, sum(class_id) AS class_sum, count(*) AS gt_pixels FROM w JOIN cells USING (source_id)
      WHERE r >= row_off AND r < row_off + 64 AND c >= col_off AND c < col_off + 64 GROUP BY ALL HAVING sum(class_id) >= 4000),
n AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY row_off, col_off) - 1 AS k FROM s)""", select="""
SELECT source_id, printf('real_gt_%05d', k) AS tile_id, row_off, col_off, class_sum::BIGINT AS class_sum, gt_pixels FROM n WHERE k < 50"""))
def f9(spark, sf):
    shapes = layers.classify_layers(tb.layer_polygons(spark, sf))
    frames = tb.layer_shapes(spark, sf).select("source_id").distinct() \
        .withColumn("height", F.lit(520)).withColumn("width", F.lit(520))
    windows = tiling.drop_slivers(tiling.padded_windows(frames, 64, 50), 40)
    hit = spatial_join.windows_hit(windows, shapes, 64, 50, ["source_id"]).drop("tile_id")
    cells = rasterize.rasterize(shapes, ["source_id"], "feature_id", "feature_id", "last", F.lit(520), F.lit(520))
    return mlprep.ground_truth_tiles(hit, cells, 64, 50, min_sum=4000, max_tiles=50).select(
        "source_id", "tile_id", "row_off", "col_off", "class_sum", "gt_pixels")


PSEUDO = LOGITS.strip() + """,
ps AS (SELECT tile_id, r, c, CASE WHEN 1 / es >= 0.35e0 THEN class_id ELSE 0 END AS cls FROM sm),
pv AS (SELECT tile_id, count(*) FILTER (cls <> 0) AS foreground FROM ps GROUP BY 1)
"""


def pseudo(spark, sf):
    """Pixel pseudo-labels at a threshold that splits the data."""
    return mlprep.pixel_pseudo_labels(fusion.classify_pixels(tb.logits(spark, sf)), prob_min=0.35, min_pixels=16)


@query("f10_pseudo_verdicts", with_ctes(PSEUDO, select="""
SELECT tile_id, foreground, foreground >= 16 AS accepted FROM pv"""))
def f10(spark, sf):
    return pseudo(spark, sf)[1]


@query("f10_pseudo_labels", with_ctes(PSEUDO, select="""
SELECT tile_id, r AS "row", c AS col, cls AS class_id FROM ps WHERE tile_id IN (SELECT tile_id FROM pv WHERE foreground >= 16)"""))
def f10_labels(spark, sf):
    return pseudo(spark, sf)[0].select("tile_id", "row", "col", "class_id")


@query("f11_tile_pseudo_labels", with_ctes(LOGITS, """
ok AS (SELECT tile_id FROM sm GROUP BY 1 HAVING avg(1 / es) >= 0.322e0)""", select="""
SELECT tile_id, class_id, count(*) AS pixels FROM sm WHERE tile_id IN (SELECT tile_id FROM ok) GROUP BY ALL"""))
def f11(spark, sf):
    classified = fusion.classify_pixels(tb.logits(spark, sf))
    kept = mlprep.tile_pseudo_labels(fusion.segmentation_stats(classified), classified, conf_min=0.322)
    return kept.groupBy("tile_id", "class_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("f12_ground_truth_info", with_ctes(MASKS, """
m AS (SELECT source_id, max(CASE WHEN source_id % 4 = 0 THEN 0 ELSE target END) AS mx FROM msk GROUP BY 1)""", select="""
SELECT o_orderkey AS tile_id, coalesce(mx, 1) AS gt_label, coalesce(mx > 0, true) AS gt_has_object,
       CASE WHEN mx IS NULL THEN 0e0 ELSE 1e0 END AS gt_iou, mx IS NULL AS gt_needs_refinement FROM orders LEFT JOIN m ON source_id = o_orderkey"""))
def f12(spark, sf):
    tiles = tb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("tile_id"))
    mask = tb.masks(spark, sf).select(
        F.col("source_id").alias("tile_id"), F.when(F.col("source_id") % 4 == 0, 0).otherwise(F.col("target")).alias("class_id"))
    return mlprep.ground_truth_info(tiles, mask)


def records(spark, sf):
    """Fusion training records of the images."""
    tiles = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("tile_id"))
    whole = F.flatten(F.array_repeat(F.col("embedding"), 12))
    seg = tb.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("tile_id"), whole.alias("seg_features"))
    dets = tb.detections(spark, sf).filter(F.col("confidence") >= fixed.DETECTION_CONFIDENCE_MIN)
    stats = fusion.segmentation_stats(fusion.classify_pixels(tb.logits(spark, sf)))
    truth = mlprep.ground_truth_info(tiles, tb.masks(spark, sf).select(
        F.col("source_id").alias("tile_id"), F.when(F.col("source_id") % 4 == 0, 0).otherwise(F.col("label") % 6)
        .alias("class_id")))
    pts = tb.points(spark, sf)
    heights = rules.heights_from_points(pts, pts.select("tile_id", F.floor("y").alias("row"), F.floor("x").alias("col")), bounded=True)
    return mlprep.fusion_records(tiles, seg, detections.feature_vectors(tiles, dets), detections.summary(dets), heights,
                                 stats, truth)


@query("f13_fusion_records", with_ctes(LOGITS, DETS, PTS, HEIGHT_STATS, """
ss AS (SELECT tile_id, avg(1 / es) AS conf, count(*) FILTER (class_id = 1) AS area FROM sm GROUP BY 1),
ds AS (SELECT tile_id, count(*) AS n, max(confidence) AS m FROM det WHERE confidence >= 0.25e0 GROUP BY 1)""", select="""
SELECT vec_id AS tile_id, 768 + 63 + 3 + 4 AS dims, round(conf, 6) AS swin_confidence, coalesce(n, 0) AS yolo_count, coalesce(m, 0e0) AS yolo_max_conf,
       round(CAST(CAST(coalesce(zm, 0) AS FLOAT) AS DOUBLE), 4) AS z_mean, CAST(area AS DOUBLE) AS mask_area,
       CASE WHEN vec_id % 4 = 0 THEN 0 ELSE label % 6 END AS gt_label,
       CASE WHEN vec_id % 4 = 0 THEN false ELSE label % 6 > 0 END AS gt_has_object,
       false AS gt_needs_refinement
FROM embeddings LEFT JOIN ss ON ss.tile_id = vec_id LEFT JOIN ds ON ds.tile_id = vec_id LEFT JOIN hts ON hts.tile_id = vec_id"""))
def f13(spark, sf):
    parts = ("swin_features", "yolo_features", "depth_features", "mask_stats")
    dims = sum((F.size(p) for p in parts), F.lit(0))
    return records(spark, sf).select(
        "tile_id", dims.cast("long").alias("dims"), F.round("swin_confidence", 6).alias("swin_confidence"), "yolo_count",
        "yolo_max_conf", F.round(F.get("depth_features", F.lit(0)).cast("double"), 4).alias("z_mean"),
        F.get("mask_stats", F.lit(0)).cast("double").alias("mask_area"), "gt_label", "gt_has_object", "gt_needs_refinement")


@query("f14_fusion_training")
def f14(spark, sf):
    rows = mlprep.checked_record(records(spark, sf))
    _, table = fusion_train.cross_validate(rows, 2, hidden=8, max_iter=10)
    return table


@query("f15_checked_records", """
WITH e AS (SELECT vec_id AS tile_id, vec_id % 5 = 0 AS short, embedding FROM embeddings)
SELECT tile_id, 838 AS dims, CASE WHEN short THEN 0e0 ELSE round(12 * list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) END AS total,
       1e0 AS accept, 0e0 AS refine, 1 AS class_id, 0.5e0 AS confidence FROM e""")
def f15(spark, sf):
    whole = F.flatten(F.array_repeat(F.col("embedding"), 12))
    raw = tb.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("tile_id"), F.when(F.col("vec_id") % 5 == 0, F.col("embedding")).otherwise(whole).alias("swin_features"),
        F.array(F.lit(1.0)).alias("yolo_features"), F.lit(None).cast("array<float>").alias("depth_features"),
        F.lit(None).cast("array<float>").alias("mask_stats"), F.lit(None).cast("boolean").alias("gt_has_object"),
        F.lit(None).cast("boolean").alias("gt_needs_refinement"), F.lit(None).cast("int").alias("gt_label"),
        F.lit(None).cast("double").alias("gt_iou"))
    total = F.aggregate("features", F.lit(0.0), lambda acc, v: acc + v.cast("double"))
    return mlprep.checked_record(raw).select(
        "tile_id", F.size("features").cast("long").alias("dims"), F.round(total, 4).alias("total"), "accept", "refine",
        "class_id", "confidence")


@query("f16_clamped_classes", with_ctes(MASKS, select="""
SELECT greatest(0, least(b0 % 9 - 1, 5)) AS class_id, count(*) AS pixels FROM msk GROUP BY 1"""))
def f16(spark, sf):
    raw = tb.masks(spark, sf).select((F.col("b0") % 9 - 1).alias("class_id"))
    return mlprep.clamp_classes(raw).groupBy("class_id").agg(F.count(F.lit(1)).alias("pixels"))


@query("f17_flagged_tiles", with_ctes(DEC, FEEDBACK, select="""
SELECT tile_id FROM dec WHERE refine_flag UNION SELECT tile_id FROM fb WHERE original_class <> corrected_class"""))
def f17(spark, sf):
    return mlprep.flagged_tiles(tb.decisions(spark, sf), tb.feedback(spark, sf))
