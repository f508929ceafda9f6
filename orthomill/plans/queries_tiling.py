"""Queries on window grids and raster filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthomill.operators import morphology, tiling, variance
from orthomill.plans import preprocess
from orthomill.plans.base_sql import MPX, PX, RAS
from orthomill.plans.registry import query, with_ctes
from orthomill.sources import testbed as tb

WIN = RAS.strip() + """,
win AS (
  SELECT ras.*, y * 448 AS row_off, x * 448 AS col_off, y * CAST(ceil(w / 448e0) AS BIGINT) + x AS tile_index,
         least(512, h - y * 448) AS win_h, least(512, w - x * 448) AS win_w
  FROM ras, LATERAL (SELECT unnest(range((h - 1) // 448 + 1)) AS y) a,
       LATERAL (SELECT unnest(range((w - 1) // 448 + 1)) AS x) b)
"""


@query("b1_padded_windows", with_ctes(WIN, select="""
SELECT source_id || printf('_t%05d', tile_index) AS tile_id, tile_index, row_off, col_off, win_h, win_w,
       win_h < 512 OR win_w < 512 AS padded FROM win"""))
def b1(spark, sf):
    return tiling.padded_windows(tb.rasters(spark, sf)).select(
        "tile_id", "tile_index", "row_off", "col_off", "win_h", "win_w", "padded")


@query("b2_multi_size_counts", with_ctes(RAS, select="""
SELECT s AS tile_size, sum(((h - 1) // 448 + 1) * ((w - 1) // 448 + 1))::BIGINT AS tiles
FROM ras, (VALUES (512), (640)) v(s) GROUP BY s"""))
def b2(spark, sf):
    return tiling.window_counts(tiling.multi_size_windows(tb.rasters(spark, sf)))


@query("b3_clamped_windows", with_ctes(RAS, select="""
SELECT source_id, row_off, col_off,
       row_number() OVER (PARTITION BY source_id ORDER BY row_off, col_off) - 1 AS window_no
FROM (SELECT DISTINCT source_id, least(y * 448, greatest(0, h - 512)) AS row_off,
             least(x * 448, greatest(0, w - 512)) AS col_off
      FROM ras, LATERAL (SELECT unnest(range((greatest(1, h - 512 + 448) - 1) // 448 + 1)) AS y) a,
           LATERAL (SELECT unnest(range((greatest(1, w - 512 + 448) - 1) // 448 + 1)) AS x) b)"""))
def b3(spark, sf):
    return tiling.clamped_windows(tb.rasters(spark, sf)).select("source_id", "row_off", "col_off", "window_no")


@query("b4_half_tile_windows", with_ctes(WIN, select="""
SELECT source_id, row_off, col_off, win_h, win_w, win_h >= 400 AND win_w >= 400 AS wide
FROM win WHERE win_h >= 256 AND win_w >= 256"""))
def b4(spark, sf):
    kept = tiling.drop_slivers(tiling.padded_windows(tb.rasters(spark, sf)))
    return kept.select("source_id", "row_off", "col_off", "win_h", "win_w",
                       ((F.col("win_h") >= 400) & (F.col("win_w") >= 400)).alias("wide"))


@query("b5_overlap_crops", with_ctes(RAS, select="""
SELECT source_id || '_' || (y * 520) || '_' || (x * 520) AS crop_name, least(640, h - y * 520) AS win_h,
       least(640, w - x * 520) AS win_w
FROM ras, LATERAL (SELECT unnest(range((h - 1) // 520 + 1)) AS y) a,
     LATERAL (SELECT unnest(range((w - 1) // 520 + 1)) AS x) b"""))
def b5(spark, sf):
    return tiling.overlap_crops(tb.rasters(spark, sf)).select("crop_name", "win_h", "win_w")


MWIN = MPX.strip() + """,
mwin AS (
  SELECT mras.*, y * 28 AS row_off, x * 28 AS col_off, y * 6 + x AS tile_index
  FROM mras, LATERAL (SELECT unnest(range((h - 1) // 28 + 1)) AS y) a, (SELECT unnest(range(6)) AS x) b),
asg AS (
  SELECT mpx.*, row_off, col_off FROM mpx JOIN mwin USING (source_id)
  WHERE r >= row_off AND r < row_off + 32 AND c >= col_off AND c < col_off + 32)
"""


@query("b6_window_pixels", with_ctes(MWIN, select="""
SELECT source_id, row_off, col_off, count(*) AS pixels, sum(b0)::BIGINT AS b0_sum, max(r - row_off) AS last_row
FROM asg GROUP BY ALL"""))
def b6(spark, sf):
    assigned = tiling.assign_windows(tb.mosaic_pixels(spark, sf), 32, 28)
    return assigned.groupBy("source_id", "row_off", "col_off").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("b0").alias("b0_sum"),
        F.max(F.col("row") - F.col("row_off")).alias("last_row"))


@query("b7_tile_transform", with_ctes(WIN, select="""
SELECT source_id, tile_index, tx + col_off * 0.5e0 AS origin_x, ty - row_off * 0.5e0 AS origin_y, 0.5e0 AS pixel_w
FROM win"""))
def b7(spark, sf):
    tiles = tiling.with_tile_transform(tiling.padded_windows(tb.rasters(spark, sf)))
    return tiles.select("source_id", "tile_index", F.get("tile_transform", 2).alias("origin_x"),
                        F.get("tile_transform", 5).alias("origin_y"), F.get("tile_transform", 0).alias("pixel_w"))


@query("b8_tile_bounds", with_ctes(WIN, select="""
SELECT source_id, tile_index, ty - (row_off + win_h) * 0.5e0 AS min_y, tx + col_off * 0.5e0 AS min_x,
       ty - row_off * 0.5e0 AS max_y, tx + (col_off + win_w) * 0.5e0 AS max_x FROM win"""))
def b8(spark, sf):
    tiles = tiling.with_tile_bounds(tiling.padded_windows(tb.rasters(spark, sf)))
    return tiles.select("source_id", "tile_index", "bounds.*")


VAR = PX.strip() + """,
g AS (SELECT source_id, r, c, b0 + b1 + b2 AS v FROM px),
gl AS (SELECT source_id, count(*) AS n, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE)
                / (9 * CAST(count(*) AS DOUBLE) * count(*)) AS gv FROM g GROUP BY 1),
blk AS (SELECT source_id, r // 3 AS br, c // 3 AS bc,
               CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (9 * CAST(count(*) AS DOUBLE) * count(*)) AS bv
        FROM g GROUP BY ALL HAVING count(*) = 9),
loc AS (SELECT source_id, median(bv) AS lv FROM blk GROUP BY 1),
st AS (SELECT source_id, gv, lv FROM gl JOIN loc USING (source_id))
"""


@query("b9_global_variance", with_ctes(VAR, select="""
SELECT source_id, round(gv, 6) AS global_variance FROM gl"""))
def b9(spark, sf):
    return variance.global_variance(tb.pixels(spark, sf), ["source_id"]).select(
        "source_id", F.round("global_variance", 6).alias("global_variance"))


@query("b10_local_variance", with_ctes(VAR, select="""
SELECT source_id, round(gv, 6) AS global_variance, round(lv, 6) AS local_variance FROM st"""))
def b10(spark, sf):
    return variance.tile_variance(tb.pixels(spark, sf), ["source_id"], 3, whole_tile=True).select(
        "source_id", F.round("global_variance", 6).alias("global_variance"),
        F.round("local_variance", 6).alias("local_variance"))


@query("b10_raster_variance", with_ctes(MPX, """
g AS (SELECT source_id, r, c, b0 + b1 + b2 AS v FROM mpx),
gl AS (SELECT source_id, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (9 * CAST(count(*) AS DOUBLE) * count(*)) AS gv FROM g GROUP BY 1),
blk AS (SELECT source_id, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE) / (9 * CAST(count(*) AS DOUBLE) * count(*)) AS bv
        FROM g GROUP BY source_id, r // 5, c // 5 HAVING count(*) = 25),
loc AS (SELECT source_id, median(bv) AS lv FROM blk GROUP BY 1)""", select="""
SELECT source_id, round(gv, 6) AS global_variance, round(lv, 6) AS local_variance FROM gl JOIN loc USING (source_id)"""))
def b10_rasters(spark, sf):
    return variance.tile_variance(tb.mosaic_pixels(spark, sf), ["source_id"], 5).select(
        "source_id", F.round("global_variance", 6).alias("global_variance"),
        F.round("local_variance", 6).alias("local_variance"))


@query("b11_variance_decision", with_ctes(VAR, select="""
SELECT source_id, round(gv, 6) AS global_variance, round(lv, 6) AS local_variance,
       NOT (gv < 125e0 AND lv < 110e0) AS accepted,
       CASE WHEN gv < 125e0 AND lv < 110e0 THEN 'low_variance' ELSE 'accepted' END AS reason
FROM st"""))
def b11(spark, sf):
    stats = variance.tile_variance(tb.pixels(spark, sf), ["source_id"], 3, whole_tile=True)
    return variance.variance_decision(stats, 125.0, 110.0).select(
        "source_id", F.round("global_variance", 6).alias("global_variance"),
        F.round("local_variance", 6).alias("local_variance"), "accepted", "reason")


@query("b12_variance_summary", with_ctes(VAR, """
spine AS (SELECT vec_id AS source_id FROM embeddings UNION ALL SELECT -1 - vec_id FROM embeddings WHERE vec_id % 10 = 0),
d AS (SELECT spine.source_id, CASE WHEN gv IS NULL THEN 'load_error' WHEN gv < 125e0 AND lv < 110e0
             THEN 'low_variance' ELSE 'accepted' END AS reason FROM spine LEFT JOIN st USING (source_id))""", select="""
SELECT count(*) AS total, count(*) FILTER (reason = 'accepted') AS accepted,
       count(*) FILTER (reason <> 'accepted') AS rejected, count(*) FILTER (reason = 'load_error') AS load_errors
FROM d"""))
def b12(spark, sf):
    stats = variance.tile_variance(tb.pixels(spark, sf), ["source_id"], 3, whole_tile=True)
    images = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("source_id"))
    spine = images.unionByName(images.filter("source_id % 10 = 0").select((-1 - F.col("source_id")).alias("source_id")))  # no such images
    decided = variance.with_load_errors(variance.variance_decision(stats, 125.0, 110.0), spine, ["source_id"])
    return variance.variance_summary(decided)


MSTAT = MWIN.strip() + """,
mblk AS (SELECT source_id, row_off, col_off, (r - row_off) // 10 AS br, (c - col_off) // 10 AS bc,
                sum(b0 + b1 + b2) AS s, sum((b0 + b1 + b2) * (b0 + b1 + b2)) AS q FROM asg GROUP BY ALL),
mglob AS (SELECT source_id, row_off, col_off,
                 CAST(1024 * sum(q) - sum(s) * sum(s) AS DOUBLE) / (9e0 * 1024 * 1024) AS gv FROM mblk GROUP BY ALL),
mloc AS (SELECT source_id, row_off, col_off, median(coalesce(bv, 0e0)) AS lv FROM
         (SELECT w.source_id, w.row_off, w.col_off, CAST(100 * q - s * s AS DOUBLE) / (9e0 * 100 * 100) AS bv
          FROM mwin w CROSS JOIN (SELECT i // 3 AS br, i % 3 AS bc FROM range(9) t(i)) k
          LEFT JOIN mblk USING (source_id, row_off, col_off, br, bc)) GROUP BY ALL),
mstat AS (SELECT * FROM mglob JOIN mloc USING (source_id, row_off, col_off)),
ov AS (SELECT source_id, r // 2 AS r, c // 2 AS c, h // 2 AS oh, w // 2 AS ow, b0, b1, b2 FROM mpx JOIN mras USING (source_id)
       WHERE r % 2 = 1 AND c % 2 = 1)
"""


def closed_sql(above: int) -> str:
    """SQL of the closed mask of overview cells with b0 above a value."""
    return f"""
seed AS (SELECT source_id, r, c, oh, ow FROM ov WHERE b0 > {above}),
offs AS (SELECT i // 5 - 2 AS dr, i % 5 - 2 AS dc FROM range(25) t(i)),
dil AS (SELECT DISTINCT source_id, r + dr AS r, c + dc AS c, oh, ow FROM seed, offs
        WHERE r + dr BETWEEN 0 AND oh - 1 AND c + dc BETWEEN 0 AND ow - 1),
clo AS (SELECT source_id, r, c, oh, ow FROM
        (SELECT source_id, r + dr AS r, c + dc AS c, oh, ow, count(*) AS n FROM dil, offs
         WHERE r + dr BETWEEN 0 AND oh - 1 AND c + dc BETWEEN 0 AND ow - 1 GROUP BY ALL)
        WHERE n = (least(oh - 1, r + 2) - greatest(0, r - 2) + 1) * (least(ow - 1, c + 2) - greatest(0, c - 2) + 1))
"""


ISL = """/*recursive*/
reach AS (
  SELECT source_id, r * 100000 + c AS root, r, c FROM clo
  UNION
  SELECT n.source_id, p.root, n.r, n.c FROM reach p JOIN clo n ON n.source_id = p.source_id
   AND abs(n.r - p.r) + abs(n.c - p.c) = 1),
comp AS (SELECT source_id, r, c, min(root) AS root FROM reach GROUP BY ALL),
isl AS (SELECT source_id, root, count(*) AS pixels, min(r) AS min_row, max(r) AS max_row, min(c) AS min_col,
               max(c) AS max_col, row_number() OVER (PARTITION BY source_id ORDER BY root) AS island_no
        FROM comp GROUP BY source_id, root)
"""


def overview_cells(spark, sf, above):
    """Valid cells of the mosaics' half-size overview."""
    sampled = morphology.overview(tb.mosaic_pixels(spark, sf), tb.mosaic_rasters(spark, sf), 2)
    return morphology.valid_first_band(sampled, above).select(
        "source_id", F.col("over_row").alias("row"), F.col("over_col").alias("col"), "over_h", "over_w")


@query("b12_windowed_preprocess", with_ctes(MSTAT, closed_sql(170), """
hit AS (SELECT DISTINCT w.source_id, row_off, col_off FROM mwin w JOIN clo ON clo.source_id = w.source_id
        AND r * 2 <= row_off + 32 AND (r + 1) * 2 >= row_off AND c * 2 <= col_off + 32 AND (c + 1) * 2 >= col_off),
kept AS (SELECT w.* FROM mwin w LEFT JOIN hit USING (source_id, row_off, col_off)
         WHERE (hit.source_id IS NOT NULL OR w.source_id NOT IN (SELECT source_id FROM clo))
           AND least(32, h - row_off) >= 16 AND least(32, w - col_off) >= 16),
acc AS (SELECT kept.*, gv, lv, row_number() OVER (PARTITION BY source_id ORDER BY row_off, col_off) - 1 AS n
        FROM kept JOIN mstat USING (source_id, row_off, col_off) WHERE NOT (gv < 84e0 AND lv < 80e0))""", select="""
SELECT source_id || printf('_t%05d', n) AS tile_id, row_off, col_off, round(gv, 6) AS global_variance,
       round(lv, 6) AS local_variance, 500000 + col_off * 2e0 AS min_x, 2000000 - row_off * 2e0 AS max_y
FROM acc"""))
def b12_flagship(spark, sf):
    judged = preprocess.windowed_preprocess(
        tb.mosaic_pixels(spark, sf), tb.mosaic_rasters(spark, sf), 32, 28, 10, 84.0, 80.0, 2, 170)
    return preprocess.accepted_tiles(judged).select(
        "tile_id", "row_off", "col_off", F.round("global_variance", 6).alias("global_variance"),
        F.round("local_variance", 6).alias("local_variance"), "bounds.min_x", "bounds.max_y")


@query("b13_gatekeeper", with_ctes(PX, """
y AS (SELECT source_id, CAST(floor(0.299e0 * b0 + 0.587e0 * b1 + 0.114e0 * b2 + 0.5e0) AS BIGINT) AS v FROM px),
gk AS (SELECT source_id, CAST(count(*) * sum(v * v) - sum(v) * sum(v) AS DOUBLE)
              / (1e0 * count(*) * count(*)) AS lv FROM y GROUP BY 1)""", select="""
SELECT source_id, round(lv, 6) AS luma_variance, lv >= 100e0 AS keep FROM gk"""))
def b13(spark, sf):
    return variance.gatekeeper(tb.pixels(spark, sf), ["source_id"]).withColumn(
        "luma_variance", F.round("luma_variance", 6))


@query("b14_valid_data_filter", with_ctes(PX, """
z AS (SELECT source_id, greatest(b0 - 120, 0) AS b0, greatest(b1 - 140, 0) AS b1, greatest(b2 - 150, 0) AS b2 FROM px),
s AS (SELECT source_id, count(*) AS n, count(*) FILTER (greatest(b0, b1, b2) > 0) AS valid, sum(b0 + b1 + b2) AS s,
             sum(b0 * b0 + b1 * b1 + b2 * b2) AS q FROM z GROUP BY 1),
v AS (SELECT source_id, valid / n AS share, CAST(3 * n * q - s * s AS DOUBLE) / (9e0 * n * n) AS var FROM s)""", select="""
SELECT source_id, round(share, 6) AS valid_share, round(var, 6) AS stacked_variance,
       CASE WHEN share < 0.7e0 THEN 'empty' WHEN var < 70e0 THEN 'flat' ELSE 'accepted' END AS reason FROM v"""))
def b14(spark, sf):
    dark = tb.pixels(spark, sf)
    for band, cut in (("b0", 120), ("b1", 140), ("b2", 150)):
        dark = dark.withColumn(band, F.greatest(F.col(band) - cut, F.lit(0)))
    out = variance.valid_data_filter(dark, ["source_id"], 0.7, 70.0)
    return out.withColumn("valid_share", F.round("valid_share", 6)).withColumn(
        "stacked_variance", F.round("stacked_variance", 6))


@query("b15_accepted_numbering", with_ctes(MSTAT, """
n AS (SELECT source_id, row_off, col_off,
             row_number() OVER (PARTITION BY source_id ORDER BY row_off, col_off) - 1 AS accepted_index
      FROM mstat WHERE NOT (gv < 84e0 AND lv < 80e0))""", select="SELECT * FROM n WHERE accepted_index < 25"))
def b15(spark, sf):
    stats = variance.padded_window_variance(tb.mosaic_pixels(spark, sf), ["source_id"], 32, 28, 10)
    judged = variance.variance_decision(stats, 84.0, 80.0)
    return variance.number_accepted(judged, max_tiles=25).select(
        "source_id", "row_off", "col_off", "accepted_index")


@query("b16_overview", with_ctes(MPX, """
shp AS (SELECT *, CAST(floor(h * least(1e0, 75e0 / greatest(h, w))) AS BIGINT) AS oh,
               CAST(floor(w * least(1e0, 75e0 / greatest(h, w))) AS BIGINT) AS ow FROM mras),
rr AS (SELECT source_id, i AS over_row, CAST(floor((i + 0.5e0) * (h / oh)) AS BIGINT) AS r FROM shp, range(75) t(i) WHERE i < oh),
cc AS (SELECT source_id, i AS over_col, CAST(floor((i + 0.5e0) * (w / ow)) AS BIGINT) AS c FROM shp, range(75) t(i) WHERE i < ow)""",
       select="""
SELECT source_id, over_row, over_col, b0 FROM mpx JOIN rr USING (source_id, r) JOIN cc USING (source_id, c)"""))
def b16(spark, sf):
    return morphology.overview(tb.mosaic_pixels(spark, sf), tb.mosaic_rasters(spark, sf), max_side=75).select(
        "source_id", "over_row", "over_col", "b0")


@query("b17_valid_mask", with_ctes(PX, select="""
SELECT source_id, count(*) FILTER (b0 > 150) AS first_band, count(*) FILTER (greatest(b0, b1, b2) > 150) AS any_band
FROM px GROUP BY 1 HAVING count(*) FILTER (greatest(b0, b1, b2) > 150) > 0"""))
def b17(spark, sf):
    shown = morphology.valid_any_band(tb.pixels(spark, sf), 150)
    return shown.groupBy("source_id").agg(
        F.count_if(F.col("b0") > 150).alias("first_band"), F.count(F.lit(1)).alias("any_band"))


@query("b18_closing", with_ctes(MSTAT, closed_sql(155), select='SELECT source_id, r AS "row", c AS col FROM clo'))
def b18(spark, sf):
    return morphology.close_mask(overview_cells(spark, sf, 155)).select("source_id", "row", "col")


@query("b19_islands", with_ctes(MSTAT, closed_sql(155), ISL, """
big AS (SELECT *, max(pixels) OVER (PARTITION BY source_id) AS largest FROM isl)""", select="""
SELECT source_id, printf('region_%02d', island_no) AS island_id, pixels, min_row, max_row, min_col, max_col
FROM big WHERE pixels > largest * 0.05e0"""))
def b19(spark, sf):
    _, table = morphology.islands(morphology.close_mask(overview_cells(spark, sf, 155)), 0.05, chunk=16)
    return table.select("source_id", "island_id", "pixels", "min_row", "max_row", "min_col", "max_col")


@query("b20_windows_on_islands", with_ctes(MSTAT, closed_sql(170), """
hit AS (SELECT DISTINCT w.source_id, row_off, col_off FROM mwin w JOIN clo ON clo.source_id = w.source_id
        AND r * 2 <= row_off + 32 AND (r + 1) * 2 >= row_off AND c * 2 <= col_off + 32 AND (c + 1) * 2 >= col_off)""",
       select="""
SELECT w.source_id, row_off, col_off FROM mwin w LEFT JOIN hit USING (source_id, row_off, col_off)
WHERE hit.source_id IS NOT NULL OR w.source_id NOT IN (SELECT source_id FROM clo)"""))
def b20(spark, sf):
    windows = tiling.padded_windows(tb.mosaic_rasters(spark, sf), 32, 28)
    cells = morphology.close_mask(overview_cells(spark, sf, 170))
    return morphology.windows_on_islands(windows, cells, 32, 28, 2).select("source_id", "row_off", "col_off")


@query("b21_region_crops", with_ctes(MSTAT, closed_sql(155), ISL, select="""
SELECT p.source_id, printf('region_%02d', island_no) AS island_id, count(*) AS pixels, sum(b0)::BIGINT AS b0_sum,
       max(p.r - min_row * 2) AS last_row, max(p.c - min_col * 2) AS last_col
FROM mpx p JOIN comp ON comp.source_id = p.source_id AND comp.r = p.r // 2 AND comp.c = p.c // 2
JOIN isl ON isl.source_id = comp.source_id AND isl.root = comp.root GROUP BY ALL"""))
def b21(spark, sf):
    cells, table = morphology.islands(morphology.close_mask(overview_cells(spark, sf, 155)), chunk=16)
    shape = morphology.overview_shape(tb.mosaic_rasters(spark, sf), 2)
    crops = morphology.crop_regions(tb.mosaic_pixels(spark, sf), shape, cells, table)
    return crops.groupBy("source_id", "island_id").agg(
        F.count(F.lit(1)).alias("pixels"), F.sum("b0").alias("b0_sum"),
        F.max("region_row").alias("last_row"), F.max("region_col").alias("last_col"))


@query("b22_mask_slices", with_ctes(MPX, """
tl AS (SELECT source_id AS region, y * 37 AS y1, x * 37 AS x1, least(y * 37 + 50, h) AS y2, least(x * 37 + 50, w) AS x2
       FROM mras, LATERAL (SELECT unnest(range((h - 1) // 37 + 1)) AS y) a, (SELECT unnest(range(5)) AS x) b)""",
       select="""
SELECT region || '_' || y1 || '_' || x1 AS tile_id, count(*) AS cells, sum(b0 % 6)::BIGINT AS class_sum,
       max(r - y1) AS last_row, max(c - x1) AS last_col
FROM tl JOIN mpx ON source_id = region AND r >= y1 AND r < y2 AND c >= x1 AND c < x2
WHERE b0 % 6 > 0 GROUP BY ALL"""))
def b22(spark, sf):
    windows = tiling.padded_windows(tb.mosaic_rasters(spark, sf), 50, 37)
    tiles = windows.select(
        F.concat_ws("_", "source_id", "row_off", "col_off").alias("tile_id"), F.col("source_id").alias("region"),
        F.array("row_off", "col_off", F.col("row_off") + F.col("win_h"), F.col("col_off") + F.col("win_w"))
        .alias("pixel_bounds"))
    mask = tb.mosaic_pixels(spark, sf).select(
        F.col("source_id").alias("region"), "row", "col", (F.col("b0") % 6).alias("class_id")).filter("class_id > 0")
    return morphology.slice_masks(tiles, mask, block=64).groupBy("tile_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("class_id").alias("class_sum"),
        F.max("row").alias("last_row"), F.max("col").alias("last_col"))


@query("b23_preprocess_summary", with_ctes(MSTAT, """
gt AS (SELECT source_id, row_off, col_off, sum(b0 % 6) AS gt_sum FROM asg WHERE b0 > 172 GROUP BY ALL),
j AS (SELECT source_id, NOT (gv < 84e0 AND lv < 80e0) AS accepted, coalesce(gt_sum, 0) AS gt_sum
      FROM mstat LEFT JOIN gt USING (source_id, row_off, col_off))""", select="""
SELECT source_id, count(*) AS total_windows, count(*) FILTER (accepted) AS accepted,
       count(*) FILTER (NOT accepted) AS rejected, count(*) FILTER (accepted AND gt_sum > 0) AS with_gt
FROM j GROUP BY ROLLUP (source_id)"""))
def b23(spark, sf):
    pixels = tb.mosaic_pixels(spark, sf)
    judged = variance.variance_decision(
        variance.padded_window_variance(pixels, ["source_id"], 32, 28, 10), 84.0, 80.0)
    mask = pixels.filter("b0 > 172").select("source_id", "row", "col", (F.col("b0") % 6).alias("class_id"))
    return variance.preprocess_summary(preprocess.ground_truth_sums(judged, mask, 32, 28))
