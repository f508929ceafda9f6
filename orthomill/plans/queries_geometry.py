"""Queries on geometry, spatial joins and raster/vector conversion."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators import components, rasterize, spatial_join, tiling, vectorize, views
from orthomill.plans.base_sql import LAYER, MASKS, RAS
from orthomill.plans.registry import query, with_ctes
from orthomill.session import spread
from orthomill.sources import layers
from orthomill.sources import testbed as tb


@query("c1_pixel_to_geo", """
SELECT l_orderkey, l_linenumber, round(500000 + 0.5e0 * l_partkey + 0.25e0 * l_suppkey, 6) AS x,
       round(2000000 - 0.125e0 * l_partkey - 0.5e0 * l_suppkey, 6) AS y FROM lineitem""")
def c1(spark, sf):
    affine = F.array(*[F.lit(v) for v in (0.5, 0.25, 500000.0, -0.125, -0.5, 2000000.0)])
    p = geo.pixel_to_geo(F.col("l_partkey"), F.col("l_suppkey"), affine)
    return tb.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(p["x"], 6).alias("x"), F.round(p["y"], 6).alias("y"))


@query("c2_box_polygon", with_ctes(LAYER, select="""
SELECT feature_id, 'POLYGON ((' || x2 || ' ' || y1 || ', ' || x2 || ' ' || y2 || ', ' || x1 || ' ' || y2 || ', '
       || x1 || ' ' || y1 || ', ' || x2 || ' ' || y1 || '))' AS wkt FROM lay"""))
def c2(spark, sf):
    return tb.layer_polygons(spark, sf).select("feature_id", geo.to_wkt(F.col("rings")).alias("wkt"))


def _sum_sql(coefficients, form):
    return " + ".join(f"({k!r}::DOUBLE) * {form.format(j=2 * j)}" for j, k in enumerate(coefficients, 1))


UTM = f"""
raw AS (SELECT feature_id, CASE WHEN feature_id % 3 = 0 THEN 43 ELSE 44 END AS zone,
               400000e0 + x1 * 100 AS e, 2000000e0 + y1 * 1000 AS n FROM lay),
k1 AS (SELECT *, n / {geo._RECTIFYING!r}::DOUBLE AS xi, (e - 500000e0) / {geo._RECTIFYING!r}::DOUBLE AS eta FROM raw),
k2 AS (SELECT feature_id, zone,
              xi - ({_sum_sql(geo.TO_GEO, 'sin({j} * xi) * cosh({j} * eta)')}) AS xi,
              eta - ({_sum_sql(geo.TO_GEO, 'cos({j} * xi) * sinh({j} * eta)')}) AS eta FROM k1),
k3 AS (SELECT feature_id, zone, asin(sin(xi) / cosh(eta)) AS chi, atan2(sinh(eta), cos(xi)) AS lam FROM k2)
"""


@query("c3_reproject", with_ctes(LAYER, UTM, select=f"""
SELECT feature_id, round(zone * 6 - 183 + degrees(lam), 7) AS lon,
       round(degrees(chi + {_sum_sql(geo.TO_LATITUDE, 'sin({j} * chi)')}), 7) AS lat FROM k3"""))
def c3(spark, sf):
    shapes = tb.layer_shapes(spark, sf)
    ring = F.array(F.array(geo.point(400000.0 + F.col("x1") * 100, 2000000.0 + F.col("y1") * 1000)))
    crs = F.when(F.col("feature_id") % 3 == 0, F.lit("EPSG:32643"))
    return shapes.withColumn("g", geo.reproject(ring, crs, fixed.EXPORT_CRS)).select(
        "feature_id", F.round(F.get(F.get("g", 0), 0)["x"], 7).alias("lon"),
        F.round(F.get(F.get("g", 0), 0)["y"], 7).alias("lat"))


@query("c4_bounds_degrees", with_ctes(LAYER, UTM, f"""
b AS (SELECT feature_id, degrees(chi + {_sum_sql(geo.TO_LATITUDE, 'sin({j} * chi)')}) AS lat,
             zone * 6 - 183 + degrees(lam) AS lon FROM k3)""", select="""
SELECT lay.feature_id, round(CASE WHEN y1 % 2 = 1 THEN y1 ELSE lat END, 7) AS min_y,
       round(CASE WHEN y1 % 2 = 1 THEN x1 ELSE lon END, 7) AS min_x, y1 % 2 = 0 AS projected
FROM lay JOIN b USING (feature_id)"""))
def c4(spark, sf):
    shapes = tb.layer_shapes(spark, sf)
    odd = F.col("y1") % 2 == 1
    y = F.when(odd, F.col("y1")).otherwise(2000000.0 + F.col("y1") * 1000)
    x = F.when(odd, F.col("x1")).otherwise(400000.0 + F.col("x1") * 100)
    b = F.struct(y.alias("min_y"), x.alias("min_x"), (y + 10).alias("max_y"), (x + 10).alias("max_x"))
    crs = F.when(F.col("feature_id") % 3 != 0, F.lit("EPSG:32644"))
    return shapes.withColumn("b", geo.bounds_to_wgs84(b, crs, fixed.DEFAULT_CRS)).select(
        "feature_id", F.round("b.min_y", 7).alias("min_y"), F.round("b.min_x", 7).alias("min_x"),
        (~odd).alias("projected"))


@query("c5_polygon_stats", with_ctes(LAYER, """
t AS (SELECT feature_id, x1 * 1e0 AS ax, y1 * 1e0 AS ay, x2 * 1e0 AS bx, y1 + 3e0 AS bw, x1 + 2e0 AS cx, y2 * 1e0 AS cy FROM lay),
m AS (SELECT feature_id, abs((bx - ax) * (cy - ay) - (cx - ax) * (bw - ay)) / 2 AS area,
             sqrt((bx - ax) ** 2 + (bw - ay) ** 2) + sqrt((cx - bx) ** 2 + (cy - bw) ** 2)
             + sqrt((ax - cx) ** 2 + (ay - cy) ** 2) AS per FROM t)""", select="""
SELECT feature_id, round(area, 6) AS area, round(per, 6) AS perimeter, 4 AS num_vertices,
       round(4 * pi() * area / (per * per), 6) AS compactness FROM m"""))
def c5(spark, sf):
    s = tb.triangles(spark, sf).withColumn("s", geo.polygon_stats(F.col("rings")))
    return s.select("feature_id", F.round("s.area", 6).alias("area"), F.round("s.perimeter", 6).alias("perimeter"),
                    F.col("s.num_vertices").cast("long").alias("num_vertices"),
                    F.round("s.compactness", 6).alias("compactness"))


@query("c6_wkt_roundtrip", """
SELECT o_orderkey, 'POLYGON ((' || x || ' ' || y || ', ' || (x + 4) || ' ' || y || ', ' || x || ' ' || (y + 6) || ', '
       || x || ' ' || y || '))' AS wkt, 12e0 AS area
FROM (SELECT o_orderkey, o_custkey % 300 AS x, o_orderkey % 500 - 250 AS y FROM orders)
WHERE o_orderkey % 5 NOT IN (3, 4)""")
def c6(spark, sf):
    x, y = F.col("o_custkey") % 300, F.col("o_orderkey") % 500 - 250
    good = F.format_string("POLYGON((%d %d.0,%d %d, %d %d, %d %d))", x, y, x + 4, y, x, y + 6, x, y)
    text = F.when(F.col("o_orderkey") % 5 == 3, "POLYGON ((1 2, 3").when(F.col("o_orderkey") % 5 == 4, "garbage") \
        .otherwise(good)
    parsed = tb.table(spark, sf, "orders").select("o_orderkey", geo.from_wkt(text).alias("rings"))
    return parsed.filter(F.col("rings").isNotNull()).select(
        "o_orderkey", geo.to_wkt(F.col("rings")).alias("wkt"), geo.polygon_area(F.col("rings")).alias("area"))


@query("c7_sanitize", """
WITH p AS (SELECT o_orderkey, i, o_orderkey % 50 AS x, CASE WHEN (o_orderkey + i) % 4 = 0 THEN 0 ELSE (o_orderkey * (i + 3)) % 17 END AS s
           FROM orders, range(3) t(i))
SELECT o_orderkey, max(CASE WHEN i = 1 AND o_orderkey % 3 = 0 THEN s * s / 4e0 ELSE CAST(s * s AS DOUBLE) END) AS area FROM p WHERE s > 0 GROUP BY 1""")
def c7(spark, sf):
    key = F.col("o_orderkey")

    def part(i):
        s = F.when((key + i) % 4 == 0, 0).otherwise((key * (i + 3)) % 17)
        x, y = key % 50 + 100 * i, F.lit(0)
        square = F.format_string("((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + s, y, x + s, y + s, x, y + s, x, y)
        # The two halves of a bow tie: either is a quarter of the square.
        tie = F.format_string("((%d %d, %d %d, %d %d, %d %d, %d %d))", x, y, x + s, y + s, x + s, y, x, y + s, x, y)
        return F.when(key % 3 == 0, tie).otherwise(square) if i == 1 else square

    text = F.concat(F.lit("MULTIPOLYGON ("), F.concat_ws(", ", part(0), part(1), part(2)), F.lit(")"))
    # Few bytes, much work: keys are dealt over all tasks before texts are made of them.
    parts = spread(tb.table(spark, sf, "orders").select("o_orderkey"), "o_orderkey").select("o_orderkey", geo.parts_from_wkt(text).alias("parts"))
    return vectorize.sanitize(parts, ["o_orderkey"]).select(
        "o_orderkey", geo.polygon_area(F.col("rings")).alias("area"))


@query("c8_simplified_shapes")
def c8(spark, sf):
    cells = tb.masks(spark, sf).select("source_id", "row", "col", (F.col("b0") % 2).alias("class_id"))
    shapes = vectorize.polygonize(cells, ["source_id"], None, min_area=1.0, tolerance=0.0, whole_tile=True)
    return vectorize.simplify(shapes, 1.0).select(
        "source_id", "component", vectorize.outer_vertices(F.col("rings")).alias("vertices"),
        F.round(geo.polygon_area(F.col("rings")), 6).alias("area"))


TRI = LAYER.strip() + """,
tri AS (SELECT feature_id, source_id, x1 * 1e0 AS ax, y1 * 1e0 AS ay, x2 * 1e0 AS bx, y1 + 3e0 AS bw, x1 + 2e0 AS cx, y2 * 1e0 AS cy FROM lay),
w AS (SELECT y * 50 AS row_off, x * 50 AS col_off FROM range(11) a(y), range(11) b(x)),
pr AS (SELECT tri.*, row_off, col_off, [ax, bx, cx] AS xs, [ay, bw, cy] AS ys,
              [col_off, col_off + 64, col_off, col_off + 64]::DOUBLE[] AS wx, [row_off, row_off, row_off + 64, row_off + 64]::DOUBLE[] AS wy
       FROM tri JOIN w ON least(ax, cx) <= col_off + 64 AND greatest(bx, cx) >= col_off
        AND ay <= row_off + 64 AND greatest(bw, cy) >= row_off),
axes AS (SELECT *, unnest([[-(bw - ay), bx - ax], [-(cy - bw), cx - bx], [-(ay - cy), ax - cx]]) AS nrm FROM pr),
sep AS (SELECT feature_id, row_off, col_off, bool_or(
          list_max([nrm[1] * xs[i] + nrm[2] * ys[i] for i in [1, 2, 3]]) < list_min([nrm[1] * wx[i] + nrm[2] * wy[i] for i in [1, 2, 3, 4]])
          OR list_min([nrm[1] * xs[i] + nrm[2] * ys[i] for i in [1, 2, 3]]) > list_max([nrm[1] * wx[i] + nrm[2] * wy[i] for i in [1, 2, 3, 4]])) AS apart
        FROM axes GROUP BY ALL),
met AS (SELECT * FROM sep WHERE NOT apart)
"""


@query("c9_windows_hit", with_ctes(TRI, """
hit AS (SELECT DISTINCT source_id, row_off, col_off FROM met JOIN tri USING (feature_id)),
ras AS (SELECT DISTINCT source_id FROM lay)""", select="""
SELECT source_id, row_off, col_off FROM hit WHERE row_off < 520 AND col_off < 520"""))
def c9(spark, sf):
    shapes = tb.triangles(spark, sf)
    frames = shapes.select("source_id").distinct().withColumn("height", F.lit(520)).withColumn("width", F.lit(520))
    return spatial_join.windows_hit(tiling.padded_windows(frames, 64, 50), shapes, 64, 50, ["source_id"]).select(
        "source_id", "row_off", "col_off")


@query("c9_shape_windows", with_ctes(TRI, select="SELECT feature_id, row_off, col_off FROM met"))
def c9_pairs(spark, sf):
    return spatial_join.shape_windows(tb.triangles(spark, sf), ["feature_id"], 64, 50).select(
        "feature_id", "row_off", "col_off")


@query("c10_box_join", with_ctes(LAYER, """
sup AS (SELECT s_suppkey AS id, (s_suppkey * 41) % 480 AS x1, (s_suppkey * 23) % 470 AS y1 FROM supplier)""", select="""
SELECT feature_id, id AS sup_id FROM lay JOIN sup ON lay.x1 <= sup.x1 + 17 AND lay.x2 >= sup.x1
 AND lay.y1 <= sup.y1 + 11 AND lay.y2 >= sup.y1"""))
def c10(spark, sf):
    key = F.col("s_suppkey")
    x, y = (key * 41) % 480, (key * 23) % 470
    sup = tb.table(spark, sf, "supplier").select(
        key.alias("id"), x.cast("double").alias("x1"), y.cast("double").alias("y1"),
        (x + 17).cast("double").alias("x2"), (y + 11).cast("double").alias("y2"))
    left = tb.layer_shapes(spark, sf).select("feature_id", "x1", "y1", "x2", "y2")
    return spatial_join.box_join(left, sup, 32.0).select("feature_id", F.col("r_id").alias("sup_id"))


REACH = """/*recursive*/
reach AS (
  SELECT source_id, pred, r * 100 + c AS root, r, c FROM msk
  UNION
  SELECT n.source_id, n.pred, p.root, n.r, n.c FROM reach p JOIN msk n ON n.source_id = p.source_id AND n.pred = p.pred
   AND abs(n.r - p.r) + abs(n.c - p.c) = 1),
comp AS (SELECT source_id, pred, r, c, min(root) AS root FROM reach GROUP BY ALL)
"""


@query("c11_components", with_ctes(MASKS, REACH, select="""
SELECT source_id, pred AS class_id, root // 100 AS first_row, root % 100 AS first_col, count(*) AS pixels
FROM comp GROUP BY ALL"""))
def c11(spark, sf):
    cells = tb.masks(spark, sf).select("source_id", "row", "col", F.col("pred").alias("class_id"))
    labelled = components.label_cells(cells, ["source_id"], "class_id", 4, None)
    return labelled.groupBy("source_id", "class_id", "component").agg(F.count(F.lit(1)).alias("pixels")).select(
        "source_id", "class_id", F.floor(F.col("component") / components.ROW_STEP).alias("first_row"),
        (F.col("component") % components.ROW_STEP).alias("first_col"), "pixels")


@query("c12_polygonize", with_ctes(MASKS, REACH, """
sides AS (SELECT a.source_id, a.root, count(*) * 4 - count(*) FILTER (b.root IS NOT NULL) AS n FROM comp a, range(1)
          LEFT JOIN comp b ON false GROUP BY ALL),
nb AS (SELECT a.source_id, a.root, count(*) AS inner_sides FROM comp a JOIN comp b
       ON a.source_id = b.source_id AND a.root = b.root AND abs(a.r - b.r) + abs(a.c - b.c) = 1 GROUP BY ALL),
sz AS (SELECT source_id, root, pred, count(*) AS pixels FROM comp GROUP BY ALL)""", select="""
SELECT source_id, pred AS class_id, root // 100 AS first_row, root % 100 AS first_col, pixels * 0.25e0 AS area,
       (pixels * 4 - coalesce(inner_sides, 0)) * 0.5e0 AS perimeter, true AS valid
FROM sz LEFT JOIN nb USING (source_id, root) WHERE pred > 0 AND pixels >= 3""").replace("""sides AS (SELECT a.source_id, a.root, count(*) * 4 - count(*) FILTER (b.root IS NOT NULL) AS n FROM comp a, range(1)
          LEFT JOIN comp b ON false GROUP BY ALL),
""", ""))
def c12(spark, sf):
    affine = F.array(*[F.lit(v) for v in (0.5, 0.0, 1000.0, 0.0, -0.5, 2000.0)])
    cells = tb.masks(spark, sf).select("source_id", "row", "col", F.col("pred").alias("class_id"))
    transforms = tb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("source_id"), affine.alias("transform"))
    shapes = vectorize.polygonize(cells, ["source_id"], transforms, min_area=0.75, tolerance=0.0, whole_tile=True)
    return shapes.select(
        "source_id", "class_id", F.floor(F.col("component") / components.ROW_STEP).alias("first_row"),
        (F.col("component") % components.ROW_STEP).alias("first_col"), "area", "perimeter", "valid")


BURN = LAYER.strip() + """,
cells AS (SELECT source_id, layer, feature_id, class_id, r, c FROM cls,
          LATERAL (SELECT unnest(range(y1, y2)) AS r) a, LATERAL (SELECT unnest(range(x1, x2)) AS c) b)
"""


@query("c13_rasterize_first_layer", with_ctes(BURN, select="""
SELECT source_id, r AS "row", c AS col, min_by(class_id, layer) AS class_id FROM cells GROUP BY ALL"""))
def c13_first(spark, sf):
    shapes = layers.classify_layers(tb.layer_polygons(spark, sf))
    return rasterize.rasterize(shapes, ["source_id"], "feature_id", "layer_rank", "first", F.lit(520), F.lit(520))


@query("c13_rasterize_last_shape", with_ctes(BURN, select="""
SELECT source_id, r AS "row", c AS col, max_by(class_id, feature_id) AS class_id FROM cells GROUP BY ALL"""))
def c13_last(spark, sf):
    shapes = layers.classify_layers(tb.layer_polygons(spark, sf))
    return rasterize.rasterize(shapes, ["source_id"], "feature_id", "feature_id", "last", F.lit(520), F.lit(520))


@query("c13_rasterize_triangles", with_ctes(LAYER, """
e AS (SELECT feature_id, x1, y1, x2, y2, unnest([
        [x1 * 1e0, y1 * 1e0, x2 * 1e0, y1 + 3e0], [x2 * 1e0, y1 + 3e0, x1 + 2e0, y2 * 1e0], [x1 + 2e0, y2 * 1e0, x1 * 1e0, y1 * 1e0]]) AS g FROM lay),
pip AS (SELECT feature_id, r, c, count(*) FILTER (
          (g[2] > r + 0.5e0) <> (g[4] > r + 0.5e0)
          AND c + 0.5e0 < g[1] + (r + 0.5e0 - g[2]) * (g[3] - g[1]) / (g[4] - g[2])) AS n
        FROM e, LATERAL (SELECT unnest(range(y1, y2 + 4)) AS r) a, LATERAL (SELECT unnest(range(x1, x2 + 1)) AS c) b
        GROUP BY ALL)""", select="""
SELECT feature_id, count(*) AS cells, sum(r)::BIGINT AS row_sum, sum(c)::BIGINT AS col_sum FROM pip WHERE n % 2 = 1 GROUP BY 1"""))
def c13_triangles(spark, sf):
    cells = rasterize.expand_spans(rasterize.scan_spans(tb.triangles(spark, sf), ["feature_id"]))
    return cells.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("row").alias("row_sum"), F.sum("col").alias("col_sum"))


@query("c14_buffered_lines", with_ctes(LAYER, """
ln AS (SELECT feature_id, layer, x1 + 20e0 AS ax, y1 + 20e0 AS ay, x2 + 20e0 AS bx, y2 + 23e0 AS bw,
              CASE WHEN lower(layer) LIKE '%line%' THEN 3e0 WHEN lower(layer) LIKE '%point%' THEN 5e0 END AS d
       FROM lay WHERE lower(layer) LIKE '%line%' OR lower(layer) LIKE '%point%'),
cl AS (SELECT *, CASE WHEN d = 5 THEN 0e0 ELSE greatest(0, least(1, ((c + 0.5e0 - ax) * (bx - ax) + (r + 0.5e0 - ay) * (bw - ay))
              / ((bx - ax) ** 2 + (bw - ay) ** 2))) END AS t
       FROM ln, LATERAL (SELECT unnest(range(CAST(ay AS BIGINT) - 6, CAST(bw AS BIGINT) + 7)) AS r) a,
            LATERAL (SELECT unnest(range(CAST(ax AS BIGINT) - 6, CAST(bx AS BIGINT) + 7)) AS c) b)""", select="""
SELECT feature_id, count(*) AS cells, sum(r)::BIGINT AS row_sum, sum(c)::BIGINT AS col_sum FROM cl
WHERE (c + 0.5e0 - ax - t * (bx - ax)) ** 2 + (r + 0.5e0 - ay - t * (bw - ay)) ** 2 <= d * d GROUP BY 1"""))
def c14(spark, sf):
    shapes = tb.layer_shapes(spark, sf).withColumn("distance", rasterize.buffer_distance(F.col("layer"), F.lit("")))
    start, end = geo.point(F.col("x1") + 20, F.col("y1") + 20), geo.point(F.col("x2") + 20, F.col("y2") + 23)
    line = F.when(F.lower("layer").contains("line"), F.array(start, end)).otherwise(F.array(start))
    lines = shapes.filter("distance > 0").withColumn("rings", F.array(line))
    cells = rasterize.near_segments(lines, ["feature_id"], F.col("distance"))
    return cells.groupBy("feature_id").agg(
        F.count(F.lit(1)).alias("cells"), F.sum("row").alias("row_sum"), F.sum("col").alias("col_sum"))


@query("c15_box_iou", with_ctes(LAYER, """
sh AS (SELECT c_custkey AS id, (c_custkey * 13) % 500 + c_custkey % 4 AS x1, (c_custkey * 29) % 500 + c_custkey % 3 AS y1, 5 + c_custkey % 20 AS s, c_custkey // 1000 AS source_id FROM customer),
pr AS (SELECT feature_id, id, greatest(0, least(lay.x2, sh.x1 + s) - greatest(lay.x1, sh.x1)) * greatest(0, least(lay.y2, sh.y1 + s) - greatest(lay.y1, sh.y1)) AS i,
              (lay.x2 - lay.x1) * (lay.y2 - lay.y1) + s * s AS total
       FROM lay JOIN sh USING (source_id))""", select="""
SELECT feature_id, id AS other_id, round(i / (total - i), 6) AS iou FROM pr WHERE i > 0"""))
def c15(spark, sf):
    base = tb.layer_shapes(spark, sf).select("source_id", "feature_id", "x1", "y1", "x2", "y2")
    dx, dy = F.col("feature_id") % 4, F.col("feature_id") % 3
    moved = base.select("source_id", F.col("feature_id").alias("id"), (F.col("x1") + dx).alias("x1"),
                        (F.col("y1") + dy).alias("y1"), (F.col("x2") + dx).alias("x2"), (F.col("y2") + dy).alias("y2"))
    pairs = spatial_join.box_join(base, moved, 32.0, ["source_id"])
    box = lambda p: {c: F.col(p + c) for c in ("x1", "y1", "x2", "y2")}
    return pairs.withColumn("iou", F.round(geo.box_iou(box(""), box("r_")), 6)).filter("iou > 0").select(
        "feature_id", F.col("r_id").alias("other_id"), "iou")


@query("c15_polygon_iou", with_ctes(LAYER, """
tp AS (SELECT t.source_id, t.feature_id, o.feature_id AS other_id, t.x1, t.y1, t.x2, t.y2, o.x1 AS bx1, o.y1 AS by1, o.x2 AS bx2, o.y2 AS by2,
              greatest(t.y1, o.y1) AS lo, least(t.y2, o.y2) AS hi
       FROM lay t JOIN lay o ON t.source_id = o.source_id AND t.x1 <= o.x2 AND o.x1 <= t.x2 AND t.y1 <= o.y2 AND o.y1 <= t.y2),
-- Between the triangle's corners, the box's ends and the heights where a triangle's side passes a side of the box, the shared width is linear.
br AS (SELECT *, list_sort(list_transform(
           [lo, hi, y1 + 3] || flatten([[y1 + (v - x1) * (y2 - y1) / 2e0, y1 + 3e0 * (v - x1) / (x2 - x1), y1 + 3 + (v - x2) * (y2 - y1 - 3) / CAST(x1 + 2 - x2 AS DOUBLE)]
                                        for v in [bx1, bx2]]),
           lambda y: greatest(lo, least(hi, y)))) AS ys FROM tp),
sl AS (SELECT feature_id, other_id, x1, y1, x2, y2, bx1, by1, bx2, by2, unnest(ys[2:]) - unnest(ys[:-2]) AS h, (unnest(ys[2:]) + unnest(ys[:-2])) / 2 AS y FROM br),
ov AS (SELECT feature_id, other_id, ((x2 - x1) * (y2 - y1) - 6) / 2e0 + (bx2 - bx1) * (by2 - by1) AS total,
              sum(h * greatest(0, least(bx2, CASE WHEN y < y1 + 3 THEN x1 + (y - y1) * (x2 - x1) / 3e0
                                                  ELSE x2 + (x1 + 2 - x2) * (y - y1 - 3) / CAST(y2 - y1 - 3 AS DOUBLE) END)
                                  - greatest(bx1, x1 + 2 * (y - y1) / CAST(y2 - y1 AS DOUBLE)))) AS shared
       FROM sl GROUP BY ALL)""", select="""
SELECT feature_id, other_id, round(shared / (total - shared), 6) AS iou FROM ov"""))
def c15_polygons(spark, sf):
    tri = tb.triangles(spark, sf).select("source_id", "feature_id", "rings", "x1", "y1", "x2", F.greatest(
        F.col("y2"), F.col("y1") + 3.0).alias("y2"))
    boxes = tb.layer_polygons(spark, sf).select("source_id", F.col("feature_id").alias("id"), "rings", "x1", "y1", "x2", "y2")
    pairs = spatial_join.box_join(tri, boxes, 32.0, ["source_id"])
    return pairs.select("feature_id", F.col("r_id").alias("other_id"), F.round(
        spatial_join.polygon_iou(F.col("rings"), F.col("r_rings")), 6).alias("iou"))


@query("c15_cell_iou", with_ctes(MASKS, """
p AS (SELECT source_id, pred, count(*) AS n FROM msk GROUP BY ALL),
t AS (SELECT source_id, target, count(*) AS n FROM msk GROUP BY ALL),
i AS (SELECT source_id, pred, target, count(*) AS n FROM msk GROUP BY ALL)""", select="""
SELECT i.source_id, i.pred AS a_id, i.target AS b_id, round(i.n / (p.n + t.n - i.n), 6) AS iou
FROM i JOIN p ON p.source_id = i.source_id AND p.pred = i.pred JOIN t ON t.source_id = i.source_id AND t.target = i.target"""))
def c15_cells(spark, sf):
    m = tb.masks(spark, sf)
    a = m.select("source_id", F.col("pred").alias("a_id"), "row", "col")
    b = m.select("source_id", F.col("target").alias("b_id"), "row", "col")
    return spatial_join.cell_iou(a, b, ["source_id"]).select("source_id", "a_id", "b_id", F.round("iou", 6).alias("iou"))


@query("c16_geojson", with_ctes(LAYER, select="""
SELECT feature_id AS id, '{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[['
  || x2 || '.0,' || y1 || '.0],[' || x2 || '.0,' || y2 || '.0],[' || x1 || '.0,' || y2 || '.0],[' || x1 || '.0,' || y1
  || '.0],[' || x2 || '.0,' || y1 || '.0]]]},"properties":{"tile_id":"tile_' || feature_id || '","class_id":' || feature_id % 6
  || ',"confidence":0.5,"height":null}}' AS feature
FROM lay WHERE source_id = 0 ORDER BY feature_id LIMIT 1000"""))
def c16(spark, sf):
    polygons = tb.layer_polygons(spark, sf).select(
        F.col("feature_id").alias("id"), F.concat(F.lit("run"), F.col("source_id")).alias("run_id"),
        F.concat(F.lit("tile_"), F.col("feature_id")).alias("tile_id"), (F.col("feature_id") % 6).alias("class_id"),
        F.lit(0.5).alias("confidence"), F.lit(None).cast("double").alias("z_mean"), "rings")
    return views.geojson_features(polygons, "run0")


@query("c17_region_coords", with_ctes(LAYER, select="""
SELECT feature_id, y1 || '.0 ' || x2 || '.0,' || y2 || '.0 ' || x2 || '.0,' || y2 || '.0 ' || x1 || '.0,' || y1 || '.0 ' || x1
       || '.0,' || y1 || '.0 ' || x2 || '.0' AS coords FROM lay"""))
def c17(spark, sf):
    swapped = geo.swap_xy(F.get("rings", F.lit(0)))
    text = F.array_join(F.transform(swapped, lambda p: F.array_join(p.cast("array<string>"), " ")), ",")
    return tb.layer_polygons(spark, sf).select("feature_id", text.alias("coords"))


@query("a12_export_raster", with_ctes(LAYER, """
f AS (SELECT min(x1) AS mx, min(y1) AS my, max(x2) AS xx, max(y2) AS xy FROM lay),
g AS (SELECT *, least(greatest((xx - mx) * 100, 256), 4096) AS w, least(greatest((xy - my) * 100, 256), 4096) AS h FROM f),
p AS (SELECT feature_id, feature_id % 5 + 1 AS cls, (x1 - mx) * (w / (xx - mx)) AS px1, (x2 - mx) * (w / (xx - mx)) AS px2,
             (xy - y2) * (h / (xy - my)) AS py1, (xy - y1) * (h / (xy - my)) AS py2 FROM lay, g),
rr AS (SELECT feature_id, cls, px1, px2, unnest(range(CAST(ceil(py1 - 0.5e0) AS BIGINT), CAST(ceil(py2 - 0.5e0) AS BIGINT))) AS r FROM p),
cc AS (SELECT feature_id, cls, r, unnest(range(CAST(ceil(px1 - 0.5e0) AS BIGINT), CAST(ceil(px2 - 0.5e0) AS BIGINT))) AS c FROM rr),
b AS (SELECT r, c, max_by(cls, feature_id) AS cls FROM cc GROUP BY ALL)""", select="""
SELECT cls AS class_id, r // 256 AS crow, c // 256 AS ccol, count(*) AS cells FROM b GROUP BY ALL"""))
def a12(spark, sf):
    polygons = tb.layer_polygons(spark, sf).select(
        F.col("feature_id").alias("ord"), (F.col("feature_id") % 5 + 1).alias("class_id"), "rings")
    cells = rasterize.export_raster(polygons)
    return cells.groupBy("class_id", F.expr("row div 256").alias("crow"), F.expr("col div 256").alias("ccol")).agg(
        F.count(F.lit(1)).alias("cells"))


@query("e14_simplification_report")
def e14(spark, sf):
    cells = tb.masks(spark, sf).select("source_id", "row", "col", (F.col("b0") % 2).alias("class_id"))
    shapes = vectorize.polygonize(cells, ["source_id"], None, min_area=1.0, tolerance=0.0, whole_tile=True)
    return vectorize.simplification_report(shapes, 1.0)
