import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from orthomill import session
from orthomill.functions import geometry as geo
from orthomill.operators import components, morphology, rasterize, spatial_join, vectorize
from orthomill.operators.components import ROW_STEP


def cells_frame(spark, arrays):
    rows = [(k, r, c, int(a[r, c])) for k, a in arrays.items() for r in range(a.shape[0]) for c in range(a.shape[1]) if a[r, c]]
    return spark.createDataFrame(rows, "source_id string, row int, col int, class_id int")


def flood(a, eight):
    label, out = {}, {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for r in range(a.shape[0]):
        for c in range(a.shape[1]):
            if not a[r, c] or (r, c) in label:
                continue
            todo = [(r, c)]
            label[r, c] = (r, c)
            while todo:
                y, x = todo.pop()
                out[y, x] = r * ROW_STEP + c
                for dy, dx in steps:
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < a.shape[0] and 0 <= p[1] < a.shape[1] and p not in label and a[p] == a[r, c]:
                        label[p] = (r, c)
                        todo.append(p)
    return out


@pytest.mark.parametrize("eight,chunk", [(False, None), (True, None), (False, 5), (True, 4)])
def test_labels_against_flood_fill(spark, eight, chunk):
    rng = np.random.default_rng(3)
    spiral = np.zeros((13, 13), dtype=int)
    for i in range(0, 13, 2):
        spiral[i, :] = 1
        spiral[i:i + 2, 12 if i % 4 == 0 else 0] = 1
    arrays = {"noise": rng.integers(0, 3, (14, 11)), "snake": spiral, "diag": np.eye(8, dtype=int)}
    got = components.label_cells(cells_frame(spark, arrays), connectivity=8 if eight else 4, chunk=chunk).collect()
    for key, a in arrays.items():
        assert {(r.row, r.col): r.component for r in got if r.source_id == key} == flood(a, eight)


def test_components_of_a_star_and_a_path(spark):
    star = [("s", 0, i) for i in range(1, 300)]
    path = [("p", i, i + 1) for i in range(500, 560)]
    edges = spark.createDataFrame(star + path + [("p", 1, 0)], "g string, u long, v long")
    got = components.connected_components(edges, ["g"]).groupBy("g", "component").count().collect()
    assert {(r.g, r.component, r["count"]) for r in got} == {("s", 0, 300), ("p", 500, 61), ("p", 0, 2)}


def ring_mask():
    a = np.zeros((8, 8), dtype=int)
    a[1:6, 1:6] = 1
    a[3, 3] = 0
    return a


def random_masks():
    rng = np.random.default_rng(4)
    return {f"n{i}": rng.integers(0, 3, (9, 10)) for i in range(4)}


@pytest.mark.parametrize("whole", [True, False])
def test_polygonize_round_trip(spark, whole):
    masks = {**random_masks(), "ring": ring_mask(), "diag": np.eye(8, dtype=int)}
    cells = cells_frame(spark, masks)
    shapes = vectorize.polygonize(cells, ["source_id"], None, min_area=0.0, tolerance=0.0, whole_tile=whole, chunk=4).cache()
    rows = shapes.collect()
    assert all(r.valid and r.area == r.pixels for r in rows)
    ring = [r for r in rows if r.source_id == "ring"]
    assert len(ring) == 1 and len(ring[0].rings) == 2 and ring[0].area == 24 and ring[0].perimeter == 24
    assert sum(r.source_id == "diag" for r in rows) == 8
    back = rasterize.expand_spans(rasterize.scan_spans(shapes, ["source_id", "component", "class_id"])).collect()
    assert sorted((r.source_id, r.row, r.col, r.class_id) for r in back) == \
        sorted((r.source_id, r.row, r.col, r.class_id) for r in cells.collect())


def test_both_ring_tracers_agree(spark):
    labelled = components.label_cells(cells_frame(spark, random_masks()), chunk=None)
    edges = vectorize.boundary_edges(labelled, ["source_id"])
    a = vectorize.stitch_rings(edges, ["source_id"])
    b = vectorize.ring_polygons(vectorize.trace_rings(edges, ["source_id"]), ["source_id"])
    def shape(df):
        return {(r.source_id, r.component): sorted(sorted({(p.x, p.y) for p in ring}) for ring in r.rings) for r in df.collect()}
    assert shape(a) == shape(b)


def test_transform_area_and_simplify(spark):
    a = np.zeros((20, 20), dtype=int)
    for i in range(15):
        a[i + 2, 2:4 + i] = 1
    cells = cells_frame(spark, {"stairs": a})
    affine = spark.createDataFrame([("stairs", [2.0, 0.0, 10.0, 0.0, -2.0, 50.0])], "source_id string, transform array<double>")
    raw = vectorize.polygonize(cells, ["source_id"], affine, tolerance=0.0)
    assert raw.first().area == 4.0 * a.sum()
    report = vectorize.simplification_report(raw, 3.0).first()
    assert report.vertices_after < report.vertices_before and 0 < report.reduction_pct < 100
    assert vectorize.simplify(raw, 0.0) is raw
    assert vectorize.polygonize(cells, ["source_id"], affine, min_area=4.0 * a.sum() + 1).count() == 0


def test_simplify_keeps_triangles():
    square = np.array([(0, 0), (1, 0), (1, 1), (0, 1), (0, 0)], dtype=float)
    assert np.array_equal(vectorize.simplify_ring(square, 100.0), square)
    line = np.array([(0, 0), (2, 0.01), (4, 0), (4, 4), (0, 4), (0, 0)], dtype=float)
    assert len(vectorize.simplify_ring(line, 0.5)) == 5


def test_wkt_text(spark):
    texts = ["POLYGON ((0 0, 4 0, 4 4.5, 0 0), (1 1, 2 1, 2 2, 1 1))", "polygon((0 0,1 0,1 1,0 0))", "POLYGON EMPTY", "POINT (1 2)",
             "POLYGON ((0 0, 1 x, 1 1))", "POLYGON ((0 0, 1 0", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.w for r in df.select("i", geo.to_wkt(geo.from_wkt(F.col("t"))).alias("w")).collect()}
    assert got == {0: texts[0], 1: "POLYGON ((0 0, 1 0, 1 1, 0 0))", 2: None, 3: None, 4: None, 5: None, 6: None}


def test_sanitize_keeps_largest_valid_part(spark):
    rows = [("two", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 8 5, 8 8, 5 8, 5 5)))"), ("line", "POLYGON ((0 0, 1 0, 2 0, 0 0))"),
            ("open", "POLYGON ((0 0, 1 0, 1 1, 0 1))"), ("bad", "nothing"), ("bow tie", "POLYGON ((0 0, 2 2, 2 0, 0 3, 0 0))"),
            ("heights", "POLYGON Z ((0 0 1, 1 0 2, 1 1 3, 0 0 1))"), ("concave", "MULTIPOLYGON (((0 0, 4 0, 4 4, 2 1, 0 4, 0 0)))")]
    df = spark.createDataFrame(rows, "k string, t string").select("k", geo.parts_from_wkt(F.col("t")).alias("parts"))
    got = vectorize.sanitize(df, ["k"]).select("k", geo.polygon_area(F.col("rings")).alias("a")).collect()
    assert sorted((r.k, round(r.a, 9)) for r in got) == [("bow tie", 1.8), ("concave", 10.0), ("heights", 0.5), ("two", 9.0)]


def test_polygon_stats_of_nothing(spark):
    df = spark.createDataFrame([(None,), ([],)], f"rings {geo.RINGS_TYPE}")
    for r in df.select(geo.polygon_stats(F.col("rings")).alias("s")).collect():
        assert tuple(r.s) == (0.0, 0.0, 0, 0.0)


def test_reprojection_round_trip_and_known_point(spark):
    df = spark.createDataFrame([(78.5, 17.25), (81.0, 21.0), (83.9, 0.5), (80.2, -35.0)], "lon double, lat double")
    for crs in ("EPSG:32644", "EPSG:32744"):
        ring = F.array(geo.point(F.col("lon"), F.col("lat")))
        back = geo.utm_to_wgs84(geo.wgs84_to_utm(ring, F.lit(crs)), F.lit(crs))
        for r in df.select("lon", "lat", F.get(back, 0).alias("p")).collect():
            assert (r.p.x, r.p.y) == (pytest.approx(r.lon, abs=1e-9), pytest.approx(r.lat, abs=1e-9))
    # On the central meridian the easting is 500 km; the equator has northing 0.
    p = spark.range(1).select(F.get(geo.utm_to_wgs84(F.array(geo.point(F.lit(500000.0), F.lit(0.0))), F.lit("EPSG:32643")), 0)
                              .alias("p")).first().p
    assert (p.x, p.y) == (pytest.approx(75.0), pytest.approx(0.0))
    same = spark.range(1).select(F.get(geo.utm_to_wgs84(F.array(geo.point(F.lit(3.0), F.lit(4.0))), F.lit("EPSG:4326")), 0)
                                 .alias("p")).first().p
    assert (same.x, same.y) == (3.0, 4.0)


def square(x1, y1, x2, y2):
    return [[(x2, y1), (x2, y2), (x1, y2), (x1, y1), (x2, y1)]]


def test_overlap_rules(spark):
    rows = [(1, 0, 2, 5, square(0.0, 0.0, 4.0, 4.0)), (2, 1, 1, 9, square(2.0, 2.0, 6.0, 6.0))]
    shapes = spark.createDataFrame(rows, f"id int, layer_rank int, class_id int, ord int, rings {geo.RINGS_TYPE}")
    first = {(r.row, r.col): r.class_id for r in rasterize.rasterize(shapes, [], "id", "layer_rank", "first").collect()}
    last = {(r.row, r.col): r.class_id for r in rasterize.rasterize(shapes, [], "id", "ord", "last").collect()}
    assert (first[3, 3], last[3, 3]) == (2, 1) and first[0, 0] == 2 and last[5, 5] == 1 and len(first) == 28
    clamped = rasterize.rasterize(shapes, [], "id", "ord", "last", F.lit(3), F.lit(3)).count()
    assert clamped == 9


def test_polygon_and_cell_iou(spark):
    pairs = [(square(0.0, 0.0, 4.0, 4.0), square(2.0, 0.0, 6.0, 4.0), 8 / 24),
             ([[(0.0, 0.0), (4.0, 0.0), (0.0, 4.0), (0.0, 0.0)]], square(0.0, 0.0, 2.0, 2.0), 4 / 8),
             (square(0.0, 0.0, 1.0, 1.0), square(5.0, 5.0, 6.0, 6.0), 0.0),
             (square(0.0, 0.0, 4.0, 4.0) + [[(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0), (1.0, 1.0)]], square(1.0, 1.0, 3.0, 3.0), 0.0),
             (None, square(0.0, 0.0, 1.0, 1.0), 0.0)]
    df = spark.createDataFrame(pairs, f"a {geo.RINGS_TYPE}, b {geo.RINGS_TYPE}, want double")
    for r in df.select("want", spatial_join.polygon_iou(F.col("a"), F.col("b")).alias("iou")).collect():
        assert r.iou == pytest.approx(r.want)


def test_overlap_of_large_outlines():
    turn = np.linspace(0, 2 * np.pi, 2001)
    rings = [spatial_join._ring_edges(x + np.cos(turn), np.append(np.sin(turn[:-1]), 0.0), np.array([2001])) for x in (0.0, 1.0)]
    assert spatial_join.overlap_area(*rings) == pytest.approx(2 * np.pi / 3 - np.sqrt(3) / 2, abs=1e-5)


def test_box_join_of_mixed_sizes(spark):
    rng = np.random.default_rng(21)

    def boxes(n, big, seed):
        sides = np.random.default_rng(seed).choice([0.0, 0.5, 3.0, 20.0, 150.0], (n, 2))
        corner = rng.uniform(-500, 500, (n, 2)).round(1)
        rows = [(i, "k" if i % 3 else "l", *map(float, c), *map(float, c + s)) for i, (c, s) in enumerate(zip(corner, sides))]
        hot = [(n + j, "k", 7.0, 7.0, 8.0, 8.0) for j in range(15)]
        return rows + hot + [(n + 20 + j, "k", -1e6, -1e6, 1e6, 1e6) for j in range(big)] + [(n + 40, None, 0.0, 0.0, 9.0, 9.0), (n + 41, "k", None, 0.0, 9.0, 9.0)]

    schema = "id int, k string, x1 double, y1 double, x2 double, y2 double"
    for big_a, big_b in ((1, 1), (2, 0), (0, 1)):
        a, b = boxes(150, big_a, 1), boxes(120, big_b, 2)
        want = sorted((p[0], q[0]) for p in a for q in b if p[1] and p[1] == q[1] and None not in p and None not in q
                      and p[2] <= q[4] and q[2] <= p[4] and p[3] <= q[5] and q[3] <= p[5])
        left, right = spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)
        got = spatial_join.box_join(left, right, 1.0, ["k"], rows_per_salt=50)
        assert sorted((r.id, r.r_id) for r in got.collect()) == want
        assert got.columns == ["k", "id", "x1", "y1", "x2", "y2", "r_id", "r_x1", "r_y1", "r_x2", "r_y2"]
        # A box over everything takes no more cells than others do.
        most = spatial_join._at_home(left, 1.0).groupBy("id").count().agg(F.max("count")).first()[0]
        assert most <= 9
    empty = left.limit(0)
    assert spatial_join.box_join(left, empty, 1.0, ["k"]).count() == spatial_join.box_join(empty, right, 1.0, ["k"]).count() == 0


def test_box_join_under_skew(spark):
    rng = np.random.default_rng(5)
    def boxes(n, hot):
        xy = rng.integers(0, 60, (n, 2))
        xy[:hot] = (3, 3)
        wh = rng.integers(1, 30, (n, 2))
        return [(i, float(x), float(y), float(x + w), float(y + h)) for i, ((x, y), (w, h)) in enumerate(zip(xy, wh))]
    a, b = boxes(60, 30), boxes(40, 0)
    schema = "id int, x1 double, y1 double, x2 double, y2 double"
    want = {(p[0], q[0]) for p in a for q in b if p[1] <= q[3] and p[3] >= q[1] and p[2] <= q[4] and p[4] >= q[2]}
    for per_salt in (10**6, 5, 1):  # no salts, some keys salted, all salted
        got = spatial_join.box_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), 16.0, rows_per_salt=per_salt)
        rows = [(r.id, r.r_id) for r in got.collect()]
        assert len(rows) == len(set(rows)) and set(rows) == want


def test_window_hits_are_exact(spark):
    # The triangle's bounding box meets the window at (10, 10), the triangle does not.
    shapes = spark.createDataFrame([(1, [[(0.0, 0.0), (18.0, 0.0), (0.0, 18.0), (0.0, 0.0)]])], f"id int, rings {geo.RINGS_TYPE}")
    got = {(r.row_off, r.col_off) for r in spatial_join.shape_windows(shapes, ["id"], 8, 10).collect()}
    assert got == {(0, 0), (0, 10), (10, 0)}


def closing(a, k=5):
    def sweep(m, pad, pick):
        p = np.pad(m, k // 2, constant_values=pad)
        return pick([p[i:i + m.shape[0], j:j + m.shape[1]] for i in range(k) for j in range(k)], axis=0)
    return sweep(sweep(a, 0, np.max), 1, np.min)


def test_closing_and_islands(spark):
    rng = np.random.default_rng(6)
    a = (rng.random((23, 19)) < 0.08).astype(int)
    cells = cells_frame(spark, {"a": a}).withColumn("over_h", F.lit(23)).withColumn("over_w", F.lit(19))
    closed = morphology.close_mask(cells)
    assert {(r.row, r.col) for r in closed.collect()} == set(zip(*map(list, np.nonzero(closing(a)))))
    labelled, table = morphology.islands(closed, chunk=6)
    assert {r.component for r in table.collect()} == set(flood(closing(a), False).values())
    assert labelled.count() == closing(a).sum()


def test_overview_samples_cell_centres(spark):
    for h in (20, 21, 33):
        pixels = spark.range(h).select(F.lit("a").alias("source_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
        frame = spark.createDataFrame([("a", h, 4)], "source_id string, height int, width int")
        got = {r.over_row: r.row for r in morphology.overview(pixels, frame, 4).collect() if r.over_col == 0}
        out = h // 4
        # Width 4 shrinks to one column sampled at 2, so only the rows are looked at here.
        assert got == {} and out > 0
        wide = pixels.withColumn("col", F.lit(2))
        got = {r.over_row: r.row for r in morphology.overview(wide, frame, 4).collect()}
        assert got == {i: int((i + 0.5) * h / out) for i in range(out)}


def test_windows_on_islands(spark):
    windows = spark.createDataFrame([(s, y, x) for s in ("a", "b") for y in (0, 50, 100) for x in (0, 50, 100)],
                                    "source_id string, row_off int, col_off int")
    cells = spark.createDataFrame([("a", 0, 0)], "source_id string, row int, col int")
    got = morphology.windows_on_islands(windows, cells, 50, 50, 10).collect()
    assert {(r.row_off, r.col_off) for r in got if r.source_id == "a"} == {(0, 0)}
    assert sum(r.source_id == "b" for r in got) == 9  # no islands: every window stays
    edge = spark.createDataFrame([("a", 4, 0), ("b", 0, 0)], "source_id string, row int, col int")
    got = morphology.windows_on_islands(windows, edge, 50, 50, 10).filter("source_id = 'a'").collect()
    assert {(r.row_off, r.col_off) for r in got} == {(0, 0), (50, 0)}  # touching counts


def test_pixel_space_is_the_inverse_of_the_transform(spark):
    affine = F.array(*[F.lit(v) for v in (0.5, 0.1, 1000.0, 0.2, -0.5, 2000.0)])
    df = spark.createDataFrame([(square(1.0, 2.0, 5.0, 7.0),)], f"rings {geo.RINGS_TYPE}")
    back = df.select(rasterize.to_pixel_space(vectorize.geo_reference(F.col("rings"), affine), affine).alias("r")).first().r
    assert [(pytest.approx(p.x), pytest.approx(p.y)) for p in back[0]] == square(1.0, 2.0, 5.0, 7.0)[0]


def test_buffers(spark):
    names = [("Road", "LineString"), ("Water_Body_Line", ""), ("Waterbody_Point", ""), ("Utility", "Point"), ("Bridge", "Polygon")]
    df = spark.createDataFrame(names, "layer string, kind string")
    got = [r.d for r in df.select(rasterize.buffer_distance(F.col("layer"), F.col("kind")).alias("d")).collect()]
    assert got == [3.0, 3.0, 5.0, 5.0, 0.0]
    degrees = df.select(rasterize.buffer_distance(F.col("layer"), F.col("kind"), True).alias("d")).first().d
    assert degrees == pytest.approx(3.0 / 111000.0)
    line = spark.createDataFrame([(1, [[(2.5, 2.5), (8.5, 2.5)], [(5.0, 9.0)]])], f"id int, rings {geo.RINGS_TYPE}")
    got = {(r.row, r.col) for r in rasterize.near_segments(line, ["id"], F.lit(1.0), F.lit(10), F.lit(9)).collect()}
    def near(r, c):
        x, y = c + 0.5, r + 0.5
        return np.hypot(x - min(max(x, 2.5), 8.5), y - 2.5) <= 1 or np.hypot(x - 5, y - 9) <= 1
    assert got == {(r, c) for r in range(10) for c in range(9) if near(r, c)}


def test_runs_are_few_blocks_and_each_cell_once(spark):
    runs = spark.createDataFrame([(a, b) for a in range(18) for b in range(a, 40)], "c0 long, c1 long")
    blocks = rasterize._blocks(runs.withColumns({"a": F.col("c0"), "b": F.col("c1")})).collect()
    found = {}
    for r in blocks:
        found.setdefault((r.a, r.b), []).append(range(r._i << r._k, (r._i + 1) << r._k))
    assert len(found) == runs.count()
    for (a, b), parts in found.items():
        assert sorted(c for p in parts for c in p) == list(range(a, b + 1)) and len(parts) <= 2 * (b - a + 1).bit_length()


def test_large_shapes_over_each_other_are_burnt_as_cell_by_cell(spark):
    rng = random.Random(3)
    boxes = [(i, i % 5 + 1, x, y, x + rng.randrange(1, 150), y + rng.randrange(1, 150)) for i in range(25) for x, y in [(rng.randrange(150), rng.randrange(150))]]
    shapes = spark.createDataFrame(boxes, "ord long, class_id int, x1 long, y1 long, x2 long, y2 long").select(
        "ord", "class_id", geo.box_rings(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("rings"))
    for overlap, shape_order in (("last", boxes), ("first", boxes[::-1])):
        want = {(r, c): k for _, k, x1, y1, x2, y2 in shape_order for r in range(y1, min(y2, 200)) for c in range(x1, min(x2, 190))}
        got = rasterize.rasterize(shapes, [], "ord", "ord", overlap, F.lit(200), F.lit(190)).collect()
        assert {(r.row, r.col): r.class_id for r in got} == want and len(got) == len(want)


def test_rows_of_one_small_file_are_dealt_over_tasks(spark):
    lines = spark.range(0, 400, 1, 1).select("id", F.array(F.array(geo.point(F.col("id"), F.lit(3)), geo.point(F.col("id") + 9, F.lit(300)))).alias("rings"))
    boxes = spark.range(0, 400, 1, 1).select("id", geo.box_rings(*[F.lit(float(v)) for v in (5, 5, 30, 300)]).alias("rings"))
    made = [rasterize.near_segments(lines, ["id"], F.lit(2.0)), rasterize.scan_spans(boxes, ["id"])]
    for df in made:
        tasks = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert len(tasks) > 3 and max(tasks) < sum(tasks) / 2


def test_shapes_of_one_small_file_meet_windows_in_many_tasks(spark):
    boxes = spark.range(0, 400, 1, 1).select("id", geo.box_rings(*[F.lit(float(v)) for v in (5, 5, 70, 30)]).alias("rings"))
    df = spatial_join.shape_windows(boxes, ["id"], 64, 50)
    tasks = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(tasks) > 3 and max(tasks) < sum(tasks) / 2
    assert {tuple(r) for r in df.select("id", "row_off", "col_off").collect()} == {(i, 0, c) for i in range(400) for c in (0, 50)} and df.count() == 800


def test_many_small_groups_share_a_call_and_none_is_cut(spark, monkeypatch):
    monkeypatch.setattr(session, "GROUP_ROWS", 300)
    key = F.when(F.col("id") < 1500, F.lit(None)).otherwise(F.col("id") % 400)
    rows = spark.range(0, 3000, 1, 3).select(key.alias("k"), F.when(F.col("id") % 2 == 0, F.lit("a")).alias("t"), "id")
    schema = StructType.fromDDL("k long, t string, rows long, call string")

    def run(table, group):
        import uuid
        first = np.flatnonzero(np.diff(group, prepend=-1))
        sizes = np.diff(np.append(first, len(group)))
        found = table.select(["k", "t"]).take(pa.array(first))
        return found.append_column("rows", pa.array(sizes)).append_column("call", pa.array([uuid.uuid4().hex] * len(first)))

    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = session.map_groups(rows, ["k", "t"], run, schema).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want = {(r.k, r.t): r["count"] for r in rows.groupBy("k", "t").count().collect()}
    assert {(r.k, r.t): r.rows for r in got} == want and len(got) == len(want)
    assert len({r.call for r in got}) <= 12


def test_tile_masks_take_no_call_of_python_each(spark):
    cells = cells_frame(spark, random_masks())
    shapes = vectorize.polygonize(cells, ["source_id"], None, min_area=0.0, tolerance=1.0, whole_tile=True)
    assert "InPandas" not in shapes._jdf.queryExecution().toString()


def test_rings_are_simplified_together_as_alone():
    rng = np.random.default_rng(8)
    rings = [np.vstack([p, p[:1]]) for p in (rng.integers(0, 9, (n, 2)).astype(float) for n in rng.integers(3, 30, 200))]
    rings[5][1] = np.nan
    pts, sizes = vectorize.simplify_rings(np.vstack(rings), np.array([len(r) for r in rings]), 1.0)
    for ring, part in zip(rings, np.split(pts, np.cumsum(sizes)[:-1])):
        assert np.array_equal(part, vectorize.simplify_ring(ring, 1.0), equal_nan=True)
        assert len(part) >= 4 and np.array_equal(part[[0, -1]], ring[[0, -1]], equal_nan=True)


def test_edges_of_no_ring_are_refused():
    zero = np.zeros(2, dtype=np.int64)
    with pytest.raises(ValueError, match="no ring"):
        vectorize._rings(zero, zero, zero, zero)
