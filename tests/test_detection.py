import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators import assembly, detections, fusion, regions, rules


def iou(a, b):
    w = max(0.0, min(a[2], b[2]) - max(a[0], b[0]))
    h = max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    both = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return w * h / both if both > 0 else 0.0


def greedy(boxes, limit):
    kept = []
    for b in sorted(set(boxes), key=lambda b: (-b[4], *b[:4])):
        if all(iou(k, b) <= limit for k in kept):
            kept.append(b)
    return set(kept)


def random_boxes(n, seed, hot=0):
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x, y = rng.integers(0, 50, 2)
        w, h = rng.integers(2, 40, 2)
        out.append((10.0, 10.0, 30.0, 30.0, 0.9) if i < hot else
                   (float(x), float(y), float(x + w), float(y + h), float(rng.integers(25, 100)) / 100))
    return out


DET = "tile_id int, x1 double, y1 double, x2 double, y2 double, confidence double, class_id int"


@pytest.mark.parametrize("limit", [0.2, 0.45])
def test_suppression_fold_and_rounds_agree_with_greedy(spark, limit):
    tiles = {1: random_boxes(16, 1), 2: random_boxes(30, 2, hot=15), 3: random_boxes(1, 3)}
    rows = [(t, *b, 0) for t, boxes in tiles.items() for b in boxes] + [(4, 0.0, 0.0, 5.0, 5.0, 0.1, 0)]
    df = spark.createDataFrame(rows, DET)
    for fold_limit in (512, 20, 0):  # everything folded, small and large groups in one table, everything in rounds
        got = detections.suppress(df, 0.25, limit, fold_limit=fold_limit).collect()
        for t, boxes in tiles.items():
            assert {(r.x1, r.y1, r.x2, r.y2, r.confidence) for r in got if r.tile_id == t} == greedy(boxes, limit)
        assert not [r for r in got if r.tile_id == 4]


def test_suppression_cap(spark):
    rows = [(1, 100.0 * i, 0.0, 100.0 * i + 5, 5.0, 0.3 + i / 100, 0) for i in range(10)]
    got = detections.suppress(spark.createDataFrame(rows, DET), max_det=3).collect()
    assert sorted(r.confidence for r in got) == pytest.approx([0.37, 0.38, 0.39])


def test_feature_vector_layout(spark):
    dets = spark.createDataFrame([(1, 1.0, 2.0, 4.0, 8.0, 0.5, 2), (1, 0.0, 0.0, 1.0, 1.0, 0.75, 1)], DET)
    spine = spark.createDataFrame([(1,), (2,)], "tile_id int")
    got = {r.tile_id: r.det_features for r in detections.feature_vectors(spine, dets, 3).collect()}
    assert got[1] == [0, 0, 1, 1, 0.75, 1, 1, 2, 3, 6, 0.5, 2, 0, 0, 0, 0, 0, 0, 2, 0.75, 0.625]
    assert got[2] == [0.0] * 21


def test_best_mask_and_quality(spark):
    masks = spark.createDataFrame([(1, 0, 10, 0.5), (1, 1, 20, 0.9), (1, 2, 30, 0.9)], "tile_id int, mask_no int, mask_area int, score double")
    best = detections.best_masks(masks, ["tile_id"]).first()
    assert (best.mask_no, best.mask_area) == (1, 20)
    box = spark.createDataFrame([(-3.7, 2.9, 100.0, 5.2), (9.0, 9.0, 3.0, 3.0)], "x1 double, y1 double, x2 double, y2 double")
    areas = [r.a for r in box.select(detections.box_mask_area(F.lit(50), F.lit(50)).alias("a")).collect()]
    assert areas == [50 * 3, 0]


def test_softmax_and_argmax(spark):
    z = [[0.0, 2.0, 2.0], [1000.0, 0.0, -5.0]]
    df = spark.createDataFrame([(1, 0, i, v) for i, v in enumerate(z)], "tile_id int, row int, col int, logits array<double>")
    got = fusion.classify_pixels(df).orderBy("col").collect()
    assert [r.class_id for r in got] == [1, 0]
    e = np.exp(np.array(z[0]) - 2)
    assert got[0].probs == pytest.approx(list(e / e.sum())) and got[1].max_prob == pytest.approx(1.0)


def test_assembly_zeroes_wrong_parts(spark):
    row = [(1, [1.0] * 4, [2.0] * 2, None, [3.0])]
    df = spark.createDataFrame(row, "tile_id int, seg_features array<float>, det_features array<float>, depth_features array<float>, mask_stats array<float>")
    got = fusion.assemble(df, 4, 3, 2, 1).first().features
    assert got == [1.0] * 4 + [0.0] * 3 + [0.0] * 2 + [3.0]
    assert fixed.SEG_DIM + fixed.DET_DIM + fixed.DEPTH_DIM + fixed.MASK_DIM == 838


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(7)
    w = {"w0": rng.normal(size=(5, 4)), "b0": rng.normal(size=4), "w1": rng.normal(size=(4, 3)), "b1": rng.normal(size=3)}
    for head, n in (("accept", 1), ("refine", 1), ("class", 6), ("confidence", 1)):
        w[f"{head}_w"], w[f"{head}_b"] = rng.normal(size=(3, n)), rng.normal(size=n)
    x = rng.normal(size=(9, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "tile_id int, features array<double>")
    h = np.maximum(np.maximum(x @ w["w0"] + w["b0"], 0) @ w["w1"] + w["b1"], 0)
    accept = 1 / (1 + np.exp(-(h @ w["accept_w"] + w["accept_b"])))[:, 0]
    refine = 1 / (1 + np.exp(-(h @ w["refine_w"] + w["refine_b"])))[:, 0]
    for r in fusion.score(df, w).collect():
        assert r.accept_val == pytest.approx(accept[r.tile_id]) and r.refine_flag == (refine[r.tile_id] > 0.5)
        assert r.class_id == (h @ w["class_w"] + w["class_b"])[r.tile_id].argmax()


DECISION = "tile_id int, accept_val double, refine_flag boolean, class_id int, confidence_val double"


def test_defaults_and_override(spark):
    spine = spark.createDataFrame([(1,), (2,)], "tile_id int")
    scored = spark.createDataFrame([(1, 0.2, False, 4, 0.3)], DECISION)
    full = fusion.with_default_decision(spine, scored)
    assert tuple(full.filter("tile_id = 2").first()) == (2, 0.5, True, 1, 0.5)
    boxes = spark.createDataFrame([(1, 2, None), (2, 0, 0.9)], "tile_id int, count long, max_confidence double")
    got = {r.tile_id: r for r in rules.detector_override(full, boxes).collect()}
    assert (got[1].class_id, got[1].accept_val, got[1].confidence_val) == (1, 1.0, 0.8)
    assert (got[2].class_id, got[2].confidence_val) == (1, 0.5)


def test_spectral_rules_boundaries(spark):
    d = spark.createDataFrame([(i, 0.5, True, c, 0.9) for i, c in enumerate((4, 4, 4, 3, 3, 4))], DECISION)
    stats = spark.createDataFrame([(0, 105.0, 100.0, 400.0), (1, 105.1, 100.0, 0.0), (2, 50.0, 100.0, 400.1),
                                   (3, 100.0, 110.1, 149.9), (4, 100.0, 110.1, 150.0)],
                                  "tile_id int, mean_g double, mean_b double, texture double")
    got = {r.tile_id: r.class_id for r in rules.spectral_rules(d, stats).collect()}
    assert got == {0: 4, 1: 3, 2: 3, 3: 4, 4: 3, 5: 4}


def test_zonal_stats_need_enough_pixels(spark):
    d = spark.createDataFrame([(1, 0.5, True, 4, 0.9), (2, 0.5, True, 4, 0.9), (3, 0.5, True, 1, 0.9)], DECISION)
    px = spark.createDataFrame([(t, i, 2 * i, 50, 4) for t, n in ((1, 3), (2, 2), (3, 9)) for i in range(n)],
                               "tile_id int, b0 int, b1 int, b2 int, mask_class int")
    got = rules.zonal_stats(d, px, min_pixels=2).collect()
    assert [r.tile_id for r in got] == [1]
    gray = np.floor(0.299 * np.arange(3) + 0.587 * 2 * np.arange(3) + 0.114 * 50 + 0.5)
    assert got[0].mean_g == 2.0 and got[0].texture == pytest.approx(gray.var())


def test_height_rules_with_nulls_and_strict_limits(spark):
    d = spark.createDataFrame([(i, 0.5, True, c, 0.9) for i, c in enumerate((4, 4, 4, 1, 1, 1, 3))], DECISION)
    h = spark.createDataFrame([(0, None, None), (1, 0.5, 1.0), (2, 0.51, 1.0), (3, 3.0, 12.0), (4, 3.0, 12.25), (6, 9.0, 99.0)],
                              "tile_id int, z_mean double, z_max double")
    got = {r.tile_id: r for r in rules.height_rules(d, h).collect()}
    assert [got[i].final_class_id for i in range(7)] == [4, 4, 0, 1, 1, 1, 3]
    assert got[2].class_id == 4 and got[2].shadow_reason == "Water rejected: mean height 0.51m > 0.5m threshold"
    assert [got[i].illegal_height_flag for i in (3, 4, 5, 6)] == [False, True, False, False]
    assert got[4].height_reason == "Building flagged: height 12.2m > 12m (possible G+3 or higher)"


def test_low_confidence(spark):
    d = spark.createDataFrame([(1, 0.5, True, 2, 0.59), (2, 0.5, True, 0, 0.1), (3, 0.5, True, 2, 0.6)], DECISION)
    assert {r.tile_id: r.class_id for r in rules.low_confidence_rule(d).collect()} == {1: 5, 2: 0, 3: 2}


def test_heights_from_points_and_sources(spark):
    pts = spark.createDataFrame([(1, 0.5, 0.5, z) for z in (1.0, 2.0, 2.0, 7.0)] + [(1, 5.5, 0.5, 99.0)], "tile_id int, x double, y double, z double")
    mask = spark.createDataFrame([(1, 0, 0)], "tile_id int, row int, col int")
    h = rules.heights_from_points(pts, mask)
    r = h.first()
    assert (r.z_mean, r.z_median, r.z_min, r.z_max) == (3.0, 2.0, 1.0, 7.0)
    assert r.z_std == pytest.approx(np.std([1, 2, 2, 7]))
    assert tuple(rules.heights_from_points(pts, mask, bounded=True).first()) == tuple(r)
    moved = pts.withColumn("x", F.col("x") * 2 + 100).withColumn("y", 50 - F.col("y") * 2)
    affine = F.array(*[F.lit(v) for v in (2.0, 0.0, 100.0, 0.0, -2.0, 50.0)])
    assert tuple(rules.heights_from_points(moved, mask, affine).first()) == tuple(r)
    spine = spark.createDataFrame([(1,), (2,)], "tile_id int")
    got = {r.tile_id: r for r in rules.with_heights(spine, h).collect()}
    assert got[1].source == "las" and got[2].source == "none" and got[2].z_mean is None


def test_burned_boxes_include_their_end(spark):
    mask = spark.createDataFrame([(1, r, c, 3) for r in range(6) for c in range(6)], "tile_id int, row int, col int, class_id int")
    boxes = spark.createDataFrame([(1, -2.0, 1.9, 2.2, 3.7), (1, 4.0, 4.0, 50.0, 50.0)], "tile_id int, x1 double, y1 double, x2 double, y2 double")
    ones = {(r.row, r.col) for r in rules.burn_boxes(mask, boxes, 6, 6).collect() if r.class_id == 1}
    assert ones == {(r, c) for r in (1, 2, 3) for c in (0, 1, 2)} | {(r, c) for r in (4, 5) for c in (4, 5)}


def test_polygon_sources(spark):
    block = [(t, r, c, 1 + (c > 3)) for t in (1, 2, 3) for r in range(4) for c in range(8)]
    mask = spark.createDataFrame(block + [(1, 9, 9, 5)], "tile_id int, row int, col int, class_id int")
    d = spark.createDataFrame([(1, 0.3, True, 4, 0.7), (2, 0.29, True, 1, 0.7), (3, 0.9, True, 2, 0.8)], DECISION)
    refined = spark.createDataFrame([(3, 0, r, c, 0.31) for r in range(4) for c in range(4)] + [(1, 0, 0, 0, 0.3)],
                                    "tile_id int, cand int, row int, col int, quality double")
    conf = spark.createDataFrame([(1, 0.66)], "tile_id int, confidence double")
    got = assembly.tile_polygons(d, mask, conf, refined, tolerance=0.0).collect()
    assert {(r.tile_id, r.class_id, r.area, r.confidence, r.source_masks[0]) for r in got} == {
        (1, 1, 16.0, 0.66, fixed.SEG_TAG), (1, 2, 16.0, 0.66, fixed.SEG_TAG), (3, 2, 16.0, 0.8, fixed.REFINED_TAG)}


def test_diagnostics_one_row_per_tile(spark):
    spine = spark.createDataFrame([("r", i) for i in range(4)], "run_id string, tile_id int")
    only = lambda *ids: spark.createDataFrame([(i,) for i in ids], "tile_id int")
    d = spark.createDataFrame([(i, 0.5, True, 1, 0.9) for i in range(4)], DECISION)
    h = spark.createDataFrame([(2, 1.0, 2.0, "las"), (3, None, None, "none")], "tile_id int, z_mean double, z_max double, source string")
    out = assembly.diagnostics(spine, only(0).withColumn("message", F.lit("gone")), only(0, 1, 2).withColumn("keep", F.col("tile_id") != 1),
                               only(1, 2, 3), only(2), h, d)
    got = {r.tile_id: r for r in out.collect()}
    assert [got[i].status for i in range(4)] == ["error", "skipped", "complete", "complete"]
    assert got[0].errors == ["load_error: gone"] and got[1].errors == ["gatekeeper_rejected_low_variance"]
    assert got[2].models_used == ["swin", "yolo", "depth"] and got[3].models_used == ["swin"]
    assert got[1].fusion_decision is None and got[2].fusion_decision.class_id == 1
    timing = spark.range(1).select(assembly.timing_map(total=F.lit(1.5), depth=F.lit(None).cast("double")).alias("t")).first().t
    assert timing == {"total": 1.5}


def test_metadata_default(spark):
    tiles = spark.createDataFrame([(1,), (2,)], "tile_id int")
    meta = spark.createDataFrame([(1, [2.0, 0.0, 0.0, 0.0, -2.0, 0.0])], "tile_id int, transform array<double>")
    got = {r.tile_id: r.transform for r in assembly.align_metadata(tiles, meta).collect()}
    assert got == {1: [2.0, 0.0, 0.0, 0.0, -2.0, 0.0], 2: [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]}


def test_grid_coords_rules(spark):
    rows = [("a_00037", None), ("a_t00037", None), ("a", None), ("x", (-1030.0, 515.0, 0.0, 0.0))]
    df = spark.createDataFrame(rows, "tile_id string, bounds struct<min_y:double,min_x:double,max_y:double,max_x:double>")
    at = lambda **k: {r.tile_id: tuple(r.g) for r in df.select(
        "tile_id", regions.grid_coords(F.col("bounds"), F.col("tile_id"), **k).alias("g")).collect()}
    assert at() == {"a_00037": (7, 3), "a_t00037": (0, 0), "a": (0, 0), "x": (1, 2)}
    assert at(id_pattern=r"_t(\d+)$")["a_t00037"] == (7, 3)


def test_dominant_class(spark):
    e = "array<struct<class_id:int,confidence:double>>"
    df = spark.createDataFrame([(1, [(2, 0.5), (3, 0.9), (4, 0.9)]), (1, []), (1, None), (None, None)], f"c int, d {e}")
    got = [r.k for r in df.select(regions.dominant_class(F.col("c"), F.col("d")).alias("k")).collect()]
    assert got == [3, 1, 1, 0]


def test_regions_touch_at_corners(spark):
    tiles = [("a1", 1, 0, 0, True), ("a2", 1, 1, 1, True), ("a3", 1, 3, 1, True), ("b1", 2, 0, 1, False), ("z", 0, 2, 1, True), ("a0", 1, 2, 2, True)]
    rows = [(t, c, x, y, (y * 512.0, x * 512.0, y * 512.0 + 512, x * 512.0 + 512) if b else None) for t, c, x, y, b in tiles]
    df = spark.createDataFrame(rows, "tile_id string, class_id int, gx long, gy long, bounds struct<min_y:double,min_x:double,max_y:double,max_x:double>")
    for chunk in (256, 2):
        members, table = regions.cluster_tiles(df, chunk=chunk)
        got = {r.region_id: r for r in table.collect()}
        assert {(r.class_id, r.num_tiles, r.min_x, r.max_x) for r in got.values()} == {(1, 4, 0.0, 2048.0), (2, 1, 0.0, 512.0)}
        assert (got["R0001"].class_id, got["R0002"].max_y) == (1, 512.0)
        lists = regions.member_lists(members, 2).collect()
        assert sorted(t for r in lists if r.region_id == "R0001" for t in r.tile_ids) == ["a0", "a1", "a2", "a3"]
    transforms = spark.createDataFrame([("a1", [1.0, 0.0, 5.0, 0.0, -1.0, 6.0])], "tile_id string, transform array<double>")
    canvas = {r.region_id: r for r in regions.region_canvas(members, transforms).collect()}
    assert (canvas["R0001"].w_tiles, canvas["R0001"].h_tiles, canvas["R0001"].width) == (4, 3, 2048)
    assert canvas["R0001"].transform[2] == 5.0 and canvas["R0002"].transform == [1.0, 0.0, 0.0, 0.0, -1.0, 0.0]


def test_tile_output_document(spark):
    spine = spark.createDataFrame([("t",), ("u",)], "tile_id string")
    polys = spark.createDataFrame([("t", 1, 0.5, ["swin"], 4.0, 8.0)], "tile_id string, class_id int, confidence double, source_masks array<string>, area double, perimeter double") \
        .withColumn("rings", geo.box_rings(F.lit(0), F.lit(0), F.lit(2), F.lit(2)))
    none = spark.createDataFrame([], "tile_id string, z_mean double, count long, confidence double, accept_val double")
    got = {r.tile_id: r for r in assembly.tile_outputs(spine, polys, none, none, none, none).collect()}
    assert got["t"].num_polygons == 1 and got["t"].polygons[0].geometry_wkt == "POLYGON ((2 0, 2 2, 0 2, 0 0, 2 0))"
    assert got["u"].polygons == [] and (got["u"].swin_confidence, got["u"].yolo_count, got["u"].fusion_accept) == (0.0, 0, 0.0)
