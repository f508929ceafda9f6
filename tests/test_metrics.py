import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.operators import fusion_train, matching, metrics, mlprep, spatial_join, views


def pairs_frame(spark, pred, target, key="a"):
    return spark.createDataFrame([(key, int(p), int(t)) for p, t in zip(pred, target)], "image string, pred int, target int")


def test_absent_class_is_left_out_of_the_mean(spark):
    df = pairs_frame(spark, [0, 0, 1, 1], [0, 1, 1, 1])
    ious = {r.class_id: r.iou for r in metrics.class_iou(df, 4).collect()}
    assert ious[0] == 0.5 and ious[1] == pytest.approx(2 / 3) and ious[2] is None and ious[3] is None
    assert metrics.mean_iou(metrics.class_iou(df, 4)).first().miou == pytest.approx((0.5 + 2 / 3) / 2)
    two = df.unionByName(pairs_frame(spark, [2, 2], [3, 3], "b"))
    assert metrics.validation_miou(two, "image", 4).first().miou == pytest.approx((0.5 + 2 / 3) / 4)
    assert metrics.pixel_accuracy(df).first().accuracy_pct == 75.0


def test_histogram_and_weights(spark):
    df = spark.createDataFrame([(c,) for c in [0] * 4 + [1] * 3 + [2] + [9] * 5], "class_id int")
    hist = metrics.class_histogram(df)
    got = {r.class_id: (r.pixels, r.pct) for r in hist.collect()}
    assert got[0] == (4, 50.0) and got[5] == (0, 0.0) and 9 not in got
    raw = 1 / (np.log1p(np.array([3, 1, 0, 0, 0]) / 4 * 100) + 0.1)
    weights = [r.weight for r in metrics.loss_weights(hist).orderBy("class_id").collect()]
    assert weights == pytest.approx(list(raw / raw.min()))


def test_losses_against_numpy(spark):
    rng = np.random.default_rng(8)
    p = rng.dirichlet(np.ones(3), (2, 5))
    t = rng.integers(0, 3, (2, 5))
    rows = [(i, [float(v) for v in p[i, j]], int(t[i, j])) for i in range(2) for j in range(5)]
    df = spark.createDataFrame(rows, "image int, probs array<double>, target int")
    hot = np.eye(3)[t]
    dice = (2 * (p * hot).sum(1) + 1e-6) / ((p + hot).sum(1) + 1e-6)
    pt = (p * hot).sum(2)
    for gamma, base in ((2.0, ((1 - pt) ** 2 * -np.log(pt)).mean()), (None, -np.log(pt).mean())):
        r = metrics.evaluation_loss(df, "image", 3, gamma=gamma).first()
        assert r.dice_loss == pytest.approx(1 - dice.mean()) and r.base_loss == pytest.approx(base)
        assert r.loss == pytest.approx(0.5 * (1 - dice.mean()) + 0.5 * base)


def greedy(pred, gt, least=0.5):
    def iou(a, b):
        w = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
        return w / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w)
    edges = sorted((-iou(p, g), i, j) for i, p in enumerate(pred) for j, g in enumerate(gt) if iou(p, g) >= least)
    used_i, used_j, out = set(), set(), []
    for v, i, j in edges:
        if i not in used_i and j not in used_j:
            used_i.add(i)
            used_j.add(j)
            out.append(round(-v, 9))
    return sorted(out)


OBJ = "tile_id int, idx int, x1 double, y1 double, x2 double, y2 double"


def test_matching_fold_and_rounds_agree_with_greedy(spark):
    rng = np.random.default_rng(9)
    tiles = {}
    for t in range(4):
        def boxes(n, copies):
            out = []
            for i in range(n):
                x, y = rng.integers(0, 6, 2)
                out.append((1.0, 1.0, 9.0, 9.0) if i % 3 < copies else (float(x), float(y), float(x + 6 + i % 3), float(y + 7)))
            return out
        tiles[t] = (boxes(14, t % 3), boxes(12, t % 2))
    pred = spark.createDataFrame([(t, i, *b) for t, (p, _) in tiles.items() for i, b in enumerate(p)], OBJ)
    gt = spark.createDataFrame([(t, i, *b) for t, (_, g) in tiles.items() for i, b in enumerate(g)], OBJ)
    for limit in (10_000, 60, 0):  # all folded, both kinds in one table, all in rounds
        got = matching.match(pred, gt, cell=8.0, fold_limit=limit).collect()
        for t, (p, g) in tiles.items():
            found = sorted(round(r.iou, 9) for r in got if r.tile_id == t for _ in range(r.matches))
            assert found == greedy(p, g)


def test_polygons_match_by_their_exact_overlap(spark):
    ring = "tile_id int, idx int, rings array<array<struct<x:double,y:double>>>"
    def poly(*pts):
        return [[tuple(map(float, p)) for p in (*pts, pts[0])]]
    lower, upper = poly((0, 0), (8, 0), (0, 8)), poly((8, 8), (0, 8), (8, 0))
    square = poly((0, 0), (8, 0), (8, 8), (0, 8))
    # The triangles share a bounding box with each other but no area; each covers half of the square.
    pred = spark.createDataFrame([(1, 0, lower), (1, 1, upper), (2, 0, lower), (2, 1, lower)], ring)
    gt = spark.createDataFrame([(1, 0, upper), (1, 1, square), (2, 0, upper), (2, 1, lower), (2, 2, lower)], ring)
    for limit in (100, 0):
        got = matching.match(pred, gt, iou_min=0.5, cell=4.0, fold_limit=limit, rings="rings").collect()
        found = {t: sorted(round(r.iou, 6) for r in got if r.tile_id == t for _ in range(r.matches)) for t in (1, 2)}
        assert found == {1: [0.5, 1.0], 2: [1.0, 1.0]}


def test_match_metrics_edges(spark):
    pred = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 4.0), (2, 0, 0.0, 0.0, 1.0, 1.0)], OBJ)
    gt = spark.createDataFrame([(1, 0, 0.0, 0.0, 4.0, 4.0), (1, 1, 0.0, 1.0, 4.0, 5.0), (3, 0, 0.0, 0.0, 1.0, 1.0)], OBJ)
    spine = spark.createDataFrame([(i,) for i in range(1, 5)], "tile_id int")
    got = {r.tile_id: r for r in matching.match_metrics(spine, pred, gt, matching.match(pred, gt)).collect()}
    assert (got[1].precision, got[1].recall, got[1].mean_iou) == (1.0, 0.5, 1.0) and got[1].f1 == pytest.approx(2 / 3)
    assert all((got[i].precision, got[i].recall, got[i].f1, got[i].mean_iou) == (0.0,) * 4 for i in (2, 3))
    assert (got[4].precision, got[4].recall, got[4].f1, got[4].mean_iou) == (1.0,) * 4
    with pytest.raises(ValueError):
        matching.match(pred, gt, iou_min=0.0)


def items(spark, n):
    return spark.createDataFrame([(f"i{i:02d}",) for i in range(n)], "tile_id string")


def test_fold_tail_is_never_validated(spark):
    sides = [[r.side for r in mlprep.k_fold(items(spark, 7), ["tile_id"], 3, f).orderBy("row_no").collect()] for f in range(3)]
    assert sides[0] == ["val"] * 2 + ["train"] * 5 and all(s[6] == "train" for s in sides)
    assert [sum(s[i] == "val" for s in sides) for i in range(7)] == [1] * 6 + [0]


def test_fusion_folds_fill_empty_sides(spark):
    def counts(n, k, f):
        return dict(mlprep.fusion_folds(items(spark, n), ["tile_id"], k, f).groupBy("side").count().collect())
    assert counts(1, 5, 0) == {"train": 1, "val": 1}
    assert counts(3, 5, 4) == {"train": 3, "val": 3}
    assert counts(10, 5, 1) == {"train": 8, "val": 2}
    assert (mlprep.fold_count(5, 3), mlprep.fold_count(5, 0)) == (3, 1)


def test_splits(spark):
    split = mlprep.shuffled_split(items(spark, 50), "tile_id").groupBy("side").count().collect()
    assert dict(split) == {"train": 40, "val": 10}
    masks = items(spark, 12).filter("tile_id <> 'i05'")
    got = {r.tile_id: r.side for r in mlprep.every_fifth(items(spark, 12), ["tile_id"], masks).collect()}
    assert [k for k, v in sorted(got.items()) if v == "val"] == ["i00", "i10"] and "i05" not in got


def test_weighted_draw_follows_the_weights(spark):
    tiles = spark.range(3000).select(F.col("id").alias("tile_id"), F.when(F.col("id") % 10 == 0, 5).otherwise(1).alias("weight"))
    draws = mlprep.weighted_draw(tiles)
    assert draws.count() == 3000 and draws.select("draw").distinct().count() == 3000
    high = draws.filter("tile_id % 10 = 0").count() / 3000
    assert high == pytest.approx(300 * 5 / (300 * 5 + 2700), abs=0.04)


def test_pairing_priority(spark):
    tiles = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "tile_id string")
    rows = [("tile", "a_mask", "3"), ("ann", "a", "2"), ("ann", "a_mask", "1"), ("ann", "b", "2b"), ("tile", "b_mask", "3b"), ("tile", "c_mask", "3c"), ("tile", "d", "x")]
    got = {r.tile_id: r.mask_path for r in mlprep.pair_masks(tiles, spark.createDataFrame(rows, "folder string, stem string, path string")).collect()}
    assert got == {"a": "1", "b": "2b", "c": "3c", "d": ""}


def test_box_labels_use_eight_neighbours(spark):
    a = np.zeros((8, 8), dtype=int)
    a[2, 2] = a[3, 3] = 2
    a[6, 6] = 5
    mask = spark.createDataFrame([("t", r, c, int(a[r, c])) for r in range(8) for c in range(8)], "tile_id string, row int, col int, class_id int")
    got = mlprep.box_labels(mask, 8, 8, min_area=2).collect()
    assert [r.line for r in got] == ["1 0.375000 0.375000 0.250000 0.250000"]


def test_class_sum_is_not_a_pixel_count(spark):
    windows = spark.createDataFrame([("a", 0, 0), ("a", 0, 10)], "source_id string, row_off int, col_off int")
    cells = spark.createDataFrame([("a", 0, i, 5) for i in range(4)] + [("a", 0, 10 + i, 1) for i in range(9)], "source_id string, row int, col int, class_id int")
    got = mlprep.ground_truth_tiles(windows, cells, 10, 10, min_sum=20).collect()
    assert [(r.tile_id, r.col_off, r.class_sum, r.gt_pixels) for r in got] == [("real_gt_00000", 0, 20, 4)]


def test_polygons_of_few_edges_overlap_as_by_arrays(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rings = [np.round(rng.uniform(0, 6, (n, 2)), d) for n in (3, 4, 6, 9) for d in (0, 1, 9) for _ in range(8)]
    edges = [np.hstack([r, np.roll(r, -1, axis=0)]) for r in rings]
    few = [spatial_join.overlap_area(a, b) for a in edges for b in edges]
    assert any(len(a) * len(b) <= spatial_join.FEW_EDGE_PAIRS for a in edges for b in edges)
    huge = np.array([[0, 0, 1e308, 1e308], [1e308, 1e308, -1e308, 1e308], [-1e308, 1e308, 0, 0]])
    assert spatial_join._few_edges_overlap([[0.0, 0.0, 1.0, float("nan")]], huge.tolist()) is None
    monkeypatch.setattr(spatial_join, "FEW_EDGE_PAIRS", 0)
    assert few == [spatial_join.overlap_area(a, b) for a in edges for b in edges] and max(few) > 1


def test_polygons_are_measured_once_and_not_by_pair(spark, monkeypatch):
    measured, area = [], matching.geo.polygon_area
    monkeypatch.setattr(matching.geo, "polygon_area", lambda rings: measured.append(str(rings)) or area(rings))
    side = lambda n, by: spark.range(n).select(
        F.lit(1).alias("tile_id"), F.col("id").alias("idx"), matching.geo.box_rings(*[F.col("id") % by + v for v in (0.0, 0.0, 8.0, 8.0)]).alias("rings"))
    got = matching.match(side(6, 3), side(4, 2), cell=32.0, rings="rings").agg(F.sum("matches"), F.sum("iou")).first()
    assert tuple(got) == (4, 4.0) and len(measured) == 2 and not any("r_rings" in m for m in measured)


def test_pseudo_labels(spark):
    rows = [(1, i, 0, 2, 0.85 if i < 3 else 0.84) for i in range(6)] + [(2, i, 0, 0, 0.99) for i in range(6)]
    df = spark.createDataFrame(rows, "tile_id int, row int, col int, class_id int, max_prob double")
    labels, verdicts = mlprep.pixel_pseudo_labels(df, min_pixels=3)
    assert {r.tile_id: (r.foreground, r.accepted) for r in verdicts.collect()} == {1: (3, True), 2: (0, False)}
    assert sorted(r.class_id for r in labels.collect()) == [0, 0, 0, 2, 2, 2]


def test_ground_truth_defaults_and_records(spark):
    tiles = spark.createDataFrame([(1,), (2,), (3,)], "tile_id int")
    mask = spark.createDataFrame([(1, 0), (1, 4), (2, 0)], "tile_id int, class_id int")
    got = {r.tile_id: tuple(r)[1:] for r in mlprep.ground_truth_info(tiles, mask).collect()}
    assert got == {1: (4, True, 1.0, False), 2: (0, False, 1.0, False), 3: (1, True, 0.0, True)}
    clamped = mlprep.clamp_classes(spark.createDataFrame([(-1,), (3,), (9,)], "class_id int"))
    assert [r.class_id for r in clamped.collect()] == [0, 3, 5]


def test_training_finds_a_separable_rule(spark):
    rng = np.random.default_rng(10)
    x = rng.normal(size=(120, 3))
    rows = [(i, [float(v) for v in r], float(r[0] > 0), float(r[1] > 0), int(r[0] > 0) + int(r[1] > 0), float(r[2])) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "tile_id int, features array<double>, accept double, refine double, class_id int, confidence double")
    models, table = fusion_train.cross_validate(df, 2, num_classes=3, hidden=6, max_iter=60)
    losses = table.collect()
    assert len(losses) == 2 and sum(r.best for r in losses) == 1 and set(models) == {"accept", "refine", "class", "confidence"}
    assert all(r.accept_loss < 0.4 and r.confidence_loss < 0.05 for r in losses)


def test_views(spark):
    diag = spark.createDataFrame([("r", "a", "complete", 2.0), ("r", "b", "error", 1.0), ("r", "c", "failed", 3.0)],
                                 "run_id string, tile_id string, status string, elapsed_s double")
    r = views.run_summary(diag).first()
    assert (r.num_tiles, r.completed, r.errors, r.failed, r.total_time_s, r.avg_time_per_tile) == (3, 1, 1, 1, 6.0, 2.0)
    assert spark.range(1).select(views.progress_percent(F.lit(0), F.lit(0)).alias("p")).first().p == 0.0
