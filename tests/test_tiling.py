import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.operators import medians, mlprep, tiling, variance
from orthomill.operators.ordering import blocked_row_number, global_row_number


def raster_frame(spark, h=1000, w=700):
    return spark.createDataFrame([("a", h, w, [0.5, 0.0, 100.0, 0.0, -0.5, 200.0])],
                                 "source_id string, height int, width int, transform array<double>")


def image_frame(spark, arrays):
    rows = [(k, r, c, int(a[r, c, 0]), int(a[r, c, 1]), int(a[r, c, 2]))
            for k, a in arrays.items() for r in range(a.shape[0]) for c in range(a.shape[1])]
    return spark.createDataFrame(rows, "source_id string, row int, col int, b0 int, b1 int, b2 int")


def test_padded_grid_matches_nested_ranges(spark):
    got = tiling.padded_windows(raster_frame(spark)).orderBy("tile_index").collect()
    want = [(y, x) for y in range(0, 1000, 448) for x in range(0, 700, 448)]
    assert [(r.row_off, r.col_off) for r in got] == want
    assert [r.tile_index for r in got] == list(range(len(want)))
    assert got[0].tile_id == "a_t00000" and not got[0].padded and got[-1].padded


def test_clamped_and_sliver_windows(spark):
    got = tiling.clamped_windows(raster_frame(spark)).orderBy("window_no").collect()
    want = sorted({(min(y, max(0, 1000 - 512)), min(x, max(0, 700 - 512)))
                   for y in range(0, max(1, 1000 - 512 + 448), 448) for x in range(0, max(1, 700 - 512 + 448), 448)})
    assert [(r.row_off, r.col_off) for r in got] == want
    small = tiling.clamped_windows(raster_frame(spark, 100, 90)).collect()
    assert [(r.row_off, r.col_off, r.win_h, r.win_w) for r in small] == [(0, 0, 100, 90)]
    # Last row starts at 896 (104 high) and last column at 448 (252 wide): below half a tile.
    kept = tiling.drop_slivers(tiling.padded_windows(raster_frame(spark))).collect()
    assert {(r.row_off, r.col_off) for r in kept} == {(0, 0), (448, 0)}


def test_transform_and_bounds(spark):
    rows = tiling.with_tile_bounds(tiling.with_tile_transform(tiling.padded_windows(raster_frame(spark))))
    r = rows.filter("row_off = 448 and col_off = 448").first()
    assert r.tile_transform == [0.5, 0.0, 324.0, 0.0, -0.5, -24.0]
    assert (r.bounds.min_x, r.bounds.max_y) == (324.0, -24.0)
    assert (r.bounds.max_x, r.bounds.min_y) == (324.0 + 252 * 0.5, -24.0 - 512 * 0.5)


def test_every_pixel_reaches_its_windows(spark):
    cells = spark.range(40).select(F.lit("a").alias("source_id"), F.col("id").cast("int").alias("row"), F.lit(0).alias("col"))
    got = {(r.row, r.row_off) for r in tiling.assign_windows(cells, 12, 5).collect()}
    assert got == {(p, o) for p in range(40) for o in range(0, 40, 5) if o <= p < o + 12}


def block_median(gray, w):
    h, width = gray.shape
    found = [gray[y:y + w, x:x + w].var() for y in range(0, h - w + 1, w) for x in range(0, width - w + 1, w)]
    return np.median(found) if found else gray.var()


def test_variances_against_numpy(spark):
    rng = np.random.default_rng(1)
    arrays = {"flat": np.full((20, 20, 3), 7), "noise": rng.integers(0, 256, (23, 17, 3)), "tiny": rng.integers(0, 256, (3, 3, 3))}
    got = {r.source_id: r for r in variance.tile_variance(image_frame(spark, arrays), ["source_id"], 5).collect()}
    for key, a in arrays.items():
        gray = a.mean(axis=2)
        assert got[key].global_variance == pytest.approx(gray.var(), abs=1e-9)
        assert got[key].local_variance == pytest.approx(block_median(gray, 5), abs=1e-9)


def test_padded_window_variance_against_numpy(spark):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (30, 26, 3))
    got = {(r.row_off, r.col_off): r for r in variance.padded_window_variance(
        image_frame(spark, {"a": image}), ["source_id"], 16, 12, 5).collect()}
    for y in range(0, 30, 12):
        for x in range(0, 26, 12):
            tile = np.zeros((16, 16, 3))
            part = image[y:y + 16, x:x + 16]
            tile[:part.shape[0], :part.shape[1]] = part
            gray = tile.mean(axis=2)
            assert got[y, x].global_variance == pytest.approx(gray.var(), abs=1e-6)
            assert got[y, x].local_variance == pytest.approx(block_median(gray, 5), abs=1e-6)


def test_rejection_needs_both_variances_low(spark):
    stats = spark.createDataFrame([("a", 11.9, 5.9), ("b", 11.9, 6.0), ("c", 12.0, 0.0)],
                                  "source_id string, global_variance double, local_variance double")
    got = {r.source_id: r.reason for r in variance.variance_decision(stats).collect()}
    assert got == {"a": "low_variance", "b": "accepted", "c": "accepted"}
    spine = spark.createDataFrame([("a",), ("z",)], "source_id string")
    every = variance.with_load_errors(variance.variance_decision(stats), spine, ["source_id"])
    assert {r.source_id: r.reason for r in every.collect()} == {"a": "low_variance", "z": "load_error"}


def test_gatekeeper_and_valid_data(spark):
    flat, rough = np.full((8, 8, 3), 100), np.indices((8, 8)).sum(axis=0)[:, :, None] % 2 * np.full(3, 200)
    empty = np.zeros((8, 8, 3))
    empty[0, 0] = 255
    pixels = image_frame(spark, {"flat": flat, "rough": rough, "empty": empty})
    keep = {r.source_id: r.keep for r in variance.gatekeeper(pixels, ["source_id"]).collect()}
    assert keep == {"flat": False, "rough": True, "empty": True}
    why = {r.source_id: r.reason for r in variance.valid_data_filter(pixels, ["source_id"]).collect()}
    assert why == {"flat": "flat", "rough": "accepted", "empty": "empty"}


def test_numbering_is_row_major_and_capped(spark):
    rows = [("a", y, x, (y + x) % 3 > 0) for y in range(6) for x in range(7)] + [("b", 0, 0, True)]
    tiles = spark.createDataFrame(rows, "source_id string, row_off int, col_off int, accepted boolean")
    got = variance.number_accepted(tiles).filter("source_id = 'a'").orderBy("accepted_index").collect()
    want = [(y, x) for _, y, x, ok in rows[:-1] if ok]
    assert [(r.row_off, r.col_off) for r in got] == want
    assert variance.number_accepted(tiles, max_tiles=4).groupBy("source_id").count().orderBy("source_id").collect() \
        == [("a", 4), ("b", 1)]


def test_row_numbers_survive_ties_and_hot_groups(spark):
    df = spark.range(500).select(F.when(F.col("id") % 3 > 0, 1).otherwise(F.col("id")).alias("k"), "id")
    got = global_row_number(df, ["k", "id"], partitions=5).orderBy("row_no").collect()
    assert [r.row_no for r in got] == list(range(500))
    assert [(r.k, r.id) for r in got] == sorted((r.k, r.id) for r in got)
    blocked = blocked_row_number(df.withColumn("b", F.col("id") % 10), ["k"], "b", ["id"]).filter("k = 1").orderBy("row_no")
    rows = blocked.collect()
    assert [r.row_no for r in rows] == list(range(len(rows)))
    assert [(r.b, r.id) for r in rows] == sorted((r.b, r.id) for r in rows)


def test_grouped_median(spark, monkeypatch):
    rng = np.random.default_rng(11)
    groups = {"even": rng.normal(size=40), "odd": rng.normal(size=31), "same": np.full(9, 2.5), "one": np.array([4.0]),
              "skewed": np.concatenate([np.full(30, 1.0), [1e9, 2.0, 3.0]]), "ties": rng.integers(0, 3, 50).astype(float)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs] + [("even", None)], "k string, v double")
    got = {r.k: r["median"] for r in medians.grouped_median(df, ["k"], "v").collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})


def test_medians_of_wide_groups_narrow_whatever_the_spread(spark):
    rng = np.random.default_rng(13)
    groups = {"outlier": np.concatenate([rng.normal(size=3000), [1e300, -1e200]]), "powers": 10.0 ** rng.uniform(-200, 200, 2501),
              "heavy": np.concatenate([np.full(4000, 0.25), rng.normal(size=3000)]), "two": np.concatenate([np.arange(2000.0), np.arange(1e9, 1e9 + 2000)]),
              "line": np.arange(4096.0), "small": rng.normal(size=6)}
    df = spark.createDataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], "k string, v double")
    got = {r.k: r["median"] for r in medians.grouped_median(df, ["k"], "v", most=40).collect()}
    assert got == pytest.approx({k: float(np.median(v)) for k, v in groups.items()})
    left, settled = medians.narrowed(df.groupBy("k", "v").agg(F.count("*").alias("_c")), ["k"], "v", 40)
    held = {r.k: r["count"] for r in left.groupBy("k").count().collect()}
    assert max(held.values()) <= 40 and held.keys() | {r.k for r in settled.collect()} == groups.keys()


@pytest.mark.parametrize("size, stride, window", [(16, 8, 4), (12, 9, 6), (7, 5, 3), (8, 12, 4), (4, 4, 9)])
def test_shared_cells_give_every_window_its_own_sums(spark, size, stride, window):
    image = np.random.default_rng(14).integers(0, 256, (29, 33, 3))
    got = {(r.row_off, r.col_off): r for r in variance.padded_window_variance(image_frame(spark, {"a": image}), ["source_id"], size, stride, window).collect()}
    for y, x in [(y, x) for y in range(0, 29, stride) for x in range(0, 33, stride)]:
        gray = np.zeros((size, size))
        part = image[y:y + size, x:x + size].mean(axis=2)
        gray[:part.shape[0], :part.shape[1]] = part
        r = got.pop((y, x))
        assert r.global_variance == pytest.approx(gray.var(), abs=1e-9) and r.local_variance == pytest.approx(block_median(gray, window), abs=1e-9)
    assert not got


def test_raster_variance_equals_tile_variance(spark):
    rng = np.random.default_rng(12)
    pixels = image_frame(spark, {"a": rng.integers(0, 256, (23, 17, 3)), "tiny": rng.integers(0, 256, (3, 3, 3))})
    a = sorted(map(tuple, variance.tile_variance(pixels, ["source_id"], 5, whole_tile=True).collect()))
    b = sorted(map(tuple, variance.tile_variance(pixels, ["source_id"], 5).collect()))
    assert a == b


def test_ground_truth_cells_are_summed_before_they_are_copied_to_windows(spark, monkeypatch):
    seen, assign = [], mlprep.tiling.assign_windows
    monkeypatch.setattr(mlprep.tiling, "assign_windows", lambda cells, *a: seen.append(cells.count()) or assign(cells, *a))
    rng = np.random.default_rng(5)
    a = rng.integers(0, 6, (40, 40))
    cells = spark.createDataFrame([("a", r, c, int(a[r, c])) for r in range(40) for c in range(40)] + [("a", None, 3, 5), ("a", 3, 3, None)], "source_id string, row int, col int, class_id int")
    windows = spark.createDataFrame([("a", r, c) for r in range(0, 40, 5) for c in range(0, 40, 5)], "source_id string, row_off int, col_off int")
    got = {(r.row_off, r.col_off): (r.class_sum, r.gt_pixels) for r in mlprep.ground_truth_tiles(windows, cells, 12, 5, min_sum=300).collect()}
    part = {(r, c): a[r:r + 12, c:c + 12] for r in range(0, 40, 5) for c in range(0, 40, 5)}
    assert got == {k: (int(p.sum()), int((p > 0).sum())) for k, p in part.items() if p.sum() >= 300} and len(got) > 10
    assert seen[0] < 400
