import io
import os
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.functions import geometry as geo
from orthomill.functions import ids
from orthomill.plans import preprocess
from orthomill.sources import files, sinks
from orthomill.sources import testbed as tb
from orthomill.streaming import jobs


def test_listing_and_latest(spark, tmp_path):
    for name in ("b.TIF", "a.tif", "c.png", "sub/d.tif"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    flat = [os.path.basename(r.path) for r in files.list_inputs(spark, str(tmp_path), [".tif"]).collect()]
    deep = [os.path.basename(r.path) for r in files.list_inputs(spark, str(tmp_path), [".tif"], recursive=True).collect()]
    assert flat == ["a.tif", "b.TIF"] and sorted(deep) == ["a.tif", "b.TIF", "d.tif"]


def test_tile_outputs_skip_broken_files(spark, tmp_path):
    (tmp_path / "a_output.json").write_text('{\n "tile_id": "a",\n "polygons": [{"class_id": 1, "geometry_wkt": "POLYGON ((0 0, 1 0, 1 1, 0 0))"}]\n}')
    (tmp_path / "b_output.json").write_text('{"tile_id": ')
    (tmp_path / "other.json").write_text('{"tile_id": "no"}')
    good, bad = files.collect_tile_outputs(spark, str(tmp_path))
    assert [r.tile_id for r in good.collect()] == ["a"]
    assert [os.path.basename(r.path) for r in bad.collect()] == ["b_output.json"]
    row = sinks.features(good).first()
    assert (row.class_name, row.confidence, row.area, row.z_mean) == ("building", 0.0, 0.0, None)


def test_json_lines_append(spark, tmp_path):
    path = str(tmp_path / "r")
    for i in range(2):
        files.append_records(spark.createDataFrame([(i,)], "n int"), path)
    (tmp_path / "r" / "extra.json").write_text('\n{"n": 7}\n\n')
    assert sorted(r.n for r in files.load_records(spark, path, "n int").collect()) == [0, 1, 7]


def test_arrays_and_load_errors(spark):
    def npy(a):
        buffer = io.BytesIO()
        np.save(buffer, a)
        return buffer.getvalue()
    image = np.arange(12, dtype=np.uint8).reshape(2, 2, 3)
    df = spark.createDataFrame([("x/tile_a.npy", npy(image)), ("x/b.npy", npy(image[:, :, 0])), ("x/c.npy", b"zip")], "path string, content binary")
    got = files.decode_arrays(df).collect()
    a = {(r.row, r.col): (r.b0, r.b1, r.b2) for r in got if r.tile_id == "a"}
    assert a == {(r, c): tuple(image[r, c]) for r in range(2) for c in range(2)}
    assert all(r.b0 == r.b1 == r.b2 for r in got if r.tile_id == "b")
    assert [r.load_error is not None for r in got if r.tile_id == "c"] == [True]


def test_metadata_split(spark):
    text = '[{"tile_id": "a", "bbox": [[1, 2], [3, 4]]}, {"bbox": [[0, 0], [1, 1]]}, {"tile_id": "b", "bounds": [[9, 9], [9, 9]], "bbox": [[1, 2], [3, 4]]}]'
    got = files.split_metadata(spark.createDataFrame([(text,)], "json string")).collect()
    assert [(r.tile_id, r.bounds[0]) for r in got] == [("a", [1.0, 2.0]), ("b", [9.0, 9.0])]


def test_names(spark):
    df = spark.createDataFrame([("d/My File  2.ortho.tif",), ("tile_a_b.png",), ("plain",)], "p string")
    got = [tuple(r) for r in df.select(ids.source_name(F.col("p")), ids.tile_id_of(F.col("p"))).collect()]
    assert got == [("My_File_2.ortho", "My File  2.ortho"), ("tile_a_b", "a_b"), ("plain", "plain")]
    names = [r[0] for r in spark.createDataFrame([(1,), (8,), (77,), (-1,)], "c int").select(ids.class_name(F.col("c"), prefix="class_")).collect()]
    assert names == ["building", "tiled_roof", "class_77", "class_-1"]


def detections(spark, run, n):
    return spark.range(n).select(
        F.lit(run).alias("run_id"), F.col("id").cast("string").alias("tile_id"), F.lit(None).cast("int").alias("class_id"),
        F.lit(0.5).alias("confidence"), F.lit(1.0).alias("z_mean"), F.lit(2.0).alias("z_max"), F.lit(3.0).alias("area"),
        geo.box_rings(F.lit(500000.0), F.lit(0.0), F.lit(500100.0), F.lit(100.0)).alias("rings"), F.lit("EPSG:32644").alias("crs"))


def test_detections_replace_only_their_run(spark, tmp_path):
    path = str(tmp_path / "d")
    for run, n in (("a", 3), ("b", 2), ("a", 4)):
        sinks.persist_detections(sinks.detection_rows(detections(spark, run, n)), path)
    stored = spark.read.parquet(path)
    assert dict(stored.groupBy("run_id").count().collect()) == {"a": 4, "b": 2}
    row = stored.first()
    assert row.class_id == 0 and row.z_max == 2.0 and row.rings[0][3].x == pytest.approx(81.0)


def test_layers_prune_and_merge(spark, tmp_path):
    rows = spark.createDataFrame([("t", 1, "building"), ("t", 9, "9")], "tile_id string, class_id int, class_name string") \
        .withColumn("rings", geo.box_rings(F.lit(0), F.lit(0), F.lit(1), F.lit(1)))
    sinks.write_layers(rows, str(tmp_path / "north.gpkg"))
    assert sinks.read_layer(spark, str(tmp_path / "north.gpkg"), "class_9").count() == 1
    merged = sinks.merge_villages(spark, [str(tmp_path / "north.gpkg"), str(tmp_path / "none")]).collect()
    assert {(r.village_name, r.source_layer) for r in merged} == {("north", "building"), ("north", "class_9")}


def test_qa_table_has_a_header(spark, tmp_path):
    df = spark.createDataFrame([("t", 1.0, 0.5, 0.7, 0.4, 3, 0.9, "x")], "tile_id string, precision double, recall double, f1 double, mIoU double, num_bboxes int, avg_confidence double, extra string")
    sinks.write_qa_csv(df, str(tmp_path / "qa"))
    text = "".join(p.read_text() for p in (tmp_path / "qa").glob("*.csv"))
    assert text.splitlines()[0] == "tile_id,precision,recall,f1,mIoU,num_bboxes,avg_confidence"


T0 = datetime(2024, 1, 1)


def diag(spark, rows):
    return spark.createDataFrame([(r, t, T0 + timedelta(minutes=m), a, s) for r, t, m, a, s in rows],
                                 "run_id string, tile_id string, ts timestamp, attempt int, status string")


RETRIES = [("r", "x", 0, 0, "failed"), ("r", "x", 1, 1, "failed"), ("r", "x", 2, 2, "complete"), ("r", "x", 3, 2, "complete"),
           ("r", "y", 4, 2, "failed"), ("r", "z", 5, 0, "error")]


def test_retries_in_batch(spark):
    got = {r.tile_id: (r.status, r.attempt) for r in jobs.best_attempts(diag(spark, RETRIES)).collect()}
    assert got == {"x": ("complete", 2), "y": ("failed", 2), "z": ("error", 0)}


def test_streams_equal_batches(spark, tmp_path):
    source = str(tmp_path / "in")
    whole = diag(spark, RETRIES + [("q", f"t{i}", 10 + i, 0, "complete") for i in range(20)])
    whole.repartition(3).write.parquet(source)  # several files, several micro-batches
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(source)
    tiles = jobs.unique_tiles(stream, "30 days")
    stored = jobs.run_to_table(tiles.select("run_id", "tile_id"), "t1")
    assert sorted(map(tuple, stored.collect())) == sorted([("r", "x"), ("r", "z")] + [("q", f"t{i}") for i in range(20)])
    progress = jobs.run_updates(jobs.run_progress(jobs.unique_tiles(stream, "30 days")), ["run_id"], "t2")
    runs = spark.createDataFrame([("r", 3), ("q", 20), ("new", 5)], "run_id string, tiles_total int")
    got = {r.run_id: (r.tiles_done, r.state) for r in jobs.with_run_state(progress, runs).collect()}
    assert got == {"r": (2, "RUNNING"), "q": (20, "COMPLETED"), "new": (0, "IDLE")}
    live = jobs.run_updates(jobs.tile_throughput(stream, "10 minutes"), ["window_start"], "t3")
    assert sorted(map(tuple, live.collect())) == sorted(map(tuple, jobs.tile_throughput(whole, "10 minutes").collect()))


def test_flagship_plan(spark, sf):
    judged = preprocess.windowed_preprocess(tb.mosaic_pixels(spark, sf), tb.mosaic_rasters(spark, sf), 32, 28, 10, 84.0, 80.0, 2, 170)
    tiles = preprocess.accepted_tiles(judged)
    docs = preprocess.tile_documents(tiles).collect()
    assert docs and all(d.tile_size == 32 and len(d.transform) == 6 for d in docs)
    assert sorted(d.tile_id for d in docs)[0].endswith("_t00000")


def test_features_keep_every_part_and_drop_heights(spark):
    from orthomill.sources import sinks
    texts = ["POLYGON ((0 0, 1 0, 1 1, 0 0))", "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 0)), ((5 5, 6 5, 6 6, 5 5)))", "POLYGON Z ((0 0 7, 1 0 7, 1 1 7, 0 0 7))",
             "MULTIPOLYGON Z (((0 0 7, 1 0 7, 1 1 7, 0 0 7)))", "POLYGON EMPTY", "POLYGON ((0 0, 1", None]
    item = "struct<class_id:int,geometry_wkt:string,confidence:double,source_masks:array<string>,z_mean:double,area:double,perimeter:double>"
    docs = spark.createDataFrame([("t", [(1, t, 0.5, ["swin"], None, 1.0, 1.0) for t in texts])], f"tile_id string, polygons array<{item}>")
    got = sinks.features(docs).collect()
    assert [(len(r.parts), len(r.rings)) for r in got] == [(1, 1), (2, 2), (1, 1), (1, 1)] and got[2].rings[0][1] == (1.0, 0.0)


def test_class_raster_has_a_frame_and_one_file_per_block(spark, tmp_path):
    import glob
    from orthomill.sources import sinks
    square = [[(float(x), float(y)) for x, y in ((0, 0), (8, 0), (8, 4), (0, 4), (0, 0))]]
    rows = spark.createDataFrame([(1, 1, square), (2, 3, square)], "ord int, class_id int, rings array<array<struct<x:double,y:double>>>")
    sinks.write_class_raster(rows, f"{tmp_path}/r", 256)
    frame = sinks.read_raster_frame(spark, f"{tmp_path}/r").first()
    assert (frame.min_x, frame.max_y, frame.width, frame.height) == (0.0, 4.0, 800, 400) and frame.transform == [0.01, 0.0, 0.0, 0.0, -0.01, 4.0]
    folders = glob.glob(f"{tmp_path}/r/crow=*/ccol=*")
    assert len(folders) == 8 and all(len(glob.glob(f"{f}/*.parquet")) == 1 for f in folders)


def test_run_state_does_not_depend_on_arrival(spark):
    from datetime import datetime
    from orthomill.streaming import jobs
    rows = [("r", "a", "error", 0), ("r", "a", "complete", 1), ("r", "b", "failed", 0), ("r", "b", "skipped", 1), ("f", "a", "error", 0), ("f", "b", "error", 1), ("f", "b", "failed", 2)]
    for order in (rows, rows[::-1]):
        df = spark.createDataFrame([(*r, datetime(2024, 1, 1 + i % 2, 5)) for i, r in enumerate(order)], "run_id string, tile_id string, status string, attempt int, ts timestamp")
        runs = spark.createDataFrame([("r", 2), ("f", 2), ("n", 1)], "run_id string, tiles_total long")
        got = jobs.with_run_state(jobs.run_progress(jobs.final_states(jobs.tile_states(df))), runs).collect()
        assert {r.run_id: r.state for r in got} == {"r": "COMPLETED", "f": "FAILED", "n": "IDLE"}
