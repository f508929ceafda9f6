"""What the physical plans must and must not contain."""

import os
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from orthomill.operators import detections, tiling, variance
from orthomill.sources import layers
from orthomill.sources import testbed as tb

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin")
LAZY = [n for n in entry_point.queries() if re.match(r"(b(1|2|3|4|5|6|7|8|9|10|11|13|14|16|17|18|20|22|23)_|c(1|2|3|5|6|9|10|13|14|15|16)_|"
                                                     r"d(2|3|4|5|9|10|11|12|14|15|16|18|20|22)_|e(1|2|4|5|6|7|8|9|10|13)_|f(1|2|8|10|12|17)_)", n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_joins(spark, sf, name):
    text = plan(entry_point.queries()[name](spark, sf))
    assert not any(f in text for f in FORBIDDEN)


def test_scan_reads_only_what_is_used(spark, sf):
    text = plan(detections.summary(tb.detections(spark, sf)))
    assert re.search(r"ReadSchema: struct<l_orderkey:bigint,l_discount:double>", text)
    text = plan(tb.table(spark, sf, "customer").withColumnRenamed("c_mktsegment", "layer").transform(layers.classify_layers))
    assert re.search(r"PushedFilters: \[.*In\(c_mktsegment", text)


def test_window_variance_shuffles_blocks_not_pixels(spark, sf):
    df = variance.padded_window_variance(tb.mosaic_pixels(spark, sf), ["source_id"], 32, 28, 10)
    text = plan(df)
    assert text.count("Exchange") == 2 and "partial_sum" in text
    assert "Exchange" not in plan(tiling.padded_windows(tb.rasters(spark, sf)))


def test_top_boxes_are_cut_before_the_shuffle(spark, sf):
    text = plan(detections.top_boxes(tb.detections(spark, sf), 3))
    assert text.count("WindowGroupLimit") == 2


def test_entry_and_registry(spark, sf):
    df = entry_point.entry(spark)
    assert df.count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_workers_need_no_installed_package(spark, tmp_path):
    here = os.getcwd()
    os.chdir(tmp_path)
    try:
        df = spark.createDataFrame([(1, 0, 0, 1)], "source_id int, row int, col int, class_id int")
        from orthomill.operators import components
        assert components.label_cells(df, chunk=None).select(F.col("component")).first()[0] == 0
    finally:
        os.chdir(here)


def test_a_busy_cell_is_dealt_by_its_pairs(spark):
    from orthomill.operators import skew
    left = spark.range(300).selectExpr("id % 2 AS k", "id AS a")
    right = spark.range(200).selectExpr("id % 2 AS k", "id AS b")
    got = skew.salted_join(left, right, ["k"], pairs_per_salt=500)
    assert got.distinct().count() == got.count() == 2 * 150 * 100
    per_salt = skew.salted_join(left, right, ["k"], pairs_per_salt=500).groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(per_salt) > 2 and max(r["count"] for r in per_salt) < 15_000
