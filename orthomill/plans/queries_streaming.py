"""Streaming queries: each reads whole tables as a stream, runs to the end and returns its sink."""

from __future__ import annotations

from pyspark.sql import functions as F

from orthomill.plans.base_sql import DIAG, LAYER
from orthomill.plans.registry import query, with_ctes
from orthomill.session import scratch_path
from orthomill.sources import sinks
from orthomill.sources import testbed as tb
from orthomill.streaming import jobs, retries

#: Tiles' outcomes from raw rows: the first that did not fail, unless three failed before it.
OUTCOMES = """
od AS (SELECT *, count(*) FILTER (status = 'failed') OVER (PARTITION BY run_id, tile_id ORDER BY ts, attempt, status ROWS UNBOUNDED PRECEDING) AS failures FROM {rows}),
oc AS (
  SELECT run_id, tile_id, status, attempt, failures FROM od WHERE status <> 'failed' OR failures >= 3
  QUALIFY row_number() OVER (PARTITION BY run_id, tile_id ORDER BY ts, attempt, status) = 1)
"""


def diagnostics_stream(spark, sf):
    """The diagnostics as a stream of Parquet files."""
    events = jobs.file_stream(spark, sf, tb.table(spark, sf, "events"), "events.parquet")
    return tb.diagnostics_of(events.withColumn("ts", F.col("ts").cast("timestamp")))


@query("g1_run_progress", with_ctes(DIAG, """
dg AS (SELECT * REPLACE (run_id || strftime(ts, ' %H-') || CAST(substr(tile_id, 6) AS BIGINT) % 4 AS run_id) FROM diag),
tot AS (SELECT run_id, count(DISTINCT tile_id) + CASE WHEN right(run_id, 1) = '3' THEN 3 ELSE 0 END AS tiles_total FROM dg GROUP BY 1)""",
    OUTCOMES.format(rows="dg"), """
dn AS (
  SELECT run_id, count(*) AS tiles_done, count(*) FILTER (status IN ('error', 'failed')) AS errors, count(*) FILTER (status = 'failed') AS given_up
  FROM oc GROUP BY 1)""", select="""
SELECT run_id, tiles_total, coalesce(tiles_done, 0) AS tiles_done, coalesce(errors, 0) AS errors, coalesce(given_up, 0) AS given_up,
       CASE WHEN coalesce(tiles_done, 0) = 0 THEN 'IDLE' WHEN tiles_done < tiles_total THEN 'RUNNING' WHEN errors = tiles_done THEN 'FAILED'
            ELSE 'COMPLETED' END AS state
FROM tot LEFT JOIN dn USING (run_id)"""))
def g1(spark, sf):
    def hourly(diagnostics):
        part = F.regexp_extract("tile_id", r"(\d+)$", 1).cast("long") % 4
        return diagnostics.withColumn("run_id", F.concat("run_id", F.date_format("ts", " HH-"), part))

    found = retries.run_outcomes(hourly(diagnostics_stream(spark, sf)), "run-outcomes", lateness="60 days")
    runs = hourly(tb.diagnostics(spark, sf)).groupBy("run_id").agg(F.countDistinct("tile_id").alias("n")).select(
        "run_id", (F.col("n") + F.when(F.col("run_id").endswith("3"), 3).otherwise(0)).alias("tiles_total"))
    return jobs.with_run_state(retries.outcome_progress(found), runs).select(
        "run_id", "tiles_total", "tiles_done", "errors", F.coalesce("given_up", F.lit(0)).alias("given_up"), "state")


@query("g2_terminal_tiles", with_ctes(DIAG, OUTCOMES.format(rows="diag"), select="SELECT * FROM oc"))
def g2(spark, sf):
    found = retries.run_outcomes(diagnostics_stream(spark, sf), "terminal-tiles", lateness="60 days")
    return found.select("run_id", "tile_id", "status", "attempt", "failures")


@query("g2_unbroken_failures", with_ctes(DIAG, """
fd AS (SELECT run_id || ' ' || attempt AS run_id, tile_id, ts, attempt, status FROM diag WHERE status IN ('failed', 'error'))""",
    OUTCOMES.format(rows="fd"), select="SELECT status, failures, count(*) AS tiles FROM oc GROUP BY ALL"))
def g2_failures(spark, sf):
    bad = diagnostics_stream(spark, sf).filter("status in ('failed', 'error')").withColumn("run_id", F.concat_ws(" ", "run_id", "attempt"))
    return retries.run_outcomes(bad, "unbroken-failures", lateness="60 days").groupBy("status", "failures").agg(F.count(F.lit(1)).alias("tiles"))


@query("g2_best_attempts", with_ctes(DIAG, """
r AS (SELECT *, row_number() OVER (PARTITION BY run_id, tile_id ORDER BY CASE status WHEN 'complete' THEN 3 WHEN 'skipped' THEN 2 WHEN 'error' THEN 1 ELSE 0 END DESC,
      attempt DESC, ts DESC) AS k FROM diag)""", select="SELECT run_id, tile_id, status, attempt FROM r WHERE k = 1"))
def g2_best(spark, sf):
    return jobs.best_attempts(tb.diagnostics(spark, sf)).select("run_id", "tile_id", "status", "attempt")


@query("g3_feedback_queue", """
SELECT doc_id AS tile_id, quality AS original_class, toxic AS corrected_class, false AS processed, true AS stamped FROM labels""")
def g3(spark, sf):
    stream = jobs.file_stream(spark, sf, tb.table(spark, sf, "labels"), "labels.parquet").select(
        F.col("doc_id").alias("tile_id"), F.col("quality").alias("original_class"), F.col("toxic").alias("corrected_class"))
    stored = jobs.run_to_table(jobs.feedback_rows(stream), "feedback")
    return stored.select("tile_id", "original_class", "corrected_class", "processed",
                         F.col("created_at").isNotNull().alias("stamped"))


@query("g4_corrections", """
SELECT strftime(ts, '%Y-%m-%d') AS day, event_id % 6 AS original_class, user_id % 6 AS corrected_class, count(*) AS corrections FROM events GROUP BY ALL""")
def g4(spark, sf):
    stream = jobs.file_stream(spark, sf, tb.table(spark, sf, "events"), "events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), (F.col("event_id") % 6).alias("original_class"),
        (F.col("user_id") % 6).alias("corrected_class"))
    counts = jobs.run_updates(jobs.correction_counts(stream), ["window_start", "original_class", "corrected_class"], "corrections")
    return counts.select(F.date_format("window_start", "yyyy-MM-dd").alias("day"), "original_class", "corrected_class", "corrections")


@query("g5_streamed_detections", with_ctes(LAYER, select="""
SELECT 'run' || (feature_id % 4) AS run_id, count(*) AS polygons FROM lay WHERE feature_id % 9 <> 4 GROUP BY 1"""))
def g5(spark, sf):
    from orthomill.functions import geometry as geo
    key = F.col("c_custkey")
    source = jobs.file_stream(spark, sf, tb.table(spark, sf, "customer"), "customer.parquet")
    box = geo.box_rings(key, key, key + 1, key + 2)
    stream = source.select(
        F.concat(F.lit("run"), key % 4).alias("run_id"), F.concat(F.lit("tile"), key).alias("tile_id"),
        (key % 6).cast("int").alias("class_id"), F.lit(0.5).alias("confidence"), F.lit(0.0).alias("z_mean"),
        F.lit(0.0).alias("z_max"), F.lit(2.0).alias("area"), F.when(key % 9 != 4, box).alias("rings"),
        F.lit("EPSG:4326").alias("crs"))
    path = scratch_path(spark, "streamed-detections")

    def store(batch, batch_id):
        rows = sinks.detection_rows(batch)
        sinks.persist_detections(rows, path, batch_id)
        sinks.persist_detections(rows, path, batch_id)  # a replayed micro-batch leaves one copy

    jobs.run_each_batch(stream, store, "streamed-detections")
    return spark.read.parquet(path).groupBy("run_id").agg(F.count(F.lit(1)).alias("polygons"))


@query("g6_window_throughput", with_ctes(DIAG, select="""
SELECT strftime(ts, '%Y-%m-%d %H') AS hour, count(DISTINCT tile_id) AS tiles, round(count(DISTINCT tile_id) / 3600, 9) AS tiles_per_s
FROM diag WHERE status <> 'failed' GROUP BY 1"""))
def g6(spark, sf):
    latest = jobs.run_updates(jobs.tile_throughput(diagnostics_stream(spark, sf)), ["window_start"], "throughput")
    return latest.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "tiles",
                         F.round("tiles_per_s", 9).alias("tiles_per_s"))
