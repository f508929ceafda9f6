"""Tiles that are tried several times: a stateful processor counts failed attempts and gives a tile up after the last.

A run is over when each of its tiles has an outcome, and a tile of which every attempt failed has one too: ``failed``. The processor
keeps a counter per run and tile, the counters of a share of a run's tiles together; the same rule over a table is one window pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from orthomill.streaming.jobs import LATENESS, run_to_table

#: How often a tile is tried.
ATTEMPTS = 3
#: Into how many shares the tiles of a run are dealt; a share is one key of the state.
SHARES = 1024

_OUTCOME = "run_id string, tile_id string, status string, attempt int, failures int, at_ms long"
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class _Attempts(StatefulProcessor):
    """One outcome per run and tile; a tile's state is dropped when the watermark is past its last attempt by the allowed lateness.

    A key is a share of a run's tiles, so that a call of Python, a read and a write of state and a timer serve many tiles. Its timer
    stands where its first tile is due.
    """

    def __init__(self, attempts: int, lateness_ms: int):
        self.attempts, self.lateness_ms = attempts, lateness_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.counts = handle.getListState("counts", "tile_id string, failures int, settled boolean, last_attempt int, last_ms long")

    def _store(self, tiles: dict) -> None:
        if tiles:
            self.counts.put([(tile, *count) for tile, count in tiles.items()])
            self.handle.registerTimer(min(count[3] for count in tiles.values()) + self.lateness_ms)
        else:
            self.counts.clear()

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        tiles = {tile: tuple(count) for tile, *count in self.counts.get()}
        timers = list(self.handle.listTimers()) if tiles else []
        for row in sorted(rows, key=lambda r: (r.at_ms, r.attempt, r.status)):
            failures, settled, last_attempt, last_ms = tiles.get(row.tile_id, (0, False, 0, 0))
            if row.at_ms >= last_ms:
                last_attempt, last_ms = row.attempt, row.at_ms
            failures += row.status == "failed" and not settled
            if not settled and (row.status != "failed" or failures >= self.attempts):
                settled = True
                yield Row(run_id=key[0], tile_id=row.tile_id, status=row.status, attempt=row.attempt, failures=failures, at_ms=row.at_ms)
            tiles[row.tile_id] = (failures, settled, last_attempt, last_ms)
        for timer in timers:
            self.handle.deleteTimer(timer)
        self._store(tiles)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        until = timerValues.getCurrentWatermarkInMs() - self.lateness_ms
        tiles = {}
        for tile, failures, settled, attempt, at_ms in self.counts.get():
            if at_ms > until:
                tiles[tile] = (failures, settled, attempt, at_ms)
            elif not settled:
                yield Row(run_id=key[0], tile_id=tile, status="failed", attempt=attempt, failures=failures, at_ms=at_ms)
        self._store(tiles)

    def close(self) -> None:
        pass


def outcomes(diagnostics: DataFrame, attempts: int = ATTEMPTS, lateness: str = LATENESS) -> DataFrame:
    """One row per run and tile that has an outcome: ``run_id, tile_id, status, attempt, failures, ts``.

    Needs ``run_id, tile_id, ts, attempt, status``. Rows count in order of ``ts``, then ``attempt``, then ``status``. The first that is not
    ``failed`` is the tile's outcome, unless ``attempts`` failed ones come before it: then the last of those is, and what comes later no
    longer counts. ``failures`` is the number of failed rows up to the outcome. Rows with a null in ``ts`` or ``status`` are no attempts.

    Of a stream, a tile's row comes out once. A tile that fails less often and is then not tried again for ``lateness`` is given up when the
    watermark gets there; in a table it has no row, as it may still be tried.
    """
    rows = diagnostics.filter("ts is not null and status is not null").select(
        "run_id", "tile_id", "ts", F.coalesce(F.col("attempt").cast("int"), F.lit(0)).alias("attempt"), "status", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    if rows.isStreaming:
        span = rows.sparkSession.sql(f"SELECT CAST(unix_millis(TIMESTAMP '1970-01-02 00:00:00+00:00' + INTERVAL {lateness}) - 86400000 AS LONG) AS ms").first().ms
        dealt = rows.withColumn("share", F.pmod(F.xxhash64("tile_id"), F.lit(SHARES)))
        found = dealt.withWatermark("ts", lateness).groupBy("run_id", "share").transformWithState(
            statefulProcessor=_Attempts(attempts, span), outputStructType=_OUTCOME, outputMode="Append", timeMode="EventTime")
    else:
        tile = Window.partitionBy("run_id", "tile_id").orderBy("at_ms", "attempt", "status")
        failures = F.count_if(F.col("status") == "failed").over(tile.rowsBetween(Window.unboundedPreceding, 0)).cast("int")
        ends = (F.col("status") != "failed") | (F.col("failures") >= attempts)
        found = rows.withColumn("failures", failures).filter(ends).withColumn("_n", F.row_number().over(tile)).filter("_n = 1")
    return found.select("run_id", "tile_id", "status", "attempt", "failures", F.timestamp_millis("at_ms").alias("ts"))


@contextmanager
def _keyed_state(spark: SparkSession) -> Iterator[None]:
    """Timers and typed state need the state store with column families; other queries of the session keep theirs."""
    name, wanted = _PROVIDER
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def run_outcomes(stream: DataFrame, name: str, attempts: int = ATTEMPTS, lateness: str = LATENESS) -> DataFrame:
    """:func:`outcomes` of everything a stream has, stored and read back."""
    with _keyed_state(stream.sparkSession):
        return run_to_table(outcomes(stream, attempts, lateness), name)


def outcome_progress(outcomes: DataFrame) -> DataFrame:
    """Finished tiles per run: ``tiles_done`` (given up ones too), ``completed``, ``errors`` (errors and given up) and ``given_up``."""
    status = F.col("status")
    return outcomes.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tiles_done"), F.count_if(status == "complete").alias("completed"),
        F.count_if(status.isin("error", "failed")).alias("errors"), F.count_if(status == "failed").alias("given_up"))
