from datetime import datetime, timedelta

from pyspark.sql import Row
from pyspark.sql import functions as F

from orthomill.streaming import jobs, retries

T0 = datetime(2024, 1, 1)
SCHEMA = "run_id string, tile_id string, ts timestamp, attempt int, status string"
ROWS = [("r", "ok", 0, 0, "complete"), ("r", "twice", 0, 0, "failed"), ("r", "twice", 1, 1, "failed"), ("r", "twice", 2, 2, "complete"),
        ("r", "lost", 0, 0, "failed"), ("r", "lost", 1, 1, "failed"), ("r", "lost", 2, 2, "failed"), ("r", "lost", 9, 3, "complete"),
        ("f", "bad", 3, 0, "error"), ("f", "gone", 3, 0, "failed"), ("f", "gone", 4, 1, "failed"), ("f", "gone", 5, 2, "failed"),
        ("w", "open", 3, 0, "failed"), ("w", "null", None, 0, "complete")]
WANT = {("r", "ok"): ("complete", 0, 0), ("r", "twice"): ("complete", 2, 2), ("r", "lost"): ("failed", 2, 3), ("f", "bad"): ("error", 0, 0), ("f", "gone"): ("failed", 2, 3)}


def frame(spark, rows):
    return spark.createDataFrame([(r, t, None if m is None else T0 + timedelta(minutes=m), a, s) for r, t, m, a, s in rows], SCHEMA)


def found(df):
    return {(r.run_id, r.tile_id): (r.status, r.attempt, r.failures) for r in df.collect()}


def test_a_table_has_the_outcomes(spark):
    df = frame(spark, ROWS).withColumn("at_ms", F.lit("clash"))
    assert found(retries.outcomes(df)) == WANT and retries.outcomes(df).count() == len(WANT)
    assert found(retries.outcomes(df, attempts=1))[("w", "open")] == ("failed", 0, 1)
    assert retries.outcomes(df.filter("false")).count() == 0


def test_a_stream_in_many_batches_has_the_same_once(spark, tmp_path):
    for i, rows in enumerate((ROWS[:5], ROWS[5:6], ROWS[6:10], ROWS[10:])):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stored = retries.run_outcomes(stream, "outcomes", lateness="30 days")
    assert found(stored) == WANT and stored.count() == len(WANT)
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == provider
    runs = spark.createDataFrame([("r", 3), ("f", 2), ("w", 2), ("n", 1)], "run_id string, tiles_total int")
    got = {r.run_id: (r.tiles_done, r.errors, r.given_up, r.state) for r in jobs.with_run_state(retries.outcome_progress(stored), runs).collect()}
    assert got == {"r": (3, 1, 1, "COMPLETED"), "f": (2, 2, 1, "FAILED"), "w": (0, 0, None, "IDLE"), "n": (0, 0, None, "IDLE")}


def test_a_tile_that_is_not_tried_again_is_given_up(spark, tmp_path):
    frame(spark, [("r", "x", 0, 0, "failed"), ("r", "y", 1, 0, "complete")]).coalesce(1).write.parquet(f"{tmp_path}/in/0")
    frame(spark, [("r", "z", 600, 0, "complete")]).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    got = found(retries.run_outcomes(stream, "given-up", lateness="1 hour"))
    assert got == {("r", "x"): ("failed", 0, 1), ("r", "y"): ("complete", 0, 0), ("r", "z"): ("complete", 0, 0)}


class Counted:
    """A handle that keeps a list and timers for one key and counts the calls."""

    def __init__(self):
        self.rows, self.timers, self.calls = [], set(), 0

    def getListState(self, name, schema):
        return self

    def __getattr__(self, name):
        def call(*args):
            self.calls += 1
            if name == "get":
                return iter(list(self.rows))
            if name == "listTimers":
                return iter(sorted(self.timers))
            if name in ("put", "clear"):
                self.rows = list(args[0]) if args else []
            else:
                (self.timers.add if name == "registerTimer" else self.timers.discard)(args[0])
        return call


class Clock:
    def __init__(self, now):
        self.getCurrentWatermarkInMs = lambda: now


def test_tiles_share_state_calls_and_keep_their_own_due_times():
    handle, processor = Counted(), retries._Attempts(3, 1000)
    processor.init(handle)
    row = lambda tile, at, status="failed": Row(tile_id=tile, attempt=0, status=status, at_ms=at)
    assert not list(processor.handleInputRows(("r", 0), iter([row(f"t{i}", 10 * i) for i in range(200)] + [row(None, 5)]), None))
    assert handle.calls <= 4 and handle.timers == {1000}
    done = list(processor.handleInputRows(("r", 0), iter([row("t0", 1, "complete"), row("t0", 2, "error"), row("t1", 4000)]), None))
    assert [(r.tile_id, r.status, r.failures) for r in done] == [("t0", "complete", 1)] and handle.timers == {1002}
    gone = list(processor.handleExpiredTimer(("r", 0), Clock(2000), None))
    assert sorted((r.tile_id or "", r.failures) for r in gone) == [("", 1)] + sorted((f"t{i}", 1) for i in range(2, 101))
    assert 2010 in handle.timers and len(handle.rows) == 100
    gone = list(processor.handleExpiredTimer(("r", 0), Clock(5000), None))
    assert len(gone) == 100 and not handle.rows


def test_tiles_of_one_share_are_given_up_one_by_one_and_null_is_a_tile(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(retries, "SHARES", 1)
    batches = [[("r", "x", 0, 0, "failed"), ("r", "y", 90, 0, "failed"), ("r", None, 90, 0, "error")], [("r", "z", 120, 0, "complete")],
               [("r", "y", 100, 1, "failed"), ("r", "y", 101, 2, "complete"), (None, "x", 100, 0, "skipped")], [("r", "u", 600, 0, "failed")]]
    for i, rows in enumerate(batches):
        frame(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stored = retries.run_outcomes(stream, "one-share", lateness="1 hour")
    assert found(stored) == {("r", "x"): ("failed", 0, 1), ("r", "y"): ("complete", 2, 2), ("r", None): ("error", 0, 0),
                             ("r", "z"): ("complete", 0, 0), (None, "x"): ("skipped", 0, 0)}
    assert stored.count() == 5
