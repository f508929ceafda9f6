"""Session settings and the shared folder used for checkpoints and scratch tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: At how many rows whole groups go to Python together; a larger group goes alone.
GROUP_ROWS = 50_000


def build_session(app: str = "orthomill", cores: str | int = "*", shuffle_partitions: int = 8,
                  **extra: str) -> SparkSession:
    """A local session with the settings the operators expect; a cluster brings its own."""
    builder = (
        SparkSession.builder.appName(app)
        .master(f"local[{cores}]")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", extra.pop("driver_memory", "12g"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Where it is not set, a session with a local master, which has one machine, gets a folder of its own; on a cluster a
    missing setting is an error, since a machine-local folder would not survive the loss of an executor.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    own = tempfile.mkdtemp(prefix="orthomill-checkpoints-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder (a reliable checkpoint, never a local one)."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder for a written table."""
    return f"{shared_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash-partition by ``keys``, without any evenly row by row, at full shuffle parallelism.

    Used ahead of Python groups and costly expressions, whose cost does not follow their bytes: a small
    shuffle would otherwise be merged into very few tasks.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _group_starts(table: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Whether a row is the first or differs from the one before in ``keys``; nulls are equal."""
    start = np.zeros(table.num_rows, dtype=bool)
    start[:1] = True
    for key in keys:
        column = table.column(key).combine_chunks()
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.or_(pc.xor(pc.is_null(a), pc.is_null(b)), pc.fill_null(pc.not_equal(a, b), False))
        if pa.types.is_floating(column.type):
            differ = pc.and_not(differ, pc.fill_null(pc.and_(pc.is_nan(a), pc.is_nan(b)), False))
        start[1:] |= differ.to_numpy(zero_copy_only=False)
    return start


def map_groups(df: DataFrame, keys: Sequence[str], run: Callable[[pa.Table, np.ndarray], pa.Table], schema: StructType) -> DataFrame:
    """``run`` over whole groups of ``keys``, many small ones in a call: it gets their rows and each row's group number.

    A group is never cut, however large; a call per group would cost more than the work on a small one.
    """
    keys = list(keys)

    def called(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from run(table, np.cumsum(_group_starts(table, keys)) - 1).to_batches()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            if held:
                last = held[-1].slice(held[-1].num_rows - 1)
                cuts = np.flatnonzero(_group_starts(pa.Table.from_batches([last, batch]), keys)[1:])
                if len(cuts) and sum(b.num_rows for b in held) + cuts[-1] >= GROUP_ROWS:
                    yield from called([*held, batch.slice(0, int(cuts[-1]))])
                    held, batch = [], batch.slice(int(cuts[-1]))
            held.append(batch)
        if held:
            yield from called(held)

    return spread(df, *keys).sortWithinPartitions(*keys).mapInArrow(parts, schema)
