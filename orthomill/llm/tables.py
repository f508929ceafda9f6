"""Shared steps: written tables in the shared folder, skew-free distincts, word patterns."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.session import scratch_path

#: Fixed value: a word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """``name`` has the value inside and its former one afterwards."""
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 200) -> Iterator[None]:
    """What is stored inside goes to Python in batches of few rows: for rows that may hold very long texts."""
    with _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows)):
        yield


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read back.

    The written table cuts the lineage, survives lost executors and gives the
    planner its size, so a join to it is broadcast only when it is small. Its
    shuffle files go with the end of the write: nothing reads them again, and kept
    until the driver's next collection they would add up over many steps.
    """
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, name)
    with _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"):
        df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` for a join that sorts and merges: neither side is sent whole to the driver and every task.

    The planner sizes rows by the bytes of the files they come from. It does not see how many rows an explode or a Python step
    makes of one, nor how far texts were compressed, and would broadcast what only looks small.
    """
    return df.hint("merge")


def dropped(*tables: DataFrame) -> None:
    """Delete the files of ``stored`` tables that nothing will read again; frames made from them can no longer be used."""
    for table in tables:
        context = table.sparkSession.sparkContext
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = context._jvm.org.apache.hadoop.fs.Path(context._jvm.java.net.URI(folder))
            path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name close to ``name`` that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_array(text: Column) -> Column:
    """The words of a text, null or blank giving none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), GAP), lambda w: w != "")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once, also when ``body`` names it many times."""
    return F.transform(F.array(value), body)[0]


def word_count(text: Column) -> Column:
    """Number of words of a text (long), 0 for null."""
    return F.size(word_array(text)).cast("long")
