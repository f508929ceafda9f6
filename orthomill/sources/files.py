"""Input files, tile documents, metadata documents and stored arrays."""

from __future__ import annotations

import io
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.functions import ids

POLYGON_TYPE = ("struct<class_id:int,geometry_wkt:string,confidence:double,source_masks:array<string>,"
                "z_mean:double,area:double,perimeter:double>")
TILE_OUTPUT_SCHEMA = (f"tile_id string, polygons array<{POLYGON_TYPE}>, num_polygons int, swin_confidence double, "
                      "yolo_count int, fusion_accept double")


def list_inputs(spark: SparkSession, path: str, extensions: Sequence[str], recursive: bool = False) -> DataFrame:
    """Files under ``path`` with one of the extensions: path, modification time, length."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return filter_inputs(found.select("path", "modificationTime", "length"), extensions)


def filter_inputs(files: DataFrame, extensions: Sequence[str]) -> DataFrame:
    """Files whose name ends in one of the extensions, whatever their case, in path order."""
    name = F.lower("path")
    wanted = F.lit(False)
    for ext in extensions:
        wanted = wanted | name.endswith(ext.lower())
    return files.filter(wanted).orderBy("path")


def named_like(files: DataFrame, text: str) -> DataFrame:
    """Files whose base name contains ``text``, whatever the case."""
    return files.filter(F.lower(ids.basename(F.col("path"))).contains(text.lower()))


def latest_artifacts(files: DataFrame, kind: str = "kind") -> DataFrame:
    """Most recently modified file per kind and the version its name stands for."""
    newest = F.max_by("path", F.struct("modificationTime", "path"))
    return files.groupBy(kind).agg(newest.alias("path")).withColumn("version", ids.stem(F.col("path")))


def collect_tile_outputs(spark: SparkSession, path: str, recursive: bool = False) -> tuple[DataFrame, DataFrame]:
    """Tile output documents under ``path`` and, apart from them, the files that could not be read."""
    texts = (
        spark.read.option("pathGlobFilter", "*_output.json")
        .option("recursiveFileLookup", str(recursive).lower()).text(path, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), "value")
    )
    return parse_tile_outputs(texts)


def parse_tile_outputs(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents ``(path, value)`` as tile outputs, and the ones that are not valid JSON."""
    parsed = texts.filter(ids.basename(F.col("path")).contains("_output.json")).select(
        "path", F.from_json("value", TILE_OUTPUT_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"})
        .alias("d"))
    return (parsed.filter(F.col("d").isNotNull() & F.col("d._bad").isNull()).select("path", "d.*").drop("_bad"),
            parsed.filter(F.col("d").isNull() | F.col("d._bad").isNotNull()).select("path", F.col("d._bad").alias("text")))


def append_records(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines."""
    df.write.mode("append").json(path)


def load_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines as rows; blank lines are skipped."""
    return spark.read.schema(schema).json(path)


def split_metadata(documents: DataFrame, column: str = "json") -> DataFrame:
    """One row per tile of metadata array documents.

    Entries without a tile id are dropped; ``bounds`` falls back to ``bbox``.
    """
    entry = ("array<struct<tile_id:string,region:string,bbox:array<array<double>>,bounds:array<array<double>>,"
             "crs:string,resolution:double,pixel_bounds:array<int>>>")
    rows = documents.select(F.explode(F.from_json(column, entry)).alias("e")).select("e.*")
    return rows.filter(F.coalesce("tile_id", F.lit("")) != "").withColumn("bounds", F.coalesce("bounds", "bbox"))


def decode_arrays(files: DataFrame) -> DataFrame:
    """Stored NumPy images ``(path, content)`` as pixels ``(tile_id, row, col, b0, b1, b2, load_error)``.

    A file that cannot be read becomes one row with ``load_error``. A single band is
    used for all three.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for tile, content in zip(pdf["tile_id"], pdf["content"]):
                try:
                    image = np.load(io.BytesIO(content), allow_pickle=False)
                    if image.ndim == 2:
                        image = image[:, :, None]
                    if image.ndim != 3:
                        raise ValueError(f"expected an image, got shape {image.shape}")
                except Exception as problem:  # noqa: BLE001 - any unreadable file is a row, not a failure
                    yield pd.DataFrame({"tile_id": [tile], "row": [None], "col": [None], "b0": [None], "b1": [None],
                                        "b2": [None], "load_error": [str(problem)]})
                    continue
                h, w, bands = image.shape
                rows, cols = np.divmod(np.arange(h * w), w)
                flat = image.reshape(h * w, bands).astype(np.int32)
                yield pd.DataFrame({"tile_id": tile, "row": rows.astype(np.int32), "col": cols.astype(np.int32),
                                    **{f"b{i}": flat[:, i if bands >= 3 else 0] for i in range(3)}, "load_error": None})

    return files.select(ids.tile_id_of(F.col("path")).alias("tile_id"), "content").mapInPandas(
        run, "tile_id string, row int, col int, b0 int, b1 int, b2 int, load_error string")
