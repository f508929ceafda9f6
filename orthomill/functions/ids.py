"""Identifiers, names and text used by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill import fixed


def basename(path: Column) -> Column:
    """File name at the end of a path; both slash styles are understood."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def stem(path: Column) -> Column:
    """File name without its last extension (a leading dot is kept as part of the name)."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def source_name(path: Column) -> Column:
    """File stem with spaces turned into underscores and doubled underscores joined."""
    return F.replace(F.replace(stem(path), F.lit(" "), F.lit("_")), F.lit("__"), F.lit("_"))


def tile_id_of(path: Column) -> Column:
    """Tile id of a tile file: the stem without a leading ``tile_``."""
    return F.regexp_replace(stem(path), r"^tile_", "")


def numbered(prefix: Column, width: int, number: Column, infix: str = "") -> Column:
    """``prefix`` + ``infix`` + zero-padded ``number``."""
    return F.concat(prefix, F.lit(infix), F.format_string(f"%0{width}d", number))


def window_id(source: Column, index: Column) -> Column:
    """Tile id ``{source}_t00005``."""
    return numbered(source, 5, index, "_t")


def region_id(number: Column) -> Column:
    """Region id ``R0001``."""
    return F.format_string("R%04d", number)


def island_id(number: Column) -> Column:
    """Island id ``region_01``."""
    return F.format_string("region_%02d", number)


def gt_tile_id(number: Column) -> Column:
    """High-value tile id ``real_gt_00000``."""
    return F.format_string("real_gt_%05d", number)


def class_dimension(spark: SparkSession, names: list[str] | None = None) -> DataFrame:
    """Class table ``(class_id, class_name)``, one row per known class."""
    names = names or fixed.CLASS_NAMES
    return spark.createDataFrame(list(enumerate(names)), "class_id int, class_name string")


def class_name(class_id: Column, names: list[str] | None = None, prefix: str = "") -> Column:
    """Name of a class; unknown ids become ``prefix`` + id."""
    names = names or fixed.CLASS_NAMES
    table = F.array(*[F.lit(n) for n in names])
    return F.coalesce(
        F.when(class_id >= 0, F.get(table, class_id.cast("int"))),
        F.concat(F.lit(prefix), class_id.cast("string")),
    )


def or_zero(value: Column) -> Column:
    """The value, or 0 where it is null."""
    return F.coalesce(value, F.lit(0.0))


def seconds_between(start: Column, end: Column) -> Column:
    """Elapsed seconds with microsecond precision."""
    micros = F.timestamp_diff("MICROSECOND", start, end)
    return micros / F.lit(1e6)


def new_run_id() -> Column:
    """A random run id; materialise the result before it is read twice."""
    return F.uuid()
