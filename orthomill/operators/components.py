"""Connected components: of equal-valued cells in a raster, and of any edge table."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orthomill.session import cut_lineage, map_groups

#: Cells get the number row * ROW_STEP + col, so the smallest number is first in row-major order.
ROW_STEP = 1 << 31


def connected_components(edges: DataFrame, scope: Sequence[str] = (), max_rounds: int = 64) -> DataFrame:
    """Component of every node that has an edge: ``(*scope, node, component)``.

    ``edges`` has columns ``u`` and ``v`` (undirected); the component is its smallest node. Scopes of every size go
    the same way, together: see :func:`components_in_rounds`.
    """
    scope = list(scope)
    table = cut_lineage(edges.filter(F.col("u") != F.col("v")).select(*scope, "u", "v").distinct())
    return components_in_rounds(table, scope, max_rounds)


def _lowest_reachable(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lowest node reachable from each of ``n`` nodes along edges ``a``-``b``: hooking and pointer jumping."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        if np.array_equal(low, label[a]) and np.array_equal(low, label[b]):
            return label
        for end in (a, b):
            np.minimum.at(label, label[end], low)
            np.minimum.at(label, end, low)
        while not np.array_equal(label[label], label):
            label = label[label]


def components_in_rounds(edges: DataFrame, scope: Sequence[str] = (), max_rounds: int = 64) -> DataFrame:
    """Components of a graph of any size by joins; ``edges`` is distinct and free of loops.

    Alternates the large-star and small-star steps, which turn any graph into
    stars around the smallest nodes in a logarithmic number of rounds; every round
    ends in a checkpoint. The centre of a large star is a hot key: its lookup is an
    equi-join of two plain exchanges, whose large partitions adaptive execution splits.
    """
    scope = list(scope)
    keys = [*scope, "u"]
    hashed = F.sum(F.xxhash64(*scope, "u", "v").cast("decimal(38,0)"))
    current = edges
    before = current.agg(F.count(F.lit(1)), hashed).first()
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        swapped = current.select(*scope, F.col("v").alias("u"), F.col("u").alias("v"))
        both = current.unionByName(swapped)
        lows = both.groupBy(*keys).agg(F.min("v").alias("_m")).withColumn("_m", F.least("_m", "u"))
        large = both.filter(F.col("v") > F.col("u")).join(lows, keys) \
            .select(*scope, F.col("v").alias("u"), F.col("_m").alias("v")) \
            .filter(F.col("u") != F.col("v")).distinct()
        down = large.select(*scope, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        centre = down.groupBy(*keys).agg(F.min("v").alias("_m"))
        leaves = down.join(centre, keys) \
            .select(*scope, F.col("v").alias("u"), F.col("_m").alias("v"))
        roots = centre.select(*scope, "u", F.col("_m").alias("v"))
        current = cut_lineage(leaves.unionByName(roots).filter(F.col("u") != F.col("v")).distinct())
        after = current.agg(F.count(F.lit(1)), hashed).first()
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return current.select(*scope, F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        current.select(*scope, F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _label(group: np.ndarray, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, known: np.ndarray, eight: bool) -> np.ndarray:
    """Smallest cell number reachable through equal neighbours of the same group; a value that is not ``known`` equals none."""
    first = np.flatnonzero(np.diff(group, prepend=-1))
    down, across = rows - np.minimum.reduceat(rows, first)[group], cols - np.minimum.reduceat(cols, first)[group] + 1
    width = int(across.max()) + 2
    code = (group * (int(down.max()) + 2) + down) * width + across
    order = np.argsort(code, kind="stable")
    ordered = code[order]
    # Of several rows for a cell the last one has the neighbours.
    last = np.flatnonzero(np.append(ordered[1:] != ordered[:-1], True))
    cells = ordered[last]
    a_list, b_list = [], []
    for step in (1, width, *((width + 1, width - 1) if eight else ())):
        at = np.minimum(np.searchsorted(cells, cells + step), len(cells) - 1)
        met = cells[at] == cells + step
        a, b = last[met], last[at[met]]
        same = (values[order[a]] == values[order[b]]) & known[order[a]] & known[order[b]]
        a_list.append(a[same])
        b_list.append(b[same])
    number = (rows * ROW_STEP + cols)[order]
    out = np.empty(len(rows), dtype=np.int64)
    out[order] = number[_lowest_reachable(len(rows), np.concatenate(a_list), np.concatenate(b_list))]
    return out


def label_cells(mask: DataFrame, keys: Sequence[str] = ("source_id",), value: str = "class_id",
                connectivity: int = 4, chunk: int | None = 256) -> DataFrame:
    """Component of every cell of a sparse raster: adds ``component`` (number of its first cell).

    ``mask`` has ``keys``, ``row``, ``col`` and ``value``. Cells are labelled inside
    ``chunk`` x ``chunk`` blocks first (bounded groups, small ones together); only cells on
    block borders then enter the global edge table. With ``chunk=None`` each key
    is labelled as one block, for masks known to be tile-sized.
    """
    keys = list(keys)
    eight = connectivity == 8
    cells = mask.select(*keys, F.col("row").cast("long"), F.col("col").cast("long"),
                        F.col(value).cast("long").alias("_value"))
    if chunk is None:
        group = keys
        blocked = cells
    else:
        blocked = cells.withColumn("_br", F.expr(f"row div {chunk}")).withColumn("_bc", F.expr(f"col div {chunk}"))
        group = [*keys, "_br", "_bc"]
    schema = StructType([*blocked.schema.fields, StructField("_local", LongType())])

    def label_blocks(table: pa.Table, block: np.ndarray) -> pa.Table:
        if table["row"].null_count or table["col"].null_count:
            raise ValueError("a cell needs a row and a column")
        value = table["_value"]
        found = _label(block, table["row"].to_numpy(), table["col"].to_numpy(), value.fill_null(0).to_numpy(), value.is_valid().to_numpy(), eight)
        return table.append_column("_local", pa.array(found))

    local = map_groups(blocked, group, label_blocks, schema)
    if chunk is None:
        return local.select(*keys, "row", "col", F.col("_value").alias(value), F.col("_local").alias("component"))

    local = cut_lineage(local)
    edge_rows = F.pmod("row", F.lit(chunk)).isin(0, chunk - 1)
    edge_cols = F.pmod("col", F.lit(chunk)).isin(0, chunk - 1)
    border = local.filter(edge_rows | edge_cols).select(*keys, "row", "col", "_value", "_local", "_br", "_bc")
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    moved = border.withColumn("_step", F.explode(F.array(*[
        F.struct(F.lit(r).alias("dr"), F.lit(c).alias("dc")) for r, c in steps]))) \
        .select(*keys, (F.col("row") + F.col("_step.dr")).alias("row"),
                (F.col("col") + F.col("_step.dc")).alias("col"), "_value",
                F.col("_local").alias("u"), F.col("_br").alias("_ur"), F.col("_bc").alias("_uc"))
    touching = moved.join(border, [*keys, "row", "col", "_value"]) \
        .filter((F.col("_ur") != F.col("_br")) | (F.col("_uc") != F.col("_bc"))) \
        .select(*keys, "u", F.col("_local").alias("v")).distinct()
    roots = connected_components(touching, keys).withColumnRenamed("node", "_local")
    return local.join(roots, [*keys, "_local"], "left").select(
        *keys, "row", "col", F.col("_value").alias(value),
        F.coalesce("component", "_local").alias("component"))


def component_boxes(labelled: DataFrame, keys: Sequence[str] = ("source_id",), value: str = "class_id") -> DataFrame:
    """Pixel count and bounding box per component."""
    return labelled.groupBy(*keys, value, "component").agg(
        F.count(F.lit(1)).alias("pixels"),
        F.min("row").alias("min_row"), F.max("row").alias("max_row"),
        F.min("col").alias("min_col"), F.max("col").alias("max_col"))
