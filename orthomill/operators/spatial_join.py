"""Joining shapes to windows and to each other through grid keys."""

from __future__ import annotations

from collections.abc import Sequence
from math import isfinite

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from orthomill.functions import geometry as geo
from orthomill.operators.skew import ROWS_PER_SALT, salted_join
from orthomill.session import spread

#: Up to this many pairs of edges two polygons are worked out without arrays, with the same result.
FEW_EDGE_PAIRS = 100


def shape_windows(shapes: DataFrame, keys: Sequence[str], size: int, stride: int,
                  rings: str = "rings") -> DataFrame:
    """Every (shape, window) that truly intersect, for the regular window grid in pixel space.

    The windows near a shape's bounding box follow from arithmetic; the exact
    test then removes those the shape only passes by. Touching counts. Windows
    are identified by ``row_off``/``col_off`` and measured at full size. The test costs
    far more than the bytes of a shape, so the shapes are dealt over all tasks first.
    """
    box = F.col("_box")

    def origins(low: Column, high: Column) -> Column:
        first = F.greatest(F.lit(0), F.ceil((low - size) / float(stride))).cast("int")
        last = F.floor(high / float(stride)).cast("int")
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda i: i * stride)) \
            .otherwise(F.array().cast("array<int>"))

    near = (
        spread(shapes.select(*keys, rings)).withColumn("_box", geo.bounds(F.col(rings)))
        .withColumn("row_off", F.explode(origins(box["y1"], box["y2"])))
        .withColumn("col_off", F.explode(origins(box["x1"], box["x2"])))
    )
    exact = geo.meets_box(F.col(rings), F.col("col_off").cast("double"), F.col("row_off").cast("double"),
                          (F.col("col_off") + size).cast("double"), (F.col("row_off") + size).cast("double"))
    return near.filter(exact).drop("_box")


def windows_hit(windows: DataFrame, shapes: DataFrame, size: int, stride: int,
                keys: Sequence[str] = ()) -> DataFrame:
    """Windows that intersect at least one shape (semi-join on the window key)."""
    hits = shape_windows(shapes, keys, size, stride).select(*keys, "row_off", "col_off").distinct()
    return windows.join(hits, [*keys, "row_off", "col_off"], "left_semi")


def _level(cell: float) -> Column:
    """How often ``cell`` must be doubled to be as large as the box; a box covers few cells of its own level."""
    side = F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return F.greatest(F.lit(0), F.coalesce(F.ceil(F.log2(side / cell)), F.lit(0))).cast("int")


def _cells(df: DataFrame, cell: float) -> DataFrame:
    """Each row under the cells of level ``_m`` that its box covers."""
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_m"))
    for axis in ("x", "y"):
        low, high = (F.floor(F.col(f"{axis}{end}") / side).cast("long") for end in (1, 2))
        df = df.withColumn(f"_g{axis}", F.explode(F.sequence(low, high)))
    return df


def _at_home(df: DataFrame, cell: float) -> DataFrame:
    return _cells(df.withColumn("_m", _level(cell)), cell)


def _abroad(df: DataFrame, cell: float, levels: list[int]) -> DataFrame:
    """Each row under the cells of those ``levels`` that are coarser than its own."""
    listed = F.array(*[F.lit(m) for m in levels]).cast("array<int>")
    own = df.withColumn("_own", _level(cell))
    return _cells(own.withColumn("_m", F.explode(F.filter(listed, lambda m: m > F.col("_own")))).drop("_own"), cell)


def box_join(left: DataFrame, right: DataFrame, cell: float, keys: Sequence[str] = (),
             rows_per_salt: int = ROWS_PER_SALT) -> DataFrame:
    """All pairs with intersecting boxes (``x1,y1,x2,y2`` each), each pair exactly once.

    Cells come in levels, each twice as large as the one below, from ``cell`` on. A box is at home in the few cells of the level of its
    own size and visits those coarser levels at which the other side has boxes, so a box over everything takes as few cells as a small
    one. Two boxes meet at the level of the larger: home rows meet home rows and visitors, visitors never meet each other.
    A pair is kept only in the cell that holds the lower-left corner of its overlap, so no de-duplication shuffle is
    needed. Cells busy on either side are salted by their own counts. Which levels there are, a few small numbers, is read first.
    Right-hand columns other than ``keys`` get the prefix ``r_``. Rows with a null key or corner have no pairs.
    """
    keys = list(keys)

    def levels(df: DataFrame) -> list[int]:
        return sorted(r[0] for r in df.select(_level(cell)).distinct().collect())

    def named(df: DataFrame) -> DataFrame:
        return df.withColumnsRenamed({c: f"r_{c}" for c in right.columns if c not in keys})

    of_left, of_right = levels(left), levels(right)
    home, meets = _at_home(right, cell), [*keys, "_m", "_gx", "_gy"]
    reached = home.unionByName(_abroad(right, cell, of_left)) if of_left[-1:] > of_right[:1] else home
    pairs = salted_join(_at_home(left, cell), named(reached), meets, rows_per_salt)
    if of_right[-1:] > of_left[:1]:
        pairs = pairs.unionByName(salted_join(_abroad(left, cell, of_right), named(home), meets, rows_per_salt))
    x = F.greatest("x1", "r_x1")
    y = F.greatest("y1", "r_y1")
    side = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("_m"))
    return pairs.filter(
        (x <= F.least("x2", "r_x2")) & (y <= F.least("y2", "r_y2"))
        & (F.floor(x / side) == F.col("_gx")) & (F.floor(y / side) == F.col("_gy"))
    ).drop("_m", "_gx", "_gy")


def _ring_edges(xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Edges of flat rings as rows ``x1, y1, x2, y2``."""
    if len(xs) < 2:
        return np.empty((0, 4))
    inside = np.ones(len(xs) - 1, dtype=bool)
    inside[np.cumsum(sizes)[:-1] - 1] = False
    return np.column_stack([xs[:-1], ys[:-1], xs[1:], ys[1:]])[inside]


def _crossing_heights(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """y of every proper crossing between two sets of edges; edges of ``a``, lowest first, in bands of 256 against those of ``b`` that reach the band."""
    a = a[np.argsort(np.minimum(a[:, 1], a[:, 3]), kind="stable")]
    low, high = np.minimum(b[:, 1], b[:, 3]), np.maximum(b[:, 1], b[:, 3])
    found = []
    for at in range(0, len(a), 256):
        band = a[at:at + 256]
        near = b[(low <= band[:, [1, 3]].max()) & (high >= band[:, [1, 3]].min())]
        ax, ay, bx, by = (band[:, i][:, None] for i in range(4))
        cx, cy, dx, dy = (near[:, i][None, :] for i in range(4))
        den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
        with np.errstate(divide="ignore", invalid="ignore"):
            t = ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den
            u = ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den
            hit = (den != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
            found.append((ay + t * (by - ay))[hit])
    return np.concatenate(found)


def _widths(edges: np.ndarray, y: float) -> list[tuple[float, float]]:
    across = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    xs = np.sort(across[:, 0] + (y - across[:, 1]) * (across[:, 2] - across[:, 0]) / (across[:, 3] - across[:, 1]))
    return list(zip(xs[0::2], xs[1::2]))


def _few_edges_overlap(a: list[list[float]], b: list[list[float]]) -> float | None:
    """:func:`overlap_area` of polygons of few edges without arrays, whose calls would cost more than the work; null if a height is not finite."""
    heights = {y for e in (*a, *b) for y in (e[1], e[3])}
    for ax, ay, bx, by in a:
        for cx, cy, dx, dy in b:
            den = (bx - ax) * (dy - cy) - (by - ay) * (dx - cx)
            if den != 0 and 0 <= (t := ((cx - ax) * (dy - cy) - (cy - ay) * (dx - cx)) / den) <= 1 \
                    and 0 <= ((cx - ax) * (by - ay) - (cy - ay) * (bx - ax)) / den <= 1:
                heights.add(ay + t * (by - ay))
    if not all(map(isfinite, heights)):
        return None

    def widths(edges: list[list[float]], y: float) -> list[tuple[float, float]]:
        xs = sorted(x1 + (y - y1) * (x2 - x1) / (y2 - y1) for x1, y1, x2, y2 in edges if (y1 > y) != (y2 > y))
        return list(zip(xs[0::2], xs[1::2]))

    total, ordered = 0.0, sorted(heights)
    for low, high in zip(ordered[:-1], ordered[1:]):
        middle, shared = (low + high) / 2, 0.0
        for p0, p1 in widths(a, middle):
            for q0, q1 in widths(b, middle):
                shared += max(0.0, min(p1, q1) - max(p0, q0))
        total += shared * (high - low)
    return total


def overlap_area(a: np.ndarray, b: np.ndarray) -> float:
    """Area shared by two polygons given as edges: slabs between all vertex and crossing heights.

    Exact for straight edges, since no two edges cross inside a slab.
    """
    if len(a) == 0 or len(b) == 0:
        return 0.0
    if len(a) * len(b) <= FEW_EDGE_PAIRS and (small := _few_edges_overlap(a.tolist(), b.tolist())) is not None:
        return small
    heights = np.unique(np.concatenate([a[:, 1], a[:, 3], b[:, 1], b[:, 3], _crossing_heights(a, b)]))
    total = 0.0
    for low, high in zip(heights[:-1], heights[1:]):
        middle = (low + high) / 2
        shared = sum(max(0.0, min(p[1], q[1]) - max(p[0], q[0]))
                     for p in _widths(a, middle) for q in _widths(b, middle))
        total += shared * (high - low)
    return total


@F.pandas_udf(DoubleType())
def _overlap(ax: pd.Series, ay: pd.Series, an: pd.Series, bx: pd.Series, by: pd.Series, bn: pd.Series) -> pd.Series:
    return pd.Series([0.0 if a[0] is None or b[0] is None else overlap_area(_ring_edges(*a), _ring_edges(*b))
                      for a, b in zip(zip(ax, ay, an), zip(bx, by, bn))])


def polygon_iou(a: Column, b: Column, areas: tuple[Column, Column] | None = None) -> Column:
    """IoU of two polygons; 0 where either is null or empty. Meant for pairs that share a box; ``areas`` are theirs, where known."""
    shared = _overlap(*geo.flat_rings(a), *geo.flat_rings(b))
    of_a, of_b = areas or (geo.polygon_area(a), geo.polygon_area(b))
    union = of_a + of_b - shared
    return F.coalesce(F.when(union > 0, shared / union), F.lit(0.0))


def cell_iou(a: DataFrame, b: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """IoU of shapes given as cells ``(*keys, a_id|b_id, row, col)``; only pairs that share a cell."""
    keys = list(keys)
    shared = a.join(b, [*keys, "row", "col"]).groupBy(*keys, "a_id", "b_id").agg(F.count(F.lit(1)).alias("shared"))
    size_a = a.groupBy(*keys, "a_id").agg(F.count(F.lit(1)).alias("cells_a"))
    size_b = b.groupBy(*keys, "b_id").agg(F.count(F.lit(1)).alias("cells_b"))
    return shared.join(size_a, [*keys, "a_id"]).join(size_b, [*keys, "b_id"]).withColumn(
        "iou", F.col("shared") / (F.col("cells_a") + F.col("cells_b") - F.col("shared")))
