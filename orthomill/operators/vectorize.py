"""Raster components to polygons: boundary edges, rings, sanitising, simplification."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.operators.components import connected_components, label_cells
from orthomill.operators.validity import largest_valid
from orthomill.session import cut_lineage, map_groups

FLAT = StructType([StructField("xs", ArrayType(DoubleType())), StructField("ys", ArrayType(DoubleType())),
                   StructField("sizes", ArrayType(IntegerType()))])

# Directions with y pointing down: 0 right, 1 down, 2 left, 3 up. The interior lies to the right.
_STEP_X = np.array([1, 0, -1, 0])
_STEP_Y = np.array([0, 1, 0, -1])


def boundary_edges(labelled: DataFrame, keys: Sequence[str], value: str | None = None) -> DataFrame:
    """Directed unit edges ``(*keys, component, x, y, dir)`` between a component and anything else.

    The component's class goes along if ``value`` names it.

    Each cell contributes its four sides; a side shared by two cells of the same
    component occurs once in each direction and cancels in the sum.
    """
    side = lambda kind, x, y, sign: F.struct(
        F.lit(kind).alias("k"), x.alias("x"), y.alias("y"), F.lit(sign).alias("s"))
    r, c = F.col("row"), F.col("col")
    sides = F.array(side(0, c, r, 1), side(0, c, r + 1, -1), side(1, c + 1, r, 1), side(1, c, r, -1))
    carried = [*keys, "component", *([value] if value else [])]
    summed = (
        labelled.select(*carried, F.explode(sides).alias("e"))
        .groupBy(*carried, "e.k", "e.x", "e.y").agg(F.sum("e.s").alias("s")).filter("s != 0")
    )
    horizontal = F.col("k") == 0
    forward = F.col("s") > 0
    return summed.select(
        *carried,
        F.when(horizontal & ~forward, F.col("x") + 1).otherwise(F.col("x")).alias("x"),
        F.when(~horizontal & ~forward, F.col("y") + 1).otherwise(F.col("y")).alias("y"),
        (F.when(forward, 0).otherwise(2) + F.when(horizontal, 0).otherwise(1)).cast("int").alias("dir"))


def _spans(owner: np.ndarray, n: int, values: np.ndarray) -> tuple[np.ndarray, int]:
    """``values`` from the least of each owner, and how many there are at most."""
    low = np.full(n, np.iinfo(np.int64).max)
    np.minimum.at(low, owner, values)
    rel = values - low[owner]
    return rel, int(rel.max()) + 2


def _successors(comp: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Next edge of every edge; where two leave a vertex the left turn wins, which keeps rings simple."""
    n = int(comp.max()) + 1
    (x, span_x), (y, span_y) = _spans(comp, n, x), _spans(comp, n, y)
    code = lambda cx, cy, cd: ((comp * span_y + cy) * span_x + cx) * 4 + cd
    own = code(x, y, d)
    order = np.argsort(own)
    ordered = own[order]
    end_x, end_y = x + _STEP_X[d], y + _STEP_Y[d]
    following = np.full(len(x), -1, dtype=np.int64)
    for turn in (3, 0, 1):
        wanted = code(end_x, end_y, (d + turn) % 4)
        at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
        found = (ordered[at] == wanted) & (following < 0)
        following[found] = order[at[found]]
    return following


def _chains(starts: np.ndarray, following: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges ring by ring, and the number of edges of each ring; rings start in the order of ``starts``."""
    after, seen = following.tolist(), bytearray(len(following))
    chain, sizes = [], []
    for edge in starts.tolist():
        if seen[edge]:
            continue
        before = len(chain)
        while not seen[edge]:
            seen[edge] = 1
            chain.append(edge)
            edge = after[edge]
        sizes.append(len(chain) - before)
    return np.array(chain, dtype=np.int64), np.array(sizes, dtype=np.int64)


def _places(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... within each run of the given sizes."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _rings(comp: np.ndarray, x: np.ndarray, y: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    """Closed rings of corners, those of a component together and its outer ring first.

    Gives the corners' ``x`` and ``y``, the number of corners of each ring, the number of rings of each component, and one of its edges.
    A ring starts at its topmost leftmost corner.
    """
    chain, sizes = _chains(np.lexsort((x, y)), _successors(comp, x, y, d))
    first = np.cumsum(sizes) - sizes
    before = np.arange(len(chain)) - 1
    before[first] = first + sizes - 1
    corner = d[chain] != d[chain[before]]
    at = chain[corner]
    ring = np.repeat(np.arange(len(sizes)), sizes)[corner]
    corners = np.bincount(ring, minlength=len(sizes))
    if not corners.all():
        raise ValueError("edges that close into no ring: a cell is given twice")
    start = np.cumsum(corners) - corners
    top = np.lexsort((x[at], y[at], ring))[start] - start
    many = np.repeat(corners, corners + 1)
    at = at[np.repeat(start, corners + 1) + (np.repeat(top, corners + 1) + _places(corners + 1)) % many]
    closed = corners + 1
    px, py = x[at], y[at]
    begin = np.cumsum(closed) - closed
    turned = px * np.roll(py, -1) - np.roll(px, -1) * py
    turned[begin + closed - 1] = 0
    owner = comp[chain[first]]
    order = np.lexsort((px[begin], py[begin], np.add.reduceat(turned, begin) < 0, owner))
    points = np.repeat(begin[order], closed[order]) + _places(closed[order])
    edge = np.empty(int(comp.max()) + 1, dtype=np.int64)
    edge[owner] = chain[first]
    return px[points], py[points], closed[order], np.bincount(owner), edge


def _lists(sizes: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(values).cast(kind))


def stitch_rings(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygons ``(*keys, component, rings)`` in pixel space, outer ring first.

    A key's edges are in one task: use it for tile-sized masks, whose boundary is bounded by
    the tile. :func:`trace_rings` handles rasters of any size. Further columns of
    ``edges`` are taken to be constant within a component.
    """
    keys = list(keys)
    kept = [c for c in edges.columns if c not in ("x", "y", "dir")]
    fields = [edges.schema[c] for c in kept] + FLAT.fields

    def stitch(table: pa.Table, group: np.ndarray) -> pa.Table:
        x, y, d, component = (table[n].to_numpy().astype(np.int64) for n in ("x", "y", "dir", "component"))
        order = np.lexsort((component, group))
        new = np.append(True, (np.diff(component[order]) != 0) | (np.diff(group[order]) != 0))
        comp = np.empty(len(order), dtype=np.int64)
        comp[order] = np.cumsum(new) - 1
        px, py, sizes, rings, edge = _rings(comp, x, y, d)
        last = np.cumsum(rings)
        points = np.add.reduceat(sizes, last - rings)
        flat = [_lists(points, px, pa.float64()), _lists(points, py, pa.float64()), _lists(rings, sizes, pa.int32())]
        found = table.select(kept).take(pa.array(edge))
        for name, values in zip(FLAT.names, flat):
            found = found.append_column(name, values)
        return found

    flat = map_groups(edges, keys, stitch, StructType(fields))
    return flat.select(*kept, geo.rings_from_flat(F.struct("xs", "ys", "sizes")).alias("rings"))


def trace_rings(edges: DataFrame, keys: Sequence[str], max_rounds: int = 48) -> DataFrame:
    """Ring corners in order, ``(*keys, component, ring, pos, x, y)``, for boundaries of any length.

    Every edge finds its successor by an equi-join on its end point; the rings
    are the components of that relation, and an edge's place in its ring comes
    from pointer doubling towards the ring's first edge. No ring is ever held by
    one task; the number of rounds grows with the logarithm of the ring length.
    """
    keys = list(keys)
    scope = [*keys, "component"]
    base = edges.withColumn("edge", ((F.col("y") * (1 << 31) + F.col("x")) * 4 + F.col("dir")).cast("long"))
    step_x = F.when(F.col("dir") == 0, 1).when(F.col("dir") == 2, -1).otherwise(0)
    step_y = F.when(F.col("dir") == 1, 1).when(F.col("dir") == 3, -1).otherwise(0)
    turns = F.array(*[F.struct(F.lit(p).alias("p"), F.lit(t).alias("t")) for p, t in enumerate((3, 0, 1))])
    wanted = base.select(*scope, F.col("edge").alias("u"), (F.col("x") + step_x).alias("x"),
                         (F.col("y") + step_y).alias("y"), F.explode(turns).alias("turn"), F.col("dir").alias("_d")) \
        .select(*scope, "u", "x", "y", F.pmod(F.col("_d") + F.col("turn.t"), F.lit(4)).cast("int").alias("dir"),
                "turn.p")
    links = cut_lineage(
        wanted.join(base, [*scope, "x", "y", "dir"])
        .groupBy(*scope, "u").agg(F.min_by("edge", "p").alias("v")))
    ring_of = _ring_ids(links, scope)
    hops = links.join(ring_of, [*scope, "u"]).select(
        *scope, "ring", "u", F.when(F.col("v") == F.col("ring"), F.lit(None)).otherwise(F.col("v")).alias("v"))
    ranked = cut_lineage(hops.withColumn("steps", F.when(F.col("v").isNull(), 0).otherwise(1).cast("long")))
    for _ in range(max_rounds):
        if ranked.filter(F.col("v").isNotNull()).isEmpty():
            break
        ahead = ranked.select(*scope, F.col("u").alias("v"), F.col("v").alias("_v"), F.col("steps").alias("_s"))
        jumped = ranked.filter(F.col("v").isNotNull()).join(ahead, [*scope, "v"]) \
            .select(*scope, "ring", "u", F.col("_v").alias("v"), (F.col("steps") + F.col("_s")).alias("steps"))
        ranked = cut_lineage(ranked.filter(F.col("v").isNull()).unionByName(jumped))
    else:
        raise RuntimeError(f"ring order did not settle in {max_rounds} rounds")
    length = ranked.groupBy(*scope, "ring").agg(F.max("steps").alias("_len"))
    placed = base.withColumnRenamed("edge", "u").join(ranked.drop("v"), [*scope, "u"]) \
        .join(length, [*scope, "ring"]).withColumn("pos", F.col("_len") - F.col("steps"))
    previous = links.join(base.select(*scope, F.col("edge").alias("u"), F.col("dir").alias("_before")), [*scope, "u"]) \
        .select(*scope, F.col("v").alias("u"), "_before")
    return placed.join(previous, [*scope, "u"]).filter(F.col("dir") != F.col("_before")) \
        .select(*scope, "ring", "pos", "x", "y")


def _ring_ids(links: DataFrame, scope: Sequence[str]) -> DataFrame:
    renamed = links.withColumnRenamed("component", "_shape")
    inner = ["_shape" if s == "component" else s for s in scope]
    return connected_components(renamed, inner).select(
        *[F.col(s).alias("component" if s == "_shape" else s) for s in inner],
        F.col("node").alias("u"), F.col("component").alias("ring"))


def component_polygons(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Polygons of components, each stitched as a group of its own, small ones together.

    A polygon is one row with all its rings, so its boundary fits a task wherever the result fits a row. Boundaries beyond that
    stay a table of vertices: :func:`trace_rings`.
    """
    return stitch_rings(edges, [*keys, "component"])


def ring_polygons(corners: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Corner table of :func:`trace_rings` as polygons; for shapes whose rings fit a row."""
    pts = F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")))),
                      lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    closed = corners.groupBy(*keys, "component", "ring").agg(pts.alias("pts"))
    ring = F.concat("pts", F.slice("pts", 1, 1))
    first = F.struct("ring", ring.alias("pts"))
    return closed.groupBy(*keys, "component").agg(
        F.transform(F.array_sort(F.collect_list(first)), lambda s: s["pts"]).alias("rings"))


def geo_reference(rings: Column, transform: Column) -> Column:
    """Rings in pixel space to coordinates."""
    return F.transform(rings, lambda ring: F.transform(
        ring, lambda p: geo.pixel_to_geo(p["x"], p["y"], transform)))


def polygonize(cells: DataFrame, keys: Sequence[str], transforms: DataFrame | None = None, value: str = "class_id",
               min_area: float = fixed.MIN_POLYGON_AREA, tolerance: float = fixed.SIMPLIFY_TOLERANCE,
               whole_tile: bool = False, chunk: int = 256) -> DataFrame:
    """Class cells of tile masks to polygons with pixel count, area, perimeter and validity.

    4-connected; holes are kept; area is tested before simplification, measures
    are taken after it. ``transforms`` holds one ``transform`` per key (or per
    leading key); without it the result stays in pixel space. Components are labelled
    block-wise; ``whole_tile`` says that every key's mask is tile-sized and labels it as one block.
    """
    keys = list(keys)
    labelled = label_cells(cells.filter(F.col(value) > 0), keys, value, 4, None if whole_tile else chunk)
    if whole_tile:
        shapes = stitch_rings(boundary_edges(labelled, keys, value), keys)
    else:
        shapes = component_polygons(boundary_edges(labelled, keys, value), keys)
    shapes = shapes.withColumn("pixels", geo.polygon_area(F.col("rings")).cast("long"))
    if transforms is not None:
        shared = [k for k in keys if k in transforms.columns]
        shapes = shapes.join(transforms.select(*shared, F.col("transform").alias("_transform")), shared) \
            .withColumn("rings", geo_reference(F.col("rings"), F.col("_transform"))).drop("_transform")
    kept = simplify(shapes.filter(geo.polygon_area(F.col("rings")) >= min_area), tolerance)
    return kept.withColumn("area", geo.polygon_area(F.col("rings"))) \
        .withColumn("perimeter", geo.polygon_length(F.col("rings"))) \
        .withColumn("valid", _closed(F.col("rings")) & (F.col("area") > 0))


def _closed(rings: Column) -> Column:
    return (F.size(rings) > 0) & F.forall(
        rings, lambda ring: (F.size(ring) >= 4) & (F.element_at(ring, 1) == F.element_at(ring, -1)))


def sanitize(parts: DataFrame, keys: Sequence[str], column: str = "parts") -> DataFrame:
    """Polygon parts, one row per key, to one polygon per key: invalid parts repaired, the largest kept, the first of equal ones, nothing left = no row.

    A part is picked inside its row, so nothing is shuffled.
    """
    picked = largest_valid(parts.select(*keys, F.col(column).alias("_parts")), "_parts")
    # Exploded rather than filtered: a filter would be pushed down and work everything out twice.
    return picked.select(*keys, F.explode(F.filter(F.array("rings"), lambda r: r.isNotNull())).alias("rings"))


def _douglas_peucker(pts: np.ndarray, first: np.ndarray, last: np.ndarray, tolerance: float) -> np.ndarray:
    """Kept positions of open lines, from ``first`` to ``last`` each; their ends always stay. All lines are halved together."""
    keep = np.zeros(len(pts), dtype=bool)
    keep[first] = keep[last] = True
    a, b = first, last
    while True:
        open_ = b - a >= 2
        a, b = a[open_], b[open_]
        if not len(a):
            return keep
        inner = b - a - 1
        begin = np.cumsum(inner) - inner
        at = np.repeat(a + 1, inner) + _places(inner)
        leg = pts[b] - pts[a]
        length2 = np.repeat((leg * leg).sum(axis=1), inner)
        rel, leg = pts[at] - np.repeat(pts[a], inner, axis=0), np.repeat(leg, inner, axis=0)
        t = np.zeros(len(at))
        np.divide((rel * leg).sum(axis=1), length2, out=t, where=length2 > 0)
        gap = np.hypot(*(rel - np.clip(t, 0, 1)[:, None] * leg).T)
        most = np.maximum.reduceat(gap, begin)
        line = np.repeat(np.arange(len(a)), inner)
        # The first of equal gaps.
        hits = np.flatnonzero(gap == most[line])
        lines, nearest = np.unique(line[hits], return_index=True)
        worst = np.zeros(len(a), dtype=np.int64)
        worst[lines] = at[hits[nearest]]
        far = most > tolerance
        keep[worst[far]] = True
        a, b = np.concatenate([a[far], worst[far]]), np.concatenate([worst[far], b[far]])


def simplify_rings(pts: np.ndarray, sizes: np.ndarray, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Simplified closed rings end to end, and their sizes; a ring that would collapse below a triangle stays as it is."""
    begin = np.cumsum(sizes) - sizes
    large = sizes > 4
    keep = np.ones(len(pts), dtype=bool)
    keep[np.repeat(large, sizes)] = False
    keep |= _douglas_peucker(pts, begin[large], (begin + sizes - 1)[large], tolerance)
    ring = np.repeat(np.arange(len(sizes)), sizes)
    keep |= (np.bincount(ring, keep, len(sizes)) < 4)[ring]
    return pts[keep], np.bincount(ring[keep], minlength=len(sizes))


def simplify_ring(pts: np.ndarray, tolerance: float) -> np.ndarray:
    """One closed ring simplified, as :func:`simplify_rings` does."""
    return simplify_rings(pts, np.array([len(pts)]), tolerance)[0]


def simplify(polygons: DataFrame, tolerance: float, column: str = "rings") -> DataFrame:
    """Douglas-Peucker on every ring; 0 leaves the polygons alone. Only the rings go through Python."""
    if tolerance <= 0:
        return polygons

    @F.pandas_udf(FLAT)
    def run(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        some = xs.notna().to_numpy()
        if not some.any():
            return pd.DataFrame({name: pd.Series([None] * len(xs), dtype=object) for name in FLAT.names})
        x, y, counts = (np.concatenate(v[some].to_list()) for v in (xs, ys, sizes))
        pts, kept = simplify_rings(np.column_stack([x, y]), counts.astype(np.int64), tolerance)
        rings = np.cumsum([len(n) for n in sizes[some]])
        points = np.append(0, np.cumsum(kept))[rings]
        out = {}
        for name, values, ends in zip(FLAT.names, (pts[:, 0], pts[:, 1], kept.astype(np.int32)), (points, points, rings)):
            lists = iter(np.split(values, ends[:-1]))
            out[name] = pd.Series([next(lists) if s else None for s in some], dtype=object)
        return pd.DataFrame(out)

    return polygons.withColumn("_flat", run(*geo.flat_rings(F.col(column)))) \
        .withColumn(column, geo.rings_from_flat(F.col("_flat"))).drop("_flat")


def outer_vertices(rings: Column) -> Column:
    """Closed vertex count of the outer ring."""
    return F.when(rings.isNull() | (F.size(rings) == 0), F.lit(0)).otherwise(F.size(F.get(rings, 0)))


def simplification_report(polygons: DataFrame, tolerance: float, column: str = "rings") -> DataFrame:
    """Outer-ring vertices before and after simplification, and the reduction in percent; one pass over the polygons."""
    both = simplify(polygons.select(F.col(column), F.col(column).alias("_after")), tolerance, "_after")
    counts = both.agg(*[F.coalesce(F.sum(outer_vertices(F.col(c))), F.lit(0)).alias(name)
                        for c, name in ((column, "vertices_before"), ("_after", "vertices_after"))])
    share = 1 - F.col("vertices_after") / F.greatest("vertices_before", F.lit(1))
    return counts.withColumn("reduction_pct", share * 100)
