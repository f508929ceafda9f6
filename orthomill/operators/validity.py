"""Validity of polygon parts, and repair of invalid ones by tracing their lines anew.

Edges of a whole batch are swept together: sorted along an axis, each meets only those that start before
it ends. Only invalid parts are traced: their lines are cut together, then each is traced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, IntegerType, StructField, StructType

from orthomill.functions import geometry as geo

#: Pairs of edges looked at together.
PAIRS_AT_ONCE = 1 << 20
PICKED = StructType([StructField("part", IntegerType()), StructField("xs", ArrayType(DoubleType())), StructField("ys", ArrayType(DoubleType())),
                     StructField("sizes", ArrayType(IntegerType()))])


class Edges:
    """Edges of closed rings without those of no length: ends, polygon, ring, and place in the ring."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, polygon_of_ring: np.ndarray) -> None:
        ring_of = np.repeat(np.arange(len(sizes)), sizes)
        at = np.flatnonzero((ring_of[1:] == ring_of[:-1]) & ((xs[1:] != xs[:-1]) | (ys[1:] != ys[:-1])))
        self.ends = np.column_stack([xs[at], ys[at], xs[at + 1], ys[at + 1]])
        self.ring = ring_of[at]
        self.polygon = polygon_of_ring[self.ring]
        self.count = np.bincount(self.ring, minlength=len(sizes))
        self.place = np.arange(len(at)) - (np.cumsum(self.count) - self.count)[self.ring]

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of edges of a polygon whose boxes meet, each once; along the axis on which its edges are shorter for its extent."""
        e, p = self.ends, self.polygon
        low, high = np.minimum(e[:, :2], e[:, 2:]), np.maximum(e[:, :2], e[:, 2:])
        n = int(p.max(initial=-1)) + 1
        first, last = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        np.minimum.at(first, p, low)
        np.maximum.at(last, p, high)
        load = np.column_stack([np.bincount(p, (high - low)[:, k], n) for k in (0, 1)]) / np.maximum(last - first, 1e-300)
        axis = (load[:, 1] < load[:, 0]).astype(int)[p]
        rows = np.arange(len(p))
        start, end = low[rows, axis], high[rows, axis]
        order = np.lexsort((start, p))
        # Starts and ends in one order: the starts counted up to an end are the edges that begin before it.
        events = np.lexsort((np.repeat([0, 1], len(p)), np.concatenate([start[order], end[order]]), np.tile(p[order], 2)))
        reach = np.empty(2 * len(p), dtype=np.int64)
        reach[events] = np.cumsum(events < len(p))
        many = reach[len(p):] - rows - 1
        upto = np.concatenate([[0], np.cumsum(many)])
        done = 0
        while done < len(p):
            stop = max(done + 1, int(np.searchsorted(upto, upto[done] + PAIRS_AT_ONCE, "right")) - 1)
            i = np.repeat(rows[done:stop], many[done:stop])
            j = i + 1 + np.arange(len(i)) - np.repeat(upto[done:stop] - upto[done], many[done:stop])
            i, j = order[i], order[j]
            meet = ((low[i] <= high[j]) & (low[j] <= high[i])).all(axis=1)
            yield i[meet], j[meet]
            done = stop

    def meetings(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs that share a point, the four sides of ends to the other's line, and whether the pair breaks validity.

        It does where edges cross or lie on each other, and where a ring touches itself elsewhere than from edge to edge.
        """
        def side(a: np.ndarray, p: np.ndarray) -> np.ndarray:
            return np.sign((a[:, 2] - a[:, 0]) * (p[:, 1] - a[:, 1]) - (a[:, 3] - a[:, 1]) * (p[:, 0] - a[:, 0]))

        for i, j in self.pairs():
            a, b = self.ends[i], self.ends[j]
            sides = np.column_stack([side(a, b[:, :2]), side(a, b[:, 2:]), side(b, a[:, :2]), side(b, a[:, 2:])])
            hit = (sides[:, 0] * sides[:, 1] <= 0) & (sides[:, 2] * sides[:, 3] <= 0)
            i, j, a, b, sides = i[hit], j[hit], a[hit], b[hit], sides[hit]
            crossing = (sides[:, 0] * sides[:, 1] < 0) & (sides[:, 2] * sides[:, 3] < 0)
            shared = np.minimum(np.maximum(a[:, :2], a[:, 2:]), np.maximum(b[:, :2], b[:, 2:])) - np.maximum(
                np.minimum(a[:, :2], a[:, 2:]), np.minimum(b[:, :2], b[:, 2:]))
            along = (sides == 0).all(axis=1) & (shared > 0).any(axis=1)
            gap = np.abs(self.place[i] - self.place[j])
            same = self.ring[i] == self.ring[j]
            neighbours = same & ((gap == 1) | (gap == self.count[self.ring[i]] - 1))
            yield i, j, sides, crossing | along | (same & ~neighbours)


def _inside(x: float, y: float, edges: np.ndarray) -> bool:
    """Whether a point lies within edges, by the even-odd rule."""
    e = edges[(edges[:, 1] > y) != (edges[:, 3] > y)]
    return bool(np.count_nonzero(e[:, 0] + (y - e[:, 1]) * (e[:, 2] - e[:, 0]) / (e[:, 3] - e[:, 1]) > x) % 2)


def _area(ring: Sequence[tuple[float, float]]) -> float:
    """Signed area of a closed ring, positive against the clock."""
    if len(ring) < 8:
        x0, y0 = ring[0]
        p = [(x - x0, y - y0) for x, y in ring]
        return sum(a * d - c * b for (a, b), (c, d) in zip(p, p[1:])) / 2
    p = np.asarray(ring, dtype=float) - ring[0]
    return float((p[:-1, 0] * p[1:, 1] - p[1:, 0] * p[:-1, 1]).sum()) / 2


def _cuts(edges: Edges) -> dict[int, list]:
    """Points at which an edge is cut by others of its polygon."""
    cuts: dict[int, list] = defaultdict(list)
    ends_of = edges.ends.tolist()
    for i, j, sides, _ in edges.meetings():
        for a, b, s in zip(i.tolist(), j.tolist(), sides.tolist()):
            p, q = ends_of[a], ends_of[b]
            if all(s):
                den = (p[2] - p[0]) * (q[3] - q[1]) - (p[3] - p[1]) * (q[2] - q[0])
                t = float(np.float64((q[0] - p[0]) * (q[3] - q[1]) - (q[1] - p[1]) * (q[2] - q[0])) / den)
                point = (p[0] + t * (p[2] - p[0]), p[1] + t * (p[3] - p[1]))
                cuts[a].append(point)
                cuts[b].append(point)
            for edge, line, ends, on in ((a, p, q, s[:2]), (b, q, p, s[2:])):
                for k in (0, 1):
                    x, y = ends[2 * k], ends[2 * k + 1]
                    if on[k] == 0 and min(line[0], line[2]) <= x <= max(line[0], line[2]) and min(line[1], line[3]) <= y <= max(line[1], line[3]):
                        cuts[edge].append((x, y))
    return cuts


def _nodes(ends: list[list[float]], cuts: Sequence[Sequence[tuple]]) -> set[tuple]:
    """The lines cut wherever they meet; pieces that lie on each other an even number of times cancel out."""
    odd: set[tuple] = set()
    for (x1, y1, x2, y2), points in zip(ends, cuts):
        path = sorted({(x1, y1), (x2, y2), *points}, key=lambda p: (p[0] - x1) * (x2 - x1) + (p[1] - y1) * (y2 - y1))
        for u, v in zip(path, path[1:]):
            odd ^= {(min(u, v), max(u, v))}
    return odd


def _simple_loops(cycle: list[tuple]) -> list[list[tuple]]:
    """A closed walk cut into closed rings that touch no point twice."""
    loops, walk, at = [], [], {}
    for p in cycle:
        if p in at:
            loops.append([*walk[at[p]:], p])
            for gone in walk[at[p] + 1:]:
                del at[gone]
            del walk[at[p] + 1:]
        else:
            at[p] = len(walk)
            walk.append(p)
    return loops


def repairs(edges: Edges, polygons: int) -> Iterator[list[list[tuple]] | None]:
    """:func:`repair` of each polygon; their lines are cut together."""
    cuts, ends = _cuts(edges), edges.ends.tolist()
    upto = np.cumsum(np.bincount(edges.polygon, minlength=polygons)).tolist()
    for first, last in zip([0, *upto], upto):
        yield _largest_piece(_nodes(ends[first:last], [cuts.get(n, ()) for n in range(first, last)]))


def repair(edges: Edges) -> list[list[tuple]] | None:
    """The largest piece of what the lines enclose by the even-odd rule, outer ring first; None where they enclose nothing."""
    return next(repairs(edges, 1))


def _largest_piece(odd: set[tuple]) -> list[list[tuple]] | None:
    """:func:`repair` from the pieces of the lines."""
    near: dict[tuple, list] = defaultdict(list)
    for u, v in odd:
        near[u].append(v)
        near[v].append(u)
    follows = {}
    for p, around in near.items():
        around.sort(key=lambda q: np.arctan2(q[1] - p[1], q[0] - p[0]))
        for k, q in enumerate(around):
            follows[(q, p)] = (p, around[k - 1])
    # Faces lie to the left of their walks.
    face_of, faces = {}, []
    for step in follows:
        if step not in face_of:
            walk = [step[0]]
            while step not in face_of:
                face_of[step] = len(faces)
                walk.append(step[1])
                step = follows[step]
            faces.append(walk)
    beside = defaultdict(set)
    for (u, v), f in face_of.items():
        beside[f].add(face_of[(v, u)])
    areas, group, parity, members = [_area(f) for f in faces], {}, {}, []
    for f in sorted(range(len(faces)), key=lambda i: areas[i]):
        # The face of least area that no walk has reached is what surrounds its lines.
        if f not in group:
            group[f], parity[f], todo = len(members), 0, [f]
            members.append(f)
            while todo:
                g = todo.pop()
                for h in beside[g] - group.keys():
                    group[h], parity[h] = group[g], 1 - parity[g]
                    todo.append(h)
    lines = {u + v: group[face_of[(u, v)]] for u, v in odd}
    ends, owner = np.array(list(lines) or np.empty((0, 4))), np.array(list(lines.values()))
    within = [len(members) > 1 and _inside(*faces[f][0], ends[owner != g]) for g, f in enumerate(members)]
    pieces = []
    for f, walk in enumerate(faces):
        if areas[f] > 0 and (parity[f] + within[group[f]]) % 2:
            loops = _simple_loops(walk)
            outer = max(loops, key=_area)
            pieces.append([outer, *[r for r in loops if r is not outer]])
    for g, f in enumerate(members):
        if within[g]:
            around = [p for p in pieces if _inside(*faces[f][0], np.array([u + v for u, v in zip(p[0], p[0][1:])]))]
            around and min(around, key=lambda p: _area(p[0])).extend(_simple_loops(faces[f]))
    return max(pieces, key=lambda p: sum(map(_area, p)), default=None)


def _flat(values: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Arrays of rows end to end, and their lengths; null is empty."""
    arrays = [() if v is None else v for v in values]
    lengths = np.array([len(a) for a in arrays], dtype=np.int64)
    return (np.concatenate([np.asarray(a, dtype=float) for a in arrays]) if len(arrays) else np.empty(0)), lengths


class Parts:
    """The polygons of a batch: which can be used at all, which are valid, and their areas."""

    def __init__(self, xs: np.ndarray, ys: np.ndarray, sizes: np.ndarray, rings: np.ndarray) -> None:
        """``sizes`` of rings in points, ``rings`` of polygons in rings."""
        self.xs, self.ys, self.sizes, self.rings = xs, ys, sizes, rings
        self.first_ring = np.cumsum(rings) - rings
        self.first_point = np.cumsum(sizes) - sizes
        n, polygon = len(rings), np.repeat(np.arange(len(rings)), rings)
        last = self.first_point + sizes - 1
        good = sizes >= 4
        a, b = self.first_point[good], last[good]
        closed = np.zeros(len(sizes), dtype=bool)
        closed[good] = (xs[a] == xs[b]) & (ys[a] == ys[b])
        bad_point = ~(np.isfinite(xs) & np.isfinite(ys))
        broken = ~closed
        np.logical_or.at(broken, np.repeat(np.arange(len(sizes)), sizes), bad_point)
        self.usable = (rings > 0) & (np.bincount(polygon, broken, n) == 0)
        kept = self.usable[polygon]
        points = np.repeat(kept, sizes)
        self.edges = Edges(xs[points], ys[points], sizes[kept], polygon[kept])
        origin = np.column_stack([xs, ys])[np.minimum(self.first_point, max(len(xs) - 1, 0))][kept][self.edges.ring] if len(xs) else np.empty((0, 2))
        e = self.edges.ends - np.tile(origin, 2)
        by_ring = np.abs(np.bincount(self.edges.ring, e[:, 0] * e[:, 3] - e[:, 2] * e[:, 1], int(kept.sum()))) / 2
        outer = np.flatnonzero(kept) == self.first_ring[polygon[kept]]
        self.area = np.bincount(polygon[kept], np.where(outer, by_ring, -by_ring), n)
        low, high = np.full((n, 2), np.inf), np.full((n, 2), -np.inf)
        np.minimum.at(low, self.edges.polygon, self.edges.ends[:, :2])
        np.maximum.at(high, self.edges.polygon, self.edges.ends[:, :2])
        self.box = np.where(high[:, 0] >= low[:, 0], (high - low).clip(0).prod(axis=1), 0.0)
        self.valid = self.usable & (self.area > 0)
        for i, _, _, breaks in self.edges.meetings():
            self.valid[self.edges.polygon[i[breaks]]] = False
        for p in np.flatnonzero(self.valid & (rings > 1)):
            mine = self.edges.polygon == p
            ends, ring = self.edges.ends[mine], self.edges.ring[mine]
            for hole in np.unique(ring)[1:]:
                x1, y1, x2, y2 = ends[ring == hole][0]
                if not _inside((x1 + x2) / 2, (y1 + y2) / 2, ends[ring == ring[0]]):
                    self.valid[p] = False

    def repaired(self, p: int) -> list[list[tuple]] | None:
        return next(self.all_repaired(np.array([p])))

    def all_repaired(self, some: np.ndarray) -> Iterator[list[list[tuple]] | None]:
        """The polygons ``some``, in ascending order, repaired."""
        wanted = np.zeros(len(self.rings), dtype=bool)
        wanted[some] = True
        rings = np.repeat(wanted, self.rings)
        points = np.repeat(rings, self.sizes)
        polygon = np.repeat(np.arange(len(some)), self.rings[some])
        return repairs(Edges(self.xs[points], self.ys[points], self.sizes[rings], polygon), len(some))


@F.pandas_udf(BooleanType())
def _valid(xs: pd.Series, ys: pd.Series, sizes: pd.Series) -> pd.Series:
    (x, _), (y, _), (n, rings) = _flat(xs), _flat(ys), _flat(sizes)
    return pd.Series(Parts(x, y, n.astype(np.int64), rings).valid)


@F.pandas_udf(PICKED)
def _pick(xs: pd.Series, ys: pd.Series, sizes: pd.Series, rings: pd.Series) -> pd.DataFrame:
    (x, _), (y, _), (n, _), (r, parts) = _flat(xs), _flat(ys), _flat(sizes), _flat(rings)
    batch = Parts(x, y, n.astype(np.int64), r.astype(np.int64))
    area, traced = np.where(batch.valid, batch.area, 0.0), {}
    row = np.repeat(np.arange(len(parts)), parts)
    best = np.zeros(len(parts))
    np.maximum.at(best, row, area)
    # A part within a box smaller than the row's best valid part cannot win.
    broken = np.flatnonzero(batch.usable & ~batch.valid & (batch.box > 0) & (batch.box >= best[row]))
    for p, piece in zip(broken.tolist(), batch.all_repaired(broken)):
        if piece:
            traced[p], area[p] = piece, sum(map(_area, piece))
    out, first = [], 0
    for many in parts.tolist():
        best = first + int(area[first:first + many].argmax()) if many else -1
        if best < 0 or not area[best] > 0:
            out.append((None, None, None, None))
        elif best in traced:
            flat = np.array([p for ring in traced[best] for p in ring])
            out.append((best - first, flat[:, 0], flat[:, 1], np.array([len(ring) for ring in traced[best]], dtype=np.int32)))
        else:
            out.append((best - first, None, None, None))
        first += many
    return pd.DataFrame(out, columns=["part", "xs", "ys", "sizes"]).astype({"part": "Int32"})


def is_valid(rings: Column) -> Column:
    """Closed rings of at least four points around a positive area, whose edges neither cross nor lie on each other.

    A ring may not touch itself; holes may touch other rings in points, and start within the outer ring. Null is not valid.
    """
    return F.coalesce(_valid(*geo.flat_rings(rings)), F.lit(False))


def largest_valid(parts: DataFrame, column: str, to: str = "rings") -> DataFrame:
    """``parts`` with a column ``to``: the largest polygon of the array of polygons ``column``, the first of equal ones; null for none.

    A valid part stays as it is; one whose rings cross, touch or overlap counts with the largest piece that they
    enclose by the even-odd rule. Parts with an open ring, under four points or a coordinate that is no number are left out.
    """
    polygons = F.col(column)
    picked = _pick(*geo.flat_rings(F.flatten(polygons)), F.transform(polygons, lambda p: F.size(p)))
    return parts.withColumn("_picked", picked).withColumn(to, F.when(
        F.col("_picked.xs").isNotNull(), geo.rings_from_flat(F.col("_picked"))).otherwise(F.get(polygons, F.col("_picked.part")))).drop("_picked")
