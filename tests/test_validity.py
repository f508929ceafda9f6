"""Validity and repair of polygons against brute force."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from orthomill.functions import geometry as geo
from orthomill.operators import validity, vectorize


def parts_of(polygons):
    rings = [r for p in polygons for r in p]
    pts = np.array([p for r in rings for p in r], dtype=float).reshape(-1, 2)
    return validity.Parts(pts[:, 0], pts[:, 1], np.array([len(r) for r in rings], dtype=np.int64), np.array([len(p) for p in polygons], dtype=np.int64))


def even_odd(rings, x, y):
    return sum((b > y) != (d > y) and a + (y - b) * (c - a) / (d - b) > x for r in rings for (a, b), (c, d) in zip(r, r[1:])) % 2 == 1


def largest_cells(rings, n):
    cells, best = {(x, y) for x in range(n) for y in range(n) if even_odd(rings, x + .5, y + .5)}, 0
    while cells:
        todo, size = [cells.pop()], 0
        while todo:
            x, y = todo.pop()
            size += 1
            for c in ((x + 1, y), (x - 1, y), (x, y + 1), (x, y - 1)):
                if c in cells:
                    cells.remove(c)
                    todo.append(c)
        best = max(best, size)
    return best


def walk(rnd, n):
    xs, ys = rnd.choices(range(n + 1), k=rnd.randint(2, 7)), []
    ys = rnd.choices(range(n + 1), k=len(xs))
    ring = [p for k in range(len(xs)) for p in ((xs[k], ys[k]), (xs[(k + 1) % len(xs)], ys[k]))]
    return [*ring, ring[0]]


def test_pieces_are_the_largest_connected_cells():
    rnd = random.Random(5)
    polygons = [[walk(rnd, 8) for _ in range(rnd.choice([1, 1, 2, 3]))] for _ in range(600)]
    batch, traced = parts_of(polygons), 0
    for p, rings in enumerate(polygons):
        want = largest_cells(rings, 8)
        if batch.valid[p]:
            assert batch.area[p] == want
        else:
            piece = batch.repaired(p)
            assert sum(map(validity._area, piece or [])) == want
            if piece:
                traced += 1
                assert parts_of([piece]).valid[0] and all(even_odd(rings, x, y) for x, y in [(c + .5, d + .5) for c in range(8) for d in range(8)] if even_odd(piece, x, y))
    assert traced > 300


def test_validity_is_that_of_all_pairs_of_edges():
    rnd = random.Random(6)
    polygons = [[[(rnd.random(), rnd.random()) for _ in range(rnd.randint(3, 7))]] for _ in range(800)]
    polygons = [[r + r[:1] for r in p] for p in polygons]

    def side(a, b, c):
        return (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])

    def crosses(r):
        e = list(zip(r, r[1:]))
        return any(side(*e[i], c) * side(*e[i], d) < 0 and side(c, d, e[i][0]) * side(c, d, e[i][1]) < 0 for i in range(len(e)) for c, d in e[i + 1:])
    got = parts_of(polygons).valid
    assert [not crosses(p[0]) for p in polygons] == got.tolist() and 100 < got.sum() < 700


@pytest.mark.parametrize("wkt,valid,area", [
    ("((0 0, 4 0, 4 4, 0 4, 0 0), (1 1, 2 1, 2 2, 1 2, 1 1))", True, 15), ("((0 0, 4 0, 4 4, 0 4, 0 0), (3 1, 6 1, 6 2, 3 2, 3 1))", False, 15),
    ("((0 0, 4 0, 4 4, 0 4, 0 0), (5 5, 6 5, 6 6, 5 6, 5 5))", False, 16), ("((0 0, 4 0, 4 4, 0 4, 0 0), (0 0, 2 1, 1 2, 0 0))", True, 14.5),
    ("((0 0, 4 0, 4 4, 0 4, 0 0), (0 1, 2 1, 2 2, 0 2, 0 1))", False, 14), ("((0 0, 4 0, 4 4, 2 0, 0 4, 0 0))", False, 4),
    ("((0 0, 4 0, 4 4, 4 6, 4 4, 0 4, 0 0))", False, 16), ("((0 0, 0 0, 4 0, 4 0, 4 4, 0 0))", True, 8)])
def test_kinds_of_broken_polygons(spark, wkt, valid, area):
    df = spark.createDataFrame([(f"POLYGON {wkt}",), (None,), ("nothing",)], "t string").select("t", geo.parts_from_wkt(F.col("t")).alias("parts"))
    row = df.filter(F.col("t").startswith("POLYGON")).select(validity.is_valid(F.get("parts", F.lit(0))).alias("v")).first()
    assert row.v == valid
    got = vectorize.sanitize(df, ["t"]).select("t", geo.polygon_area(F.col("rings")).alias("a")).collect()
    assert [(r.t, r.a) for r in got] == [(f"POLYGON {wkt}", area)]
    assert vectorize.sanitize(df.filter("false"), ["t"]).count() == 0


def test_outlines_of_many_vertices_are_swept_in_short_time():
    n = 100_000
    turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
    ring = np.column_stack([np.cos(turn), np.sin(turn)])
    started = time.process_time()
    assert parts_of([[[*map(tuple, ring), tuple(ring[0])]]]).valid[0] and time.process_time() - started < 10
    ring[10], ring[60_000] = ring[60_000].copy(), ring[10].copy()
    assert not parts_of([[[*map(tuple, ring), tuple(ring[0])]]]).valid[0]


def test_parts_repaired_together_are_those_repaired_alone():
    rng = np.random.default_rng(9)
    rings = [np.vstack([p, p[:1]]) for p in (rng.integers(0, 7, (n, 2)).astype(float) for n in rng.integers(3, 14, 120))]
    batch = parts_of([[ring.tolist()] for ring in rings] + [[[(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)], [(8, 0), (9, 1), (9, 0), (8, 1), (8, 0)]]])
    some = np.flatnonzero(batch.usable)[::2]
    together = list(batch.all_repaired(some))
    assert len(together) == len(some) and together == [batch.repaired(p) for p in some.tolist()]
    edges = [validity.Edges(r[:, 0], r[:, 1], np.array([len(r)]), np.zeros(1, dtype=np.int64)) for r in (rings[p] for p in some[:-1])]
    assert together[:len(edges)] == [validity.repair(e) for e in edges] and sum(piece is not None for piece in together) > 40
    assert list(batch.all_repaired(np.array([], dtype=np.int64))) == []
