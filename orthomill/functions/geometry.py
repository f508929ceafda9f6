"""Planar geometry on rings, as Column expressions.

A polygon is ``rings: array<array<struct<x,y>>>``: the closed outer ring first,
then closed holes. A transform is ``array<double>`` ``[a,b,c,d,e,f]`` with
``x = a*col + b*row + c`` and ``y = d*col + e*row + f``.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RING_TYPE = "array<struct<x:double,y:double>>"
RINGS_TYPE = f"array<{RING_TYPE}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def point(x: Column, y: Column) -> Column:
    """Point struct."""
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def pixel_to_geo(col: Column, row: Column, transform: Column) -> Column:
    """Pixel position to coordinates."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    return point(a * col + b * row + c, d * col + e * row + f)


def shift_transform(transform: Column, col: Column, row: Column) -> Column:
    """Transform of a window whose top-left pixel is (``col``, ``row``)."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    return F.array(a, b, c + col * a + row * b, d, e, f + col * d + row * e)


def window_bounds(transform: Column, col: Column, row: Column, width: Column, height: Column) -> Column:
    """Extent of a window under a north-up transform: min/max of y and x."""
    corner = pixel_to_geo(col, row, transform)
    far = pixel_to_geo(col + width, row + height, transform)
    return F.struct(
        F.least(corner["y"], far["y"]).alias("min_y"),
        F.least(corner["x"], far["x"]).alias("min_x"),
        F.greatest(corner["y"], far["y"]).alias("max_y"),
        F.greatest(corner["x"], far["x"]).alias("max_x"),
    )


def box_rings(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Rectangle polygon, counter-clockwise from the lower right corner."""
    return F.array(F.array(point(x2, y1), point(x2, y2), point(x1, y2), point(x1, y1), point(x2, y1)))


def edges(ring: Column) -> Column:
    """Consecutive vertex pairs of a closed ring as ``struct<x1,y1,x2,y2>``."""
    n = F.greatest(F.size(ring) - 1, F.lit(0))
    return F.zip_with(
        F.slice(ring, F.lit(1), n), F.slice(ring, F.lit(2), n),
        lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")),
    )


def all_edges(rings: Column) -> Column:
    """Edges of every ring."""
    return F.flatten(F.transform(rings, edges))


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v)


def ring_area(ring: Column) -> Column:
    """Unsigned shoelace area, relative to the first vertex to keep precision far from the origin."""
    ox, oy = F.get(ring, 0)["x"], F.get(ring, 0)["y"]
    cross = F.transform(
        edges(ring),
        lambda e: (e["x1"] - ox) * (e["y2"] - oy) - (e["x2"] - ox) * (e["y1"] - oy),
    )
    return F.abs(_total(cross)) / 2.0


def ring_length(ring: Column) -> Column:
    """Length of a closed ring."""
    return _total(F.transform(
        edges(ring), lambda e: F.sqrt((e["x2"] - e["x1"]) * (e["x2"] - e["x1"])
                                      + (e["y2"] - e["y1"]) * (e["y2"] - e["y1"]))))


def _no_rings(rings: Column) -> Column:
    return rings.isNull() | (F.size(rings) == 0) | (F.size(F.get(rings, 0)) == 0)


def polygon_area(rings: Column) -> Column:
    """Outer area minus holes; 0 for a null or empty polygon."""
    net = let(F.transform(rings, ring_area), lambda areas: 2.0 * F.get(areas, 0) - _total(areas))
    return F.when(_no_rings(rings), F.lit(0.0)).otherwise(net)


def polygon_length(rings: Column) -> Column:
    """Length of all rings; 0 for a null or empty polygon."""
    return F.when(_no_rings(rings), F.lit(0.0)).otherwise(_total(F.transform(rings, ring_length)))


def polygon_stats(rings: Column) -> Column:
    """Area, perimeter, closed vertex count of the outer ring and compactness 4*pi*A/P^2."""
    def fields(m: Column) -> Column:
        area, length = m["area"], m["length"]
        return F.struct(
            area.alias("area"),
            length.alias("perimeter"),
            F.when(_no_rings(rings), F.lit(0)).otherwise(F.size(F.get(rings, 0))).alias("num_vertices"),
            F.when(length > 0, F.lit(4.0 * math.pi) * area / (length * length)).otherwise(F.lit(0.0))
            .alias("compactness"),
        )

    return let(F.struct(polygon_area(rings).alias("area"), polygon_length(rings).alias("length")), fields)


def bounds(rings: Column) -> Column:
    """Bounding box ``struct<x1,y1,x2,y2>`` of the outer ring."""
    outer = F.get(rings, 0)
    xs, ys = F.transform(outer, lambda p: p["x"]), F.transform(outer, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x1"), F.array_min(ys).alias("y1"),
                    F.array_max(xs).alias("x2"), F.array_max(ys).alias("y2"))


def swap_xy(ring: Column) -> Column:
    """Ring as an array of ``[y, x]`` pairs."""
    return F.transform(ring, lambda p: F.array(p["y"], p["x"]))


# --- text form ---------------------------------------------------------------

def _number(v: Column) -> Column:
    whole = (v == F.floor(v)) & (F.abs(v) < 1e15)
    return F.when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))


def _ring_text(ring: Column) -> Column:
    pairs = F.transform(ring, lambda p: F.concat(_number(p["x"]), F.lit(" "), _number(p["y"])))
    return F.concat(F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def to_wkt(rings: Column) -> Column:
    """WKT of a polygon; null stays null, no rings is ``POLYGON EMPTY``."""
    body = F.concat(F.lit("POLYGON ("), F.array_join(F.transform(rings, _ring_text), ", "), F.lit(")"))
    return F.when(rings.isNull(), F.lit(None)).when(_no_rings(rings), F.lit("POLYGON EMPTY")).otherwise(body)


def _tidy(text: Column) -> Column:
    """Text with single blanks, none around brackets and commas, and without a Z or M mark of its dimensions."""
    tidy = F.regexp_replace(F.regexp_replace(F.trim(text), r"\s+", " "), r" ?([(),]) ?", "$1")
    return F.regexp_replace(tidy, r"(?i)^((?:MULTI)?POLYGON) ?(?:ZM|Z|M)(?=\()", "$1")


def _swap(text: Column, *pairs: tuple[str, str]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _parse(text: Column, kind: str, depth: int) -> Column:
    """Coordinates of a tidy WKT text as nested arrays; null if the text is something else.

    Brackets and separators are rewritten to JSON, outermost separators first,
    and the engine's JSON parser does the rest.
    """
    schema = "array<" * depth + "double" + ">" * depth
    body = F.when(F.upper(F.substring(text, 1, len(kind) + 1)) == f"{kind}(", F.substr(text, F.lit(len(kind) + 1)))
    marked = _swap(body, (")),((", "@"), ("),(", "#"), (",", "],["), (" ", ","), ("@", "]]],[[["), ("#", "]],[["),
                   ("(" * (depth - 1), "[" * depth), (")" * (depth - 1), "]" * depth))
    return F.from_json(marked, schema)


def _points(coordinates: Column) -> Column:
    return F.transform(coordinates, lambda ring: F.transform(
        ring, lambda p: F.struct(F.get(p, 0).alias("x"), F.get(p, 1).alias("y"))))


def _well_formed(coordinates: Column) -> Column:
    return F.forall(coordinates, lambda ring: F.forall(
        ring, lambda p: F.size(p).between(2, 4) & F.get(p, 0).isNotNull() & F.get(p, 1).isNotNull()))


def from_wkt(text: Column) -> Column:
    """Rings of a POLYGON text, heights and measures left out; null where the text is not a well-formed polygon."""
    return let(_parse(_tidy(text), "POLYGON", 3), lambda c: F.when(_well_formed(c), _points(c)))


def parts_from_wkt(text: Column) -> Column:
    """Polygon parts of a POLYGON or MULTIPOLYGON text (array of rings); null if malformed."""
    def coordinates(tidy: Column) -> Column:
        single = _parse(tidy, "POLYGON", 3)
        return F.coalesce(_parse(tidy, "MULTIPOLYGON", 4), F.when(single.isNotNull(), F.array(single)))

    return let(let(_tidy(text), coordinates), lambda c: F.when(F.forall(c, _well_formed), F.transform(c, _points)))


# --- flat form for Arrow batches ---------------------------------------------

def flat_rings(rings: Column) -> list[Column]:
    """Rings as three plain arrays: all x, all y, and the ring sizes."""
    pts = F.flatten(rings)
    return [F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"]),
            F.transform(rings, lambda ring: F.size(ring))]


def rings_from_flat(flat: Column) -> Column:
    """Inverse of :func:`flat_rings` for a struct with fields ``xs``, ``ys``, ``sizes``."""
    pts = F.zip_with(flat["xs"], flat["ys"], lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    sizes = flat["sizes"]

    def ring(size: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(sizes, F.lit(1), i), F.lit(0), lambda acc, v: acc + v)
        return F.slice(pts, before + 1, size)

    return F.when(flat.isNotNull() & sizes.isNotNull(), F.transform(sizes, ring))


# --- predicates --------------------------------------------------------------

def segment_meets_box(e: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Closed segment against closed box: overlapping extents and corners not all on one side."""
    dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
    sides = [dx * (cy - e["y1"]) - dy * (cx - e["x1"]) for cx in (x1, x2) for cy in (y1, y2)]
    return ((F.least(e["x1"], e["x2"]) <= x2) & (F.greatest(e["x1"], e["x2"]) >= x1)
            & (F.least(e["y1"], e["y2"]) <= y2) & (F.greatest(e["y1"], e["y2"]) >= y1)
            & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0))


def contains_point(rings: Column, px: Column, py: Column) -> Column:
    """Even-odd rule over all rings."""
    def crosses(e: Column) -> Column:
        at = e["x1"] + (py - e["y1"]) * (e["x2"] - e["x1"]) / (e["y2"] - e["y1"])
        return ((e["y1"] > py) != (e["y2"] > py)) & (px < at)
    return F.size(F.filter(all_edges(rings), crosses)) % 2 == 1


def meets_box(rings: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Exact polygon/box intersection test; touching counts."""
    touches = F.exists(all_edges(rings), lambda e: segment_meets_box(e, x1, y1, x2, y2))
    return touches | contains_point(rings, x1, y1)


def box_iou(a: dict[str, Column] | Column, b: dict[str, Column] | Column) -> Column:
    """IoU of two boxes with fields x1,y1,x2,y2; 0 where the union is empty."""
    w = F.greatest(F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]), F.lit(0.0))
    h = F.greatest(F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]), F.lit(0.0))
    inter = w * h
    union = ((a["x2"] - a["x1"]) * (a["y2"] - a["y1"])
             + (b["x2"] - b["x1"]) * (b["y2"] - b["y1"]) - inter)
    return F.when(union > 0, inter / union).otherwise(F.lit(0.0))


# --- reprojection ------------------------------------------------------------

# WGS84 ellipsoid and UTM constants.
_SEMI_MAJOR = 6378137.0
_FLATTENING = 1 / 298.257223563
_SCALE = 0.9996
_FALSE_EASTING = 500000.0
_FALSE_NORTHING = 10000000.0

_N = _FLATTENING / (2 - _FLATTENING)
_RECTIFYING = _SEMI_MAJOR / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64) * _SCALE

# Coefficients of the Krueger series to fourth order in n.
TO_GEO = [
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96 - _N**4 / 360,
    _N**2 / 48 + _N**3 / 15 - 437 * _N**4 / 1440,
    17 * _N**3 / 480 - 37 * _N**4 / 840,
    4397 * _N**4 / 161280,
]
TO_LATITUDE = [
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3 + 116 * _N**4 / 45,
    7 * _N**2 / 3 - 8 * _N**3 / 5 - 227 * _N**4 / 45,
    56 * _N**3 / 15 - 136 * _N**4 / 35,
    4279 * _N**4 / 630,
]
TO_GRID = [
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16 + 41 * _N**4 / 180,
    13 * _N**2 / 48 - 3 * _N**3 / 5 + 557 * _N**4 / 1440,
    61 * _N**3 / 240 - 103 * _N**4 / 140,
    49561 * _N**4 / 161280,
]


def utm_zone(crs: Column) -> Column:
    """Zone number of ``EPSG:326zz`` / ``EPSG:327zz``; null for any other CRS."""
    zone = F.regexp_extract(crs, r"^EPSG:32[67](\d\d)$", 1)
    return F.when(zone != "", zone.cast("int"))


def _central_meridian(crs: Column) -> Column:
    return utm_zone(crs) * 6.0 - 183.0


def _northing_shift(crs: Column) -> Column:
    return F.when(crs.startswith("EPSG:327"), F.lit(_FALSE_NORTHING)).otherwise(F.lit(0.0))


def _series(coefficients: list[float], term) -> Column:
    total = F.lit(0.0)
    for j, k in enumerate(coefficients, start=1):
        total = total + F.lit(k) * term(2.0 * j)
    return total


def utm_to_wgs84(ring: Column, crs: Column) -> Column:
    """Ring in a UTM zone to (lon, lat) degrees; already geographic rings pass through."""
    normalised = F.transform(ring, lambda p: F.struct(
        ((p["y"] - _northing_shift(crs)) / _RECTIFYING).alias("xi"),
        ((p["x"] - _FALSE_EASTING) / _RECTIFYING).alias("eta")))
    conformal = F.transform(normalised, lambda p: F.struct(
        (p["xi"] - _series(TO_GEO, lambda j: F.sin(j * p["xi"]) * F.cosh(j * p["eta"]))).alias("xi"),
        (p["eta"] - _series(TO_GEO, lambda j: F.cos(j * p["xi"]) * F.sinh(j * p["eta"]))).alias("eta")))
    sphere = F.transform(conformal, lambda p: F.struct(
        F.asin(F.sin(p["xi"]) / F.cosh(p["eta"])).alias("chi"),
        F.atan2(F.sinh(p["eta"]), F.cos(p["xi"])).alias("lam")))
    geographic = F.transform(sphere, lambda p: F.struct(
        (_central_meridian(crs) + F.degrees(p["lam"])).alias("x"),
        F.degrees(p["chi"] + _series(TO_LATITUDE, lambda j: F.sin(j * p["chi"]))).alias("y")))
    return F.when(utm_zone(crs).isNull(), ring).otherwise(geographic)


def wgs84_to_utm(ring: Column, crs: Column) -> Column:
    """Ring in (lon, lat) degrees to the UTM zone named by ``crs``."""
    e2 = math.sqrt(2 * _FLATTENING - _FLATTENING**2)
    sphere = F.transform(ring, lambda p: F.struct(
        F.sinh(F.atanh(F.sin(F.radians(p["y"]))) - F.lit(e2) * F.atanh(F.lit(e2) * F.sin(F.radians(p["y"]))))
        .alias("t"),
        F.radians(p["x"] - _central_meridian(crs)).alias("lam")))
    conformal = F.transform(sphere, lambda p: F.struct(
        F.atan2(p["t"], F.cos(p["lam"])).alias("xi"),
        F.atanh(F.sin(p["lam"]) / F.sqrt(1.0 + p["t"] * p["t"])).alias("eta")))
    return F.transform(conformal, lambda p: F.struct(
        (_FALSE_EASTING + _RECTIFYING * (p["eta"] + _series(
            TO_GRID, lambda j: F.cos(j * p["xi"]) * F.sinh(j * p["eta"])))).alias("x"),
        (_northing_shift(crs) + _RECTIFYING * (p["xi"] + _series(
            TO_GRID, lambda j: F.sin(j * p["xi"]) * F.cosh(j * p["eta"])))).alias("y")))


def reproject(rings: Column, crs: Column, default_crs: str) -> Column:
    """Polygon to (lon, lat); a missing CRS is taken to be ``default_crs``."""
    source = F.coalesce(crs, F.lit(default_crs))
    return F.transform(rings, lambda ring: utm_to_wgs84(ring, source))


def bounds_to_wgs84(b: Column, crs: Column, default_crs: str) -> Column:
    """Bounds ``struct<min_y,min_x,max_y,max_x>`` to degrees where they look projected.

    Values count as projected when the first y exceeds 1000; other bounds are
    returned as they are.
    """
    source = F.coalesce(crs, F.lit(default_crs))
    corners = utm_to_wgs84(F.array(point(b["min_x"], b["min_y"]), point(b["max_x"], b["max_y"])), source)
    low, high = F.get(corners, 0), F.get(corners, 1)
    projected = F.struct(low["y"].alias("min_y"), low["x"].alias("min_x"),
                         high["y"].alias("max_y"), high["x"].alias("max_x"))
    return F.when(b["min_y"] > 1000, projected).otherwise(b)
