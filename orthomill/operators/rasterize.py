"""Vector shapes to raster cells, by scan lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill import fixed
from orthomill.functions import geometry as geo
from orthomill.session import spread

#: Raster rows that go to one task together.
BAND = 64


def to_pixel_space(rings: Column, transform: Column) -> Column:
    """Rings in coordinates to (col, row) space: the inverse of the affine transform."""
    a, b, c, d, e, f = (F.get(transform, i) for i in range(6))
    det = a * e - b * d
    return F.transform(rings, lambda ring: F.transform(ring, lambda p: F.struct(
        ((e * (p["x"] - c) - b * (p["y"] - f)) / det).alias("x"),
        ((a * (p["y"] - f) - d * (p["x"] - c)) / det).alias("y"))))


def _first_centre(position: Column) -> Column:
    """First cell whose centre is at or past ``position``."""
    return F.ceil(position - 0.5)


def _cells_between(low: Column, high: Column, extent: Column | None) -> Column:
    """Cells with a centre in ``[low, high)``, clamped to ``[0, extent)``; possibly empty."""
    first = F.greatest(_first_centre(low), F.lit(0))
    last = _first_centre(high) - 1
    if extent is not None:
        last = F.least(last, extent - 1)
    return F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))) \
        .otherwise(F.array().cast("array<long>"))


def _rows_by_band(pieces: DataFrame, low: Column, high: Column, extent: Column | None, keys: Sequence[str]) -> DataFrame:
    """Adds ``_band`` and ``row``: every row with a centre in ``[low, high)``.

    Few bytes, many rows: the pieces of a shape go by its ``keys`` and band of rows over all tasks before rows and cells are
    made of them, and what follows per key, band and row needs no other shuffle.
    """
    first, last = F.greatest(F.floor(low / BAND), F.lit(0)), F.floor(high / BAND)
    if extent is not None:
        last = F.least(last, F.floor((extent - 1) / BAND))
    bands = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<long>"))
    dealt = spread(pieces.withColumn("_band", F.explode(bands)), *keys, "_band")
    top = F.col("_band") * BAND
    return dealt.withColumn("row", F.explode(_cells_between(F.greatest(low, top), F.least(high, top + BAND), extent)))


def scan_spans(shapes: DataFrame, keys: Sequence[str], height: Column | None = None,
               width: Column | None = None, rings: str = "rings") -> DataFrame:
    """Inside cells of each polygon as runs ``(*keys, row, c0, c1)``, ends included.

    A cell belongs to a polygon if its centre does (even-odd rule over all
    rings). Edges are cut into scan-line crossings first and paired per row, so
    the work follows the crossings and the covered cells, and one huge polygon is
    spread over its rows. ``height``/``width`` may use columns listed in ``keys``.
    """
    keys = list(keys)
    edge = F.col("_edge")
    edges = spread(shapes.select(*keys, rings)).select(*keys, F.explode(geo.all_edges(F.col(rings))).alias("_edge"))
    crossings = (
        _rows_by_band(edges, F.least(edge["y1"], edge["y2"]), F.greatest(edge["y1"], edge["y2"]), height, keys)
        .withColumn("_x", edge["x1"] + (F.col("row") + 0.5 - edge["y1"]) * (edge["x2"] - edge["x1"])
                    / (edge["y2"] - edge["y1"]))
    )
    per_row = crossings.groupBy(*keys, "_band", "row").agg(F.sort_array(F.collect_list("_x")).alias("_xs"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.expr("size(_xs) div 2") - 1),
        lambda i: F.struct(F.get("_xs", i * 2).alias("x0"), F.get("_xs", i * 2 + 1).alias("x1")))
    span = F.col("_span")
    low = F.greatest(_first_centre(span["x0"]), F.lit(0)).cast("long")
    high = _first_centre(span["x1"]) - 1
    if width is not None:
        high = F.least(high, width - 1)
    return (
        per_row.filter(F.size("_xs") >= 2).withColumn("_span", F.explode(pairs))
        .select(*keys, "row", low.alias("c0"), high.cast("long").alias("c1"))
        .filter(F.col("c0") <= F.col("c1"))
    )


def expand_spans(spans: DataFrame) -> DataFrame:
    """One row per cell of each run."""
    return spans.withColumn("col", F.explode(F.sequence("c0", "c1"))).drop("c0", "c1")


def near_segments(lines: DataFrame, keys: Sequence[str], distance: Column, height: Column | None = None,
                  width: Column | None = None, rings: str = "rings") -> DataFrame:
    """Cells whose centre lies within ``distance`` (in cells) of a line's segments.

    A ring of one point is a point. Rows are listed per segment, then only the
    columns its stretch near that row can reach; the exact distance decides.
    """
    keys = list(keys)
    ring = F.col("_ring")
    pieces = F.when(F.size(ring) == 1, F.array(F.struct(
        F.get(ring, 0)["x"].alias("x1"), F.get(ring, 0)["y"].alias("y1"),
        F.get(ring, 0)["x"].alias("x2"), F.get(ring, 0)["y"].alias("y2")))).otherwise(geo.edges(ring))
    s, d = F.col("_seg"), F.col("_d")
    nudge = 1e-9

    def clamp(t: Column) -> Column:
        return F.least(F.greatest(t, F.lit(0.0)), F.lit(1.0))

    segments = (
        lines.select(*keys, distance.alias("_d"), F.explode(rings).alias("_ring")).withColumn("_seg", F.explode(pieces))
        .select(*keys, "_d", *[s[c].alias(f"_{c}") for c in ("x1", "y1", "x2", "y2")], (s["x2"] - s["x1"]).alias("_dx"), (s["y2"] - s["y1"]).alias("_dy")))
    x1, y1, dx, dy = (F.col(c) for c in ("_x1", "_y1", "_dx", "_dy"))
    cy, cx = F.col("row") + 0.5, F.col("col") + 0.5
    t_low = F.when(dy == 0, F.lit(0.0)).otherwise(clamp((cy - d - y1) / dy))
    t_high = F.when(dy == 0, F.lit(1.0)).otherwise(clamp((cy + d - y1) / dy))
    xa, xb = F.col("_xa"), F.col("_xb")
    length2 = dx * dx + dy * dy
    t = F.col("_t")
    ex, ey = cx - (x1 + t * dx), cy - (y1 + t * dy)
    # Kept as columns of their own between the steps, so that each is worked out once.
    return (
        _rows_by_band(segments, F.least("_y1", "_y2") - d, F.greatest("_y1", "_y2") + d + nudge, height, keys)
        .withColumns({"_xa": x1 + dx * t_low, "_xb": x1 + dx * t_high})
        .withColumns({"_xa": F.least(xa, xb) - d, "_xb": F.greatest(xa, xb) + d + nudge})
        .withColumn("col", F.explode(_cells_between(xa, xb, width)))
        .withColumn("_t", F.when(length2 == 0, F.lit(0.0)).otherwise(clamp(((cx - x1) * dx + (cy - y1) * dy) / length2)))
        .filter(ex * ex + ey * ey <= d * d)
        .select(*keys, "_band", "row", "col").distinct().drop("_band")
    )


def _winners(cells: DataFrame, places: Sequence[str], ranked: Column, overlap: str) -> DataFrame:
    """``(*places, _r)``: the rank that wins each place."""
    if overlap not in ("first", "last"):
        raise ValueError("overlap must be 'first' or 'last'")
    return cells.groupBy(*places).agg((F.min if overlap == "first" else F.max)(ranked).alias("_r"))


def _rank(order: str, value: str) -> Column:
    return F.col(order).cast("long") * 256 + F.col(value)


def burn(cells: DataFrame, keys: Sequence[str], order: str, overlap: str = "first",
         value: str = "class_id") -> DataFrame:
    """One class per cell where shapes overlap.

    ``first``: the lowest ``order`` wins (layers in name order). ``last``: the highest
    wins (later shapes paint over). ``order`` is an integer and classes are bytes, so
    both fit one number and the aggregate stays a hash aggregate. Cells not
    returned are background 0.
    """
    won = _winners(cells, [*keys, "row", "col"], _rank(order, value), overlap)
    return won.select(*keys, "row", "col", (F.col("_r") % 256).cast("int").alias(value))


def _blocks(spans: DataFrame) -> DataFrame:
    """Runs ``c0, c1`` cut into blocks ``_i`` of level ``_k``: cells ``_i * 2**_k`` up to the next one's first, as few as possible."""
    low, high = F.expr("shiftright(c0 + shiftleft(1L, _k) - 1, _k)"), F.expr("shiftright(c1 + 1, _k) - 1")
    levels = spans.withColumn("_k", F.expr("explode(sequence(0, cast(floor(log2(c1 - c0 + 1)) AS int)))")).withColumns({"_low": low, "_high": high})
    # Rows in place of nested arrays, so that every step is compiled.
    ends = F.array(F.when(F.col("_low") % 2 == 1, F.col("_low")), F.when(F.col("_high") % 2 == 0, F.col("_high")))
    return levels.filter("_low <= _high").withColumn("_i", F.explode(ends)).filter("_i IS NOT NULL").drop("_low", "_high", "c0", "c1")


def rasterize(shapes: DataFrame, keys: Sequence[str], shape_id: str, order: str, overlap: str = "first",
              height: Column | None = None, width: Column | None = None) -> DataFrame:
    """Burn polygons given in pixel space; see :func:`scan_spans` and :func:`burn`.

    ``shape_id`` tells the polygons apart; ``order`` may be the same column. A run counts as a few blocks of doubling lengths, of which
    there are at most twice as many as cells, and one shape wins each block before blocks become cells: many large
    shapes over each other cost their runs, not their cells.
    """
    spans = scan_spans(shapes, list(dict.fromkeys([*keys, shape_id, order, "class_id"])), height, width)
    won = _winners(_blocks(spans), [*keys, "row", "_k", "_i"], _rank(order, "class_id"), overlap)
    cells = won.withColumn("col", F.explode(F.expr("sequence(shiftleft(_i, _k), shiftleft(_i + 1, _k) - 1)")))
    return _winners(cells, [*keys, "row", "col"], F.col("_r"), overlap).select(
        *keys, "row", "col", (F.col("_r") % 256).cast("int").alias("class_id"))


def buffer_distance(layer: Column, geom_type: Column, geographic: Column | bool = False) -> Column:
    """Buffer of a layer in CRS units: lines 3 m, points 5 m, polygons none.

    Geographic coordinates use the rough metres-per-degree divisor.
    """
    name = F.lower(layer)
    is_line = geom_type.contains("Line") | name.contains("line")
    is_point = geom_type.contains("Point") | name.contains("point")
    metres = F.when(is_line, F.lit(fixed.LINE_BUFFER_M)).when(is_point, F.lit(fixed.POINT_BUFFER_M)) \
        .otherwise(F.lit(0.0))
    degrees = F.lit(geographic) if isinstance(geographic, bool) else geographic
    return F.when(degrees, metres / fixed.METRES_PER_DEGREE).otherwise(metres)


def export_raster_frame(polygons: DataFrame, per_unit: int = 100, min_side: int = 256,
                        max_side: int = 4096) -> DataFrame:
    """One row: bounds of all polygons, size of the exported class raster and its transform (pixel to coordinate).

    A side without extent has its smallest size, and one pixel covers one unit there.
    """
    b = geo.bounds(F.col("rings"))
    frame = polygons.select(b.alias("b")).agg(
        F.min("b.x1").alias("min_x"), F.min("b.y1").alias("min_y"),
        F.max("b.x2").alias("max_x"), F.max("b.y2").alias("max_y"))

    def side(extent: Column) -> Column:
        return F.least(F.greatest((extent * per_unit).cast("int"), F.lit(min_side)), F.lit(max_side))

    sized = frame.withColumn("width", side(F.col("max_x") - F.col("min_x"))) \
        .withColumn("height", side(F.col("max_y") - F.col("min_y")))

    def per_pixel(low: str, high: str, pixels: str) -> Column:
        return F.when(F.col(high) > F.col(low), (F.col(high) - F.col(low)) / F.col(pixels)).otherwise(F.lit(1.0))

    return sized.withColumn("transform", F.array(
        per_pixel("min_x", "max_x", "width"), F.lit(0.0), F.col("min_x"), F.lit(0.0), -per_pixel("min_y", "max_y", "height"), F.col("max_y")))


def export_raster(polygons: DataFrame, order: str = "ord") -> DataFrame:
    """Class cells of the exported raster; later polygons paint over earlier ones.

    Only the one-row frame comes back to the driver; its values enter the plan as literals.
    """
    frame = export_raster_frame(polygons).first()
    if frame is None or frame["min_x"] is None:
        return polygons.sparkSession.createDataFrame([], "row long, col long, class_id int")
    sx, sy = 1 / frame["transform"][0], -1 / frame["transform"][4]
    placed = polygons.withColumn("rings", F.transform("rings", lambda ring: F.transform(
        ring, lambda p: F.struct(((p["x"] - frame["min_x"]) * sx).alias("x"),
                                 ((frame["max_y"] - p["y"]) * sy).alias("y")))))
    return rasterize(placed, [], order, order, "last", F.lit(frame["height"]), F.lit(frame["width"]))
