"""Exact nearest tiles by binary codes: multi-index hashing with growing segment radii.

A code is cut into segments and indexed under every segment's value. In round r a query probes
all values at distance r from its own in each segment. Whatever round r has not met differs by more than r in every
segment, so all codes within ``segments * (r + 1) - 1`` bits are known, and a query whose k-th
verified distance lies within that is settled and leaves the search.
"""

from __future__ import annotations

from math import log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.llm.tables import stored

BITS = 64


def tile_code(features: Column) -> Column:
    """64 sign bits of a feature vector: bit b of the sum of the features b, b + 64, b + 128 and so on.

    Null for a null or empty vector; null and NaN features count as 0, and a sum of 0 gives bit 0.
    """
    clean = F.transform(features, lambda v: F.coalesce(F.nanvl(v.cast("double"), F.lit(0.0)), F.lit(0.0)))
    bits = F.transform(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.when(
        F.aggregate(F.filter(clean, lambda v, i: i % BITS == b), F.lit(0.0), lambda a, v: a + v) > 0, F.call_function(
            "shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return F.when(F.size(features) > 0, F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))


def _bounds(segments: int) -> list[tuple[int, int]]:
    """Shift and width of each segment; widths differ by one at most."""
    cuts = [round(i * BITS / segments) for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _segments(code: Column, bounds: list[tuple[int, int]]) -> Column:
    return F.array(*[F.struct(F.lit(i).alias("segment"), F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1)).alias("value"))
                     for i, (shift, width) in enumerate(bounds)])


def nearest_tiles(records: DataFrame, queries: DataFrame, k: int = 10, segments: int | None = None) -> DataFrame:
    """The ``k`` rows of ``records`` nearest to each row of ``queries`` by Hamming distance of ``tile_code``, exactly.

    Both hold ``tile_id`` (integer) and ``swin_features`` (array of numbers). Returns ``tile_id`` (the query's), ``rank`` from 1, ``neighbour_id``,
    ``distance``; ties go to the smaller neighbour, then are arbitrary among equal rows. A query's own row, where it is in ``records``,
    is a row like any other. Rows without a vector are neither found nor searched for; fewer than ``k`` rows
    give fewer ranks; repeated queries are answered each, repeated records count each. No rows on either side give none; other columns are not read.
    ``segments`` is by default as many as make a segment two bits narrower than log2 of the number of codes: a bucket then holds about
    four codes, and probes, whose number grows steeply with the width, stay fewer than what they find. It does not change the result. Equal codes are searched for once and indexed once, with their
    ``k`` smallest ids, so a vector that a third of all rows share costs no more than any other. The number of
    rounds is at most a segment's width.
    """
    coded = stored(records.select("tile_id", tile_code(F.col("swin_features")).alias("code")).filter(F.col("code").isNotNull()), "mih-codes")
    asked = stored(queries.select("tile_id", tile_code(F.col("swin_features")).alias("code")).filter(F.col("code").isNotNull()), "mih-queries")
    codes = stored(coded.groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("tile_id").alias("least")), "mih-index")
    total = codes.count()
    if segments is None:
        segments = min(8, max(1, round(BITS / max(8.0, log2(total + 1) - 2))))
    bounds = _bounds(segments)
    index = stored(codes.withColumn("s", F.explode(_segments(F.col("code"), bounds))).select(
        F.col("s.segment").alias("segment"), F.col("s.value").alias("value"), "code", "n", "least"), "mih-segments")
    open_queries = asked.select(F.col("code").alias("query")).distinct()
    # Masks of the current radius by segment: each grows by bits above its highest.
    flips = records.sparkSession.createDataFrame([(i, 0, -1, w) for i, (_, w) in enumerate(bounds)], "segment int, mask long, top int, width int")
    found, done = None, []
    for radius in range(max(w for _, w in bounds) + 1):
        if radius:
            flips = flips.filter("top + 1 < width").withColumn("top", F.explode(F.expr("sequence(top + 1, width - 1)"))).withColumn(
                "mask", F.col("mask").bitwiseOR(F.expr("shiftleft(1L, top)")))
        own = open_queries.withColumn("s", F.explode(_segments(F.col("query"), bounds))).select(
            "query", F.col("s.segment").alias("segment"), F.col("s.value").alias("own"))
        probes = own.join(flips, "segment").select("query", "segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"))
        # A code met in several segments is kept where it is nearest, the first such segment: nothing is met twice.
        apart = [F.bit_count(F.shiftrightunsigned(F.col("query").bitwiseXOR(F.col("code")), s).bitwiseAND(F.lit((1 << w) - 1))) for s, w in bounds]
        first = F.array_position(F.array(*apart), F.array_min(F.array(*apart))) - 1
        met = probes.join(index, ["segment", "value"]).filter((first == F.col("segment")) & (F.array_min(F.array(*apart)) == radius)).select(
            "query", "code", "n", "least", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"))
        known = met if found is None else found.unionByName(met)
        # The k results lie among the k codes that come first by distance and smallest id.
        order = Window.partitionBy("query").orderBy("distance", "least", "code")
        found = stored(known.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k).drop("r"), "mih-found")
        covered = segments * (radius + 1) - 1
        settled = stored(found.filter(F.col("distance") <= covered).groupBy("query").agg(F.sum("n").alias("n")).filter(F.col("n") >= k).select("query"), "mih-settled")
        done.append(found.join(settled, "query", "left_semi"))
        found = found.join(settled, "query", "left_anti")
        open_queries = stored(open_queries.join(settled, "query", "left_anti"), "mih-open")
        if open_queries.isEmpty():
            break
    best = found
    for part in done:
        best = best.unionByName(part)
    firsts = Window.partitionBy("code").orderBy("tile_id")
    ids = coded.withColumn("i", F.row_number().over(firsts)).filter(F.col("i") <= k).select("code", F.col("tile_id").alias("neighbour_id"))
    ranking = Window.partitionBy("query").orderBy("distance", F.col("neighbour_id").asc_nulls_last())
    ranked = stored(best.select("query", "code", "distance").join(ids, "code").withColumn("rank", F.row_number().over(ranking)).filter(
        F.col("rank") <= k).select(F.col("query").alias("code"), "rank", "neighbour_id", "distance"), "mih-ranked")
    return asked.join(ranked, "code").select("tile_id", "rank", "neighbour_id", F.col("distance").cast("int").alias("distance"))
