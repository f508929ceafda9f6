"""Near copies by word shingles: SimHash classes and min-wise bands give candidates, the exact Jaccard similarity of whole texts decides.

The operator of ``simhash`` goes first: it ties texts whose fingerprints are linked at two bits or fewer, the closest copies. Prints of texts
at a similarity of 0.8 lie up to 11 bits apart, which its covering cannot reach, so bands find the others:
two texts are candidates where any of ``BANDS`` groups of ``ROWS`` minima agrees; at a similarity s a pair is
missed with probability (1 - s**6)**40, five in a million at 0.8 and less above.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.llm import simhash
from orthomill.llm.components import connected
from orthomill.llm.tables import by_merge, dropped, fresh, small_batches, stored

BANDS, ROWS = 40, 6
#: How many of a text's partners are compared in one task at most.
SHARE = 200
#: How many texts of a bucket are compared with all others before what is left goes by its rarest shingles.
TURNS = 3

_RNG = np.random.default_rng(64)
_FLIP, _ODD = (_RNG.integers(0, 1 << 32, (BANDS * ROWS, 1), dtype=np.uint32) for _ in range(2))
_ODD |= np.uint32(1)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def shingles(text: bytes | None, size: int = 5) -> np.ndarray:
    """Distinct XXH64 of a UTF-8 text's word shingles; A-Z count as a-z, fewer words give one shingle, none give none."""
    words = _words(text)
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = min(size, len(words)) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - first].tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[s:e]) for s, e in zip(starts, ends[first:].tolist())], np.uint64))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed key for each band of minima; none for a text without words."""
    if not len(hashes):
        return []
    short = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(BANDS * ROWS, np.uint32((1 << 32) - 1))
    for at in range(0, len(short), 512):
        least = np.minimum(least, ((short[at:at + 512] ^ _FLIP) * _ODD).min(axis=1))
    return [xxhash.xxh64_intdigest(g.tobytes(), j) - (1 << 63) for j, g in enumerate(least.reshape(BANDS, ROWS))]


def _sketches(numbered: DataFrame, row: str, size: int) -> DataFrame:
    """Row number, ``tile_id``, hash of the text's words (``node``), shingles and band keys of every row."""
    kind = numbered.schema["tile_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, counts, keys = [], [], []
            for t in batch.column(2).cast(pa.binary()):
                text = t.as_py()
                found = shingles(text, size)
                nodes.append(xxhash.xxh64_intdigest(b" ".join(_words(text))) - (1 << 63))
                counts.append(len(found))
                keys.append(bands(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nodes, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, pa.list_(pa.int64()))],
                ["row_no", "tile_id", "node", "n", "keys"])

    return numbered.select(F.col(row), "tile_id", F.col("notes").cast("string")).mapInArrow(
        run, f"row_no long, tile_id {kind}, node long, n int, keys array<bigint>")


def _alike(pairs: DataFrame, texts: DataFrame, size: int, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole texts have the Jaccard similarity; a text with many partners is spread over tasks."""
    shares = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).cast("int").alias("share"))
    heads = (by_merge(texts).join(shares, texts["node"] == shares["a"])
             .select("a", F.col("notes").alias("notes_a"), F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")))
    both = (dealt.join(by_merge(texts.select(F.col("node").alias("b"), F.col("notes").alias("notes_b"))), "b")
            .join(heads, ["a", "share"]).select("a", "b", "notes_a", "notes_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lru_cache(maxsize=8)(lambda text: shingles(text, size))
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).cast(pa.binary()), batch.column(3).cast(pa.binary())):
                p, q = known(x.as_py()), known(y.as_py())
                common = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(common >= similarity * (len(p) + len(q) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def _pairs(joined: DataFrame, tried: DataFrame | None, similarity: float) -> DataFrame:
    """Distinct untried (a, b) of nodes that are of different classes and of near enough sizes."""
    sizes: Column = F.least("n", "other_n") >= similarity * F.greatest("n", "other_n")
    found = (joined.filter((F.col("root") != F.col("other_root")) & sizes)
             .select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct())
    return stored(found if tried is None else found.join(tried, ["a", "b"], "left_anti"), "near-pairs")


def _shingle_rows(texts: DataFrame, size: int) -> DataFrame:
    """``(node, n, shingle)``: the distinct shingles of every text and their number."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                found = shingles(text.as_py(), size).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(found), node)), pa.array(np.full(len(found), len(found), np.int32)), pa.array(found)], ["node", "n", "shingle"])

    return texts.select("node", "notes").mapInArrow(run, "node long, n int, shingle long")


def _rare_pairs(rest: DataFrame, texts: DataFrame, tried: DataFrame | None, size: int, similarity: float) -> DataFrame:
    """Untried pairs (a, b) of ``rest`` (node, root) of different classes that can still be similar enough, by their rarest shingles.

    With shingles in order from rare to common, two texts that are similar enough have their first common shingle so early in both that
    enough shingles follow. A text with that many shingles of its own, as one with too many edits has, meets nobody. Of the
    texts with one shingle, only those outside its largest class look for partners, so classes that are found cost nothing.
    """
    with small_batches(rest.sparkSession):
        rows = stored(_shingle_rows(texts.join(rest, "node", "left_semi"), size), "near-shingles")
    counts = stored(rows.groupBy("shingle").agg(F.count(F.lit(1)).alias("texts")).filter("texts > 1"), "near-counts")
    own = Window.partitionBy("node")
    shared = rows.join(counts, "shingle").withColumn("alone", F.col("n") - F.count(F.lit(1)).over(own))
    early = (shared.withColumn("place", F.col("alone") + F.row_number().over(own.orderBy("texts", "shingle")) - 1)
             .filter(F.col("n") - F.col("place") >= similarity * F.col("n") - 1e-6).select("node", "n", "shingle", "place"))
    classes = rest.groupBy("root").agg(F.count(F.lit(1)).alias("class_size"))
    early = stored(early.join(rest.join(classes, "root"), "node"), "near-early")
    mixed = (early.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.struct("class_size", "root"))["root"].alias("largest"))
             .filter("low != high").select("shingle", "largest"))
    mixed = stored(mixed, "near-mixed")
    seekers = stored(early.join(mixed, "shingle").filter("root != largest").select("shingle", "node", "n", "root", "place"), "near-seekers")
    others = early.join(mixed, "shingle", "left_semi").select(
        "shingle", F.col("node").alias("other"), F.col("n").alias("other_n"), F.col("root").alias("other_root"), F.col("place").alias("other_place"))
    enough = (1 + similarity) * F.least(F.col("n") - F.col("place"), F.col("other_n") - F.col("other_place")) >= similarity * (F.col("n") + F.col("other_n")) - 1e-6
    met = seekers.join(others, (seekers["shingle"] == others["shingle"]) & (F.col("root") != F.col("other_root")) & enough)
    pairs = _pairs(met.drop("shingle"), tried, similarity)
    dropped(rows, counts, early, mixed, seekers)
    return pairs


def printed_classes(numbered: DataFrame, nodes: DataFrame, row: str, size: int) -> DataFrame:
    """``(node, other)``: texts of a SimHash class of several texts, and the smallest of the class; fingerprints are of ``size``-word shingles."""
    found = simhash.near_duplicate_notes(numbered.select(F.col(row).alias("tile_id"), "notes"), size)
    member = found.select(F.col("tile_id").alias("row_no"), "component_id").join(nodes.select("node", F.col("least.row_no").alias("row_no")), "row_no")
    member = stored(member.select("node", "component_id"), "near-printed")
    dropped(found)
    first = member.groupBy("component_id").agg(F.min("node").alias("other"), F.count(F.lit(1)).alias("members")).filter("members > 1")
    return member.join(first, "component_id").select("node", "other")


def near_copy_roots(nodes: DataFrame, printed: DataFrame, texts_of, size: int, similarity: float) -> DataFrame:
    """``(node, root)`` of the texts that are linked to another, from ``nodes`` (node, n, keys) and ``printed_classes``.

    Each text is compared with the first of its SimHash class. Then, in a few turns, the text of each bucket that meets most others is compared with those of other classes and leaves the bucket, which
    settles small buckets for good and joins a large group of near copies in as many comparisons as it has texts. What
    is left in buckets of several classes goes through its rarest shingles (``_rare_pairs``); a pair once compared never is again.
    """
    keyed = nodes.select(F.explode("keys").alias("bucket"), "node", "n")
    crowds = stored(keyed.groupBy("bucket").agg(F.count(F.lit(1)).alias("members")).filter("members > 1"), "near-buckets")
    met = stored(by_merge(keyed).join(crowds, "bucket"), "near-met")
    weight = met.groupBy("node").agg(F.sum("members").alias("weight"))
    weighed = stored(met.join(weight, "node").select("bucket", "node", "n", "weight"), "near-weighed")
    dropped(crowds, met)
    sized = nodes.select("node", "n")
    other = sized.withColumnsRenamed({"node": "other", "n": "other_n"})
    first = _pairs(printed.join(sized, "node").join(other, "other").withColumns({"root": F.col("node"), "other_root": F.col("other")}), None, similarity)
    wanted = weighed.select("node").unionByName(first.select(F.explode(F.array("a", "b")).alias("node"))).distinct()
    texts = stored(texts_of(wanted), "near-texts", "zstd")
    tried, roots = None, None

    def compare(found: DataFrame) -> None:
        nonlocal tried, roots
        if found.isEmpty():
            return
        with small_batches(found.sparkSession):
            alike = stored(_alike(found, texts, size, similarity), "near-alike")
        tried = found if tried is None else tried.unionByName(found)
        # The stars of what is found so far stand for its edges.
        former, roots = roots, connected(alike if roots is None else alike.unionByName(roots.select(F.col("root").alias("a"), F.col("node").alias("b"))))
        dropped(alike, *([] if former is None else [former]))

    def rerooted(rows: DataFrame) -> DataFrame:
        if roots is None:
            return rows
        return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))

    compare(first)
    rooted = stored(rerooted(weighed.withColumn("root", F.col("node"))).select("bucket", "node", "n", "weight", "root"), "near-rooted")
    dropped(weighed)
    for turn in range(TURNS + 1):
        if turn < TURNS:
            chosen = rooted.groupBy("bucket").agg(
                F.max(F.struct("weight", F.xxhash64("node").alias("order"), "node", "n", "root")).alias("x"), F.min("root").alias("low"), F.max("root").alias("high"))
            leader = stored(chosen.filter("low != high").select(
                "bucket", F.col("x.node").alias("other"), F.col("x.n").alias("other_n"), F.col("x.root").alias("other_root")), "near-leaders")
            left = rooted.join(leader, "bucket").filter("node != other")
            found = _pairs(left, tried, similarity)
        else:
            rest = stored(rooted.groupBy("node").agg(F.first("root").alias("root")), "near-rest")
            found = _rare_pairs(rest, texts, tried, size, similarity)
            dropped(rooted, rest)
        compare(found)
        if turn < TURNS:
            again = rerooted(left.select("bucket", "node", "n", "weight", "root"))
            several = again.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("bucket")
            before, rooted = rooted, stored(again.join(several, "bucket").select("bucket", "node", "n", "weight", "root"), "near-rooted")
            dropped(before, leader)
            if rooted.isEmpty():
                break
    dropped(texts)
    return roots if roots is not None else nodes.select("node", F.col("node").alias("root")).limit(0)


def keep_first_copies(feedback: DataFrame, size: int = 5, similarity: float = 0.8) -> DataFrame:
    """``feedback`` with one row of each class of near copies, all columns kept.

    Two notes are linked where the Jaccard similarity of their ``size``-word shingles is ``similarity`` or more; links make classes.
    The row that stays has the smallest ``tile_id`` (null last), then the smallest text hash, then comes first, so repeated
    and null ids are told apart. Null, empty and blank notes are one class. No rows give no rows. Texts are taken whole.
    """
    row = fresh(feedback, "_row_no")
    numbered = stored(feedback.withColumn(row, F.monotonically_increasing_id()), "near-notes", "zstd")
    with small_batches(feedback.sparkSession, 1000):
        sketched = stored(_sketches(numbered, row, size), "near-sketches")
    place = F.struct(F.col("tile_id").isNull().alias("none"), "tile_id", "node", "row_no")
    nodes = stored(sketched.groupBy("node").agg(F.min(place).alias("least"), F.first("n").alias("n"), F.first("keys").alias("keys")), "near-nodes")
    dropped(sketched)

    def texts_of(wanted: DataFrame) -> DataFrame:
        rows = nodes.select("node", F.col("least.row_no").alias(row)).join(wanted, "node")
        return by_merge(numbered.select(row, F.col("notes").cast("string").alias("notes"))).join(rows, row).select("node", "notes")

    roots = near_copy_roots(nodes, printed_classes(numbered, nodes, row, size), texts_of, size, similarity)
    kept = (nodes.select("node", "least").join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root"))
            .agg(F.min("least").alias("least")).select(F.col("least.row_no").alias(row)))
    return numbered.join(kept, row, "left_semi").select(feedback.columns)
