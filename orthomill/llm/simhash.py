"""Near-duplicate notes by SimHash fingerprints and anchor-point covering.

Anchors are the codewords of a covering code: two perfect binary Golay blocks of 23 bits
(covering radius 3) and one perfect Hamming block of 15 bits (radius 1). Every fingerprint
has one home anchor, whose blocks all lie within the covering radius. A fingerprint within
two bits of it lies, block by block, within the radius plus its differing bits of that same anchor;
so a fingerprint copied to every anchor it reaches with at most two bits beyond the
radii (about 150 of 2**35) meets each of its neighbours at the neighbour's home.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orthomill.llm.components import connected
from orthomill.llm.tables import by_merge, dropped, fresh, stored

BITS = 64
#: The generator polynomial of the binary Golay code, bit 0 first.
GOLAY = 0b110001110101


def fingerprint(text: bytes | None, shingle: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of a UTF-8 text: bit set if in over half of the word shingles' XXH64.

    A-Z count as a-z; fewer words than a shingle give one shingle of all words; none give 0.
    """
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = max(0, min(shingle, len(words)) - 1)
    starts = np.concatenate(([0], ends[:-1] + 1))[:len(words) - first].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[s:e], seed) for s, e in zip(starts, ends[first:].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = np.unpackbits(hashes[at:at + 65536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += part.sum(axis=0, dtype=np.int64)
    set_bits = (ones * 2 > len(hashes)).astype(np.uint64)
    return int((set_bits << np.arange(BITS, dtype=np.uint64)).sum(dtype=np.uint64))


def fingerprints(feedback: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """``(tile_id, fingerprint long)``, one row per row of ``feedback``, from its whole ``notes``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            prints = np.fromiter((fingerprint(t.as_py(), shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names)

    names = ["tile_id", "fingerprint"]
    kind = feedback.schema["tile_id"].dataType.simpleString()
    return feedback.select("tile_id", F.col("notes").cast("string")).mapInArrow(run, f"tile_id {kind}, fingerprint long")


class _Block:
    """A perfect code on some bits: error patterns by syndrome and by distance beyond the radius."""

    def __init__(self, shift: int, columns: list[int], radius: int, reach: int):
        self.shift, self.columns, n = shift, columns, len(columns)
        self.mask = np.uint64((1 << n) - 1)
        classes = 1 << max(columns).bit_length()
        self.lists = []
        for beyond in range(reach + 1):
            weights = range(radius + 1) if beyond == 0 else [radius + beyond]
            found = [(self._syndrome_of(c), sum(1 << i for i in c)) for w in weights for c in combinations(range(n), w)]
            found.sort()
            syndromes = np.array([s for s, _ in found], np.int64)
            counts = np.bincount(syndromes, minlength=classes)
            self.lists.append((counts, np.concatenate(([0], np.cumsum(counts)[:-1])), np.array([p for _, p in found], np.uint64)))

    def _syndrome_of(self, bits: tuple[int, ...]) -> int:
        out = 0
        for i in bits:
            out ^= self.columns[i]
        return out

    def split(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values = (prints >> np.uint64(self.shift)) & self.mask
        syndromes = np.zeros(len(prints), np.int64)
        for i, column in enumerate(self.columns):
            syndromes ^= ((values >> np.uint64(i)) & np.uint64(1)).astype(np.int64) * column
        return values, syndromes


@cache
def _blocks(reach: int) -> tuple[_Block, ...]:
    golay, power = [], 1
    for _ in range(23):
        golay.append(power)
        power <<= 1
        if power >> 11:
            power ^= GOLAY
    return (_Block(0, golay, 3, reach), _Block(23, golay, 3, reach), _Block(46, list(range(1, 16)), 1, reach))


def anchors(prints: np.ndarray, threshold: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors within covering radius plus ``threshold``: (index into ``prints``, anchor, is home)."""
    blocks = _blocks(threshold)
    parts = [b.split(prints) for b in blocks]
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for beyond in product(range(threshold + 1), repeat=len(blocks)):
        if sum(beyond) > threshold:
            continue
        counts = [b.lists[e][0][s] for b, e, (_, s) in zip(blocks, beyond, parts)]
        total = np.prod(counts, axis=0)
        rows = np.repeat(np.arange(len(prints)), total)
        rest = np.arange(len(rows)) - np.repeat(np.cumsum(total) - total, total)
        anchor = np.zeros(len(rows), np.uint64)
        for b, e, (values, s), n in zip(blocks, beyond, parts, counts):
            patterns = b.lists[e][2][b.lists[e][1][s][rows] + rest % n[rows]]
            rest = rest // n[rows]
            anchor |= (values[rows] ^ patterns) << np.uint64(b.shift)
        out.append((rows, anchor, np.full(len(rows), not any(beyond))))
    return tuple(np.concatenate(x) for x in zip(*out))


def anchored(prints: DataFrame, threshold: int = 2) -> DataFrame:
    """``(anchor, fingerprint, home)`` for distinct fingerprints: every anchor each one reaches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for at in range(0, len(values), 1000):
                piece = values[at:at + 1000]
                rows, anchor, home = anchors(piece, threshold)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(piece[rows].view(np.int64)), pa.array(home)],
                    ["anchor", "fingerprint", "home"])

    return prints.select("fingerprint").mapInArrow(run, "anchor long, fingerprint long, home boolean")


def homes(prints: DataFrame) -> DataFrame:
    """``(anchor, fingerprint)``: the one home anchor of each fingerprint."""
    return anchored(prints, 0).select("anchor", "fingerprint")


def links(prints: DataFrame, threshold: int = 2, crowd: int = 256) -> DataFrame:
    """Edges ``(a, b)`` that join every two distinct fingerprints at ``threshold`` (1 or 2) or fewer bits.

    Under an anchor each home is compared to all that reach it, some 150 rows of each fingerprint. Where an anchor is home
    to over ``crowd`` fingerprints, all that reach it are joined another exact way, linear in their
    number: two words within two bits share a word within one bit of each, so the at most
    65 fingerprints around such a word are tied to their smallest member.
    """
    home = stored(homes(prints), "simhash-homes")
    crowded = home.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > crowd).select("anchor")
    sparse = home.join(crowded, "anchor", "left_anti").withColumnRenamed("fingerprint", "u")
    targets = sparse.unionByName(crowded.withColumn("u", F.lit(None).cast("long")))
    near = (F.col("u") < F.col("fingerprint")) & (F.bit_count(F.col("u").bitwiseXOR(F.col("fingerprint"))) <= threshold)
    met = stored(
        by_merge(anchored(prints, threshold).select("anchor", "fingerprint")).join(targets, "anchor")
        .filter(F.col("u").isNull() | near).select("u", "fingerprint"), "simhash-met")
    dropped(home)
    pairs = met.filter(F.col("u").isNotNull()).select(F.col("u").alias("a"), F.col("fingerprint").alias("b"))
    flips = F.expr("transform(sequence(-1, 63), i -> if(i < 0, fingerprint, fingerprint ^ shiftleft(1L, i)))")
    around = (
        met.filter(F.col("u").isNull()).select("fingerprint").distinct()
        .select("fingerprint", F.explode(flips).alias("word"))
        .groupBy("word").agg(F.collect_set("fingerprint").alias("members"))
        .filter(F.size("members") > 1)
        .select(F.array_min("members").alias("a"), F.explode("members").alias("b")).filter("a < b"))
    # Members around one word differ in up to two bits; with a threshold of 1 the word must be a member.
    if threshold == 1:
        around = around.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 1)
    return pairs.unionByName(around)


def near_duplicate_notes(feedback: DataFrame, shingle: int = 3, seed: int = 42, threshold: int = 2) -> DataFrame:
    """Group feedback rows whose notes' fingerprints are linked by ``threshold`` (2) or fewer differing bits.

    Needs ``tile_id`` (integer) and ``notes``; other columns are not read. Returns one row per input row:
    ``tile_id``, ``fingerprint`` (long, the 64 bits), ``component_id``, the smallest ``tile_id`` that can be
    reached over links. Null, empty and blank notes have fingerprint 0 and are linked like any other. Repeated
    rows come back as often as they came in. A null ``tile_id`` is never a component's id unless it
    holds no other. An empty table gives an empty table. Texts are taken whole, whatever their length.
    """
    if threshold != 2:
        raise ValueError("the crowd's exact way is made for 2 bits")
    printed = stored(fingerprints(feedback, shingle, seed), "simhash-prints")
    distinct = stored(printed.groupBy("fingerprint").agg(F.min("tile_id").alias("least")), "simhash-distinct")
    edges = links(distinct.select("fingerprint"), threshold)
    roots = connected(edges)
    dropped(edges)
    rooted = distinct.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(rooted.join(least, "root").select("fingerprint", "component_id"), "simhash-classes")
    dropped(distinct, roots)
    return printed.join(classes, "fingerprint").select("tile_id", "fingerprint", "component_id")


def keep_first(feedback: DataFrame, **options) -> DataFrame:
    """``feedback`` with one row of each near-duplicate class, that of the smallest ``tile_id``, all columns kept.

    Of rows that share that ``tile_id`` one stays, the one whose notes hash lowest. Rows without a ``tile_id``
    cannot be told apart by their class and all stay.
    """
    classes = near_duplicate_notes(feedback, **options)
    chosen = classes.filter(F.col("tile_id") == F.col("component_id")).select("tile_id").distinct()
    first = Window.partitionBy("tile_id").orderBy(F.xxhash64(F.col("notes")))
    nth = fresh(feedback, "_nth")
    kept = (feedback.filter(F.col("tile_id").isNotNull()).join(chosen, "tile_id", "left_semi")
            .withColumn(nth, F.row_number().over(first)).filter(F.col(nth) == 1).select(feedback.columns))
    return kept.unionByName(feedback.filter(F.col("tile_id").isNull()))
