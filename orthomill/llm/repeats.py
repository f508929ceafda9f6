"""Repeated passages: the earliest occurrence stays, later ones are spans to remove.

A text is cut into small paragraphs, units, at the words whose hash is least among the words around them, so a copy has the same cuts
wherever it begins and ends, whatever its lines. Digests of the normalised units are grouped over all texts and the earliest stays. Runs of
repeated units that could make up a passage are then compared with the texts that keep them, word by word, on beyond both edges. Spans are
offsets into the original text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, compress, count
from operator import ne

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import dropped, fresh, stored

_WORD = re.compile(r"\S+")
#: Words in a row of which the least hash is a cut, and words of a unit at least; any 50 words in a row hold a whole unit.
REACH, LEAST = 11, 8
#: Words read beyond both edges of a run (what is left of a passage there is shorter), and words of a match that counts.
EDGE, MATCH = 40, 10
#: Texts whose units leave Python together.
TEXTS = 1000


def _cut(words: list[str]) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Unsigned digests, first words and numbers of words of the units of ``units_of``."""
    n = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    cuts = np.array([0, n])
    if n >= REACH:
        least = np.lib.stride_tricks.sliding_window_view(hashes, REACH).argmin(axis=1)
        cuts = np.union1d(cuts, least + np.arange(len(least)))
    ends = cuts[np.searchsorted(cuts, cuts[:-1] + LEAST).clip(max=len(cuts) - 1)]
    return [xxhash.xxh64_intdigest(" ".join(words[a:b])) for a, b in zip(cuts[:-1].tolist(), ends.tolist())], cuts[:-1], ends - cuts[:-1]


def units_of(words: list[str]) -> list[tuple[int, int, int]]:
    """``(hash, first word, words)`` of a text's units, from its lower-case words.

    A unit begins at each cut, and at the first word, and reaches to the first cut ``LEAST`` words on or more, or to the end. Which
    words are cuts depends on the ``REACH - 1`` words before and after alone.
    """
    if not words:
        return []
    digests, starts, lengths = _cut(words)
    return [(d - (1 << 63), a, w) for d, a, w in zip(digests, starts.tolist(), lengths.tolist())]


def _words(text: str | None) -> list[tuple[int, int, str]]:
    return [(m.start(), m.end(), m.group().lower()) for m in _WORD.finditer(text or "")]


def _units(numbered: DataFrame, row: str) -> DataFrame:
    """All units: ``hash, row_no, rank, pos, words``, and the words ``beside``: those of the units before and after."""
    names = ["row_no", "rank", "hash", "pos", "words", "beside"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                piece = batch.slice(at, TEXTS)
                digests, starts, lengths, counts = [], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], []
                beside = [np.zeros(0, np.int64)]
                for t in piece.column(2):
                    words = (t.as_py() or "").lower().split()
                    found, first, length = _cut(words) if words else ((), starts[0], lengths[0])
                    digests.extend(found)
                    counts.append(len(found))
                    starts.append(first)
                    lengths.append(length)
                    around = np.concatenate(([0], length, [0]))
                    beside.append(around[:-2] + around[2:])
                hashes = (np.array(digests, np.uint64) ^ np.uint64(1 << 63)).view(np.int64)
                whose = pa.array(np.repeat(np.arange(piece.num_rows), counts))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0).take(whose), piece.column(1).take(whose), pa.array(hashes), *(pa.array(np.concatenate(x), pa.int32()) for x in (starts, lengths, beside))], names)

    rank = F.coalesce(F.col("tile_id").cast("long"), F.lit((1 << 63) - 1))
    units = numbered.select(F.col(row).alias("row_no"), rank.alias("rank"), F.col("notes").cast("string")).mapInArrow(
        run, "row_no long, rank long, hash long, pos int, words int, beside int")
    return stored(units, "repeat-units", "zstd")


def _places(numbered: DataFrame, row: str, min_words: int) -> DataFrame:
    """What to compare: for each run of repeated units that may hold ``min_words``, the stretches of kept texts that its units stand in.

    ``row_no, rank, own`` (where the stretch begins in the text, in words), ``kept_row, kept_rank, at, until`` (in words of the kept text).
    """
    units = _units(numbered, row)
    common = stored(units.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("hash"), "repeat-common")
    unit = stored(units.join(common, "hash"), "repeat-met")
    dropped(units, common)
    first = stored(unit.groupBy("hash").agg(F.min(F.struct("rank", "row_no", "pos")).alias("first")), "repeat-first")
    again = (unit.join(first, "hash").filter("row_no != first.row_no or pos != first.pos")
             .groupBy("row_no", "rank").agg(F.collect_list(F.struct("pos", "words", "beside", F.col("first.rank").alias("kr"), F.col("first.row_no").alias("kn"), F.col("first.pos").alias("kp"))).alias("units")))
    names = ["row_no", "rank", "own", "kept_row", "kept_rank", "at", "until"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            units = batch.column(2)
            ends = units.offsets.to_numpy()
            fields = [units.values.field(i).to_numpy() for i in range(6)]
            for row_no, rank, first, last in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), ends[:-1].tolist(), ends[1:].tolist()):
                order = np.argsort(fields[0][first:last])
                own_pos, own_words, besides, ranks, rows, kept_pos = (f[first:last][order].tolist() for f in fields)
                at = 0
                while at < len(own_pos):
                    start, stop, beside, groups = own_pos[at], own_pos[at], 0, {}
                    while at < len(own_pos) and own_pos[at] <= stop:
                        pos, words, kp = own_pos[at], own_words[at], kept_pos[at]
                        stop, beside = max(stop, pos + words), max(beside, besides[at])
                        spot = groups.setdefault((rows[at], ranks[at], pos - kp), [kp, 0])
                        spot[1] = max(spot[1], kp + words)
                        at += 1
                    if stop - start + 2 * beside >= min_words:
                        for (kn, kr, shift), (low, high) in groups.items():
                            low = max(0, low - EDGE, -shift)
                            out.append((row_no, rank, low + shift, kn, kr, low, high + EDGE))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(7)], names)

    places = stored(again.mapInArrow(run, ", ".join(f"{c} long" for c in names)), "repeat-places")
    dropped(unit, first)
    return places


def _slices(numbered: DataFrame, row: str, places: DataFrame) -> DataFrame:
    """``(kept_row, at, until, slice)``: the wanted stretches of kept texts, lower-cased words joined by spaces; each stretch once."""
    share = F.pmod(F.xxhash64("at", "until"), F.lit(8))
    wanted = (places.select("kept_row", "at", "until").distinct().groupBy("kept_row", share.alias("share"))
              .agg(F.collect_list(F.struct("at", "until")).alias("wanted")).drop("share"))
    types = pa.list_(pa.struct([("at", pa.int64()), ("until", pa.int64()), ("slice", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for text, parts in zip(batch.column(1), batch.column(2).to_pylist()):
                words = text.as_py().lower().split()
                found.append([{"at": p["at"], "until": p["until"], "slice": " ".join(words[p["at"]:p["until"]])} for p in parts])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, types)], ["kept_row", "parts"])

    texts = numbered.select(F.col(row).alias("kept_row"), F.col("notes").cast("string").alias("notes"))
    cut = texts.join(wanted, "kept_row").select("kept_row", "notes", "wanted").mapInArrow(run, "kept_row long, parts array<struct<at:bigint,until:bigint,slice:string>>")
    return stored(cut.select("kept_row", F.explode("parts").alias("x")).select("kept_row", "x.at", "x.until", "x.slice"), "repeat-slices", "zstd")


def _agreeing(own: list[str], kept: list[str]) -> list[tuple[int, int]]:
    """Stretches of ``MATCH`` words or more in which two word lists agree place by place."""
    end = min(len(own), len(kept))
    out, start = [], 0
    for i in chain(compress(count(), map(ne, own, kept)), (end,)):
        if i - start >= MATCH:
            out.append((start, i))
        start = i + 1
    return out


def _spans(numbered: DataFrame, row: str, min_words: int) -> DataFrame:
    """The spans of ``repeated_spans`` from stored notes with row numbers."""
    kind = numbered.schema["tile_id"].dataType.simpleString()
    places = _places(numbered, row, min_words)
    slices = _slices(numbered, row, places)
    per_row = (places.join(slices, ["kept_row", "at", "until"]).groupBy("row_no", "rank")
               .agg(F.collect_list(F.struct("own", "kept_rank", "slice")).alias("parts")))
    texts = numbered.select(F.col(row).alias("row_no"), F.col("notes").cast("string").alias("notes"))
    names = ["row_no", "rank", "start", "length", "words", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for row_no, rank, text, parts in zip(*(batch.column(i).to_pylist() for i in range(4))):
                words = _words(text)
                lower = [w[2] for w in words]
                found = sorted({(p["own"] + a, p["own"] + b, p["kept_rank"]) for p in parts
                                for kept in [p["slice"].split()] for a, b in _agreeing(lower[p["own"]:p["own"] + len(kept)], kept)})
                at = 0
                while at < len(found):
                    start, stop, kept = found[at]
                    while at < len(found) and found[at][0] <= stop:
                        stop, kept = max(stop, found[at][1]), min(kept, found[at][2])
                        at += 1
                    if stop - start >= min_words:
                        out.append((row_no, rank, words[start][0], words[stop - 1][1] - words[start][0], stop - start, kept))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(6)], names)

    spans = per_row.join(texts, "row_no").select("row_no", "rank", "notes", "parts").mapInArrow(run, ", ".join(f"{c} long" for c in names))

    def named(rank: str) -> Column:
        return F.when(F.col(rank) != (1 << 63) - 1, F.col(rank)).cast(kind)
    return spans.select(named("rank").alias("tile_id"), "row_no", F.col("start").cast("int").alias("start"), F.col("length").cast("int").alias("length"),
                        F.col("words").cast("int").alias("words"), named("kept").alias("kept_tile_id"))


def repeated_spans(feedback: DataFrame, min_words: int = 40) -> DataFrame:
    """Spans of ``notes`` that repeat what stands earlier, in the order of ``tile_id``: one row per span to remove.

    Returns ``tile_id``, ``row_no`` (the row within this result's reading of the table), ``start`` and ``length`` (code points of the original text), ``words``,
    ``kept_tile_id`` (the smallest tile that keeps one of its units). Runs of under ``min_words`` repeated words stay, so
    common lines and phrases are left alone. Any 50 words that two texts share hold a common unit; what else of a passage stands in a text that
    keeps one of its units goes with it. A unit's earliest occurrence is that of the smallest ``tile_id`` (null last),
    then of the first row of that tile, then the first in the text. Null, empty and blank notes have no units. A repeated row's text of
    ``min_words`` or more is removed from all but one row. Where earlier texts hold a passage in several lengths, under a unit of words can stay at its
    edge, if they stand only in a text that keeps none of the passage's units. No rows give no rows; other columns are not read. Digests group by
    combining before the shuffle and a digest that many rows share is only joined, never gathered.
    """
    numbered = stored(feedback.select("tile_id", "notes", F.monotonically_increasing_id().alias("row_no")), "repeat-notes", "zstd")
    return _spans(numbered, "row_no", min_words)


def without_repeats(feedback: DataFrame, min_words: int = 40) -> DataFrame:
    """``feedback`` with repeated spans cut out of ``notes`` and a column ``kept_spans``, row for row, all other columns kept.

    ``kept_spans`` holds ``(start, length)`` of what is left, as offsets into the original text. A null text stays null without spans;
    a text that repeats as a whole becomes empty. The text is stored once and meets its spans in one join.
    """
    row = fresh(feedback, "_row")
    numbered = stored(feedback.withColumn(row, F.monotonically_increasing_id()), "repeat-notes", "zstd")
    spans = _spans(numbered, row, min_words)
    gone = fresh(numbered, "_gone")
    cut = spans.groupBy(F.col("row_no").alias(row)).agg(F.sort_array(F.collect_list(F.struct(
        F.col("start").cast("int").alias("start"), (F.col("start") + F.col("length")).cast("int").alias("stop")))).alias(gone))
    joined = numbered.join(cut, row, "left").withColumn(gone, F.coalesce(gone, F.array().cast("array<struct<start:int,stop:int>>")))
    # What is left lies between the end of one span and the start of the next.
    ends = F.concat(F.array(F.lit(0)), F.transform(gone, lambda g: g["stop"]))
    starts = F.concat(F.transform(gone, lambda g: g["start"]), F.array(F.length(F.coalesce("notes", F.lit("")))))
    left = F.filter(F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("start"), (b - a).alias("length"))), lambda k: k["length"] > 0)
    return joined.withColumn("kept_spans", left).withColumn("notes", F.when(
        F.col("notes").isNotNull(), F.array_join(F.transform("kept_spans", lambda k: F.substring(F.col("notes"), k["start"] + 1, k["length"])), ""))).drop(row, gone)
