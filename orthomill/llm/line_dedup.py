"""Lines that many notes share: all but those of the last note go, by range-sorted line hashes and keep bitmaps.

Hashes of normalised lines are dealt over tasks by range and sorted by note and position within; a task reads them as a
stream, in which a line's first occurrence is that of the note that keeps it. What comes back per note is a bitmap of
the lines to keep, not text. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orthomill.llm.tables import fresh, stored

#: What is stripped at both ends of a line, and the letters that are lower-cased.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one line's hash that one stream holds; a line with more is dealt over several streams by its notes.
STREAM_ROWS = 2_000
WORD_BITS = 64


def lines_of(text: Column) -> Column:
    """The lines of a text, cut at line feeds; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n")


def line_key(line: Column) -> Column:
    """A line without ASCII white space at both ends, A-Z as a-z."""
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


def _note_key() -> list[Column]:
    """What tells notes apart: equal rows have equal lines, so they may share one bitmap."""
    return [F.col("tile_id"), F.xxhash64(F.col("notes"), F.lit(13)).alias("note_hash")]


def _streams(feedback: DataFrame, min_chars: int, min_tiles: int) -> DataFrame:
    """Lines that stand in ``min_tiles`` rows or more, in streams: ``hash``, ``check``, ``salt``, note and position, sorted.

    The counts combine before the shuffle, so lines that cannot repeat often enough leave before the sort.
    """
    key = F.col("key")
    line = stored(
        feedback.select(*_note_key(), F.posexplode(lines_of(F.col("notes"))).alias("pos", "line"))
        .withColumn("key", line_key(F.col("line"))).filter(F.char_length(key) >= min_chars)
        .select("tile_id", "note_hash", "pos", F.xxhash64(key).alias("hash"), F.xxhash64(F.lit(13), key).alias("check")), "line-hashes")
    counts = stored(line.groupBy("hash", "check").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") >= min_tiles), "line-counts")
    salt = F.pmod(F.xxhash64("tile_id"), F.ceil(F.col("rows") / STREAM_ROWS)).cast("int")
    return (line.join(counts, ["hash", "check"]).withColumn("salt", salt)
            .repartitionByRange("hash", "check", "salt")
            .sortWithinPartitions("hash", "check", "salt", F.desc_nulls_last("tile_id"), "note_hash", "pos"))


def dropped_lines(feedback: DataFrame, min_chars: int = 40, min_tiles: int = 5) -> DataFrame:
    """``(tile_id, note_hash, pos)`` of every line to drop."""
    line = ["hash", "check"]
    stream = Window.partitionBy(*line, "salt").orderBy(F.desc_nulls_last("tile_id"), "note_hash", "pos")
    before = F.lag(F.struct("tile_id")).over(stream)
    # The first row of a stream opens with its largest tile; every change of tile is one more note.
    read = stored(
        _streams(feedback, min_chars, min_tiles)
        .withColumn("new", (before.isNull() | ~before["tile_id"].eqNullSafe(F.col("tile_id"))).cast("int"))
        .withColumn("keeper", F.first("tile_id").over(stream))
        .withColumn("tiles", F.sum("new").over(stream.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))), "line-streams")
    split = (read.filter(F.col("rows") > STREAM_ROWS).filter("new = 1").groupBy(*line)
             .agg(F.max("keeper").alias("all_keeper"), F.count(F.lit(1)).alias("all_tiles")))
    whole = read.join(split, line, "left")
    keeper = F.when(F.col("all_tiles").isNull(), F.col("keeper")).otherwise(F.col("all_keeper"))
    return (whole.filter((F.coalesce("all_tiles", "tiles") >= min_tiles) & ~keeper.eqNullSafe(F.col("tile_id")))
            .select("tile_id", "note_hash", "pos"))


def keep_bitmaps(feedback: DataFrame, min_chars: int = 40, min_tiles: int = 5) -> DataFrame:
    """``(tile_id, note_hash, keep)`` of every note that loses a line.

    ``keep`` is a compressed bitmap: ``(word, bits)`` in order of ``word``, where bit i of ``bits`` is 1 if line ``64 * word + i`` stays;
    words of which every line stays are left out.
    """
    word = F.shiftright("pos", 6)
    bit = F.expr("shiftleft(1L, pos & 63)")
    return (dropped_lines(feedback, min_chars, min_tiles).groupBy("tile_id", "note_hash", word.alias("word"))
            .agg(F.bitwise_not(F.bit_or(bit)).alias("bits"))
            .groupBy("tile_id", "note_hash").agg(F.sort_array(F.collect_list(F.struct("word", "bits"))).alias("keep")))


def _kept(lines: Column, keep: Column) -> Column:
    """The lines that a bitmap keeps: what stands before each of its words, the word's own, and what follows the last."""
    def part(k: Column, i: Column) -> Column:
        start = k["word"] * WORD_BITS
        last = F.when(i == 0, F.lit(0)).otherwise((F.get(keep, i - 1)["word"] + 1) * WORD_BITS)
        own = F.filter(F.slice(lines, start + 1, WORD_BITS), lambda _, j: F.call_function("shiftrightunsigned", k["bits"], j).bitwiseAND(F.lit(1).cast("long")) == 1)
        return F.concat(F.slice(lines, last + 1, start - last), own)

    end = (F.get(keep, F.size(keep) - 1)["word"] + 1) * WORD_BITS
    rest = F.slice(lines, end + 1, F.greatest(F.size(lines) - end, F.lit(0)))
    return F.concat(F.flatten(F.transform(keep, part)), rest)


def without_shared_lines(feedback: DataFrame, min_chars: int = 40, min_tiles: int = 5) -> DataFrame:
    """``feedback`` with shared lines cut out of ``notes``, and ``n_lines`` and ``n_dropped`` (long) besides, row for row.

    ``notes`` is cut at line feeds. A line counts by its key (``line_key``); a key of ``min_chars`` code points or more that stands
    in ``min_tiles`` different ``tile_id`` or more loses all its lines but those of the largest ``tile_id``. The other lines stay
    as they are, joined by line feeds; a note that loses every line becomes empty. ``n_lines`` counts them before.

    Null or empty notes are one empty line and stay as they are. Rows of one ``tile_id``, repeated or not, are one tile; null is a tile of its own and
    never the largest beside others. No rows give no rows. All other columns pass by, also columns called ``n_lines``
    or ``n_dropped``, which are replaced. Keys are told apart by 128 bits of hash.
    """
    keep, note_hash = fresh(feedback, "_keep"), fresh(feedback, "_note_hash")
    maps = keep_bitmaps(feedback, min_chars, min_tiles).select(F.col("tile_id").alias("_t"), F.col("note_hash").alias("_h"), F.col("keep").alias(keep))
    hashed = feedback.withColumn(note_hash, _note_key()[1])
    joined = hashed.join(maps, hashed["tile_id"].eqNullSafe(maps["_t"]) & (hashed[note_hash] == maps["_h"]), "left").drop("_t", "_h")
    lines = lines_of(F.col("notes"))
    gone = F.aggregate(keep, F.lit(0).cast("long"), lambda n, k: n + F.bit_count(F.bitwise_not(k["bits"])))
    out = joined.withColumns({
        "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce(gone, F.lit(0).cast("long")),
        "notes": F.when(F.col(keep).isNull(), F.col("notes")).otherwise(F.array_join(_kept(lines, F.col(keep)), "\n"))})
    return out.drop(keep, note_hash)
