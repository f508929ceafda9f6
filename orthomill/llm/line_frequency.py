"""Quality rules by cross-document line frequency, in DataFrame functions only.

Lines are normalised and hashed; a line that stands in too many distinct documents of a host is
removed, and a document left with too little is rejected. Counts combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthomill.llm.tables import let, stored, word_array

WINDOW = 8


def _without(text: Column, characters: str) -> Column:
    for c in characters:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def repeated_window_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in ``window``-word windows that the text holds twice or more, the first included.

    Window hashes are sorted together with their positions, so equal windows lie side by side; as many low
    bits as the position needs are taken from the hash (44 bits of hash are left at a million words).
    """
    def of(w: Column) -> Column:
        bits = F.length(F.bin(F.size(w).cast("long")))

        def high(x: Column) -> Column:
            return F.call_function("shiftrightunsigned", x, bits)

        packed = F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: F.coalesce(
            F.call_function("shiftleft", high(F.xxhash64(*[F.get(w, i + k) for k in range(window)])), bits).bitwiseOR(i.cast("long")), F.lit(0).cast("long")))
        twice = let(F.sort_array(packed), lambda s: F.transform(
            F.filter(s, lambda x, i: (high(x) == F.coalesce(high(F.get(s, i - 1)), F.lit(-1).cast("long")))
                     | (high(x) == F.coalesce(high(F.get(s, i + 1)), F.lit(-1).cast("long")))),
            lambda x: x.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1)))
        covered = let(F.sort_array(twice), lambda p: F.aggregate(
            F.transform(p, lambda x, i: F.least(F.lit(window).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(window).cast("long")))),
            F.lit(0).cast("long"), lambda a, x: a + x))
        return F.when(F.size(w) > window, covered).otherwise(F.lit(0).cast("long"))

    return let(words, of)


def measure(feedback: DataFrame) -> DataFrame:
    """``tile_id``, ``source_file``, base counts of the whole ``notes``, and its lines as (no, hash, words)."""
    text = F.coalesce(F.col("notes").cast("string"), F.lit(""))
    split = F.transform(F.split("_text", "\n"), lambda line, no: F.struct(no.alias("no"), word_array(line).alias("words"), line.alias("line")))
    lines = F.filter(split, lambda x: F.size(x.words) > 0)
    hashed = F.transform(F.col("_lines"), lambda x: F.struct(
        x.no.alias("no"), F.xxhash64(F.lower(F.array_join(x.words, " "))).alias("hash"), F.size(x.words).alias("words")))
    plain = F.transform(F.col("_lines"), lambda x: x.line)
    return (
        feedback.select("tile_id", F.col("source_file").cast("string"), text.alias("_text"))
        .withColumn("_lines", lines)
        .select(
            F.monotonically_increasing_id().alias("row_no"), "tile_id", "source_file", F.xxhash64("_text").alias("text_hash"),
            F.aggregate("_lines", F.lit(0).cast("long"), lambda a, x: a + F.size(x.words)).alias("n_words"),
            F.length(_without(F.col("_text"), " \t\n\x0b\x0c\r")).cast("long").alias("word_chars"),
            (F.length("_text") - F.length(_without(F.col("_text"), "#*$%&|<>"))).cast("long").alias("n_symbols"),
            (F.size("_lines") - let(plain, lambda p: F.size(F.array_distinct(p)))).cast("long").alias("n_dup_lines"),
            repeated_window_words(F.flatten(F.transform("_lines", lambda x: x.words))).alias("n_repeat_words"),
            hashed.alias("lines"))
    )


def frequent_lines(measured: DataFrame, min_documents: int = 20, host_share: float = 0.001) -> DataFrame:
    """``(host, hash)`` of lines that stand in more than ``min_documents`` and ``host_share`` of a host's distinct texts.

    The count decides on all but hosts of over ``min_documents / host_share`` texts (20,000 as given), where the small share
    keeps a line that so many writers would come upon by themselves.

    Copies of a text, and repeated rows, count as one document. All occurrences are counted first, which
    combines before the shuffle and bounds the distinct count from above; only lines that
    pass so are counted over distinct texts.
    """
    line = measured.select(F.coalesce(F.concat(F.lit("="), "source_file"), F.lit("")).alias("host"), "text_hash",
                           F.explode(F.array_distinct(F.transform("lines", lambda x: x["hash"]))).alias("hash"))
    texts = (measured.select(F.coalesce(F.concat(F.lit("="), "source_file"), F.lit("")).alias("host"), "text_hash").distinct()
             .groupBy("host").agg(F.count(F.lit(1)).alias("texts")))
    above = (F.col("n") > min_documents) & (F.col("n") > host_share * F.col("texts"))
    candidates = stored(line.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_documents)
                        .join(texts, "host").filter(above).select("host", "hash", "texts"), "line-candidates")
    return stored(
        line.join(candidates, ["host", "hash"]).groupBy("host", "hash", "texts", "text_hash").agg(F.lit(1).alias("one"))
        .groupBy("host", "hash", "texts").agg(F.count(F.lit(1)).alias("n")).filter(above).select("host", "hash"), "line-frequent")


def judge_notes(feedback: DataFrame, min_documents: int = 20, host_share: float = 0.001, min_words: int = 20,
                max_repeated: int = 30, min_left_words: int = 10, min_left_share: float = 0.2) -> DataFrame:
    """Base counts and the line-frequency verdict of every row of ``feedback`` (``tile_id``, ``source_file``, ``notes``).

    One row per row: ``tile_id``, ``source_file``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed`` (fewer than ``min_words`` words, or over ``max_repeated`` percent of them in
    repeated windows), ``removed_lines`` (0-based numbers of the ``\\n``-split lines that are too frequent on their host),
    ``removed_words``, ``kept``: not ``base_failed``, and at least ``min_left_words`` words and ``min_left_share`` of all words
    are left, or nothing was removed. The host is ``source_file``; rows without one share a host of their own. Null and
    blank notes have no words and fail the base rules. Repeated rows are judged alike and count
    once. Empty tables give empty tables; other columns are not read; texts are taken whole.
    """
    measured = stored(measure(feedback), "line-measured")
    hits = (measured.select("row_no", F.coalesce(F.concat(F.lit("="), "source_file"), F.lit("")).alias("host"), F.explode("lines").alias("x"))
            .select("row_no", "host", F.col("x.hash").alias("hash"), F.col("x.no").alias("no"), F.col("x.words").alias("words"))
            .join(frequent_lines(measured, min_documents, host_share), ["host", "hash"])
            .groupBy("row_no").agg(F.sum("words").alias("removed_words"), F.sort_array(F.collect_list("no")).alias("removed_lines")))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeated * F.col("n_words"))
    left = F.col("n_words") - F.col("removed_words")
    return (
        measured.drop("lines", "text_hash").join(hits, "row_no", "left")
        .withColumn("removed_words", F.coalesce("removed_words", F.lit(0).cast("long")))
        .withColumn("removed_lines", F.coalesce("removed_lines", F.array().cast("array<int>")))
        .withColumn("base_failed", base_failed)
        .withColumn("kept", ~F.col("base_failed") & ((F.col("removed_words") == 0) | ((left >= min_left_words) & (left >= min_left_share * F.col("n_words")))))
        .drop("row_no")
    )


def without_lines(notes: Column, removed: Column) -> Column:
    """The text without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(notes, "\n"), lambda x, i: ~F.array_contains(removed, i)), "\n")
