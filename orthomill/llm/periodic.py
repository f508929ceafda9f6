"""Runs of repeating words inside a note: seeds from k-grams, extended along diagonals.

A run of period q whose words repeat at least once matches itself at lag q over q words or more (over 12 - q where q is small). So for lags
in a band from k to 2k, every run holds a k-gram that stands again one lag later: k is the overlap that the band guarantees.
Pairs of places of one k-gram are the seeds, and a table of how far each lag has been read keeps a stretch from being
read twice. Grams get exact numbers (equal numbers, equal words), a longer gram's from two shorter ones, and
the search ends with the first length at which no gram repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The least number of words of a run, and the shortest gram: the least overlap that any period guarantees.
MIN_WORDS = 12
SHORTEST = MIN_WORDS // 2


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One number for every different pair (a, b)."""
    return np.unique(a * (int(b.max()) + 1) + b, return_inverse=True)[1]


def _shortest_grams(words: np.ndarray) -> np.ndarray:
    two = _paired(words[:-1], words[1:])
    four = _paired(two[:-2], two[2:])
    return _paired(four[:-2], two[4:])


def _near_seeds(gram: np.ndarray, place: np.ndarray, high: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lag, start) of all pairs of one gram less than ``high`` apart, for lags that few places can have."""
    out = []
    for step in range(1, high):
        lag = place[step:] - place[:-step]
        near = (gram[step:] == gram[:-step]) & (lag < high)
        if not near.any():
            break
        out.append((lag[near], place[:-step][near]))
    return out


def _far_seeds(gram: np.ndarray, place: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(lag, start) of pairs of one ``k``-gram at lags from k to 2k, at least one on every stretch that no shorter period explains.

    Places at most k / 2 apart form a chain, all steps of which are the gram's own period; pairs inside a chain
    only have multiples of it. Two chains of one gram continue to the left in step until one of them begins, so a
    pair with a chain's first place stands for all. Chains begin over k / 2 apart, hence few lie in reach.
    """
    starts = np.ones(len(place), bool)
    starts[1:] = (gram[1:] != gram[:-1]) | (place[1:] - place[:-1] > k // 2)
    chain = np.cumsum(starts) - 1
    first, of = place[starts], gram[starts]
    out = []
    for way in (1, -1):
        step = 1
        while True:
            other = chain + way * step
            inside = (other >= 0) & (other < len(first))
            other = np.where(inside, other, 0)
            lag = way * (first[other] - place)
            near = inside & (of[other] == gram) & (lag < 2 * k)
            if not near.any():
                break
            near &= lag >= k
            out.append((lag[near], np.minimum(place, first[other])[near]))
            step += 1
    return out


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many leading items of two arrays are equal, read in growing pieces."""
    at, size, n = 0, 64, min(len(a), len(b))
    while at < n:
        differ = a[at:min(at + size, n)] != b[at:min(at + size, n)]
        if differ.any():
            return at + int(differ.argmax())
        at, size = at + size, size * 2
    return n


def runs_of(words: list) -> list[tuple[int, int, int]]:
    """Maximal ``(start, length, period)`` by start, then period: smallest period, at least 12 words and two periods."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    number: dict = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) > n - SHORTEST:
        return []
    grams, k, best = _shortest_grams(ids), SHORTEST, {}
    while len(grams):
        order = np.argsort(grams, kind="stable")
        sorted_grams = grams[order]
        same = sorted_grams[1:] == sorted_grams[:-1]
        if not same.any():
            break
        repeats = np.concatenate((same, [False])) | np.concatenate(([False], same))
        gram, place = sorted_grams[repeats], order[repeats]
        found = _near_seeds(gram, place, 2 * SHORTEST) if k == SHORTEST else _far_seeds(gram, place, k)
        if found:
            lags, starts = (np.concatenate(x) for x in zip(*found))
            by = np.lexsort((starts, lags))
            lags, starts = lags[by], starts[by]
            # Seeds that follow one another on a diagonal lie on one stretch.
            opens = np.ones(len(lags), bool)
            opens[1:] = (lags[1:] != lags[:-1]) | (starts[1:] - starts[:-1] > 1)
            covered: dict[int, int] = {}
            for lag, start in zip(lags[opens].tolist(), starts[opens].tolist()):
                if start < covered.get(lag, 0):
                    continue
                stop = start + k + _agree(ids[start + k:n - lag], ids[start + lag + k:])
                left = start - _agree(ids[:start][::-1], ids[lag:start + lag][::-1])
                covered[lag] = stop
                if stop - left >= max(MIN_WORDS - lag, lag):
                    run = (left, stop + lag)
                    best[run] = min(lag, best.get(run, lag))
        if len(grams) <= k:
            break
        grams, k = _paired(grams[:-k], grams[k:]), 2 * k
    return sorted((s, e - s, q) for (s, e), q in best.items())


def collapsed(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words without what runs repeat: a run keeps its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def periodic_runs(feedback: DataFrame) -> DataFrame:
    """``(tile_id, n_words, runs, notes)`` of every row: its runs, and its words without what they repeat, joined by single spaces.

    A run is a stretch of words in which words ``period`` apart are the same, with the smallest such period, at least 12 words and two
    periods long, that no neighbouring word extends. ``runs`` holds ``(start, length, period)`` (long; words are counted from 0) by start, then
    period. A word goes if it lies in any run after that run's first period. Words are runs of anything but ASCII white space and
    compared as they are. Null, empty and blank notes have no words, no runs and an empty text. Repeated and null ``tile_id`` come back as
    often as they came; no rows give no rows; other columns are not read. Texts are taken whole: work follows the words, times the
    logarithm of the longest period at which anything repeats.
    """
    kind = feedback.schema["tile_id"].dataType.simpleString()
    run_type = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found, texts = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                words = (t.as_py() or b"").split()
                runs = runs_of(words)
                counts.append(len(words))
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(texts, pa.binary()).cast(pa.string())],
                ["tile_id", "n_words", "runs", "notes"])

    return feedback.select("tile_id", F.col("notes").cast("string")).mapInArrow(
        run, f"tile_id {kind}, n_words long, runs array<struct<start:bigint,length:bigint,period:bigint>>, notes string")
