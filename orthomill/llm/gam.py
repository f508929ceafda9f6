"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting fits one shallow tree per feature and turn on binned values and adds its leaves
to the feature's lookup table; the strongest pairs get two-way tables the same way. A
score is then a sum of table entries, looked up for a whole batch at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from orthomill.llm.tables import stored

#: Most labelled rows a fit takes; more than these are thinned by a hash of their id.
FIT_ROWS = 20_000
NOTE_FEATURES = (
    "log_words", "word_length", "distinct_words", "stutter", "top_word", "upper", "digits", "marks", "bars",
    "stops", "words_per_line", "repeated_lines", "short_words", "capitals",
)
#: Added to a leaf's weight, so that leaves on few rows stay small.
_RIDGE = 2.0
_LINE_END, _UPPER, _DIGIT = b"\n", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789"
_MARKS, _BARS, _STOPS = b"!#$%&*<>{}\\^~=@", b"|[]/_+;:", b".?"


def note_features_of(text: bytes | None) -> list[float]:
    """The features of one whole UTF-8 text, in the order of ``NOTE_FEATURES``; finite for any text."""
    data = text or b""
    words = data.split()
    n, size = len(words), max(1, len(data))
    if not n:
        return [0.0] * len(NOTE_FEATURES)

    def share(of: bytes) -> float:
        return (len(data) - len(data.translate(None, of))) / size

    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lines = [x for x in data.split(_LINE_END) if x.strip()]
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    letters = len(b"".join(words))
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)), letters / n, len(counts) / n ** 0.85, stutter / n, max(counts.values()) / n, share(_UPPER),
        share(_DIGIT), share(_MARKS) * size / n, share(_BARS) * size / n, share(_STOPS) * size / n, n / len(lines),
        1 - len(set(lines)) / len(lines), float((lengths <= 3).mean()), sum(map(bytes.istitle, words)) / n,
    ]


@F.arrow_udf(ArrayType(DoubleType()))
def _measure(notes: pa.Array) -> pa.Array:
    rows = [note_features_of(t.as_py()) for t in notes.cast(pa.binary())]
    return pa.array(rows, pa.list_(pa.float64()))


def note_features(feedback: DataFrame) -> DataFrame:
    """``feedback`` with one double column for each of ``NOTE_FEATURES``, from the whole ``notes``.

    A null text counts as empty. Columns of those names that are there already are replaced.
    """
    measured = feedback.withColumn("_measured", _measure(F.col("notes").cast("string")))
    return measured.withColumns({c: F.col("_measured")[i] for i, c in enumerate(NOTE_FEATURES)}).drop("_measured")


@dataclass
class Gam:
    """Lookup tables on binned features: ``cuts`` and ``tables`` per feature, ``pairs`` for two at a time."""

    features: tuple[str, ...]
    cuts: list[np.ndarray]
    intercept: float
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Bin numbers, one column per feature; NaN and null count as 0."""
        values = np.nan_to_num(values)
        return np.stack([np.searchsorted(c, values[:, j], "right") for j, c in enumerate(self.cuts)], axis=1)

    def margin(self, values: np.ndarray) -> np.ndarray:
        bins = self.bins(values)
        out = np.full(len(values), self.intercept)
        for j, table in enumerate(self.tables):
            out += table[bins[:, j]]
        for i, j, coarse_i, coarse_j, table in self.pairs:
            out += table[coarse_i[bins[:, i]], coarse_j[bins[:, j]]]
        return out

    def probability(self, values: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(values), -30, 30)))


def _gain(g, h):
    return g * g / (h + _RIDGE)


def _tree(g: np.ndarray, h: np.ndarray, depth: int) -> np.ndarray:
    """Leaf values by bin of a tree of at most 2**depth leaves on the bins' gradient sums."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        at = int(np.argmax(gains)) + 1
        if gains[at - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_tree(g[:at], h[:at], depth - 1), _tree(g[at:], h[at:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + _RIDGE))


def _cross(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and cell values of the best cut of a two-way table into four quarters."""
    def corners(x):
        c = x.cumsum(0).cumsum(1)
        a = c[:-1, :-1]
        return np.stack([a, c[:-1, -1:] - a, c[-1:, :-1] - a, c[-1, -1] - c[:-1, -1:] - c[-1:, :-1] + a])

    qg, qh = corners(g), corners(h)
    gains = _gain(qg, qh).sum(0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    leaf = qg[:, i, j] / (qh[:, i, j] + _RIDGE)
    cells = np.empty(g.shape)
    cells[:i + 1, :j + 1], cells[:i + 1, j + 1:], cells[i + 1:, :j + 1], cells[i + 1:, j + 1:] = leaf
    return float(gains[i, j] - _gain(g.sum(), h.sum())), cells


def fit(values: np.ndarray, labels: np.ndarray, features: Sequence[str], bins: int = 48, turns: int = 160,
        rate: float = 0.12, depth: int = 2, n_pairs: int = 6, coarse: int = 8) -> Gam:
    """Boost the tables on rows of ``values`` and 0/1 ``labels``; the same rows give the same model."""
    values, y = np.nan_to_num(np.asarray(values, float)), np.asarray(labels, float)
    cuts = [np.unique(np.quantile(values[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(values.shape[1])]
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Gam(tuple(features), cuts, float(np.log(share / (1 - share))), [np.zeros(len(c) + 1) for c in cuts])
    binned = model.bins(values)
    margin = np.full(len(y), model.intercept)

    def slopes():
        p = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return y - p, p * (1 - p)

    for _ in range(turns):
        for j, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(binned[:, j], g, len(table)), np.bincount(binned[:, j], h, len(table)), depth)
            table += step
            margin += step[binned[:, j]]
    # The pairs whose best cut still gains most are boosted on coarse grids of equal bin ranges.
    maps = [np.minimum(np.arange(len(c) + 1) * coarse // (len(c) + 1), coarse - 1) for c in cuts]
    g, h = slopes()
    ranked = []
    for i, j in combinations(range(len(cuts)), 2):
        cell = maps[i][binned[:, i]] * coarse + maps[j][binned[:, j]]
        gain, _ = _cross(*(np.bincount(cell, x, coarse * coarse).reshape(coarse, coarse) for x in (g, h)))
        ranked.append((-gain, i, j))
    chosen = [(i, j, maps[i][binned[:, i]], maps[j][binned[:, j]], np.zeros((coarse, coarse))) for _, i, j in sorted(ranked)[:n_pairs]]
    for _ in range(turns // 4):
        for i, j, at_i, at_j, table in chosen:
            g, h = slopes()
            sums = [np.bincount(at_i * coarse + at_j, x, coarse * coarse).reshape(coarse, coarse) for x in (g, h)]
            step = rate * _cross(*sums)[1]
            table += step
            margin += step[at_i, at_j]
    model.pairs = [(i, j, maps[i], maps[j], table) for i, j, _, _, table in chosen]
    return model


def fit_rows(records: DataFrame, features: Sequence[str], label: str, fit_limit: int = FIT_ROWS, key: str | None = None) -> Gam:
    """Fit on at most ``fit_limit`` rows of ``records``, those whose ``key`` (or features) hashes lowest, if there are more.

    Rows without a label are left out; with no labelled row the model scores 0.5 everywhere. The rows are counted first and
    thinned by their hash where they are, so what is sorted and sent on doesn't grow with the table.
    """
    drawn = F.shiftrightunsigned(F.xxhash64(*([key] if key else features)), 24)
    rows = records.filter(F.col(label).isNotNull()).select(
        *[F.col(c).cast("double") for c in features], F.col(label).cast("double"), drawn.alias("_drawn"))
    share = min(1.0, 1.1 * fit_limit / max(1, rows.count()))
    thinned = rows.filter(F.col("_drawn") < int(share * (1 << 40)))
    sample = thinned.orderBy("_drawn", *features, label).limit(fit_limit).drop("_drawn").toPandas().to_numpy(float)
    if not len(sample):
        sample = np.array([[0.0] * len(features) + [0.0], [0.0] * len(features) + [1.0]])
    return fit(sample[:, :-1], sample[:, -1], features)


def score(records: DataFrame, model: Gam, name: str = "score") -> DataFrame:
    """``records`` with the probability of label 1 in column ``name``; a null feature counts as 0."""
    @F.arrow_udf(DoubleType())
    def look_up(*columns: pa.Array) -> pa.Array:
        values = [c.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for c in columns]
        return pa.array(model.probability(np.stack(values, axis=1)))

    return records.withColumn(name, look_up(*[F.col(c).cast("double") for c in model.features]))


def _judged(feedback: DataFrame, labels: DataFrame, label: str, held_out: int, fit_limit: int, *dropped: str) -> DataFrame:
    """``feedback`` with ``held_out`` and ``score``; its rows are measured once and stored with what is carried."""
    measured = stored(note_features(feedback).drop(*dropped), "gam-features")
    out = F.coalesce(F.crc32(F.col("tile_id").cast("string").cast("binary")) % held_out == 0, F.lit(False))
    known = (labels.filter(F.col("tile_id").isNotNull() & F.col(label).isNotNull())
             .groupBy("tile_id").agg(F.max(label).alias("_label")))
    learned = measured.select("tile_id", *NOTE_FEATURES).filter(~out).join(known, "tile_id")
    return score(measured, fit_rows(learned, NOTE_FEATURES, "_label", fit_limit, "tile_id"), "_score").withColumn("_held_out", out)


def grade_notes(feedback: DataFrame, labels: DataFrame, label: str = "gt_label", held_out: int = 5, threshold: float = 0.3,
                fit_limit: int = FIT_ROWS) -> DataFrame:
    """Score the quality of every row's notes, having learned from ``labels`` ``(tile_id, <label> 0/1)``.

    Rows whose crc32 of the ``tile_id`` as text is a multiple of ``held_out`` never enter the fit, which takes
    at most ``fit_limit`` rows; only ``NOTE_FEATURES`` of the whole text are inputs. Returns one row per row of
    ``feedback``: ``tile_id``, ``held_out``, ``score`` (0 to 1) and ``predicted`` (1 if score >= ``threshold``).
    Null and empty notes are scored as texts without words; a null ``tile_id`` is scored, never learned from and not held
    out. Of several labels of a tile the highest counts; a tile on several rows is learned from once per row.
    Tables without rows give no rows; without labels every score is 0.5. Other columns are not read.
    """
    return _judged(feedback.select("tile_id", "notes"), labels, label, held_out, fit_limit, "notes").select(
        "tile_id", F.col("_held_out").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"))


def keep_good(feedback: DataFrame, labels: DataFrame, label: str = "gt_label", held_out: int = 5, threshold: float = 0.3,
              fit_limit: int = FIT_ROWS) -> DataFrame:
    """The rows of ``feedback`` that ``grade_notes`` predicts as 1, all columns kept, each as often as it came in.

    Each row is judged on its own text. The row travels as one struct, so no column's name can clash.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in feedback.columns]).alias("_row")
    judged = _judged(feedback.select("tile_id", "notes", row), labels, label, held_out, fit_limit, "notes")
    return judged.filter(F.col("_score") >= threshold).select("_row.*")
