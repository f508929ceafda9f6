"""Packing notes into training windows by the sum-of-squares rule.

Every task packs the rows of its partition as they come. An array counts the open windows of each fill level; a
document goes to the level for which the sum of the squared counts comes out smallest, a new window being
level 0. When the rows are used up, open windows top each other up, since texts may be cut anywhere.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the packed form.
WINDOW, END_ID = 4096, 2
#: Words, and words stripped of case and marks, that a worker remembers the ids of; any further one is encoded each time.
REMEMBERED, REMEMBERED_BODIES = 250_000, 750_000


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit bytes, word by word.

    Words end at ASCII white space, which the tokenizer drops and never encodes across, so a text's ids
    are its words' ids in order. Words are remembered, whole and without case and marks. A text's
    unknown words of letters only are encoded in one call: each ends at the one id whose token closes a word.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer, self.known, self.bodies = Tokenizer.from_file(path), {}, {}
        # Of letters of these alphabets and marks only, a word and the marks after it are encoded apart.
        self.marks = {m: self._ids(m) for m in (".", ",", "|", "!!", "###", "***", "$$$", "%%%", "&&&")}
        self.closing = {i for token, i in self.tokenizer.get_vocab().items() if token.endswith("</w>")}

    def _ids(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _split(self, word: str) -> tuple[str, bytes]:
        """A word's lower-case letters and the ids of the marks after them, or the word as it is."""
        if word.isalpha():
            return (word.lower(), b"") if max(word) < "ƀ" else (word, b"")
        for m, ids in self.marks.items():
            if word.endswith(m) and word[:-len(m)].isalpha():
                body = word[:-len(m)]
                return (body.lower(), ids) if max(body) < "ƀ" else (body, ids)
        return word, b""

    def _encode_new(self, bodies: list[str]) -> dict[str, bytes]:
        letters = [b for b in bodies if b.isalpha()]
        out, word, flat = {}, array("I"), []
        for i in self.tokenizer.encode(" ".join(letters), add_special_tokens=False).ids if letters else ():
            word.append(i)
            if i in self.closing:
                flat.append(word.tobytes())
                word = array("I")
        if len(flat) == len(letters) and not word:
            out.update(zip(letters, flat))
        for b in bodies:
            if b not in out:
                out[b] = self._ids(b)
        return out

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of words not remembered as they stand."""
        split = {w: self._split(w) for w in words}
        new = self._encode_new(list({b for b, _ in split.values() if b not in self.bodies}))
        out = {w: (self.bodies.get(b) or new.get(b, b"")) + mark for w, (b, mark) in split.items()}
        if len(self.bodies) < REMEMBERED_BODIES:
            self.bodies.update((b, ids) for b, ids in new.items() if len(b) < 64)
        if len(self.known) < REMEMBERED:
            self.known.update((w, ids) for w, ids in out.items() if len(w) < 64)
        return out

    def encode(self, text: bytes) -> bytes:
        # Splitting bytes takes ASCII white space only, unlike splitting a string.
        if b"\x00" in text:
            words = [str(w, "utf-8") for w in text.split()]
        else:
            words = [w for w in str(b"\x00".join(text.split()), "utf-8").split("\x00") if w]
        get = self.known.get
        ids = [get(w) for w in words]
        if None in ids:
            learned = self._learn({w for w, i in zip(words, ids) if i is None})
            ids = [learned[w] if i is None else i for w, i in zip(words, ids)]
        return b"".join(ids)


@cache
def _encoder(path: str) -> Encoder:
    return Encoder(path)


class _Open:
    """A partly filled window and its pieces (tile_id, start, ids, ids of the whole document)."""
    __slots__ = ("fill", "pieces")

    def __init__(self):
        self.fill, self.pieces = 0, []

    def add(self, tile_id, start: int, ids: bytes, total: int) -> None:
        self.pieces.append((tile_id, start, self.fill, ids, total))
        self.fill += len(ids) // 4


class Packer:
    """Sum-of-squares packing of one stream of documents; ``closed`` fills with finished windows."""

    def __init__(self, window: int = WINDOW):
        self.window, self.closed = window, []
        self.counts = np.zeros(window + 1, np.int64)
        self.open: dict[int, list[_Open]] = {}

    def level_for(self, size: int) -> int:
        """The fill level (0: a new window) to put ``size`` ids at; ties go to the fullest."""
        n = self.counts
        levels = np.nonzero(n[1:self.window - size + 1])[0] + 1
        to = levels + size
        # Moving a window from h to h + s changes the squares by 2 (n[h+s] - n[h]) + 2; a full window leaves the count.
        change = np.where(to < self.window, 2 * (n[to] - n[levels]) + 2, 1 - 2 * n[levels])
        best, at = (2 * n[size] + 1, 0) if size < self.window else (0, 0)
        if len(levels):
            i = len(levels) - 1 - int(np.argmin(change[::-1]))
            if change[i] <= best:
                at = int(levels[i])
        return at

    def add(self, tile_id, ids: bytes) -> None:
        """Cut off full windows, then place the rest of the document."""
        total, step = len(ids) // 4, 4 * self.window
        full = total // self.window
        for k in range(full):
            w = _Open()
            w.add(tile_id, k * self.window, ids[k * step:(k + 1) * step], total)
            self.closed.append(w.pieces)
        rest = ids[full * step:]
        if rest:
            self.place(tile_id, full * self.window, rest, total)

    def place(self, tile_id, start: int, ids: bytes, total: int) -> None:
        level = self.level_for(len(ids) // 4)
        if level:
            w = self.open[level].pop()
            self.counts[level] -= 1
        else:
            w = _Open()
        w.add(tile_id, start, ids, total)
        if w.fill == self.window:
            self.closed.append(w.pieces)
        else:
            self.counts[w.fill] += 1
            self.open.setdefault(w.fill, []).append(w)

    def finish(self) -> None:
        """Top up the fullest open windows with the pieces of the emptiest, cut as needed.

        One window at most stays partly filled; it is cut into windows whose lengths are powers of two, which are not padded.
        """
        left = sorted((w for level in self.open.values() for w in level), key=lambda w: -w.fill)
        self.open, pending = {}, []
        self.counts[:] = 0
        at, last = 0, len(left) - 1
        while at < last:
            w = left[at]
            while w.fill < self.window and (pending or at < last):
                if not pending:
                    pending, last = [(t, s, ids, total) for t, s, _, ids, total in left[last].pieces], last - 1
                tile_id, start, ids, total = pending.pop()
                room = 4 * (self.window - w.fill)
                w.add(tile_id, start, ids[:room], total)
                if len(ids) > room:
                    pending.append((tile_id, start + room // 4, ids[room:], total))
            if w.fill == self.window:
                self.closed.append(w.pieces)
                at += 1
        pieces = [(t, s, ids, total) for w in left[at:last + 1] for t, s, _, ids, total in w.pieces] + pending
        while pieces:
            size = sum(len(p[2]) // 4 for p in pieces)
            # What pending held may exceed a window by less than another one.
            room, w = 4 * min(self.window, 1 << (size.bit_length() - 1)), _Open()
            while room:
                tile_id, start, ids, total = pieces.pop(0)
                w.add(tile_id, start, ids[:room], total)
                if len(ids) > room:
                    pieces.insert(0, (tile_id, start + room // 4, ids[room:], total))
                room -= min(room, len(ids))
            self.closed.append(w.pieces)


def pack_notes(feedback: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Cut the ids of every row's whole ``notes`` into windows of ``window`` ids; one row per piece.

    ``tokenizer`` is the path of a ``tokenizers`` file that every executor has. A row's ids are its text's, without special tokens, then
    ``end_id``; a null text counts as empty, so each row has at least one id. Returns ``tile_id``, ``start`` (ids of the row before the piece),
    ``length``, ``ids`` (binary, little-endian unsigned 32-bit), ``note_ids`` (ids of the row), ``window_id`` (long, unique in the
    table), ``offset`` (place in the window, gapless from 0). Each id of a row lies in one piece. Windows are full, or of a power of two
    ids, at most 12 of those a partition. Repeated rows and rows without ``tile_id`` are packed like any other; other columns are not read; no rows give no rows.
    A narrow step; a task holds its open windows only. Rerun over the same partitions it gives the same windows.
    """
    kind = feedback.schema["tile_id"].dataType.simpleString()
    names = ["tile_id", "start", "length", "ids", "note_ids", "window_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = _encoder(tokenizer), Packer(window)
        first, number, end = TaskContext.get().partitionId() << 33, 0, np.array([end_id], "<u4").tobytes()
        id_type = None

        def emit() -> pa.RecordBatch:
            nonlocal number
            rows = [(t, s, len(ids) // 4, ids, total, first + number + k, offset)
                    for k, pieces in enumerate(packer.closed) for t, s, offset, ids, total in pieces]
            number += len(packer.closed)
            packer.closed = []
            types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            id_type = batch.column(0).type
            for tile_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                packer.add(tile_id, encoder.encode(text.as_py() or b"") + end)
                if len(packer.closed) >= 256:
                    yield emit()
        packer.finish()
        if packer.closed:
            yield emit()

    return feedback.select("tile_id", F.col("notes").cast("string")).mapInArrow(
        run, f"tile_id {kind}, start long, length long, ids binary, note_ids long, window_id long, offset long")
