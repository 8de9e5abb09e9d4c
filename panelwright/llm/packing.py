"""Packing documents into token windows by the sum of squares of the fill levels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .files import ship_package
from .memory import with_tables_of
from .tokens import REMEMBERED_BYTES, encoder

WINDOW = 1024
END_ID = 0
# Sequence numbers carry the partition above this bit.
_LOCAL_BITS = 33

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary()),
])


class LevelPacker:
    """Windows being filled, counted by fill level.

    ``counts[h]`` is the number of open windows that hold h tokens. A piece goes
    to the level where the sum of squared counts is least afterwards: a window of
    that level moves up by the piece's length, or a new one starts. Of equal
    choices the fullest window wins. Only the pieces of open windows are held.
    """

    def __init__(self, window: int, first_sequence: int):
        self.window = window
        self.counts = np.zeros(window + 1, dtype=np.int64)
        self._open: dict[int, list[list]] = {}
        self._next = first_sequence

    def _emit(self, pieces: list) -> Iterator[tuple]:
        sequence, offset = self._next, 0
        self._next += 1
        for doc_id, start, ids, doc_tokens in pieces:
            length = len(ids) // 4
            yield doc_id, start, length, doc_tokens, sequence, offset, ids
            offset += length

    def _choose(self, length: int) -> int:
        """The level to put a piece on; 0 starts a window."""
        new_cost = 2 * self.counts[length] + 1
        levels = self.counts[1 : self.window - length + 1]
        if not levels.any():
            return 0
        after = 2 * self.counts[length + 1 :] + 1
        after[-1] = 0  # a full window is no longer counted
        cost = np.where(levels > 0, after - 2 * levels + 1, np.iinfo(np.int64).max)
        best = len(cost) - 1 - int(cost[::-1].argmin())
        return best + 1 if cost[best] <= new_cost else 0

    def add(self, doc_id, ids: bytes) -> Iterator[tuple]:
        """Place one document; yields the pieces of windows that are full now."""
        total, width = len(ids) // 4, self.window * 4
        whole = total // self.window
        for i in range(whole):
            yield from self._emit([(doc_id, i * self.window, ids[i * width : (i + 1) * width], total)])
        rest = total - whole * self.window
        if not rest:
            return
        level = self._choose(rest)
        pieces = []
        if level:
            pieces = self._open[level].pop()
            self.counts[level] -= 1
        pieces.append((doc_id, whole * self.window, ids[whole * width :], total))
        if level + rest == self.window:
            yield from self._emit(pieces)
        else:
            self.counts[level + rest] += 1
            self._open.setdefault(level + rest, []).append(pieces)

    def finish(self) -> Iterator[tuple]:
        """Empty the open windows into full ones, cutting pieces at window ends;
        a partition leaves one window unfilled at most."""
        current, room = [], self.window
        for level in sorted(self._open, reverse=True):
            for pieces in self._open[level]:
                for doc_id, start, ids, doc_tokens in pieces:
                    while ids:
                        part = ids[: room * 4]
                        current.append((doc_id, start, part, doc_tokens))
                        start, ids, room = start + len(part) // 4, ids[room * 4 :], room - len(part) // 4
                        if not room:
                            yield from self._emit(current)
                            current, room = [], self.window
        if current:
            yield from self._emit(current)
        self._open.clear()
        self.counts[:] = 0


def pack(
    docs: DataFrame, vocabulary: str, window: int = WINDOW, id_column: str = "doc_id", text_column: str = "text",
    end_id: int = END_ID, remembered_bytes: int = REMEMBERED_BYTES,
) -> DataFrame:
    """Cut and pack all documents into sequences of at most ``window`` tokens.

    One row per piece: ``start`` is its place in its document of ``doc_tokens``
    ids (the end id included), ``offset`` its place in sequence ``sequence_id``,
    ``ids`` its little-endian unsigned 32-bit ids.

    Each task packs its own input partition, so nothing is shuffled and a task
    that runs again gives the same pieces. Null and empty texts are documents of
    the end id alone. Documents longer than a window fill windows of their own;
    only the remainder is placed. Repeated rows are packed each. An empty table
    gives no row; other columns are ignored. A worker remembers the ids of pieces of
    text up to ``remembered_bytes``; fewer cost time and change no result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(vocabulary, remembered_bytes).encode, np.array([end_id], dtype="<u4").tobytes()
        packer = LevelPacker(window, TaskContext.get().partitionId() << _LOCAL_BITS)
        out, held = [], 0

        def flush() -> pa.RecordBatch:
            columns = zip(*out) if out else [[]] * len(_ARROW)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for piece in packer.add(doc_id, encode(text.as_py()) + end):
                    out.append(piece)
                    held += len(piece[-1])
                if held > 8 << 20:
                    yield flush()
                    out, held = [], 0
        out.extend(packer.finish())
        if out:
            yield flush()

    ship_package(docs.sparkSession)
    texts = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    return texts.mapInArrow(with_tables_of("tokens", work), SCHEMA)
