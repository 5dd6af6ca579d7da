"""Sum-of-squares online packing of tokenised documents into windows.

Each document's whole windows are cut off; its rest goes to the fill level for which the sum of
squared counts of partially filled windows becomes least. A level array holds those counts and, by
level, the open windows. What is still open at the end of a task is joined and cut anew, and the
last rest becomes windows at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowgrid.llm.bpe import binary_encoder, slices

WINDOW = 2048
#: Open windows in a task before they are joined and cut anew: bounds a task's memory.
OPEN_WINDOWS = 4096

PIECE = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
        T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()),
        T.StructField("offset", T.LongType()),
    ]
)


class SumOfSquares:
    """The packer of one task. Items are (doc_id, start, ids, doc_tokens), ids as bytes."""

    def __init__(self, first_id: int, window: int = WINDOW, most_open: int = OPEN_WINDOWS) -> None:
        self.window, self.most_open, self.next_id = window, most_open, first_id
        self.count = np.zeros(window + 1, np.int64)  # windows at each fill level; 0 and full stay 0
        self.levels: dict[int, list[list]] = {}
        self.n_open = 0
        self.done: list[tuple] = []

    def level_for(self, size: int) -> int:
        """The fill level to place ``size`` at: least sum of squares, then the fullest."""
        last = self.window - size
        before, after = self.count[: last + 1], self.count[size:]
        change = 2 * after + 1 - 2 * before + 1
        change[0] = 2 * after[0] + 1  # a new window leaves no level
        change[last] -= 2 * after[last] + 1  # a full window is no longer partial
        usable = before > 0
        usable[0] = True
        change = np.where(usable, change, np.iinfo(np.int64).max)
        return int(last - np.argmin(change[::-1]))

    def _emit(self, items: list) -> None:
        at = 0
        for doc, start, ids, total in items:
            n = len(ids) // 4
            self.done.append((doc, start, n, zlib.crc32(ids), total, self.next_id, at))
            at += n
        self.next_id += 1

    def add(self, doc: int | None, ids: bytes) -> None:
        total, step = len(ids) // 4, 4 * self.window
        whole = len(ids) // step * step
        for at in range(0, whole, step):
            self._emit([(doc, at // 4, ids[at : at + step], total)])
        if whole == len(ids):
            return
        item = (doc, whole // 4, ids[whole:], total)
        size = total - whole // 4
        level = self.level_for(size)
        if level:
            items = self.levels[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        else:
            items = []
        items.append(item)
        if level + size == self.window:
            self._emit(items)
            return
        self.levels.setdefault(level + size, []).append(items)
        self.count[level + size] += 1
        self.n_open += 1
        if self.n_open >= self.most_open:
            self.drain(last=False)

    def drain(self, last: bool = True) -> None:
        """Join what all open windows hold and cut it to full ones; the rest stays open, or at the
        end becomes windows at powers of two."""
        rest = [x for level in sorted(self.levels, reverse=True) for items in self.levels[level] for x in items]
        self.levels.clear()
        self.count[:] = 0
        self.n_open = 0
        room, window = self.window, []
        left = sum(len(x[2]) // 4 for x in rest)
        if left < room and last:
            room = 1 << left.bit_length() - 1 if left else 0
        for doc, start, ids, total in rest:
            while ids:
                part = ids[: 4 * room]
                window.append((doc, start, part, total))
                n = len(part) // 4
                start, ids, room, left = start + n, ids[4 * n :], room - n, left - n
                if not room:
                    self._emit(window)
                    room, window = self.window, []
                    if left < room and last and left:
                        room = 1 << left.bit_length() - 1
        if window:
            fill = self.window - room
            self.levels[fill] = [window]
            self.count[fill] = 1
            self.n_open = 1

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


def pack_documents(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 1, window: int = WINDOW) -> DataFrame:
    """Pack every whole text of ``docs``; one row per piece, as PIECE names them.

    A null or empty text has the end id alone. A null doc_id stays null; repeated rows are packed
    each. A task with OPEN_WINDOWS windows that are partly filled joins their rests and cuts them anew
    into whole ones before it goes on, which bounds its memory. Tasks pack independently, under sequence ids that hold their number, so nothing is
    shuffled and a task that runs again gives the same pieces. An empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = binary_encoder(tokenizer_path), end_id.to_bytes(4, "little")
        packer = SumOfSquares((TaskContext.get().partitionId() if TaskContext.get() else 0) << 36, window)

        def out() -> pa.RecordBatch:
            rows = packer.take()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * len(PIECE))], names=PIECE.names)

        for batch in batches:
            for small in slices(batch):
                for doc, t in zip(small.column(0).to_pylist(), small.column(1), strict=True):
                    packer.add(doc, b"".join(encoder.fragments(t.as_py() or "")) + end)
                yield out()
        packer.drain()
        yield out()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, PIECE)
