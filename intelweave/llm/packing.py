"""Sum-of-squares online packing of documents into training sequences.

A document is tokenised, closed with an end token and cut into whole windows and a rest. The rests of a task are
packed one by one: of all fill levels with an open window, and the level of a new one, a rest goes where the sum
of the squared numbers of open windows by level is least afterwards. Only the level array and the few open
windows are held. At the end of a task, and whenever many windows are open, the emptiest windows are cut up to
fill the fullest, so that a task leaves one partly filled sequence at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import TOKENIZER, blocks, rested, tokenizer_path
from .transducer import transducer

#: Open windows of a task after which the emptiest are used up.
OPEN_WINDOWS = 2048
#: Rows of one output batch.
ROWS = 4096
#: Sequence ids of one task lie within 2 ** TASK_BITS of each other.
TASK_BITS = 40


class Levels:
    """Open windows by fill level."""

    def __init__(self, window: int):
        self.window = window
        self.open = np.zeros(window + 1, np.int64)
        self.stacks: list[list[int]] = [[] for _ in range(window + 1)]

    def place(self, size: int) -> int:
        """The level to put a piece of size on (0: a new window); ties go to the fullest."""
        w = self.window
        before, after = self.open[: w - size + 1], self.open[size:]
        # half of what the sum of squares grows by: a window leaves level h and enters h + size
        grows = after - before + 1.0
        grows[0] = after[0] + 0.5
        grows[w - size] = (0.5 - before[w - size]) if size < w else 0.0
        grows[1:][before[1:] == 0] = np.inf
        return w - size - int(np.argmin(grows[::-1]))

    def move(self, window: int, level: int, size: int) -> None:
        if level:
            self.open[level] -= 1
        if level + size < self.window:
            self.open[level + size] += 1
            self.stacks[level + size].append(window)


class Packer:
    def __init__(self, window: int, first_id: int):
        self.window, self.next = window, first_id
        self.levels = Levels(window)
        self.held: dict[int, list[tuple]] = {}  # pieces of open windows: (id, start, ids, doc_tokens)
        self.rows: list[tuple] = []

    def _new(self) -> int:
        self.next += 1
        return self.next - 1

    def _close(self, number: int, pieces: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in pieces:
            self.rows.append((doc, start, len(ids), ids, n, number, offset))
            offset += len(ids)

    def add(self, doc, ids: np.ndarray) -> None:
        w, n = self.window, len(ids)
        whole = n - n % w
        for start in range(0, whole, w):
            self._close(self._new(), [(doc, start, ids[start : start + w], n)])
        if whole == n:
            return
        size = n - whole
        level = self.levels.place(size)
        number = self.levels.stacks[level].pop() if level else self._new()
        self.held.setdefault(number, []).append((doc, whole, ids[whole:].copy(), n))  # a view would hold all of a long document
        self.levels.move(number, level, size)
        if level + size == w:
            self._close(number, self.held.pop(number))
        if len(self.held) > OPEN_WINDOWS:
            self.fill()

    def fill(self) -> None:
        """Fill the fullest open windows with pieces cut from the emptiest; one stays open at most."""
        size = {k: sum(len(p[2]) for p in pieces) for k, pieces in self.held.items()}
        order = sorted(self.held, key=lambda k: (-size[k], k))
        i, j = 0, len(order) - 1
        while i < j:
            to, gap = self.held[order[i]], self.window - size[order[i]]
            while gap and i < j:
                source = self.held[order[j]]
                doc, start, ids, n = source.pop()
                took = min(gap, len(ids))
                to.append((doc, start + len(ids) - took, ids[len(ids) - took :], n))
                if took < len(ids):
                    source.append((doc, start, ids[: len(ids) - took], n))
                gap -= took
                size[order[j]] -= took
                if not source:
                    del self.held[order[j]]
                    j -= 1
            if not gap:
                self._close(order[i], self.held.pop(order[i]))
                i += 1
            else:
                size[order[i]] = self.window - gap
        self.levels = Levels(self.window)
        for k, pieces in self.held.items():
            self.levels.move(k, 0, sum(len(p[2]) for p in pieces))

    def end(self) -> None:
        self.fill()
        for k in list(self.held):
            self._close(k, self.held.pop(k))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, end_id: int = 0, tokenizer: str = TOKENIZER) -> DataFrame:
    """One row per piece: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    A null text is empty: its document is the end token alone. A null id is kept. Repeated rows are documents of
    their own. Other columns aren't read. An empty table gives no pieces. Documents are packed where they lie, so
    nothing is shuffled; a lost task packs the same rows in the same order again when its input is a file scan.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = transducer(tokenizer_path(tokenizer))
        packer = Packer(window, TaskContext.get().partitionId() << TASK_BITS)

        def flush() -> pa.RecordBatch:
            cols = list(zip(*packer.rows, strict=True)) if packer.rows else [[]] * 7
            packer.rows = []
            kinds = (id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
            cols[3] = [i.astype("<u4").tobytes() for i in cols[3]]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["__id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for rows, texts in blocks(batches, "__text"):
            id_type = rows.column(0).type
            for doc, ids in zip(rows.column(0).to_pylist(), machine.id_texts(texts), strict=True):
                packer.add(doc, np.append(ids, np.int32(end_id)))
                if len(packer.rows) >= ROWS:
                    yield flush()
        packer.end()
        yield flush()

    plain = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    kind = plain.schema["__id"].dataType.simpleString()
    out = plain.mapInArrow(rested(run), f"__id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumnRenamed("__id", id_col)


def padding(length):
    """Padding of a sequence of that many tokens: up to the window, none at a power of two. A Column of lengths."""
    return F.when(F.bit_count(length) == 1, 0).otherwise(1024 - length)
