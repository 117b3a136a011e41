"""Sequences of at most 1024 tokens, packed online by the sum-of-squares rule.

A document that does not fit is cut: its full windows stand alone and the rest is placed. A level array
counts the open windows of each fill level; a rest goes where the sum of the squared counts
grows least, which keeps the fill levels spread out, so that whatever comes finds a window that it
completes. Windows that are still open at the end of a task are completed by cutting: the emptiest are
dealt out over the gaps of the fullest. So a task leaves one padded sequence at most.

Every task packs what it reads, without a shuffle, and holds a bounded number of open windows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.tokens import default_path, encoder

LENGTH = 1024
#: The id that ends a document.
END = 0
#: Windows that may be open at once; beyond it the open ones are completed by cutting.
MOST_OPEN = 512
#: A task's number is multiplied by this to keep its sequence ids apart.
SEQUENCES_PER_TASK = 1 << 40


@dataclass
class Piece:
    """Tokens of one document that lie together: ids as bytes, four for each."""

    doc: object
    start: int
    ids: bytes
    total: int

    def __len__(self) -> int:
        return len(self.ids) // 4

    def cut(self, at: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[: 4 * at], self.total),
            Piece(self.doc, self.start + at, self.ids[4 * at :], self.total),
        )


@dataclass
class Packer:
    """Places pieces; ``closed`` holds finished sequences until they are taken."""

    length: int = LENGTH
    most_open: int = MOST_OPEN
    closed: list[list[Piece]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.levels = np.zeros(self.length + 1, np.int64)
        self.open: list[list[list[Piece]]] = [[] for _ in range(self.length + 1)]

    def add(self, doc, ids: bytes) -> None:
        piece = Piece(doc, 0, ids, len(ids) // 4)
        while len(piece) >= self.length:
            full, piece = piece.cut(self.length)
            self.closed.append([full])
        if len(piece):
            self._place(piece)
            if int(self.levels.sum()) > self.most_open:
                self._complete()

    def level_for(self, size: int) -> int:
        """The fill level, 0 for a new window, that a piece joins with the least growth of the sum of squares.

        Ties go to the fullest window.
        """
        counts = self.levels
        to = counts[size:].astype(np.int64) * 2 + 1
        to[-1] = 0  # a full window is no longer counted
        growth = to - (2 * counts[: self.length + 1 - size] - 1)
        growth[0] = to[0]  # a new window leaves no level
        allowed = counts[: self.length + 1 - size] > 0
        allowed[0] = True
        growth = np.where(allowed, growth, np.iinfo(np.int64).max)
        return int(len(growth) - 1 - np.argmin(growth[::-1]))

    def _place(self, piece: Piece) -> None:
        level = self.level_for(len(piece))
        if level:
            window = self.open[level].pop()
            self.levels[level] -= 1
        else:
            window = []
        window.append(piece)
        self._put(window, level + len(piece))

    def _put(self, window: list[Piece], level: int) -> None:
        if level == self.length:
            self.closed.append(window)
        elif level:
            self.open[level].append(window)
            self.levels[level] += 1

    def _complete(self) -> None:
        """Deal the emptiest open windows out over the gaps of the fullest; one window at most stays open."""
        windows = [w for level in range(self.length - 1, 0, -1) for w in self.open[level]]
        self.__post_init__()
        first, last = 0, len(windows) - 1
        while first < last:
            window = windows[first]
            gap = self.length - sum(map(len, window))
            while gap and first < last:
                piece = windows[last].pop()
                if len(piece) > gap:
                    piece, rest = piece.cut(gap)
                    windows[last].append(rest)
                window.append(piece)
                gap -= len(piece)
                if not windows[last]:
                    last -= 1
            if gap == 0:
                self.closed.append(window)
                first += 1
        if first == last:
            self._put(windows[first], sum(map(len, windows[first])))

    def finish(self) -> None:
        self._complete()
        self.closed += [w for level in self.open for w in level]
        self.__post_init__()


def pack(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids: a row for every piece of every document.

    A document is its ids, those of special tokens in the text included, and then the id 0; ids holds those of the piece, four bytes each, least first. A null
    or empty text is the closing id alone. Rows with null or repeated doc_ids are documents of their own, and
    nothing joins them but their id. Other columns are not read; an empty table has no pieces. A
    task that is run again on the same input packs it the same way. A text of any length is taken
    whole, one at a time.
    """
    path = path or default_path()
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches):
        encode, packer = encoder(path).encode_plain, Packer()
        end = np.array([END], "<u4").tobytes()
        number = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        id_type = None

        def rows():
            nonlocal number
            columns: tuple[list, ...] = ([], [], [], [], [], [], [])
            for window in packer.closed:
                offset = 0
                for piece in window:
                    values = (piece.doc, piece.start, len(piece), piece.total, number, offset, piece.ids)
                    for column, value in zip(columns, values):
                        column.append(value)
                    offset += len(piece)
                number += 1
            packer.closed.clear()
            types = [id_type, *[pa.int64()] * 5, pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)],
                names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
            )

        for batch in batches:
            id_type = batch.schema.field(0).type
            for doc, text in zip(batch.column(0), batch.column(1)):
                packer.add(doc.as_py(), encode(text.as_py() or "") + end)
                if len(packer.closed) >= 4096:
                    yield rows()
            yield rows()
        if id_type is not None:
            packer.finish()
            yield rows()

    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def packed_digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The pieces with a CRC-32 of their ids in place of the ids."""
    pieces = pack(docs, path)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
