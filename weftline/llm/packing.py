"""Sum-of-squares packing of documents into windows of a fixed number of tokens.

A task packs the documents it reads, one after the other.  A document's full windows are
closed at once; its rest goes to the level (the fill of open windows) that leaves the
sum of squared level counts smallest, which keeps every level rare and so the number of
windows that stay open small.  Counts are kept in a level array; equal costs go to the
fullest level.  At the end the windows still open fill each other up, cutting pieces,
and the last is cut into powers of two, at which sequences need no padding.

There is no shuffle, and a task that is run again packs its rows alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches
from weftline.llm.tokens import encoder, shared_source

WINDOW = 2048
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class SumOfSquares:
    """Open windows by level.  A piece is (document, start, ids); ``add`` returns closed windows."""

    def __init__(self, window: int):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)  # the level array; 0 and window stay 0
        self.open: dict[int, list[list]] = {}

    def level_for(self, size: int) -> int:
        """The level to put ``size`` tokens on; 0 opens a window."""
        last = self.window - size
        old = self.count[1 : last + 1]
        new = 2 * self.count[size + 1 : self.window + 1] + 1
        if last >= 1:
            new[-1] = 0  # a window that becomes full leaves the array
            cost = np.where(old > 0, new - 2 * old + 1, np.iinfo(np.int64).max)
            best = last - int(np.argmin(cost[::-1]))
            if cost[best - 1] <= 2 * self.count[size] + 1:
                return best
        return 0

    def add(self, piece: tuple) -> list | None:
        size = len(piece[2])
        if size == self.window:
            return [piece]
        level = self.level_for(size)
        pieces = []
        if level:
            self.count[level] -= 1
            pieces = self.open[level].pop()
        pieces.append(piece)
        if level + size == self.window:
            return pieces
        self.count[level + size] += 1
        self.open.setdefault(level + size, []).append(pieces)
        return None

    def finish(self) -> list[list]:
        """Windows left open, joined into full ones and a rest in powers of two."""
        left = [p for level in sorted(self.open, reverse=True) for pieces in self.open[level] for p in pieces]
        self.open, self.count[:] = {}, 0
        total, closed = sum(len(p[2]) for p in left), []
        sizes = [self.window] * (total // self.window)
        rest = total % self.window
        sizes += [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]
        left.reverse()
        for size in sizes:
            pieces = []
            while size:
                doc, start, ids = left.pop()
                if len(ids) > size:
                    left.append((doc, start + size, ids[size:]))
                    ids = ids[:size]
                pieces.append((doc, start, ids))
                size -= len(ids)
            closed.append(pieces)
        return closed


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pieces of all ``docs`` (doc_id, text), with the sequence and the place each lies in.

    A null text is empty and consists of the end id; repeated rows are documents of their
    own; an empty table has no pieces.  ``ids`` are unsigned 32-bit integers.
    """
    source = shared_source(docs.sparkSession, tokenizer)

    def pack(batches):
        code, levels = encoder(source.value), SumOfSquares(window)
        end = np.array([end_id], code.dtype)
        sequence = TaskContext.get().partitionId() << 36
        out: list[tuple] = []

        def close(pieces):
            nonlocal sequence
            at = 0
            for (doc_id, n), start, ids in pieces:
                out.append((doc_id, start, len(ids), n, sequence, at, ids.astype("<u4").tobytes()))
                at += len(ids)
            sequence += 1

        def flushed():
            types = [pa.int64()] * 6 + [pa.binary()]
            names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate([code.encode(text), end])
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    piece = piece.copy() if len(piece) < window else piece  # else it keeps the whole document
                    if pieces := levels.add(((doc_id, len(ids)), start, piece)):
                        close(pieces)
                if len(out) >= 2000:
                    yield flushed()
        for pieces in levels.finish():
            close(pieces)
        if out:
            yield flushed()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, pack, PIECE_SCHEMA)
