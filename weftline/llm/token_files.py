"""Token ids in files, with Elias-Fano coded document boundaries.

A file is a Parquet table of shards.  A shard holds whole documents in ascending
``doc_id`` order: their ids one after the other, and where each begins.  Boundaries are a
rising sequence of n + 1 numbers up to u, kept in n * (2 + log2(u / n)) bits: the low
bits packed, the high bits as gaps in unary, and the place of every 256th set bit, so
that ``select(i)`` reads a document's place without decoding the others.

Writing through Spark's committer makes a retried task harmless, on any store.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.common import map_batches
from weftline.llm.tokens import encoder, shared_source

#: Ids after which a shard is closed.  A document is never cut.
SHARD_IDS = 1 << 20
SAMPLE = 256
MAGIC = b"WEF1"
HEADER = struct.Struct("<4sBBxxqqq")  # magic, bytes of an id, low bits, documents, ids, bytes of the high bits

SHARD_SCHEMA = "part int, ord int, n_docs long, before long, n_tokens long, doc_ids array<long>, image binary"
DOCUMENT_SCHEMA = "doc_id long, start long, n_tokens long, ids binary"


@dataclass
class EliasFano:
    """A rising sequence of non-negative integers; ``select(i)`` is its i-th number."""

    n: int
    width: int
    low: np.ndarray  # packed bits, little-endian
    high: np.ndarray  # packed bits, little-endian
    samples: np.ndarray  # place of set bit 0, 256, 512 ..

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        width = max(0, (top // max(n, 1)).bit_length() - 1)
        bits = (values[:, None] >> np.arange(width)) & 1
        places = (values >> width) + np.arange(n)
        high = np.zeros((int(places[-1]) + 1) if n else 0, np.uint8)
        high[places] = 1
        return cls(n, width, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"),
                   np.packbits(high, bitorder="little"), places[::SAMPLE].astype("<u4"))

    def _low(self, i: int) -> int:
        at = i * self.width
        first, last = at >> 3, (at + self.width + 7) >> 3
        return (int.from_bytes(self.low[first:last].tobytes(), "little") >> (at & 7)) & ((1 << self.width) - 1)

    def select(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        while left:  # to the next set bit, a byte at a time where a byte holds too few
            byte = int(self.high[(at + 1) >> 3]) >> ((at + 1) & 7)
            if (ones := byte.bit_count()) < left:
                left, at = left - ones, ((at + 1) | 7)
                continue
            while left:
                at += 1
                left -= byte & 1
                byte >>= 1
        return ((at - i) << self.width) | (self._low(i) if self.width else 0)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        high = (places - np.arange(self.n)) << self.width
        if not self.width:
            return high
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.width).reshape(self.n, self.width)
        return high | (bits.astype(np.int64) << np.arange(self.width)).sum(axis=1)


def shard_image(lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of a shard: header, low bits, high bits, samples, ids."""
    ef = EliasFano.of(np.concatenate([[0], np.cumsum(np.array(lengths, np.int64))]))
    head = HEADER.pack(MAGIC, ids.dtype.itemsize, ef.width, len(lengths), len(ids), len(ef.high))
    return b"".join([head, ef.low.tobytes(), ef.high.tobytes(), ef.samples.tobytes(), ids.tobytes()])


def open_shard(image: bytes) -> tuple[EliasFano, np.ndarray]:
    """Boundaries and ids of a shard, as views of its bytes."""
    magic, size, width, docs, n_ids, n_high = HEADER.unpack_from(image)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    n, at = docs + 1, HEADER.size
    low = np.frombuffer(image, np.uint8, (n * width + 7) // 8, at)
    at += len(low)
    high = np.frombuffer(image, np.uint8, n_high, at)
    at += n_high
    samples = np.frombuffer(image, "<u4", (n + SAMPLE - 1) // SAMPLE, at)
    at += samples.nbytes
    return EliasFano(n, width, low, high, samples), np.frombuffer(image, f"<u{size}", n_ids, at)


def document_at(image: bytes, i: int) -> np.ndarray:
    """The ids of the i-th document of a shard, found by two selects."""
    bounds, ids = open_shard(image)
    return ids[bounds.select(i) : bounds.select(i + 1)]


def write_token_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` (doc_id, text) with the tokenizer file and write them to ``path``.

    A null text is empty and has the end id alone; a null id sorts first; rows of one id
    are all written, by text.  The only shuffle deals the texts out by ranges of the id;
    a range is encoded and written by one task, which holds one shard at a time.
    """
    source = shared_source(docs.sparkSession, tokenizer)

    def encode(batches):
        code, part = encoder(source.value), TaskContext.get().partitionId()
        end = np.array([end_id], code.dtype)
        doc_ids, lengths, parts, size, ord_, before = [], [], [], 0, 0, 0

        def shard():
            image = shard_image(lengths, np.concatenate(parts))
            columns = [[part], [ord_], [len(doc_ids)], [before], [size], [list(doc_ids)], [image]]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "ord", "n_docs", "before", "n_tokens", "doc_ids", "image"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = code.encode(text)
                parts += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) + 1)
                size += len(ids) + 1
                if size >= SHARD_IDS:
                    yield shard()
                    before, ord_ = before + size, ord_ + 1
                    doc_ids, lengths, parts, size = [], [], [], 0
        if doc_ids:
            yield shard()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))
    map_batches(rows, encode, SHARD_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document of ``path``: doc_id, start, n_tokens and its ids (unsigned 32 bits).

    Parts hold ascending ranges of ids, so a document's start is the ids of the parts
    before (one number a part, broadcast), of the shards before and of the documents before.
    """
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"))
    placed = shards.join(F.broadcast(starts), "part").select(
        "doc_ids", (F.col("_ahead") + F.col("before")).alias("first"), "image"
    )

    def decode(batches):
        for batch in batches:
            for doc_ids, first, image in zip(*(batch.column(i) for i in range(3))):
                bounds, ids = open_shard(image.as_py())
                at, ids = bounds.all(), ids.astype("<u4")
                cells = [ids[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids.as_py(), pa.int64()), pa.array(at[:-1] + first.as_py(), pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(cells, pa.binary())],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    return placed.mapInArrow(decode, DOCUMENT_SCHEMA)
