"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches, the largest ids first.  A run is a table of (hash, number of
documents that hold the line so far, largest of them), one row a hash, bucketed and sorted
by the hash, so that a batch is merged with it without shuffling it again.  A new
batch merges its own hashes with the runs: what the runs have settled (enough documents
hold the line, and the largest is known) is left out by the merge-anti-join, everything
else is counted on and makes the batch's own run.  When a level holds ``FANOUT`` runs they
are compacted into one run of the next level, so a hash is rewritten once a level.

Hashes have 128 bits.  Only hashes and ids move while runs are built; texts move once, to
meet the lines that they lose.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.common import scratch, written

BLANKS = b" \t\n\x0b\x0c\r"
#: Code points that a line's key has at least; shorter lines are never dropped.
SHORTEST = 20
#: Documents that hold a line at least before it is dropped from all but the last.
HOLDERS = 3
#: Runs of a level that are compacted into one of the next.
FANOUT = 3
#: Batches that a whole table is cut into.
BATCHES = 4

_KEY = ["hi", "lo"]


def line_key(line: bytes, shortest: int = SHORTEST) -> bytes | None:
    """The stripped line with A-Z lowered, None if it has too few code points."""
    key = line.strip(BLANKS)
    if len(key) < shortest or (len(key) < 4 * shortest and sum((b & 0xC0) != 0x80 for b in key) < shortest):
        return None
    return key.lower()


def _hashes(text: bytes | None, shortest: int) -> list[bytes | None]:
    """The 16-byte hash of each line of a text, None for a line that is never dropped."""
    out, digest = [], xxhash.xxh3_128_digest
    for line in (text or b"").split(b"\n"):
        key = line_key(line, shortest)
        out.append(None if key is None else digest(key))
    return out


def line_hashes(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, hi, lo): the distinct line hashes of each document with an id."""

    def work(batches):
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = set(_hashes(text, shortest)) - {None}
                ids += [doc_id] * len(own)
                found += own
            halves = pa.py_buffer(b"".join(found))
            both = pa.Array.from_buffers(pa.int64(), 2 * len(found), [None, halves])
            even = pa.array(range(0, 2 * len(found), 2), pa.int64())
            odd = pa.array(range(1, 2 * len(found), 2), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), both.take(even), both.take(odd)], ["doc_id", *_KEY])

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(work, "doc_id long, hi long, lo long")


class LineRuns:
    """Levels of runs in a database of their own, whose files lie in the shared folder.

    ``add`` takes the batches in descending ranges of doc_id: all documents of a batch have
    smaller ids than those of the batches before it.  ``drop`` removes every run.
    """

    def __init__(self, spark: SparkSession, holders: int = HOLDERS, fanout: int = FANOUT):
        self.spark, self.holders, self.fanout = spark, holders, fanout
        self.database = f"line_runs_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.made = 0
        self.folder = scratch(spark, "line-runs")
        spark.sql(f"CREATE DATABASE {self.database} LOCATION '{self.folder}'")

    def _write(self, run: DataFrame) -> str:
        name = f"{self.database}.run_{self.made}"
        self.made += 1
        run.write.bucketBy(self.buckets, *_KEY).sortBy(*_KEY).option("compression", "zstd").format("parquet").saveAsTable(name)
        return name

    def runs(self) -> list[str]:
        """Names of all runs, the latest first: what a later one says of a hash holds."""
        return [name for level in self.levels for name in reversed(level)]

    def add(self, lines: DataFrame) -> None:
        """Merge a batch of (doc_id, hi, lo), one row a document and line, with the runs."""
        fresh = lines.groupBy(*_KEY).agg(F.count("doc_id").alias("holders"), F.max("doc_id").alias("last"))
        for name in self.runs():
            settled = self.spark.table(name).where(F.col("holders") >= self.holders)
            fresh = fresh.join(settled, _KEY, "left_anti")
        fresh = fresh.select(*_KEY, "holders", "last", F.lit(0).cast("long").alias("seen"))
        for name in self.runs():
            open_ = self.spark.table(name).where(F.col("holders") < self.holders).select(*_KEY, F.col("holders").alias("n"), F.col("last").alias("of"))
            # A run counts all runs before it too, so of several the largest count is the latest.
            fresh = fresh.join(open_, _KEY, "left").select(
                *_KEY, "holders", F.greatest("last", "of").alias("last"), F.greatest("seen", "n").alias("seen")
            )
        fresh = fresh.select(*_KEY, (F.col("holders") + F.col("seen")).alias("holders"), "last")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(fresh.repartition(self.buckets, *_KEY)))
        for level, names in enumerate(self.levels):
            if len(names) >= self.fanout:
                self._compact(level)

    def _merged(self, names: list[str]) -> DataFrame:
        # Read as plain files: Spark 4.1 takes a union of bucketed tables for bucketed and leaves keys apart.
        files = [f"{self.folder}/{name.split('.')[1]}" for name in names]
        runs = self.spark.read.schema("hi long, lo long, holders long, last long").parquet(*files)
        return runs.groupBy(*_KEY).agg(F.max("holders").alias("holders"), F.max("last").alias("last"))

    def _compact(self, level: int) -> None:
        if level + 1 == len(self.levels):
            self.levels.append([])
        names, self.levels[level] = self.levels[level], []
        self.levels[level + 1].append(self._write(self._merged(names).repartition(self.buckets, *_KEY)))
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")

    def settled(self) -> DataFrame:
        """(hi, lo, last) of every line that enough documents hold; lazy over the runs."""
        if not self.runs():
            return self.spark.createDataFrame([], "hi long, lo long, last long")
        return self._merged(self.runs()).where(F.col("holders") >= self.holders).select(*_KEY, "last")

    def drop(self) -> None:
        self.spark.sql(f"DROP DATABASE {self.database} CASCADE")


def _cuts(docs: DataFrame, batches: int) -> list[int]:
    """Bounds between batches of about equally many rows; they steer work, not results."""
    shares = [i / batches for i in range(1, batches)]
    found = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), F.array(*map(F.lit, shares)), F.lit(1000))).first()[0]
    return sorted(set(found or []))


def repeated_lines(docs: DataFrame, holders: int = HOLDERS, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """(doc_id, hi, lo): the lines that each document loses."""
    spark = docs.sparkSession
    lines = written(line_hashes(docs, shortest).distinct() if _repeats(docs) else line_hashes(docs, shortest), "line-hashes")
    cuts = _cuts(lines, batches)
    runs = LineRuns(spark, holders)
    for low, high in reversed(list(zip([None, *cuts], [*cuts, None]))):
        batch = lines
        if low is not None:
            batch = batch.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id") <= high)
        runs.add(batch)
    settled = written(runs.settled(), "settled-lines")
    runs.drop()
    return lines.join(settled, _KEY).where("doc_id <> last").select("doc_id", *_KEY)


def _repeats(docs: DataFrame) -> bool:
    """Whether some id occurs twice."""
    return not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def drop_repeated_lines(docs: DataFrame, holders: int = HOLDERS, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """``docs`` with ``text`` less repeated lines, ``n_lines`` before and ``n_dropped``.

    A line is told by its key: stripped of blanks, A-Z lowered.  A key of at least
    ``shortest`` code points that at least ``holders`` documents hold goes from all of them
    but the one with the largest doc_id, wherever it stands in them.  Rows of one doc_id are
    one document; a row without an id keeps all its lines and counts for no other.  A null
    or empty text is one empty line and gives the empty text.  All other columns are kept,
    ``n_lines`` and ``n_dropped`` are replaced.  An empty table gives no rows.
    """
    rest = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped", "_lost")]
    lost = repeated_lines(docs, holders, shortest, batches).groupBy("doc_id").agg(
        F.collect_list(F.struct(*_KEY)).alias("_lost")  # a document's own lines, no more than its text has
    ).select(F.col("doc_id").alias("_id"), "_lost")
    rows = docs.select(*rest, F.col("text").cast("binary").alias("text"))
    rows = rows.join(lost, F.col("doc_id").cast("long") == F.col("_id"), "left").select(*rest, "text", "_lost")
    schema = rows.select(*rest).schema.add("text", "string").add("n_lines", "long").add("n_dropped", "long")

    def work(batches):
        for batch in batches:
            texts, before, dropped = [], [], []
            halves = batch.column(len(rest) + 1)
            flat = halves.flatten()
            both = list(zip(flat.field(0).to_pylist(), flat.field(1).to_pylist()))
            ends = halves.value_lengths().fill_null(0).to_numpy().cumsum().tolist()
            for i, text in enumerate(batch.column(len(rest)).to_pylist()):
                text = text or b""
                own = both[ends[i - 1] if i else 0 : ends[i]]
                if not own:
                    texts.append(text)
                    before.append(text.count(b"\n") + 1)
                    dropped.append(0)
                    continue
                gone = {a.to_bytes(8, "little", signed=True) + b.to_bytes(8, "little", signed=True) for a, b in own}
                lines = text.split(b"\n")
                kept = [x for x, h in zip(lines, _hashes(text, shortest)) if h not in gone]
                texts.append(b"\n".join(kept))
                before.append(len(lines))
                dropped.append(len(lines) - len(kept))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array(texts, pa.binary()).view(pa.string()), pa.array(before, pa.int64()), pa.array(dropped, pa.int64())],
                [*rest, "text", "n_lines", "n_dropped"],
            )

    return rows.mapInArrow(work, schema)

