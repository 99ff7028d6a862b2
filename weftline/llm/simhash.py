"""SimHash near duplicates: groups of documents whose fingerprints differ by few bits.

Fingerprints are cut into 16 segments of 4 bits and mapped to the bit count of each: a
point of a 16-dimensional grid.  The Manhattan distance of two points is a lower bound of
the Hamming distance, so fingerprints that differ by at most 2 bits are at most 2 apart
on the grid, and some grid point is at most 1 from both.  Each distinct fingerprint is
put on its own point and the (up to) 32 points next to it; those that meet on a point are
the candidates of the range join.  A point with two of them gives a pair, verified by its
differing bits.  Points with more would give all pairs, so their fingerprints are joined
on the exact analogue instead: themselves with one bit flipped or none.  All that share
such a value are within 2 bits of each other, and a link to the smallest of them keeps
the group connected with one link a member.  Nothing is capped, no link gets lost.

Joins name their method: Spark would take a table for as small as its compressed file, before
it is exploded, and gather it in the driver.  A table is sent to every task only if it is known to
have at most ``BROADCAST_ROWS`` rows; all others are merged.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, written

SEED = 42
SHINGLE = 3
DISTANCE = 2
#: Rows that a table may have to go through the driver to every task.
BROADCAST_ROWS = 100_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The 64-bit SimHash of a whole text; 0 if it has no word.

    Words are runs without ASCII blanks, A-Z lowered; shingles of ``size`` words count as
    often as they occur, fewer words are one shingle; a bit is set if more than half of
    the shingles' XXH64 values have it.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < size:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        line, at, starts = b" ".join(words), 0, []
        for word in words:
            starts.append(at)
            at += len(word) + 1
        ends = [s - 1 for s in islice(starts, size, None)] + [at - 1]
        digest = xxhash.xxh64_intdigest
        hashes = [digest(line[a:b], SEED) for a, b in zip(starts, ends)]
    counts = np.zeros(64, np.int64)
    values = np.array(hashes, "<u8")
    for at in range(0, len(values), 1 << 14):
        bits = np.unpackbits(values[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(values)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of every row of ``docs`` (doc_id, text); fp as a signed 64-bit integer."""

    def work(batches):
        for batch in batches:
            values = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "fp"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, "doc_id long, fp long")


def _bit_counts(fp: Column) -> Column:
    """The bit count of each 4-bit segment, in the segment's own 4 bits."""
    odd, low = F.lit(0x55555555), F.lit(0x33333333)

    def half(x: Column) -> Column:
        pairs = x.bitwiseAND(odd) + F.shiftrightunsigned(x, 1).bitwiseAND(odd)
        return pairs.bitwiseAND(low) + F.shiftrightunsigned(pairs, 2).bitwiseAND(low)

    return F.shiftleft(half(F.shiftrightunsigned(fp, 32)), 32).bitwiseOR(half(fp.bitwiseAND(F.lit(0xFFFFFFFF))))


def _grid(fps: DataFrame) -> DataFrame:
    """(point, fp): the own grid point of a fingerprint and those one step from it."""
    steps = fps.select("fp", _bit_counts(F.col("fp")).alias("own"), F.explode(F.sequence(F.lit(0), F.lit(32))).alias("step"))
    count = F.expr("shiftrightunsigned(own, 4 * shiftright(step, 1)) & 7L")
    one = F.expr("shiftleft(1L, 4 * shiftright(step, 1))")
    point = (
        F.when(F.col("step") == 32, F.col("own"))
        .when((F.col("step") % 2 == 0) & (count < 4), F.col("own") + one)
        .when((F.col("step") % 2 == 1) & (count > 0), F.col("own") - one)
    )
    return steps.select(point.alias("point"), "fp").where(F.col("point").isNotNull())


def _flips(fps: DataFrame) -> DataFrame:
    """(near, fp): a fingerprint and all values one bit from it."""
    bits = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(64))).alias("bit"))
    return bits.select(F.expr("CASE WHEN bit = 64 THEN fp ELSE fp ^ shiftleft(1L, bit) END").alias("near"), "fp")


def _join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", rows: int | None = None) -> DataFrame:
    """A join by merging, or by sending ``right`` to every task if its ``rows`` are known to be few."""
    few = rows is not None and rows <= BROADCAST_ROWS
    return left.join(right.hint("broadcast" if few else "merge"), on, how)


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints: all of 2 bits or fewer are connected by them."""
    met = _grid(fps).groupBy("point").agg(F.count("fp").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"))
    met = written(met.where("n > 1"), "points")
    pairs = met.where((F.col("n") == 2) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE)).select("a", "b")
    points = met.where("n > 2").select("point")
    crowded = written(_join(_grid(fps), points, "point", rows=points.count()).select("fp").distinct(), "crowded")
    near = _flips(crowded)
    least = near.groupBy("near").agg(F.min("fp").alias("b"), F.count("fp").alias("n")).where("n > 1").select("near", "b")
    stars = _join(near, least, "near").where("fp <> b").select(F.col("fp").alias("a"), "b")
    return pairs.union(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): root is the smallest node it reaches.

    Rounds of large and small stars: every node's larger neighbours, then its smaller ones,
    are linked to the smallest of them.  A round is written to the shared folder; rounds
    end when one changes nothing.  They grow with the logarithm of the longest path.
    """

    def measured(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    state = measured(edges)
    while True:
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _join(both, least, "a", rows=2 * state[0]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _join(large, least, "a", rows=state[0]).where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        edges = written(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
        now = measured(edges)
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        edges.select("b", "b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs`` (doc_id, text).

    Null, empty and blank texts have fingerprint 0 and link like others.  Copies are joined
    by their fingerprint first, so links are between distinct fingerprints only.  A row
    without an id has a fingerprint but links nothing and has no component.
    """
    marked = written(fingerprints(docs), "fingerprints")
    nodes = marked.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first"))
    nodes = written(nodes, "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = _join(nodes, roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(_join(rooted, least, "root").select("fp", "component_id"), "components")
    found = _join(marked.where("doc_id is not null"), named, "fp").select("doc_id", "fp", "component_id")
    return found.union(marked.where("doc_id is null").select("doc_id", "fp", F.lit(None).cast("long")))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each component: the one of the smallest doc_id.

    Of rows that share that id one is kept.  Rows without an id are all kept.
    """
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    return _join(docs, kept, "doc_id", "left_semi").select(docs.columns).dropDuplicates(["doc_id"]).union(docs.where("doc_id is null"))
