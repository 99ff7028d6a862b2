"""Vector code compression: product codes whose nearest entries are found by Orchard search.

A vector is cut into equal parts and each part is named by the nearest entry of that
part's codebook.  Every codebook entry has the list of all entries in order of their
distance from it.  A search starts at some entry, goes down that entry's list, jumps to
the list of a better entry (the best of ``STEP`` listed neighbours, which are looked at
together), leaves out entries marked as visited, and stops at a listed entry that lies beyond twice the current distance: by the triangle
inequality neither it nor a later one can be nearer.

Codebooks are fitted by rounds over all rows.  A task keeps integer sums per (part, entry)
and sends one row for each, Spark adds them up, and only the new codebooks, whose size is
set by parameters and the dimension, come to the driver and go out with the next round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Vectors searched together in a task.
BLOCK = 2048
#: Listed neighbours looked at in one step of a search.
STEP = 8
#: Largest magnitude of a scaled component: squared distances of long parts stay below 2^63.
LARGEST = 1 << 26


class OrchardLists:
    """One part's codebook with its distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        n = len(entries)
        self.apart = np.empty((n, n), np.int64)
        for i, entry in enumerate(entries):
            self.apart[i] = ((entries - entry) ** 2).sum(axis=1)
        self.order = np.argsort(self.apart, axis=1, kind="stable")
        self.listed = np.take_along_axis(self.apart, self.order, axis=1)
        sums = entries.sum(axis=1)
        self.by_sum = np.argsort(sums, kind="stable")
        self.sums = sums[self.by_sum]

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) of each row of ``parts``; ties go to the lower index.

        All searches of the block advance together: each row has its own current entry,
        its place in that entry's list and its own marks.
        """
        rows, n = len(parts), len(self.entries)
        start = np.searchsorted(self.sums, parts.sum(axis=1)).clip(0, n - 1)
        best = self.by_sum[start]
        found = ((parts - self.entries[best]) ** 2).sum(axis=1)
        visited = np.zeros((rows, n), bool)
        visited[np.arange(rows), best] = True
        place = np.zeros(rows, np.int64)
        active = np.arange(rows)
        ahead = np.arange(STEP)
        while len(active):
            at = place[active, None] + ahead
            inside = at < n
            at = np.minimum(at, n - 1)
            own = best[active, None]
            near = self.order[own, at]
            # The root is left out: d(c, e) > 2 d(q, c) is the same as its squares with 4.
            within = inside & (self.listed[own, at] <= 4 * found[active, None])
            look = within & ~visited[active[:, None], near]
            row, column = np.nonzero(look)
            who, entry = active[row], near[row, column]
            visited[who, entry] = True
            away = ((parts[who] - self.entries[entry]) ** 2).sum(axis=1)
            better = (away < found[who]) | ((away == found[who]) & (entry < best[who]))
            place[active] += STEP
            if better.any():
                who, entry, away = who[better], entry[better], away[better]
                by = np.lexsort((entry, away, who))
                first = np.ones(len(by), bool)
                first[1:] = who[by][1:] != who[by][:-1]
                by = by[first]
                best[who[by]], found[who[by]], place[who[by]] = entry[by], away[by], 0
            on = within[:, -1] & (place[active] < n)
            active = active[on | (place[active] == 0)]
        return best, found


@dataclass
class Codebooks:
    """Entries as an integer array (parts, entries, width of a part)."""

    entries: np.ndarray

    @property
    def dimension(self) -> int:
        return self.entries.shape[0] * self.entries.shape[2]

    def text(self) -> str:
        """All components by part, entry and position, comma-joined."""
        return ",".join(map(str, self.entries.ravel().tolist()))


def _whole(vector: Column) -> Column:
    return vector.isNotNull() & ~F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | x.isin(float("inf"), float("-inf"))
    )


def kept_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """``rows`` whose vector is not null and has finite components only, as column ``_v``."""
    out = rows.withColumn("_v", F.col(vector).cast("array<double>"))
    return out.where(_whole(F.col("_v")))


def _integers(column: pa.Array, dimension: int) -> tuple[np.ndarray, np.ndarray]:
    """(which rows have the dimension, their scaled and floored components)."""
    sizes = np.diff(column.offsets.to_numpy())
    fits = sizes == dimension
    flat = column.flatten().to_numpy(zero_copy_only=False)
    values = np.floor(flat[np.repeat(fits, sizes)] * SCALE)
    if len(values) and max(values.max(), -values.min()) > LARGEST:
        raise ValueError(f"a vector component beyond {LARGEST // SCALE} has no exact code")
    return fits, values.astype(np.int64).reshape(-1, dimension)


def _search(lists: list[OrchardLists], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and squared distances, (rows, parts) each."""
    width = vectors.shape[1] // len(lists)
    codes = np.empty((len(vectors), len(lists)), np.int64)
    errors = np.empty_like(codes)
    for p, of in enumerate(lists):
        for at in range(0, len(vectors), BLOCK):
            block = np.ascontiguousarray(vectors[at : at + BLOCK, p * width : (p + 1) * width])
            codes[at : at + BLOCK, p], errors[at : at + BLOCK, p] = of.nearest(block)
    return codes, errors


def first_codebooks(rows: DataFrame, key: str, parts: int, entries: int) -> Codebooks | None:
    """Codebooks of the ``entries`` kept rows with the smallest keys, ascending.

    Rows of one key go by their components; rows without a key come last.  The first row
    whose length is a multiple of ``parts`` sets the dimension; rows of another length
    start no entry.  None without such a row.
    """
    order = [F.col(key).asc_nulls_last(), "_v"]
    first = rows.where((F.size("_v") > 0) & (F.size("_v") % parts == 0)).orderBy(*order).select(F.size("_v").alias("n")).limit(1).collect()
    if not first:
        return None
    dimension = first[0]["n"]
    start = rows.where(F.size("_v") == dimension).orderBy(*order).select("_v").limit(entries).collect()
    values = np.floor(np.array([r[0] for r in start], float).reshape(len(start), dimension) * SCALE)
    if values.size and np.abs(values).max() > LARGEST:
        raise ValueError(f"a vector component beyond {LARGEST // SCALE} has no exact code")
    cut = values.astype(np.int64).reshape(len(start), parts, dimension // parts)
    return Codebooks(np.ascontiguousarray(cut.transpose(1, 0, 2)))


def refined(rows: DataFrame, books: Codebooks) -> Codebooks:
    """One round: every entry becomes the floored mean of the parts that are nearest to it."""
    shape, dimension = books.entries.shape, books.dimension
    parts, entries, width = shape

    def sums(batches):
        lists, total, count = [OrchardLists(e) for e in books.entries], np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            _, vectors = _integers(batch.column(0), dimension)
            codes, _ = _search(lists, vectors)
            for p in range(parts):
                np.add.at(total[p], codes[:, p], vectors[:, p * width : (p + 1) * width])
                count[p] += np.bincount(codes[:, p], minlength=entries)
        used = np.argwhere(count > 0)
        columns = [used[:, 0], used[:, 1], count[count > 0]]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(list(total[count > 0]), pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    each = rows.select("_v").mapInArrow(sums, "part long, entry long, n long, total array<long>")
    wide = "decimal(38,0)"
    added = each.groupBy("part", "entry").agg(
        F.sum(F.col("n").cast(wide)).alias("n"), *(F.sum(F.col("total")[i].cast(wide)).alias(f"s{i}") for i in range(width))
    )
    out = books.entries.copy()
    for row in added.collect():  # at most parts x entries rows
        out[row["part"], row["entry"]] = [int(row[f"s{i}"]) // int(row["n"]) for i in range(width)]
    return Codebooks(out)


def fit(rows: DataFrame, key: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks over all ``rows`` (from ``kept_rows``); None if there are none.

    With fewer rows than ``entries`` the codebooks have as many entries as there are rows.
    """
    books = first_codebooks(rows, key, parts, entries)
    for _ in range(rounds if books else 0):
        books = refined(rows, books)
    return books


def encode(rows: DataFrame, books: Codebooks | None) -> DataFrame:
    """``rows`` with ``codes`` (entry of each part) and ``error`` (summed squared distance).

    Both are null for a vector of another length than the codebooks'.  Columns of these
    names are replaced; all other columns are kept.
    """
    rest = [c for c in rows.columns if c not in ("codes", "error", "_v")]
    schema = rows.select(*rest).schema.add("codes", ArrayType(IntegerType())).add("error", LongType())
    if books is None:
        return rows.select(*rest, F.lit(None).cast("array<int>").alias("codes"), F.lit(None).cast("long").alias("error"))
    dimension = books.dimension

    def work(batches):
        lists = [OrchardLists(e) for e in books.entries]
        for batch in batches:
            fits, vectors = _integers(batch.column(len(rest)), dimension)
            codes, errors = _search(lists, vectors)
            place = np.cumsum(fits) - 1
            own = [codes[i].tolist() if ok else None for i, ok in zip(place, fits)]
            error = [int(errors[i].sum()) if ok else None for i, ok in zip(place, fits)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(rest)], pa.array(own, pa.list_(pa.int32())), pa.array(error, pa.int64())], [*rest, "codes", "error"]
            )

    return rows.select(*rest, "_v").mapInArrow(work, schema)


def compress(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """(coded rows, codebooks) of ``rows``.

    A row goes if its vector is null or holds a null, NaN or infinite component.  Repeated
    rows and keys are rows of their own, a null key is coded like others, an empty table
    gives no rows and no codebooks.  Components are floored multiples of 1/1024; one beyond
    65,536 raises, as its distances would not be exact.  A vector whose length differs from
    that of the smallest key's vector (of those that can be cut) has null codes.
    """
    kept = kept_rows(rows, vector)
    books = fit(kept, key, parts, entries, rounds)
    return encode(kept.drop(vector), books), books


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded`` with ``vector``: the entries its codes name, scaled back to doubles."""
    of = F.lit([[(e / SCALE).tolist() for e in part] for part in books.entries])
    return coded.withColumn("vector", F.flatten(F.transform("codes", lambda c, p: F.element_at(F.element_at(of, p + 1), c + 1))))


def hex_code(codes: Column) -> Column:
    """Two lowercase hex digits for each entry index below 256."""
    return F.array_join(F.transform(codes, lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "")
