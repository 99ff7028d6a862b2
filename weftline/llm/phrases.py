"""Collocations by prefix-free parsing: repeated text is counted once, weighted.

Parsing.  A document is a row of words with marks between its pieces.  Wherever the hash of
``longest - 1`` neighbouring tokens is divisible by ``CHUNK`` a chunk ends with them and the
next one begins with them, so chunks depend on content alone, equal passages give equal
chunks, and neighbours overlap by ``longest - 1`` tokens.  Distinct chunks with their number
of occurrences are the dictionary; it is all that is counted from then on.

Counting.  An n-gram belongs to the chunk in which it starts before the closing overlap:
it lies wholly in there, and nowhere else by this rule, so overlaps are assigned once.
Its count is the sum of the frequencies of its chunks.

No n-gram that cannot reach ``least`` is ever sent as text: two-word hashes are counted
first, and each further length only where both shorter n-grams inside passed.  What passed
goes to the tasks as a bit table, whose size follows the number of hashes up to
``FILTER_BITS``; a fuller table lets more through to the exact counts, which decide.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import written

LONGEST = 4
LEAST = 30
#: A longer candidate with this share (in percent) of a phrase's count replaces it.
COVERED = 80
TOP = 2000
#: Words of a chunk, on average.
CHUNK = 32
#: Largest bit table of hashes that reach the least count: 2^28 bits, 32 MiB.
FILTER_BITS = 28
#: Tokens counted together.
TOKENS = 1 << 21
#: Shares that a language's phrases are ranked in before the last ranking.
SHARES = 16

#: The mark between pieces: a character that ends pieces, so no word has it.
BREAK = b"."
_MARKS = b".,;:!?\n\x0b\x0c\r"
_SIGNS = bytes.maketrans(_MARKS + bytes(range(65, 91)), BREAK * len(_MARKS) + bytes(range(97, 123)))
_BREAKS = re.compile(rb"[ \t]*\.[. \t]*")


def tokens(text: bytes) -> bytes:
    """Words, A-Z lowered, and one mark after each piece that holds words, each followed by one blank."""
    found = _BREAKS.sub(b" . ", text.translate(_SIGNS) + BREAK)
    if b"  " in found or b"\t" in found:
        found = b" ".join(found.split()) + b" "
    return found.lstrip(b" .") if found[:1] in (b" ", BREAK) else found


class Numbered:
    """The tokens of a row of bytes, each followed by one blank, and numbers of the distinct ones."""

    def __init__(self, row: bytes):
        self.row = row
        self.ends = np.flatnonzero(np.frombuffer(row, np.uint8) == 32) + 1
        self.begins = np.append(0, self.ends).astype(np.int64)
        buffers = [None, pa.py_buffer(self.begins), pa.py_buffer(row)]
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.ends), buffers).dictionary_encode()
        self.numbers = coded.indices.to_numpy().astype(np.int64)
        self.words = coded.dictionary.to_pylist()  # each with its blank

    def hashes(self) -> np.ndarray:
        own = np.array([xxhash.xxh3_64_intdigest(w) for w in self.words], np.uint64)
        return own[self.numbers] if len(own) else np.zeros(0, np.uint64)

    def is_word(self) -> np.ndarray:
        mark = np.array([w != BREAK + b" " for w in self.words], bool)
        return mark[self.numbers] if len(mark) else np.zeros(0, bool)


def run_hashes(hashes: np.ndarray, longest: int) -> list[np.ndarray]:
    """Hashes of the 1 to ``longest`` tokens from each place; the ends are not wrapped."""
    out = [hashes]
    for k in range(1, longest):
        before = out[-1][: max(0, len(hashes) - k)]
        out.append((before ^ (before >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + hashes[k:])
    return out


def chunks(texts: list[bytes], longest: int = LONGEST, size: int = CHUNK) -> list[list[bytes]]:
    """The chunks of each text: tokens, each followed by one blank.  The last one of a text ends with marks alone."""
    overlap = longest - 1
    rows = [found + (BREAK + b" ") * (overlap - 1) if (found := tokens(text)) else b"" for text in texts]
    found = Numbered(b"".join(rows))
    last = np.searchsorted(found.ends, np.cumsum([len(r) for r in rows]), side="right")  # tokens up to each text's end
    first = np.append(0, last[:-1])
    at = run_hashes(found.hashes(), overlap)[-1]
    ends = np.flatnonzero((at >> np.uint64(7)) % np.uint64(size) == 0) + overlap
    ends = np.union1d(ends, last[last > first])
    of = np.searchsorted(last, ends, side="left")
    kept = (ends - first[of] > overlap) if len(ends) else np.zeros(0, bool)
    out: list[list[bytes]] = [[] for _ in texts]
    begin, before, byte = 0, -1, found.begins
    for doc, end in zip(of[kept].tolist(), ends[kept].tolist()):
        start = begin if doc == before else first[doc]
        out[doc].append(found.row[byte[start] : byte[end]])
        begin, before = end - overlap, doc
    return out


def parse(docs: DataFrame, longest: int = LONGEST, size: int = CHUNK) -> DataFrame:
    """The dictionary (lang, chunk, n) of ``docs`` (lang, text): distinct chunks and how often each occurs."""

    def work(batches):
        found, held = defaultdict(int), 0

        def flushed():
            keys = list(found)
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.binary()), pa.array(list(found.values()), pa.int64())],
                ["lang", "chunk", "n"],
            )
            found.clear()
            return batch

        def parted(batch):
            """Some texts at a time: many short ones or one long one."""
            some, room = [], 0
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                some.append((lang, text.as_py()))
                room += len(some[-1][1])
                if room >= 8 * TOKENS // 2:
                    yield some
                    some, room = [], 0
            if some:
                yield some

        for batch in batches:
            for some in parted(batch):
                for (lang, _), own in zip(some, chunks([text for _, text in some], longest, size)):
                    for chunk in own:
                        found[lang, chunk] += 1
                        held += len(chunk)
                if len(found) > 100_000 or held > 1 << 25:
                    yield flushed()
                    held = 0
        if found:
            yield flushed()

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text")).where("text is not null")
    return rows.mapInArrow(work, "lang string, chunk binary, n long").groupBy("lang", "chunk").agg(F.sum("n").alias("n"))


class BitTable:
    """Hashes that passed, by their upper bits; may let others through."""

    def __init__(self, bits: int, image: bytes):
        self.shift, self.image = np.uint64(64 - bits), np.frombuffer(image, np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes >> self.shift
        return (self.image[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bit_table(hashes: DataFrame, largest: int = FILTER_BITS) -> tuple[int, bytes]:
    """(bits, image) of a table of ``hashes`` (hash), about 16 bits a hash, at most 2^``largest``."""
    count = hashes.count()
    bits = min(largest, max(10, (16 * count).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    own = F.expr(f"shiftleft(1L, cast(shiftrightunsigned(hash, {64 - bits}) & 63 as int))")
    image = np.zeros(1 << bits - 6, np.int64)
    words = hashes.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(own).alias("bits")).toArrow()
    image[words["at"].to_numpy()] = words["bits"].to_numpy()
    return bits, image.tobytes()


class Block:
    """Tokens of many chunks of one language, with the weight and reach of each place."""

    def __init__(self, lang: str, rows: list[tuple[bytes, int]], longest: int):
        self.lang = lang
        sizes = np.array([chunk.count(b" ") for chunk, _ in rows])
        found = Numbered(b"".join([chunk for chunk, _ in rows]))
        self.numbers, self.words = found.numbers, found.words
        self.weight = np.repeat(np.array([n for _, n in rows], np.int64), sizes)
        word = found.is_word()
        #: By length: where so many words stand together from a place on that belongs to its chunk.
        self.starts = [word.copy()]
        for back in range(1, longest):
            self.starts[0][np.cumsum(sizes) - back] = False
        for k in range(1, longest):
            self.starts.append(self.starts[-1][: max(0, len(word) - k)] & word[k:])
        seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")))
        self.hashes = run_hashes(found.hashes() + seed, longest)

    def places(self, k: int, tables: dict[int, BitTable]) -> np.ndarray:
        """Where an n-gram of ``k`` words starts that the tables let through."""
        at = np.flatnonzero(self.starts[k - 1])
        for j in range(2, k + 1):
            if j in tables:
                for step in range(k - j + 1):
                    at = at[tables[j].has(self.hashes[j - 1][at + step])]
        return at

    def _grouped(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of one of each distinct key, weight of all of them)."""
        if not len(keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        return order[first], np.add.reduceat(self.weight[at[order]], first)

    def hashed(self, k: int, tables: dict[int, BitTable]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes and their weights; those of chunks that occur once are counted without a second column."""
        at = self.places(k, tables)
        once = self.weight[at] == 1
        keys = np.sort(self.hashes[k - 1][at[once]])
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        at = at[~once]
        more = self.hashes[k - 1][at]
        one, sums = self._grouped(more, at)
        return np.append(keys[first], more[one]).view(np.int64), np.append(np.diff(np.append(first, len(keys))), sums)

    def exact(self, k: int, tables: dict[int, BitTable]) -> tuple[list[bytes], np.ndarray]:
        at = self.places(k, tables)
        own, base = self.numbers[at], len(self.words)
        for j in range(1, k):  # pairs of (n-gram so far, next word); the first are numbered anew, so that pairs fit
            own = own if j == 1 else np.unique(own, return_inverse=True)[1]
            own = own * base + self.numbers[at + j]
        one, sums = self._grouped(own, at)
        words = [map(self.words.__getitem__, (self.numbers[at[one] + j]).tolist()) for j in range(k)]
        return [b"".join(run)[:-1] for run in zip(*words)], sums


def _counted(dictionary: DataFrame, longest: int, emit, schema: str) -> DataFrame:
    """Blocks of the dictionary's chunks, by language, through ``emit``."""

    def work(batches):
        held, size = defaultdict(list), 0

        def blocks():
            for lang, rows in held.items():
                yield from emit(Block(lang, rows, longest))
            held.clear()

        for batch in batches:
            for lang, chunk, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held[lang].append((chunk, n))
                size += chunk.count(b" ")
                if size >= TOKENS:
                    yield from blocks()
                    size = 0
        if held:
            yield from blocks()

    return dictionary.select("lang", "chunk", "n").mapInArrow(work, schema)


def frequent_hashes(dictionary: DataFrame, k: int, tables: dict, longest: int, least: int) -> DataFrame:
    """(hash) of the ``k``-grams whose hash is counted ``least`` times: all that are so frequent, and rarely another."""

    def emit(block: Block):
        values, sums = block.hashed(k, {j: BitTable(*t) for j, t in tables.value.items()})
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(sums)], ["hash", "n"])

    each = _counted(dictionary, longest, emit, "hash long, n long")
    return each.groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("hash")


def frequent_phrases(dictionary: DataFrame, longest: int = LONGEST, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, n): exact counts of all phrases of 1 to ``longest`` words that occur ``least`` times.

    A row of ``k`` 0 has a language's number of words.
    """
    sc, images = dictionary.sparkSession.sparkContext, {}
    for k in range(2, longest):
        found = written(frequent_hashes(dictionary, k, sc.broadcast(dict(images)), longest, least), f"hashes-{k}")
        images[k] = bit_table(found)
    tables = sc.broadcast(images)

    def emit(block: Block):
        own = {j: BitTable(*t) for j, t in tables.value.items()}
        total = int(block.weight[block.starts[0]].sum())
        yield _phrase_batch(block.lang, 0, [b""], [total])
        for k in range(1, longest + 1):
            phrases, sums = block.exact(k, own)
            yield _phrase_batch(block.lang, k, phrases, sums)

    each = _counted(dictionary, longest, emit, "lang string, k int, phrase string, n long")
    return each.groupBy("lang", "k", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("k") == 0))


def _phrase_batch(lang: str, k: int, phrases, sums) -> pa.RecordBatch:
    n = len(phrases)
    return pa.RecordBatch.from_arrays(
        [pa.repeat(pa.scalar(lang, pa.string()), n), pa.repeat(pa.scalar(k, pa.int32()), n), pa.array(phrases, pa.binary()).view(pa.string()), pa.array(sums, pa.int64())],
        ["lang", "k", "phrase", "n"],
    )


def _words(start: Column | int, size: Column | int) -> Column:
    return F.array_join(F.slice("words", start, size), " ")


def scored(counts: DataFrame) -> DataFrame:
    """Candidates (lang, phrase, k, a, l, r, score) of ``counts``: each with its weakest cut."""
    phrases = counts.where("k > 0").select("lang", "phrase", F.col("n"))
    cuts = counts.where("k > 1").select("lang", "phrase", "k", F.col("n").alias("a"), F.split("phrase", " ").alias("words"))
    cuts = cuts.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select(
        "lang", "phrase", "k", "a", "cut", _words(F.lit(1), F.col("cut")).alias("first"), _words(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("rest")
    )
    left = phrases.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l"))
    right = phrases.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r"))
    cuts = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = F.expr("cast(2000000 as decimal(10,0)) * cast(a as decimal(20,0)) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    weakest = cuts.groupBy("lang", "phrase", "k", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("w"))
    return weakest.select("lang", "phrase", "k", "a", "w.l", "w.r", "w.score")


def uncovered(candidates: DataFrame, covered: int = COVERED) -> DataFrame:
    """``candidates`` less those inside a longer candidate with ``covered`` percent of their count."""
    longer = candidates.where("k > 2").select("lang", "a", "k", F.split("phrase", " ").alias("words"))
    longer = longer.withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    longer = longer.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    inside = longer.select("lang", _words(F.col("at"), F.col("size")).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    wide = "decimal(28,0)"
    gone = F.coalesce(100 * F.col("most").cast(wide) >= covered * F.col("a").cast(wide), F.lit(False))
    return candidates.join(inside, ["lang", "phrase"], "left").where(~gone).drop("most")


def first_of_each(candidates: DataFrame, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` with ``rank``; a language is ranked in shares first."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    share = Window.partitionBy("lang", "_share").orderBy(*order)
    some = candidates.withColumn("_share", F.pmod(F.xxhash64("phrase"), F.lit(SHARES)))
    some = some.withColumn("_at", F.row_number().over(share)).where(F.col("_at") <= top).drop("_share", "_at")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)


def mine_phrases(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """The strongest phrases of each language of ``docs`` (lang, text): lang, rank, phrase, a, l, r, n, score.

    Words are runs without blank and tab inside pieces, which end at ``. , ; : ! ?`` and line
    ends, A-Z lowered.  Phrases have 2 to ``longest`` words and occur ``least`` times at
    least, overlapping ones counted each.  Repeated rows count each; a null text has no
    words, a null lang is ``und``; other columns are ignored; without words there are no
    rows.  Equal scores go by count, then by phrase in byte order.
    """
    dictionary = written(parse(docs, longest), "phrase-chunks")
    counts = written(frequent_phrases(dictionary, longest, least), "phrase-counts")
    candidates = written(scored(counts), "phrase-candidates")
    best = first_of_each(uncovered(candidates, covered), top)
    totals = counts.where("k = 0").select("lang", "n")
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
