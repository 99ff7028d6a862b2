"""Benchmark passages in documents, by a generalised suffix automaton of the test items.

The automaton accepts every run of words of every item.  A document's words are streamed
through it; at each word it knows the longest run ending there that some item holds.  A
run of ``window`` words or more means that the last ``window`` words lie in an item, and
the state reached by them names the items.  An item shorter than the window counts as
one window of its own length.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches, set_aside, written

WINDOW = 10
#: Words of items in one automaton, so that its size is bounded; more items make more
#: automata, each streamed over by all documents.
BLOCK_WORDS = 200_000

# Bytes that part words: ASCII other than letters and digits.  Letters A-Z become small.
_WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

HIT_SCHEMA = "n_words long, hits array<struct<first:long,last:long>>, items array<string>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a whole text, A-Z lowered; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


class Automaton:
    """A generalised suffix automaton over words, with the items of every window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ids = [(name, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]) for name, words in items if words]
        for _, run in ids:
            at = 0
            for word in run:
                at = self._extend(at, word)
        #: state of a window -> items that hold it; state of a short item -> its length, items
        self.holds: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        for name, run in ids:
            for at, length in self.states(run):
                names = None
                if length >= window:
                    names = self.holds.setdefault(self.cut(at, window), set())
                if names is not None and name is not None:
                    names.add(name)
            if len(run) < window:
                state = 0
                for word in run:
                    state = self.next[state][word]
                names = self.short.setdefault(state, (len(run), set()))[1]
                if name is not None:
                    names.add(name)
        #: per state, the short items that end here: those of the states on its suffix path
        self.ends: dict[int, list[tuple[int, set[str]]]] = {}
        if self.short:
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                above = self.ends.get(self.link[state], []) if state else []
                own = [self.short[state]] if state in self.short else []
                if above or own:
                    self.ends[state] = above + own

    def _extend(self, last: int, word: int) -> int:
        """Add a word after the run of state ``last``; shared runs of items share states."""
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, word, known)
        state = self._state({}, self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = state
            p = self.link[p]
        if p < 0:
            self.link[state] = 0
        else:
            q = self.next[p][word]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return state

    def _state(self, moves: dict[int, int], length: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(0)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """A state for the shorter runs of ``q``, to which the suffix path of ``p`` now leads."""
        shorter = self._state(dict(self.next[q]), self.length[p] + 1)
        self.link[shorter], self.link[q] = self.link[q], shorter
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = shorter
            p = self.link[p]
        return shorter

    def cut(self, state: int, length: int) -> int:
        """The state of the last ``length`` words of a run of ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state

    def states(self, run: list[int]) -> Iterator[tuple[int, int]]:
        """State and longest matching length after every word (-1 for a word of no item)."""
        state, length = 0, 0
        moves, link, lengths = self.next, self.link, self.length
        for word in run:
            if word < 0:
                state, length = 0, 0
            else:
                while state and word not in moves[state]:
                    state = link[state]
                    length = lengths[state]
                if word in moves[state]:
                    state = moves[state][word]
                    length += 1
                else:
                    length = 0
            yield state, length

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Joined runs of hit words (first, last), and the items with an occurring window."""
        known = self.vocabulary.get
        spans: list[tuple[int, int]] = []
        items: set[str] = set()
        window, ends = self.window, self.ends
        for i, (state, length) in enumerate(self.states([known(w, -1) for w in words])):
            reach = 0
            if length >= window:
                reach = window
                items |= self.holds[self.cut(state, window)]
            if ends and state in ends:
                for size, names in ends[state]:
                    if size <= length:
                        reach = max(reach, size)
                        items |= names
            if reach:
                first = i - reach + 1
                while spans and spans[-1][1] >= first - 1:
                    first = min(first, spans.pop()[0])
                spans.append((first, i))
        return spans, items


def find_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, cut_above: float | None = None) -> DataFrame:
    """``docs`` (with a column ``text``) and what they share with ``benchmark`` (item_id, text).

    Adds n_words, hits (runs of hit words as first and last position, joined and in order)
    and items (item_ids with an occurring window, sorted as text).  A null or empty text
    has no words; a null or empty item has no window; an item without an id hits words but
    is not listed; repeated items count once.  Without items no document is hit.
    With ``cut_above`` the hit words are cut out, see ``remove_passages``.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = items.agg(F.sum(F.size(F.split("text", " ")))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    dealt = items.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    names = [c for c in docs.columns if c not in ("n_words", "hits", "items")]
    found = docs.select(*names, F.lit(None).cast("long").alias("n_words"), F.array().cast("array<struct<first:long,last:long>>").alias("hits"), F.array().cast("array<string>").alias("items"))
    for block in range(blocks):
        held = [(r["item_id"], words_of(r["text"])) for r in dealt.where(F.col("_block") == block).collect()]
        last = cut_above if block == blocks - 1 else None
        found = _scanned(written(found, "passages") if block else found, pickle.dumps(Automaton(held, window)), last)
    return found


_BUILT: dict[int, Automaton] = {}


def _scanned(found: DataFrame, automaton: bytes, cut_above: float | None) -> DataFrame:
    shared = found.sparkSession.sparkContext.broadcast(automaton)
    text, hits, items = (found.columns.index(c) for c in ("text", "hits", "items"))
    count = found.columns.index("n_words")

    def scan(batches):
        key = hash(shared.value)
        if key not in _BUILT:
            _BUILT.clear()
            _BUILT[key] = pickle.loads(shared.value)
        held = _BUILT[key]
        for batch in batches:
            columns = list(batch.columns)
            n, runs, names = [], [], []
            for value, old, before in zip(columns[text].to_pylist(), columns[hits].to_pylist(), columns[items].to_pylist()):
                words = words_of(value)
                spans, more = held.scan(words)
                n.append(len(words))
                runs.append(_joined([(s["first"], s["last"]) for s in old] + spans) if old else [{"first": a, "last": b} for a, b in spans])
                names.append(sorted({*before, *more}))
            columns[count] = pa.array(n, pa.int64())
            columns[hits] = pa.array(runs, columns[hits].type)
            columns[items] = pa.array(names, pa.list_(pa.string()))
            out = pa.RecordBatch.from_arrays(columns, batch.schema.names)
            if cut_above is not None:
                texts = columns[text].to_pylist()
                columns[text] = pa.array([without(t, h) if h else t for t, h in zip(texts, runs)], pa.string())
                clean = [sum(s["last"] - s["first"] + 1 for s in h) <= cut_above * k for h, k in zip(runs, n)]
                out = pa.RecordBatch.from_arrays(columns, batch.schema.names).filter(pa.array(clean, pa.bool_()))
            yield out

    return map_batches(found, scan, found.schema)


def _joined(spans: list[tuple[int, int]]) -> list[dict]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a - 1:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"first": a, "last": b} for a, b in out]


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, longest_share: float = 0.5) -> DataFrame:
    """``docs`` with the hit words cut out of their texts; clean texts stay as they are.

    A document of which more than ``longest_share`` of the words are hit is dropped.
    A cut reaches from the first hit word's first byte to the last one's end.
    """
    rows, restored = set_aside(docs, ("n_words", "hits", "items"))
    return restored(find_passages(rows, benchmark, window, longest_share))


def without(text: str, hits: list[dict]) -> str:
    """``text`` without the words of ``hits``."""
    raw = text.encode("utf-8", "surrogatepass")
    plain = raw.translate(_WORD_BYTES)
    places, at = [], 0
    for word in plain.split():
        at = plain.index(word, at)
        places.append((at, at + len(word)))
        at += len(word)
    out, at = [], 0
    for h in hits:
        out.append(raw[at : places[h["first"]][0]])
        at = places[h["last"]][1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
