"""Token counts of the sections of documents, from one encoding of each whole document.

Encoding the sections one by one would give other tokens than the document has.  Here a
document is encoded once, the characters each token covers are mapped to the sections
that lie there, and a token that crosses a border goes by a stated rule.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches
from weftline.llm.tokens import encoder, shared_source

#: first: the section of a crossing token's first byte; last: of its last byte; largest:
#: the section that holds most of its bytes, the first of equals.
RULES = ("first", "last", "largest")
SECTION_SCHEMA = "doc_id long, section long, start long, end long, n_tokens long, n_crossing long"


def section_tokens(borders: np.ndarray, lengths: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and those of them that cross a border.

    ``borders`` are byte offsets 0 .. n of sections without gaps, ``lengths`` the bytes of
    each token in order, which cover the text without gaps too.  Both are sorted, so the
    join of intervals is a search of token borders in section borders.
    """
    sections = len(borders) - 1
    ends = np.cumsum(lengths)
    starts = ends - lengths
    first = np.searchsorted(borders, starts, "right") - 1
    last = np.searchsorted(borders, ends, "left") - 1
    crossing = first < last
    at = first.copy() if rule != "last" else last.copy()
    if rule == "largest":
        for i in np.flatnonzero(crossing):
            inner = np.clip(borders[first[i] : last[i] + 2], starts[i], ends[i])
            at[i] = first[i] + int(np.argmax(np.diff(inner)))
    return np.bincount(at, minlength=sections), np.bincount(at[crossing], minlength=sections)


def count_section_tokens(docs: DataFrame, tokenizer: str, separator: str = "\n", rule: str = "first") -> DataFrame:
    """Tokens of every section of every row of ``docs`` (doc_id, text).

    A section reaches up to and with the next ``separator``; start and end are code
    points.  A null or empty text is one empty section without tokens.  The sum over a
    row's sections is the number of tokens of its whole text.  ``tokenizer`` is a
    byte-level file, whose tokens cover a text's bytes without gaps.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    source = shared_source(docs.sparkSession, tokenizer)

    def work(batches):
        code = encoder(source.value)
        if code.kind != "byte":
            raise ValueError("sections are counted with a byte-level tokenizer")
        lengths = code.byte_lengths()
        cut = re.compile(re.escape(separator))
        for batch in batches:
            columns: list[list] = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                places = [0, *(m.end() for m in cut.finditer(text))]
                if places[-1] < len(text) or len(places) == 1:
                    places.append(len(text))
                pieces = [text[a:b] for a, b in zip(places[:-1], places[1:])]
                borders = np.cumsum([0, *(len(p.encode("utf-8", "surrogatepass")) for p in pieces)])
                tokens, crossing = section_tokens(borders, lengths[code.encode(text)], rule)
                n = len(pieces)
                for column, values in zip(columns, ([doc_id] * n, range(n), places[:-1], places[1:], tokens, crossing)):
                    column.extend(values)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_batches(rows, work, SECTION_SCHEMA)
