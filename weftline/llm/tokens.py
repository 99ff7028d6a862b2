"""Whole texts to ids with a public tokenizer file, each distinct chunk encoded once.

Encoding a text anew costs most of its time on words seen before.  In a text of plain
Latin characters the pre-tokenizer never crosses a single blank or line end between two words, so the
text is cut there and a chunk's ids are kept in a table bounded by bytes; a chunk that is not in
the table is cut by the file's own pattern and its pieces go through the library's model.
Every other text (one with the content of an added token among them), and every other
kind of tokenizer, goes through the library whole.
"""

from __future__ import annotations

import json
import re
from pathlib import Path
from struct import pack

import numpy as np
from tokenizers import Tokenizer

# The letters and numbers of Latin-1, the texts taken apart here, and the
# patterns of the two pre-tokenizers, written for these characters.
LETTER = "A-Za-zªµºÀ-ÖØ-öø-ÿ"
NUMBER = "0-9²³¹¼½¾"
OTHER_TEXT = re.compile("[^\t\n\r\x20-\x7e\xa1-\xff]")
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
WORD_PIECES = re.compile(f"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^\\s{LETTER}{NUMBER}]+")
BYTE_PIECES = re.compile(f"{ENDINGS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LETTER}{NUMBER}]+|\\s+(?!\\S)|\\s+")

BLANK_RUN = re.compile(r"\s\s")
BEFORE_SINGLE_BLANK = re.compile(r"(?<=\S)(?=[ \n]\S)")

#: Bytes of the table of one worker, of which two generations are kept, and what an entry
#: takes beside its characters and ids; chunks of a text that are looked up at a time.
KEPT_BYTES, ENTRY_BYTES, CHUNKS_AT_ONCE = 96 << 20, 190, 50_000


def byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 160, 173)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts as little-endian arrays.

    ``room`` bounds the bytes of the kept table: when it is full it becomes the older one, from
    which chunks that occur again are taken over, and the one before that goes.
    """

    def __init__(self, source: str, room: int = KEPT_BYTES):
        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        kind = json.loads(source)
        pre, norm = kind.get("pre_tokenizer") or {}, kind.get("normalizer")
        steps = [x["type"] for x in (norm or {}).get("normalizers", [])]
        split = next((x for x in pre.get("pretokenizers", []) if x["type"] == "Split"), None)
        self.kind = "whole"
        if kind["model"]["type"] == "BPE" and not kind["model"].get("dropout"):
            if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
                self.kind = "byte"
            elif steps == ["NFC", "Replace", "Lowercase"] and split and split["pattern"].get("Regex", "").startswith(ENDINGS + "|[\\p{L}]+|[\\p{N}]|"):
                self.kind = "word"
        # Added tokens are found before a text is cut up; a text that may hold one goes through the library whole.
        self.added = [t["content"] for t in kind.get("added_tokens", []) if t["content"]]
        self.added += [t.lower() for t in self.added if self.kind == "word" and t.lower() not in self.added]
        vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if vocabulary <= 1 << 16 else "<u4")
        self.format = "<%d" + ("H" if self.dtype.itemsize == 2 else "I")
        self.room = room
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.size = self.size_of_pieces = 0
        self.shown = byte_characters()

    def _piece(self, piece: str) -> bytes:
        if (kept := self.pieces.get(piece)) is None:
            if piece.isascii() and piece.isprintable():
                shown = piece.replace(" ", self.shown[32])
            else:
                shown = piece.encode().decode("latin-1").translate(self.shown)
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
            kept = pack(self.format % len(ids), *ids)
            self.size_of_pieces += len(piece) + len(kept) + ENTRY_BYTES
            if self.size_of_pieces > self.room // 2:
                self.pieces.clear()
                self.size_of_pieces = 0
            self.pieces[piece] = kept
        return kept

    def _chunks(self, text: str) -> list[str]:
        if self.kind == "word":
            return text.lower().split()
        if BLANK_RUN.search(text):
            return BEFORE_SINGLE_BLANK.split(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def _may_hold_added(self, text: str) -> bool:
        text = text.lower() if self.kind == "word" else text
        return any(token in text for token in self.added)

    def encode(self, text: str) -> np.ndarray:
        """The ids of one whole text."""
        if not text:
            return np.zeros(0, self.dtype)
        if self.kind == "whole" or OTHER_TEXT.search(text) or self._may_hold_added(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype)
        chunks = self._chunks(text)
        parts = [self._kept(chunks[at : at + CHUNKS_AT_ONCE]) for at in range(0, len(chunks), CHUNKS_AT_ONCE)]
        return np.frombuffer(b"".join(parts), self.dtype)

    def _kept(self, chunks: list[str]) -> bytes:
        """Ids of some chunks, of which the new ones are encoded and kept."""
        if self.size > self.room:
            self.known, self.older, self.size = {}, self.known, 0
        known, older, pieces = self.known, self.older, WORD_PIECES if self.kind == "word" else BYTE_PIECES
        for chunk in set(chunks).difference(known):
            if (kept := older.get(chunk)) is None:
                kept = b"".join(map(self._piece, pieces.findall(chunk)))
            known[chunk] = kept
            self.size += len(chunk) + len(kept) + ENTRY_BYTES
        return b"".join(map(known.__getitem__, chunks))

    def byte_lengths(self) -> np.ndarray:
        """Bytes that each id of a byte-level vocabulary stands for."""
        back = {c: b for b, c in self.shown.items()}
        lengths = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), np.int64)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            lengths[i] = len(token) if all(c in back for c in token) else len(token.encode())
        return lengths


_ENCODERS: dict[int, Encoder] = {}


def encoder(source: str) -> Encoder:
    """The worker's own encoder for a tokenizer file: its table outlives a task."""
    key = hash(source)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(source)
    return _ENCODERS[key]


def shared_source(spark, path: str):
    """The tokenizer file as a broadcast: a vocabulary file, whatever the corpus."""
    return spark.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))
