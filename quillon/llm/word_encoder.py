"""A cache in front of a public tokenizer, exact for vocabularies that split at white space.

The short cuts hold for one kind of tokenizer, whose file names the steps in STEPS; a file
that names others is used through the library alone, text by text. That kind drops white space and encodes each run of letters, each digit and each run of
other signs by itself, so a text's ids are those of its words one after the other, and most
words have been met before. Words of ASCII and Latin-1 letters are cut into those pieces
here and only unknown pieces go to the tokenizer's model; any other word, and any that could
hold a special token, goes whole through the tokenizer. Texts with white space that is not
ASCII go through those same steps word by word. The cache lives as long as the worker and
is emptied when it is full.
"""

from __future__ import annotations

import json
import re
import struct
from functools import lru_cache

import numpy as np

#: Words, and pieces, that the cache holds at most.
WORDS, PIECES = 150_000, 200_000
#: One-to-one lower case, composed, no special tokens: ASCII but "<", and Latin-1 letters.
SIMPLE = re.compile("[\x21-\x3b\x3d-\x7eÀ-ÿ]+")
PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\\s0-9a-zß-öø-ÿ]+")


#: What a tokenizer's file has to say for the short cuts to hold, as the library prints it.
STEPS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "model": {"type": "BPE", "dropout": None},
    "bare tokens": [],
}


def _steps(file: dict) -> dict:
    """The steps that a tokenizer's file names, and its added tokens that hold no "<"."""
    out = {k: file.get(k) for k in ("truncation", "padding", "normalizer", "pre_tokenizer")}
    return out | {"model": {k: file["model"].get(k) for k in ("type", "dropout")}, "bare tokens": [t["content"] for t in file["added_tokens"] if "<" not in t["content"] or t["normalized"]]}


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write printable bytes as themselves, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(others)}


class WordEncoder:
    """Encodes texts for one tokenizer, each id as ``width`` little-endian bytes (2 or 4)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.plain = _steps(json.loads(self.tokenizer.to_str())) == STEPS
        self.size = self.tokenizer.get_vocab_size()
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.kind = np.dtype("<u4")

    def _bytes(self, ids: list[int]) -> bytes:
        return struct.pack(f"<{len(ids)}{'H' if self.kind.itemsize == 2 else 'I'}", *ids)

    def _piece(self, piece: str) -> bytes:
        if len(self.parts) >= PIECES:
            self.parts.clear()
        spelt = piece if piece.isascii() else "".join(map(self.letters.__getitem__, piece.encode()))
        out = self.parts[piece] = self._bytes([t.id for t in self.model.tokenize(spelt)])
        return out

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if not SIMPLE.fullmatch(text):
            return self._bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)
        text, parts = text.lower(), self.parts
        if text.isalpha():
            return parts.get(text) or self._piece(text)
        return b"".join([parts.get(p) or self._piece(p) for p in PIECE.findall(text)])

    def serialized(self, text: bytes, kind: np.dtype) -> bytes:
        """The ids of a text as an array of ``kind``, little-endian."""
        if not self.plain:
            self.kind = kind
            return self._bytes(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids)
        if kind != self.kind:
            self.known.clear()
            self.parts.clear()
            self.kind = kind
        words, known = text.split(), self.known
        new = set(words).difference(known)
        if len(known) + len(new) > WORDS:
            known.clear()
            new = set(words)
        if len(new) > WORDS:  # one text with more words than the cache may hold
            return b"".join(map(self._word, words))
        for w in new:
            known[w] = self._word(w)
        return b"".join(map(known.__getitem__, words))

    def ids(self, text: bytes) -> list[int]:
        return np.frombuffer(self.serialized(text, np.dtype("<u4")), "<u4").tolist()


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)
