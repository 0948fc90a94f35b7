"""A bounded cache of word pieces about a tokenizer of the tokenizers library.

A tokenizer that lower-cases, cuts a text into pieces by one pattern, drops white space
and never lets a token span two pieces gives a text the ids of its pieces. Each distinct
piece is encoded by the library once and then looked up. Whether a tokenizer is of that
kind is read from its description. Of such a tokenizer, a text of plain letters is cut
here by the tokenizer's own pattern; any other text, and any text for another kind of
tokenizer, is given to the library.
"""

from __future__ import annotations

import json
import re
import unicodedata
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Pieces held at once; at the bound the cache starts anew.
MAX_PIECES = 400_000
#: Letters beyond this code point are left to the library.
PLAIN_END = 0x17F


def _ranges(points: list[int]) -> str:
    return "".join(re.escape(chr(p)) for p in points)


def _plain_points() -> list[int]:
    """Printable characters up to PLAIN_END that normalisation leaves as they are and
    whose lower case is one character of that range."""
    points = []
    for p in range(0x21, PLAIN_END + 1):
        c = chr(p)
        low = c.lower()
        if unicodedata.category(c)[0] in "CZ" or unicodedata.normalize("NFC", c) != c:
            continue
        if len(low) == 1 and ord(low) <= PLAIN_END:
            points.append(p)
    return points


def _byte_letters() -> dict[int, int]:
    """Byte-level tokenizers write a byte as a letter: visible Latin-1 characters stand
    for themselves, the other bytes follow from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: 256 + i for i, b in enumerate(hidden)}


BYTE_LETTERS = _byte_letters()


class Pieces(dict):
    """Piece -> its ids as bytes, encoded by the library's model when first met."""

    def __init__(self, owner: WordBpe) -> None:
        super().__init__()
        self.tokenize = owner.tokenizer.model.tokenize
        self.dtype = owner.dtype

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MAX_PIECES:
            self.clear()
        letters = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
        ids = np.array([t.id for t in self.tokenize(letters)], self.dtype).tobytes()
        self[piece] = ids
        return ids


class WordBpe:
    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        self.token = [""] * self.size
        for token, i in vocabulary.items():
            self.token[i] = token
        self.dtype = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.description = json.loads(self.tokenizer.to_str())
        self.specials = [t["content"] for t in self.description["added_tokens"]]
        self.split = self._pattern()
        self.odd = re.compile(f"[^ \n{_ranges(_plain_points())}]")
        self.pieces = Pieces(self)

    def _pattern(self) -> re.Pattern | None:
        """The tokenizer's pattern of pieces over plain text; None for another kind."""
        d = self.description
        normal = (d["normalizer"] or {}).get("normalizers", [])
        before = (d["pre_tokenizer"] or {}).get("pretokenizers", [])
        fits = (
            [n["type"] for n in normal] == ["NFC", "Replace", "Lowercase"]
            and (normal[1]["pattern"], normal[1]["content"]) == ({"Regex": r"\s+"}, " ")
            and [b["type"] for b in before] == ["Split", "ByteLevel"]
            and (before[0]["behavior"], before[0]["invert"]) == ("Removed", True)
            and r"[^\s\p{L}\p{N}]+" in before[0]["pattern"].get("Regex", "")
            and not before[1]["add_prefix_space"]
            and not before[1]["use_regex"]
            and d["post_processor"] is None
        )
        if not fits:
            return None
        points = _plain_points()
        letters = _ranges([p for p in points if unicodedata.category(chr(p))[0] == "L"])
        numbers = _ranges([p for p in points if unicodedata.category(chr(p))[0] == "N"])
        pattern = before[0]["pattern"]["Regex"]
        pattern = pattern.replace(r"[\p{L}]", f"[{letters}]").replace(r"[\p{N}]", f"[{numbers}]")
        pattern = pattern.replace(r"\p{L}", letters).replace(r"\p{N}", numbers)
        return None if r"\p" in pattern else re.compile(pattern)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library's own ids of whole texts."""
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, text: str) -> np.ndarray:
        if self.split is None or self.odd.search(text) or any(s in text for s in self.specials):
            return np.array(self.whole([text])[0], self.dtype)
        parts = self.split.findall(text.lower())
        return np.frombuffer(b"".join(map(self.pieces.__getitem__, parts)), self.dtype)

    def decode(self, ids: list[int]) -> str:
        """As the library's ``decode(ids, skip_special_tokens=False)``: a tokenizer without
        a decoder joins its tokens by spaces."""
        if self.tokenizer.decoder is None:
            return " ".join(map(self.token.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One per worker process, kept between tasks."""
    return WordBpe(path)
