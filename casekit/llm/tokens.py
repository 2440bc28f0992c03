"""The tokenizers library with a memory for words.

All three steps of the vocabulary's pipeline work within a run of characters without white space: normalisation
(NFC, white space, lower case), the split into letters, digits and signs, and byte-pair merging. So the tokens
of a text are those of its runs between ASCII white space, one after the other, and each run is encoded once.
"""

from __future__ import annotations

import re
from array import array
from functools import cache

from tokenizers import Tokenizer

MOST_WORDS = 400_000
LONGEST_WORD = 64

# The vocabulary's own split, narrowed to lower-case words of Latin letters, digits and ASCII signs.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ňŊ-ž]+")
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ž]+|[0-9]|[!-/:-@\[-`{-~]+")
# Byte-level vocabularies write the bytes that have no visible Latin-1 letter as letters from U+0100 on.
HIDDEN = [b for b in range(256) if not (0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE)]
BYTE_LETTERS = {b: 256 + k for k, b in enumerate(HIDDEN)}


class WordTokens(dict):
    """UTF-8 word → its ids as little-endian 32-bit numbers; forgets all when it has too many words."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= MOST_WORDS:
            self.clear()
        ids = self.plain(word.decode()) if len(word) <= LONGEST_WORD else None
        if ids is None:
            ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        out = array("I", ids).tobytes()
        if len(word) <= LONGEST_WORD:
            self[word] = out
        return out

    def plain(self, word: str) -> list[int] | None:
        """Ids of a word of common characters by the library's model alone; None if it needs the whole library."""
        if "<|" in word or not PLAIN.fullmatch(word):
            return None
        out: list[int] = []
        for piece in PIECES.findall(word.lower()):
            piece = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTE_LETTERS)
            out += [t.id for t in self.model.tokenize(piece)]
        return out

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text. ASCII capitals are lowered first, unless a special token might be meant."""
        text = text if b"<|" in text else text.lower()
        return b"".join(map(self.__getitem__, text.split()))


@cache
def word_tokens(path: str) -> WordTokens:
    """One memory for each Python worker."""
    return WordTokens(path)
