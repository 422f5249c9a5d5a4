"""Exact token ids with reuse of encoded pieces, shared by packing and BPE encoding.

A piece is split only where the pre-tokenizer splits whatever stands around it, and each part is
encoded by the library once per Python worker and kept; the store is emptied at ``STORE_ITEMS``
entries, which bounds its memory. A part that is one word of Latin letters is one pre-token, so it
goes straight to the library's BPE model, which spares the normaliser and the patterns.

:class:`WordCodec` is for vocabularies that drop white space and case: no rule looks across white
space, so a text's ids are those of its words.
"""

from __future__ import annotations

import os
from array import array

STORE_ITEMS = 400_000
#: Signs that the pre-tokenizers split from a letter before them, and never from each other.
SIGNS = b".,;:!?"
_LETTERS = frozenset(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
#: Letters below this code point have no combining forms: a word of them is in every normal form.
LATIN_END = "ɐ"


def tokenizer(path: str):
    """The tokenizers library's encoder, without threads of its own, truncation or padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def byte_letters() -> list[str]:
    """The printable character that a byte-level alphabet writes for each byte."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, more = [], 256
    for b in range(256):
        out.append(chr(b if b in printable else more))
        more += b not in printable
    return out


def split_signs(word: bytes) -> tuple[bytes, bytes] | None:
    """(letters before, signs) of a word that ends in signs after an ASCII letter."""
    base = word.rstrip(SIGNS)
    return (base, word[len(base):]) if len(base) < len(word) and base and base[-1] in _LETTERS else None


class PieceStore(dict):
    """Piece (bytes) -> its ids as little-endian 32-bit integers."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder, self.model = encoder, encoder.model
        self.letters = dict(enumerate(byte_letters()))

    def keep(self, piece: bytes, ids: bytes | None) -> bytes | None:
        if len(self) >= STORE_ITEMS:
            self.clear()
        self[piece] = ids
        return ids

    def run(self, text: bytes) -> bytes:
        """Ids of any text, by the whole library."""
        return array("I", self.encoder.encode(text.decode(), add_special_tokens=False).ids).tobytes()

    def ascii_pretoken(self, shown: str) -> bytes:
        """Ids of one pre-token whose bytes are written as themselves."""
        return array("I", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def pretoken(self, text: str) -> bytes:
        """Ids of one pre-token."""
        return self.ascii_pretoken(text.encode().decode("latin-1").translate(self.letters))


class WordCodec(PieceStore):
    """Words of a vocabulary with lower-casing and without white space."""

    def __init__(self, path: str):
        super().__init__(tokenizer(path))

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha():  # ASCII letters
            return self.keep(word, self.ascii_pretoken(word.lower().decode()))
        if parts := split_signs(word):
            return self.keep(word, self[parts[0]] + self[parts[1]])
        text = word.decode()
        if text.isalpha() and max(text) < LATIN_END:
            low = text.lower()
            if low.isalpha() and max(low) < LATIN_END:
                return self.keep(word, self.pretoken(low))
        return self.keep(word, self.run(word))

    def encode(self, text: bytes) -> bytes:
        return b"".join(map(self.__getitem__, text.split()))
