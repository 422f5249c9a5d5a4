"""Byte-level BPE encoding and decoding with content-defined chunk reuse (operator 8).

A rolling hash over the last ``WINDOW`` bytes cuts texts into chunks of about ``2**mask_bits`` bytes,
so equal passages fall into equal chunks wherever they stand. A chunk is encoded once per Python
worker, over all its tasks, and kept (``CHUNK_BYTES`` of chunks, then the store is emptied: memory only, never results).

Chunk joins fall anywhere, inside words too, so the tokens around them are repaired: a chunk keeps
only the ids between its first and its last *certain* cut, and the text from the last certain cut
before a join to the first one after it is encoded again. A cut is certain before a single space
between two characters that are no white space: the pre-tokenizer starts a piece there whatever the
context, so re-encoding agrees with the whole text from there on; where a chunk has no two certain
cuts the repair grows over it into the next chunk. Between certain cuts the text is encoded piece by
piece, each piece by the library once per worker.

Defined cases: a null or empty text has no ids; every row gives one row, null and repeated ids included;
an empty table gives no rows; other columns are ignored. Special-token strings in a text become
their ids, as in the library's default.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, rolling_hash, slices, utf8
from .tokens import LATIN_END, PieceStore, byte_letters, split_signs, tokenizer

WINDOW, MASK_BITS, CHUNK_BYTES = 16, 10, 32 << 20
_BASE = 0xD1342543DE82EF95
_SPACES = frozenset(b" \t\n\v\f\r\x1c\x1d\x1e\x1f")


def _starts_plain(part: bytes) -> bool:
    return bool(part) and (part[0] not in _SPACES if part[0] < 0x80 else not part[:4].decode("utf-8", "ignore")[:1].isspace())


def _ends_plain(part: bytes) -> bool:
    return bool(part) and (part[-1] not in _SPACES if part[-1] < 0x80 else not part[-4:].decode("utf-8", "ignore")[-1:].isspace())


def _certain(left: bytes, right: bytes) -> bool:
    return _ends_plain(left) and _starts_plain(right)


def cut_points(buf: np.ndarray, mask_bits: int = MASK_BITS) -> np.ndarray:
    """Places (exclusive ends) where the hash of the ``WINDOW`` bytes before has its low bits zero
    and a character ends."""
    if len(buf) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    at = np.arange(WINDOW, len(buf) + 1)
    h = rolling_hash(buf.astype(np.uint64) + np.uint64(1), at - WINDOW, at, _BASE)
    nxt = np.append(buf[WINDOW:], 0)
    return at[((h & np.uint64((1 << mask_bits) - 1)) == 0) & ((nxt & 0xC0) != 0x80)]


class _Pieces(PieceStore):
    """Part -> ids of the part after ``lead`` (a space or nothing); None where its cuts are not certain.

    Inside a part, the pre-tokenizer splits before signs that follow a letter, and around a line end
    between two characters that are no white space."""

    def __init__(self, encoder, lead: bytes):
        super().__init__(encoder)
        self.lead, self.shown_lead = lead, self.letters[32] if lead else ""
        self.bare = self if not lead else _Pieces(encoder, b"")

    def __missing__(self, part: bytes) -> bytes | None:
        if part.isalpha():  # ASCII letters
            return self.keep(part, self.ascii_pretoken(self.shown_lead + part.decode()))
        if not (_starts_plain(part) and _ends_plain(part)):
            return self.keep(part, None)
        if b"\n" in part:
            first, *rest = part.split(b"\n")
            ids = [self[first], *map(self.bare.__getitem__, rest)]
            if None not in ids:
                return self.keep(part, self.line_end.join(ids))
        elif parts := split_signs(part):
            return self.keep(part, self[parts[0]] + self.bare[parts[1]])
        else:
            text = part.decode()
            if text.isalpha() and max(text) < LATIN_END:
                return self.keep(part, self.pretoken(self.lead.decode() + text))
        return self.keep(part, self.run(self.lead + part))

    @cached_property
    def line_end(self) -> bytes:
        return self.run(b"\n")


class ChunkCodec:
    """Encodes texts exactly as the library does, reusing chunks and pieces."""

    def __init__(self, path: str, mask_bits: int = MASK_BITS):
        self.encoder = tokenizer(path)
        self.pieces, self.mask_bits = _Pieces(self.encoder, b" "), mask_bits
        self.chunks: dict[bytes, tuple[bytes, bytes, bytes] | None] = {}
        self.chunk_bytes = self.reused = 0

    def _after_cut(self, parts: list[bytes]) -> bytes:
        """Ids of the parts, each with a space before it; the first starts at a certain cut."""
        ids = list(map(self.pieces.__getitem__, parts))
        if None not in ids:
            return b"".join(ids)
        out, held = [], [parts[0]]
        for part in parts[1:]:
            if _certain(held[-1], part):
                out.append(self._held(held))
                held = []
            held.append(part)
        out.append(self._held(held))
        return b"".join(out)

    def _held(self, parts: list[bytes]) -> bytes:
        one = self.pieces[parts[0]] if len(parts) == 1 else None
        return one if one is not None else self.pieces.run(b" " + b" ".join(parts))

    def _seam(self, text: bytes, at_cut: bool) -> bytes:
        """Ids of a text that ends at a certain cut or the end, and starts at one or at the start."""
        if not text:
            return b""
        parts = text.split(b" ")
        if at_cut:
            return self._after_cut(parts[1:])
        i = next((i for i in range(1, len(parts)) if _certain(parts[i - 1], parts[i])), len(parts))
        first = self.pieces.run(b" ".join(parts[:i]))
        return first + self._after_cut(parts[i:]) if i < len(parts) else first

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes, bytes] | None:
        """(text before the first certain cut, ids between, text from the last one on)."""
        if chunk in self.chunks:
            self.reused += 1
            return self.chunks[chunk]
        parts = chunk.split(b" ")
        i, j = 1, len(parts) - 1
        while i < len(parts) and not _certain(parts[i - 1], parts[i]):
            i += 1
        while j > i and not _certain(parts[j - 1], parts[j]):
            j -= 1
        done = None
        if i < j:
            done = b" ".join(parts[:i]), self._after_cut(parts[i:j]), b" " + b" ".join(parts[j:])
        self.chunk_bytes += len(chunk)
        if self.chunk_bytes > CHUNK_BYTES:
            self.chunks.clear()
            self.chunk_bytes = len(chunk)
        self.chunks[chunk] = done
        return done

    def encode(self, texts: list[bytes]) -> Iterator[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        for lo, hi in slices(texts):
            buf = np.frombuffer(b"".join(texts[lo:hi]), dtype=np.uint8)
            cuts, at = cut_points(buf, self.mask_bits), 0
            for text in texts[lo:hi]:
                own = cuts[np.searchsorted(cuts, at, side="right"):np.searchsorted(cuts, at + len(text))] - at
                at += len(text)
                out, seam, at_cut, a = [], b"", False, 0
                for b in [*own.tolist(), len(text)]:
                    chunk = text[a:b]
                    a = b
                    if (done := self._chunk(chunk)) is None:
                        seam += chunk
                        continue
                    out += self._seam(seam + done[0], at_cut), done[1]
                    seam, at_cut = done[2], True
                out.append(self._seam(seam, at_cut))
                yield b"".join(out)


def byte_table(encoder) -> list[bytes]:
    """The bytes that each id stands for (byte-level alphabets write bytes as printable characters)."""
    byte_of = {c: b for b, c in enumerate(byte_letters())}
    table = []
    for i in range(encoder.get_vocab_size(with_added_tokens=True)):
        token = encoder.id_to_token(i) or ""
        table.append(bytes(map(byte_of.get, token)) if all(c in byte_of for c in token) else token.encode())
    return table


def decode_bytes(ids: np.ndarray, table: list[bytes]) -> str:
    """The text of ids; bytes that are no UTF-8 become U+FFFD, as in the library."""
    return b"".join(map(table.__getitem__, ids.tolist())).decode("utf-8", "replace")


def encode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
           mask_bits: int = MASK_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, ids (array of int)."""
    rows = pick(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary, mask_bits)
        for b in batches:
            ids = [np.frombuffer(x, dtype="<i4") for x in codec.encode(utf8(b.column("text")))]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.list_(pa.int32()))})

    return rows.mapInArrow(scan, f"doc_id {id_type}, ids array<int>")


def decode(df: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``df``: doc_id, text."""
    rows = pick(df, doc_id=id_col, ids=ids_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = byte_table(tokenizer(vocabulary))
        for b in batches:
            texts = [decode_bytes(np.array(x or [], dtype=np.int64), table) for x in b.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string())})

    return rows.mapInArrow(scan, f"doc_id {id_type}, text string")


@lru_cache(maxsize=1)
def worker_codec(vocabulary: str, mask_bits: int) -> ChunkCodec:
    """The codec of this Python worker: later tasks find the chunks of earlier ones."""
    return ChunkCodec(vocabulary, mask_bits)


def round_trip(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text",
               mask_bits: int = MASK_BITS) -> DataFrame:
    """One row per row of ``df``: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas),
    decoded_sha256 (of the decoded text)."""
    rows = pick(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = worker_codec(vocabulary, mask_bits)
        table = byte_table(codec.encoder)
        decimal = [str(i).encode() for i in range(len(table))]
        for b in batches:
            n, shown, text = [], [], []
            for raw in codec.encode(utf8(b.column("text"))):
                ids = np.frombuffer(raw, dtype="<u4")
                n.append(len(ids))
                shown.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                text.append(hashlib.sha256(decode_bytes(ids, table).encode()).hexdigest())
            yield pa.record_batch({"doc_id": b.column("doc_id"), "n_tokens": pa.array(n, pa.int64()),
                                   "ids_sha256": pa.array(shown, pa.string()),
                                   "decoded_sha256": pa.array(text, pa.string())})

    return rows.mapInArrow(scan, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")
