"""Shared helpers: row views, lineage cuts, and word tables over Arrow batches.

A *word* is a maximal run of bytes other than space and ``\\t\\n\\v\\f\\r``; as those are ASCII,
words can be cut from UTF-8 bytes. :class:`WordTable` holds the words of many texts as arrays
(start, end, 64-bit hash), so operators work on whole batches without a loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.session import scratch_path

#: Bytes of text that one array pass takes; bounds the memory of a Python worker.
SLICE_BYTES = 1 << 20



def pick(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under fixed names: other columns of the caller, whatever their
    names, never reach an operator."""
    return df.select(*[(F.col(f"`{c}`") if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet under the shared folder and read again: cuts the lineage,
    survives lost executors, and gives every later reader the same rows."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def document_key(id_col: str, text_col: str) -> Column:
    """Key of the document a row holds: its id with the hash of its text (a null text reads as empty), null
    where the id is. Rows with one id and one text are one document; different texts of one id are several."""
    doc_id = F.col(f"`{id_col}`")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return F.when(doc_id.isNotNull(), F.struct(doc_id.alias("doc_id"), F.xxhash64(text).alias("h")))


def spark_of(df: DataFrame) -> SparkSession:
    return df.sparkSession


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null reads as empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def slices(texts: list[bytes], limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes together (one text at least)."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, dtype=np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (xor-shift and multiply, a bijection)."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def rolling_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial of ``values[start:end]`` modulo 2**64 by one prefix sum. It chooses places only: structured
    ranges may share a value, so it never stands for equality."""
    up, down = _powers(base, 1 << max(16, int(len(values) + 1).bit_length()))
    prefix = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * up[: len(values)], out=prefix[1:])
    return mix((prefix[ends] - prefix[starts]) * down[starts])


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(mix(a * np.uint64(0x5851F42D4C957F2D)) + b)


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of ``values[start:end]`` for each range: equal ranges have equal hashes wherever they stand.
    Blocks of 1, 2, 4... values are hashed from the two halves by a non-linear step, and a range from the two
    greatest blocks that cover it and its length. An empty range hashes to 0."""
    size = np.asarray(ends) - np.asarray(starts)
    out = np.zeros(len(size), dtype=np.uint64)
    level = np.frexp(size.astype(np.float64))[1] - 1  # of the greatest block that fits
    block, width = values, 1
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        if len(at):
            out[at] = _join(_join(block[starts[at]], block[ends[at] - width]), size[at].astype(np.uint64))
        if len(block) <= width:
            break
        block = _join(block[:-width], block[width:])
        width *= 2
    return out


def byte_class(*members: int) -> np.ndarray:
    """A table of 256 flags, set for the given bytes."""
    out = np.zeros(256, dtype=bool)
    out[list(members)] = True
    return out


_SPACE = byte_class(0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
LANE_BYTES = 64  # longer words are hashed by XXH64, one by one


def word_hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each word: eight bytes at a time, joined by the step of ``range_hash``, with the
    length; words over ``LANE_BYTES`` by XXH64."""
    padded = np.concatenate([buf, np.zeros(8, dtype=np.uint8)])
    lanes = np.lib.stride_tricks.as_strided(padded.view(np.uint8), (len(buf) + 1, 8), (1, 1))
    size = end - start
    out = size.astype(np.uint64)
    at = np.flatnonzero(size <= LANE_BYTES)
    done = 0
    while len(at):
        left = size[at] - done
        value = np.ascontiguousarray(lanes[start[at] + done]).view(np.uint64).ravel()
        part = left < 8
        value[part] &= (np.uint64(1) << (8 * left[part]).astype(np.uint64)) - np.uint64(1)
        out[at] = _join(out[at], value)
        done += 8
        at = at[left > 8]
    for k in np.flatnonzero(size > LANE_BYTES).tolist():
        out[k] = xxhash.xxh64_intdigest(buf[start[k]:end[k]].tobytes())
    return out


class WordTable:
    """Words of a list of texts: maximal runs of bytes outside ``gap``. ``buf``: the texts joined by newlines;
    ``start``/``end``: byte ranges of the words in it; ``first``: index of each text's first word, with the
    total last; ``hash`` (with ``hashed``): a 64-bit hash of each word."""

    def __init__(self, texts: list[bytes], hashed: bool = True, gap: np.ndarray = _SPACE):
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
        self.offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=self.offset[1:])
        self.inside = ~gap[self.buf]
        edge = np.flatnonzero(self.inside[1:] != self.inside[:-1]) + 1
        if len(self.inside) and self.inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[0::2], edge[1::2]
        self.first = np.searchsorted(self.start, self.offset)
        if hashed:
            self.hash = word_hash(self.buf, self.start, self.end)

    def distinct(self) -> tuple[list[bytes], np.ndarray]:
        """The distinct words, and each word's place among them."""
        ends = np.zeros(len(self.start) + 1, dtype=np.int64)
        np.cumsum(self.end - self.start, out=ends[1:])
        parts = [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(self.buf[self.inside]))]
        coded = pa.Array.from_buffers(pa.large_binary(), len(self.start), parts).dictionary_encode()
        return coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)

    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def sliding(values: np.ndarray, width: int, pick_of) -> np.ndarray:
    """``pick_of`` (np.minimum or np.maximum) over every ``values[i:i + width]``, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = pick_of(out[: len(out) - step], out[step:]), have + step
    return out
