"""Character n-gram helpers.

* ``gram_bits``: native expression, the set of hashed n-gram bits of a string
  (bit = first 7 hex digits of md5(gram) as an integer, mod ``nbits``).
* ``paired_grams`` and what is built on it: the n-grams of two columns over a
  whole slice of rows, as arrays of (row, gram). Both strings of a pair sit on
  one row, so clipping needs no shuffle, and no step loops over rows.
* ``edit_distances``: bit-parallel edit distance of many pairs at once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def char_ngrams(c: Column, n: int) -> Column:
    """All character n-grams of ``c`` in order; [] when shorter than n."""
    last = F.length(c) - F.lit(n) + 1
    idx = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(idx, lambda i: F.substring(c, i, n))


def gram_bits(c: Column, ns, nbits: int) -> Column:
    """Distinct hashed bits of the n-grams of ``c`` for every n in ``ns``
    (grams are de-duplicated before hashing)."""
    grams = F.array_distinct(F.flatten(F.array(*[char_ngrams(c, n) for n in ns])))
    bits = F.transform(grams, lambda g: F.pmod(F.conv(F.substring(F.md5(g), 1, 7), 16, 10).cast("long"),
                                               F.lit(nbits)))
    return F.array_distinct(bits)


def set_tanimoto(a: Column, b: Column, empty_value: float = 0.0) -> Column:
    """|A and B| / |A or B| for two distinct-valued arrays; both empty -> ``empty_value``."""
    union = F.nullif(F.size(F.array_union(a, b)), F.lit(0))
    return F.coalesce(F.size(F.array_intersect(a, b)) / union, F.lit(float(empty_value)))


class Grams(NamedTuple):
    """The distinct n-grams of every row: entry k says that gram ``gram[k]`` stands ``left[k]`` times in the left
    string of row ``row[k]`` and ``right[k]`` times in the right one. ``at``: for each gram number the place of one
    occurrence in the joined strings."""

    n: int
    row: np.ndarray
    gram: np.ndarray
    left: np.ndarray
    right: np.ndarray
    at: np.ndarray


def paired_grams(left: Sequence[str], right: Sequence[str], sizes: Sequence[int]) -> Iterator[Grams]:
    """:class:`Grams` for each n of ``sizes`` (ascending). Grams are numbered over the whole slice: an n-gram is its
    first n - 1 characters' number and its last character, numbered anew by hashing."""
    strings = [*left, *right]
    rows, total = len(left), sum(map(len, left))
    lengths = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    values = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes, alphabet = pd.factorize(values)
    row = np.repeat(np.tile(np.arange(rows), 2), lengths)
    end = np.repeat(np.cumsum(lengths), lengths)
    at, gram = np.arange(len(values)), codes
    for n in range(1, max(sizes) + 1):
        if n > 1:
            whole = at + n <= end[at]
            at = at[whole]
            gram = pd.factorize(gram[whole] * len(alphabet) + codes[at + n - 1])[0]
        if n in sizes:
            n_grams = int(gram.max(initial=-1)) + 1
            entry, distinct = pd.factorize(row[at] * n_grams + gram)
            split = np.searchsorted(at, total)
            place = np.zeros(n_grams, dtype=np.int64)
            place[gram] = at
            yield Grams(n, distinct // max(n_grams, 1), distinct % max(n_grams, 1), np.bincount(entry[:split], minlength=len(distinct)),
                        np.bincount(entry[split:], minlength=len(distinct)), place)


_MD5_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_MD5_SINES = [int(abs(math.sin(i + 1)) * (1 << 32)) for i in range(64)]
_MD5_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_MD5_ROWS, _MD5_BLOCK = 1 << 13, 55  # messages of one pass; bytes that fit a message of one block


def _md5_first(octets: np.ndarray, start: np.ndarray, size: int) -> np.ndarray:
    """The first 32 bits of the md5 (as a big-endian integer) of the ``size`` bytes at each place of ``start``, by
    arrays: the 64 steps of the digest's only block."""
    words = [np.zeros(len(start), dtype=np.uint32) for _ in range(size // 4 + 1)]
    for k in range(size):
        words[k // 4] |= octets[start + k].astype(np.uint32) << np.uint32(8 * (k % 4))
    words[size // 4] |= np.uint32(0x80 << 8 * (size % 4))
    message = dict(enumerate(words)) | {14: np.uint32(size * 8)}
    a, b, c, d = (np.full(len(start), v, dtype=np.uint32) for v in _MD5_START)
    for i in range(64):
        if i < 16:
            f, k = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, k = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, k = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, k = c ^ (b | ~d), 7 * i % 16
        f += a
        f += np.uint32(_MD5_SINES[i])
        if k in message:
            f += message[k]
        turn = _MD5_SHIFTS[i // 16][i % 4]
        a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
    return (a + np.uint32(_MD5_START[0])).byteswap()


class GramHashes:
    """First 7 hex digits of the md5 (= its top 28 bits) of n-grams of a text, given by their places in it. Nothing is
    kept between texts, so memory is that of the text."""

    def __init__(self, text: str):
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        self.octets = np.frombuffer(text.encode(), dtype=np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), dtype=np.int64)])

    def __call__(self, at: np.ndarray, n: int) -> np.ndarray:
        start = self.begin[at]
        size = self.begin[at + n] - start
        out = np.empty(len(at), dtype=np.int64)
        for length in np.unique(size).tolist():
            which = np.flatnonzero(size == length)
            for lo in range(0, len(which), _MD5_ROWS):
                rows = which[lo:lo + _MD5_ROWS]
                if length <= _MD5_BLOCK:
                    out[rows] = _md5_first(self.octets, start[rows], length) >> np.uint32(4)
                else:
                    out[rows] = [int.from_bytes(hashlib.md5(self.octets[i:i + length].tobytes()).digest()[:4], "big") >> 4 for i in start[rows].tolist()]
        return out


def pair_counts(left: Sequence[str], right: Sequence[str], max_n: int = 0, widths: dict[int, tuple[int, ...]] | None = None,
                empty_value: float = 0.0) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """For rows of (left, right): ``matches[n - 1, row]``, the clipped n-gram matches for n up to ``max_n`` (sum over
    the left string's n-grams of the lesser of both counts), and per width of ``widths`` (bits -> n-gram sizes) the set
    Tanimoto of the hashed fingerprints, the same bits as ``gram_bits``."""
    rows, widths = len(left), widths or {}
    matches = np.zeros((max_n, rows), dtype=np.int64)
    flags = {w: np.zeros((2, rows, w), dtype=bool) for w in widths}
    hashed = {n for sizes in widths.values() for n in sizes}
    hash_of = GramHashes("".join([*left, *right])) if hashed else None
    for g in paired_grams(left, right, sorted({*range(1, max_n + 1), *hashed})):
        if g.n <= max_n:
            matches[g.n - 1] = np.bincount(g.row, np.minimum(g.left, g.right), minlength=rows)
        if g.n in hashed:
            value = hash_of(g.at, g.n)
            for w, sizes in widths.items():
                if g.n in sizes:
                    bit = (value % w)[g.gram]
                    for side, held in enumerate((g.left > 0, g.right > 0)):
                        flags[w][side, g.row[held], bit[held]] = True
    tanimoto = {}
    for w, (a, b) in flags.items():
        both, either = (a & b).sum(axis=1), (a | b).sum(axis=1)
        tanimoto[w] = np.where(either > 0, both / np.maximum(either, 1), float(empty_value))
    return matches, tanimoto


def edit_distances(left: Sequence[str], right: Sequence[str], words: int = 1 << 13) -> np.ndarray:
    """Levenshtein distance over code points of each pair. Pairs of like lengths go through the bit-parallel
    recurrence together, about ``words`` 64-bit words of pattern at a time."""
    out = np.zeros(len(left), dtype=np.int64)
    todo = []
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        if a != b:
            todo.append((-(-min(len(a), len(b)) // 64), max(len(a), len(b)), k))
    todo.sort()
    lo = 0
    while lo < len(todo):
        hi = lo + 1
        while hi < len(todo) and (hi + 1 - lo) * max(1, todo[hi][0]) <= words:
            hi += 1
        at = [k for *_, k in todo[lo:hi]]
        pairs = [sorted((left[k], right[k]), key=len) for k in at]
        out[at] = _edit_distances([p[0] for p in pairs], [p[1] for p in pairs])
        lo = hi
    return out


def _flat(strings: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(code point, its string, its place there) of all strings, and their lengths."""
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    values = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    row = np.repeat(np.arange(len(n)), n)
    return values.astype(np.int64), row, np.arange(len(values)) - np.repeat(np.cumsum(n) - n, n), n


def _edit_distances(short: Sequence[str], long: Sequence[str]) -> np.ndarray:
    """Columns of the edit matrix as differences in bits (pattern: the short string), for all pairs at once: one step
    per character of the long strings, each on arrays of (pair, word)."""
    c, row, place, m = _flat(short)
    n_words = max(1, -(-int(m.max(initial=0)) // 64))
    letters, letter = np.unique(row << 21 | c, return_inverse=True)
    equal = np.zeros((len(letters) + 1, n_words), dtype=np.uint64)  # where each letter of a pair stands; last: nowhere
    np.bitwise_or.at(equal, (letter, place // 64), np.uint64(1) << (place % 64).astype(np.uint64))
    c, row, place, n = _flat(long)
    steps = np.full((int(n.max(initial=0)), len(n)), len(letters), dtype=np.int64)
    if len(letters):
        at = np.minimum(np.searchsorted(letters, row << 21 | c), len(letters) - 1)
        steps[place, row] = np.where(letters[at] == (row << 21 | c), at, len(letters))
    one, high = np.uint64(1), np.uint64(63)
    up = np.full((len(n), n_words), ~np.uint64(0))  # +1 steps down the column
    down = np.zeros_like(up)  # -1 steps
    last = np.maximum(m - 1, 0)
    pairs, word, bit = np.arange(len(n)), last // 64, (last % 64).astype(np.uint64)
    score = m.copy()
    for j, step in enumerate(steps):
        eq = equal[step]
        vertical = eq | down
        a = eq & up
        total = a + up
        carry = total < a
        while n_words > 1 and carry[:, :-1].any():
            more = np.zeros_like(total)
            more[:, 1:] = carry[:, :-1]
            total += more
            carry = (total == 0) & (more == one)
        horizontal = (total ^ up) | eq
        plus = down | ~(horizontal | up)
        minus = up & horizontal
        change = ((plus[pairs, word] >> bit) & one).astype(np.int64) - ((minus[pairs, word] >> bit) & one).astype(np.int64)
        score += np.where(j < n, change, 0)
        over_plus, over_minus = plus >> high, minus >> high
        plus <<= one
        minus <<= one
        plus[:, 0] |= one
        plus[:, 1:] |= over_plus[:, :-1]
        minus[:, 1:] |= over_minus[:, :-1]
        up = minus | ~(vertical | plus)
        down = plus & vertical
    return np.where(m == 0, n, score)
