"""Quality rules with suffix-array repetition (operator 2).

Each text gets a suffix array over its words. Neighbouring suffixes with a longest common prefix of
``min_repeat_words`` or more words bound the LCP intervals, whose strings are the maximal repeated
substrings; their places are united, and a text passes if the united places cover no more than
``max_covered`` of its words and the longest repeat has no more than ``max_longest`` words. The
arrays of a whole slice of texts are built together by prefix doubling (numpy), with the text as
part of the first rank, so that texts never match each other; only suffixes that still tie are
sorted again, so the work follows the repetition that is there.

Plain rules before it (fixed by the contract of the query): at least 20 words, and no more than 30 %
of the words in 8-word windows found twice.

Defined cases: a null or empty text has no words and fails the base rules; every row gives one row,
null and repeated ids included; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WordTable, pick, slices, utf8

MIN_REPEAT_WORDS, MAX_COVERED, MAX_LONGEST = 8, 0.2, 100
BASE_WINDOW, BASE_MIN_WORDS, BASE_MAX_PERCENT = 8, 20, 30

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def neighbour_lcp(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each suffix the longest prefix, in words, that it shares with another suffix of its own
    text: the greater LCP with its two neighbours in the suffix array."""
    n = len(hashes)
    if n < 2:
        return np.zeros(n, dtype=np.int64)
    order = np.lexsort((hashes, text))
    same = (hashes[order][1:] == hashes[order][:-1]) & (text[order][1:] == text[order][:-1])
    head = np.concatenate([[0], np.where(same, 0, np.arange(1, n))])
    rank = np.empty(n + 1, dtype=np.int64)  # a suffix's rank is the place of its group's first
    rank[order] = np.maximum.accumulate(head)
    rank[n] = -1
    levels, h = [rank.copy()], 1
    tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    active = order[tied]  # kept in the order of their ranks
    while len(active):
        after = np.where(active + h < n, rank[np.minimum(active + h, n)], -1)
        sub = np.lexsort((after, rank[active]))
        a, r, f = active[sub], rank[active[sub]], after[sub]
        same = (r[1:] == r[:-1]) & (f[1:] == f[:-1])
        start = np.concatenate([[True], r[1:] != r[:-1]])
        at = np.arange(len(a))
        begin = np.maximum.accumulate(np.where(start, at, 0))  # of the old group
        fresh = np.maximum.accumulate(np.where(np.concatenate([[True], ~same]), at, 0))  # of the new
        rank[a] = r + fresh - begin
        tied = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        active = a[tied]
        levels.append(rank.copy())
        h *= 2
    place = np.empty(n, dtype=np.int64)
    place[rank[:n]] = np.arange(n)  # all ranks differ now: the suffix array
    lcp = np.zeros(n - 1, dtype=np.int64)
    left, right = place[:-1].copy(), place[1:].copy()
    for j in range(len(levels) - 1, -1, -1):
        eq = (levels[j][left] == levels[j][right]) & (left < n) & (right < n)
        lcp += eq * (1 << j)
        left, right = (np.minimum(x + eq * (1 << j), n) for x in (left, right))
    best = np.zeros(n, dtype=np.int64)
    best[place[1:]] = lcp
    best[place[:-1]] = np.maximum(best[place[:-1]], lcp)
    return best


def _covered(lcp: np.ndarray, least: int) -> np.ndarray:
    """Whether each word lies in a repeated substring of ``least`` words or more."""
    at = np.flatnonzero(lcp >= least)
    step = np.zeros(len(lcp) + 1, dtype=np.int64)
    np.add.at(step, at, 1)
    np.add.at(step, at + lcp[at], -1)
    return np.cumsum(step[:-1]) > 0


def _covered_windows(lcp: np.ndarray, width: int) -> np.ndarray:
    return _covered(np.where(lcp >= width, width, 0), width)


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_repeat_words: int = MIN_REPEAT_WORDS, max_covered: float = MAX_COVERED,
               max_longest: int = MAX_LONGEST) -> DataFrame:
    """One row per row of ``df``: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, covered_words, covered_fraction, longest_repeat, n_repeat_places."""
    rows = pick(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in slices(texts):
                own = texts[lo:hi]
                t = WordTable(own)
                lcp = neighbour_lcp(t.hash, t.text_of_word())

                def per_text(x, t=t):
                    c = np.concatenate([[0], np.cumsum(x)])
                    return c[t.first[1:]] - c[t.first[:-1]]

                def per_bytes(x, t=t):
                    c = np.concatenate([[0], np.cumsum(x)])
                    return c[t.offset[1:]] - c[t.offset[:-1]]

                n_words = np.diff(t.first)
                inside = np.zeros(len(t.buf) + 1, dtype=np.int8)
                inside[t.start] += 1
                inside[t.end] -= 1
                chars = (np.cumsum(inside[:-1]) > 0) & ((t.buf & 0xC0) != 0x80)
                n_repeat = per_text(_covered_windows(lcp, BASE_WINDOW))
                covered = per_text(_covered(lcp, min_repeat_words))
                longest = np.zeros(hi - lo, dtype=np.int64)
                np.maximum.at(longest, t.text_of_word(), np.where(lcp >= min_repeat_words, lcp, 0))
                fraction = covered / np.maximum(n_words, 1)
                failed = (n_words < BASE_MIN_WORDS) | (100 * n_repeat > BASE_MAX_PERCENT * n_words)
                kept = ~failed & (fraction <= max_covered) & (longest <= max_longest)
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo), "n_words": n_words.astype(np.int64),
                    "word_chars": per_bytes(chars).astype(np.int64),
                    "n_symbols": per_bytes(_SYMBOL[t.buf]).astype(np.int64),
                    "n_dup_lines": np.array([repeated_lines(x) for x in own], dtype=np.int64),
                    "n_repeat_words": n_repeat.astype(np.int64), "base_failed": failed, "kept": kept,
                    "covered_words": covered.astype(np.int64), "covered_fraction": fraction,
                    "longest_repeat": longest,
                    "n_repeat_places": per_text(lcp >= min_repeat_words).astype(np.int64)})

    return rows.mapInArrow(scan, f"doc_id {id_type}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                 "n_repeat_words long, base_failed boolean, kept boolean, covered_words long, "
                                 "covered_fraction double, longest_repeat long, n_repeat_places long")
