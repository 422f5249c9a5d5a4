"""Span columns in plain SQL functions: places of regular-expression matches, joined span texts.

A span is ``struct<kind string, rank int, start int, end int, hit string>`` in code points, end
exclusive. ``split`` gives the text between matches and ``regexp_extract_all`` the matches; running
sums of their lengths are the places. Texts without a match are told by ``rlike`` first, so most
rows pay one pass. Patterns here repeat single character classes only (no repeated groups), which
Java matches without recursion: long texts cannot overflow the stack.

Long texts are scanned in blocks of about ``BLOCK_CHARS``, cut after characters that no match can hold, so the
matches are those of the whole text and the work grows with its length. (A stretch without such a character stays one
block.) Each block knows the characters around it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_CHARS, LEFT_CHARS, RIGHT_CHARS = 4096, 32, 4
SPAN = "array<struct<kind:string,rank:int,start:int,end:int,hit:string>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


def quoted(pattern: str) -> Column:
    return F.lit(pattern)


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def blocks(text: Column, boundary: str) -> Column:
    """The text as an array of struct<at, left, block, right>; ``boundary``: what no match can hold, one character."""
    n = BLOCK_CHARS
    cut = rf"(?s).{{1,{n}}}\z|.{{0,{n - 1}}}(?:{boundary})|.+?(?:(?:{boundary})|\z)"
    parts = F.when(F.length(text) <= n, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(cut), F.lit(0)))
    empty = F.array().cast("array<struct<at:int,left:string,block:string>>")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("left"), empty.alias("out"))

    def step(acc, x):
        one = F.struct(acc["at"].alias("at"), acc["left"].alias("left"), x.alias("block"))
        return F.struct((acc["at"] + F.length(x)).alias("at"), F.right(F.concat(acc["left"], x), F.lit(LEFT_CHARS)).alias("left"),
                        F.concat(acc["out"], F.array(one)).alias("out"))

    placed = F.aggregate(parts, start, step, lambda acc: acc["out"])
    return let(placed, lambda every: F.transform(every, lambda b, i: b.withField("right", F.left(
        F.coalesce(F.get(every, i + 1)["block"], F.lit("")), F.lit(RIGHT_CHARS)))))


def moved(found: Column, at: Column) -> Column:
    """Spans of a block as spans of the text."""
    return F.transform(found, lambda s: s.withField("start", s["start"] + at).withField("end", s["end"] + at))


def spans(text: Column, kind: str, rank: int, pattern: str, keep=None, shown=None) -> Column:
    """All leftmost non-overlapping matches of ``pattern`` in ``text``; ``keep(hit)`` drops matches
    afterwards. ``shown(hit)``: the hit as the reader's text has it."""
    p = quoted(pattern)
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("hit"))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        one = F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), start.alias("start"),
                       end.alias("end"), (x["hit"] if shown is None else shown(x["hit"])).alias("hit"))
        return F.when(x["hit"].isNull(), acc).otherwise(
            F.struct(end.alias("at"), F.concat(acc["out"], F.array(one)).alias("out")))

    start = F.struct(F.lit(0).alias("at"), no_spans().alias("out"))
    found = F.aggregate(pairs, start, step, lambda acc: acc["out"])
    if keep is not None:
        found = F.filter(found, lambda s: keep(s["hit"]))
    return F.when(F.rlike(text, p), found).otherwise(no_spans())


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["start"] < span["end"]) & (span["start"] < o["end"]))


def count_of(found: Column, kind: str) -> Column:
    return F.size(F.filter(found, lambda s: s["kind"] == kind)).cast("long")


def joined(found: Column, *order: str) -> Column:
    """``kind:start:end`` of all spans, sorted by the named fields, comma-joined."""
    keyed = F.transform(found, lambda s: F.struct(*[s[o] for o in order], s["start"].alias("s"), s["end"].alias("e"),
                                                  s["kind"].alias("k")))
    return F.array_join(F.transform(F.array_sort(keyed), lambda s: F.concat_ws(":", s["k"], s["s"], s["e"])), ",")


def masked(text: Column, found: Column, mark: str) -> Column:
    """The text with every span (overlapping ones united) replaced by ``mark``."""
    placed = F.array_sort(F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        piece = F.concat(acc["out"], text.substr(acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))
        return F.when(s["end"] <= acc["at"], acc).when(
            (s["start"] < acc["at"]), F.struct(s["end"].alias("at"), acc["out"].alias("out"))).otherwise(
            F.struct(s["end"].alias("at"), piece.alias("out")))

    done = F.aggregate(placed, start, step, lambda acc: F.concat(
        acc["out"], text.substr(acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(found) > 0, done).otherwise(text)
