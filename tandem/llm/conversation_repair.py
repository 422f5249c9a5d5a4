"""Conversation structure repair by weighted interval parsing (operator 12).

A conversation's role initials must read ``(s?(ua)+)?``. Edits per row: Keep (0), Rerole to user or assistant (1),
Delete (2; blank and duplicate rows cannot stay), and Insert of an empty user or assistant turn anywhere (5); a
truncated row that stays adds 5. The repair is the cheapest, and among the cheapest the one whose audit (the initials
of the edits in order) is least in ASCII.

The repair grammar in Chomsky normal form has a nonterminal ``N(p, q)`` for every pair of states of the language's
automaton (what takes state p to state q), the rules ``N(p, q) -> N(p, r) N(r, q)``, one row's edits as its terminals,
and insertions as unit rules. A cell is the least (cost, audit) per nonterminal of a span of rows:

1. leaves: the cells of single rows, closed under insertions before and after the row;
2. spans are combined bottom-up by their length, 1, 2, 4 ... rows. As every derivation of a span goes through some state
   at any place in it, one split per span finds them all. Audits of one span and nonterminal that cost the same are no
   prefixes of each other (each insertion costs), so the least of the parts gives the least of the whole;
3. a conversation is cut into blocks of ``BLOCK`` rows by dense positions. A block's cell is found in one row, and
   ``BLOCK`` neighbouring cells make the cell of the next level: no task holds a long conversation, only its audit.

Counts of faults, illegal neighbours and turns are parts of the cells and add up in the same way. The repaired text
is hashed while its lines stream by in order; SHA-256 allows no other way, so one conversation's lines pass one task.

Defined cases: null roles and texts read as one space (so does a null id or turn in the key of the damage); rows of
equal turn stand in the order of the hash of their role and text (equal rows side by side), null turns first; a null
conv_id is one conversation; a role that does not start with s, u or a cannot be kept; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.operators.ordering import sequence_index

from .common import pick, stored

BLOCK = 32
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES = 4  # 0: start, 1: after s, 2: after u, 3: after a
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ACCEPTED = (0, 3)
NONE, BLANK, DUPLICATE, CUT = range(4)  # a row's first fault

Cell = tuple  # of (cost, audit) or None, for N(p, q) at p * STATES + q


def damage(df: DataFrame) -> DataFrame:
    """The rows (conv_id, turn, role, text) after the damage, with ``copy`` (1 for a repeat)."""
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    rows = df.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.where("kind <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _same_conversation(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def positioned(rows: DataFrame) -> DataFrame:
    """Rows with their place in the conversation (pos) and ``fault``, the first fault of each."""
    marked = rows.withColumn("digest", F.unhex(F.sha2(F.concat_ws(":", F.length("role").cast("string"), "role", "text"), 256)))
    placed = sequence_index(marked, ["turn", "digest", "copy"], ["conv_id"]).drop("copy")
    first = placed.groupBy("conv_id", "digest").agg(F.min("pos").alias("first"), F.count("*").alias("n")).where("n > 1").select(
        F.col("conv_id").alias("of"), F.col("digest").alias("of_digest"), "first")
    first = stored(first, "first_places")  # small, and a plain side: a hot row's join can split
    joined = placed.join(first, _same_conversation(F.col("conv_id"), F.col("of")) & (F.col("digest") == F.col("of_digest")), "left")
    end = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    fault = (F.when(end == "", BLANK).when(F.col("pos") > F.col("first"), DUPLICATE)
             .when(~F.substring(end, -1, 1).isin(".", "!", "?"), CUT).otherwise(NONE))
    return joined.select("conv_id", "turn", "role", "text", "pos", fault.alias("fault"))


def _least(a: tuple | None, b: tuple | None) -> tuple | None:
    return b if a is None else a if b is None else min(a, b)


def combine(a: Cell, b: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out = [None] * (STATES * STATES)
    for p in range(STATES):
        for r in range(STATES):
            x = a[p * STATES + r]
            if x is None:
                continue
            for q in range(STATES):
                y = b[r * STATES + q]
                if y is not None:
                    z = (x[0] + y[0], x[1] + y[1])
                    old = out[p * STATES + q]
                    if old is None or z < old:
                        out[p * STATES + q] = z
    return tuple(out)


def insertions() -> Cell:
    """The cell of no rows: insertions alone."""
    out: list = [None] * (STATES * STATES)
    for p in range(STATES):
        out[p * STATES + p] = (0, "")
        state, k = p, 0
        while k < STATES:  # from each state one role only may follow by insertion
            state = next(q for (s, c), q in STEPS.items() if s == state and c in "ua")
            k += 1
            out[p * STATES + state] = _least(out[p * STATES + state], (k * INSERT, "I" * k))
    return tuple(out)


@cache
def leaf(initial: str, fault: int) -> Cell:
    """The cell of one row."""
    out: list = [None] * (STATES * STATES)
    for p in range(STATES):
        options = [(p, DELETE, "D")]
        if fault not in (BLANK, DUPLICATE):
            more = TRUNCATED if fault == CUT else 0
            options += [(STEPS.get((p, initial)), more, "K")] + [(STEPS.get((p, c)), REROLE + more, "R") for c in "ua"]
        for q, cost, edit in options:
            if q is not None:
                out[p * STATES + q] = _least(out[p * STATES + q], (cost, edit))
    return combine(combine(insertions(), tuple(out)), insertions())


def combine_all(cells: list[Cell]) -> Cell:
    """The cell of neighbouring spans, bottom-up by length."""
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


#: Counts of a span; sorted by turn, distinct turns add up but for the seam.
COUNTS = "blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, head string, tail string"
_CELLS = f"conv_id {{id}}, block long, {COUNTS}, cells array<struct<cost: long, audit: string>>"
LEGAL = ("su", "ua", "au")


def _row_span(turn: int | None, initial: str, fault: int) -> dict:
    return {"blank": int(fault == BLANK), "duplicate": int(fault == DUPLICATE), "truncated": int(fault == CUT), "illegal": 0,
            "turns": int(turn is not None), "low": turn, "high": turn, "head": initial, "tail": initial, "cells": leaf(initial, fault)}


def _join_spans(spans: list[dict]) -> dict:
    out = {k: sum(s[k] for s in spans) for k in ("blank", "duplicate", "truncated", "illegal", "turns")}
    for a, b in zip(spans, spans[1:], strict=False):
        out["illegal"] += a["tail"] + b["head"] not in LEGAL
        out["turns"] -= a["high"] is not None and a["high"] == b["low"]
    turns = [s for s in spans if s["turns"]]
    return out | {"low": turns[0]["low"] if turns else None, "high": turns[-1]["high"] if turns else None,
                  "head": spans[0]["head"], "tail": spans[-1]["tail"], "cells": combine_all([s["cells"] for s in spans])}


def _spans_to_arrow(ids: pa.Array, blocks: pa.Array, spans: list[dict]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())]))
    out = {"conv_id": ids, "block": blocks}
    for field in COUNTS.split(", "):
        name, type_name = field.split(" ")
        out[name] = pa.array([s[name] for s in spans], pa.string() if type_name == "string" else pa.int64())
    out["cells"] = pa.array([[c and {"cost": c[0], "audit": c[1]} for c in s["cells"]] for s in spans], kind)
    return pa.record_batch(out)


def spans_of_rows(rows: DataFrame) -> DataFrame:
    """One row per block of ``BLOCK`` rows of a conversation: its cell and counts."""
    own = F.struct("pos", "turn", F.substring("role", 1, 1).alias("initial"), "fault")
    blocks = rows.groupBy("conv_id", F.floor(F.col("pos") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(own)).alias("rows"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = [_join_spans([_row_span(r["turn"], r["initial"], r["fault"]) for r in rows]) for rows in b.column("rows").to_pylist()]
            yield _spans_to_arrow(b.column("conv_id"), b.column("block"), spans)

    return blocks.mapInArrow(parse, _CELLS.format(id=rows.schema["conv_id"].dataType.simpleString()))


def join_blocks(spans: DataFrame) -> DataFrame:
    """Spans of the next level: ``BLOCK`` neighbours become one."""
    own = F.struct(*[c for c in spans.columns if c != "conv_id"])
    groups = spans.groupBy("conv_id", F.floor(F.col("block") / BLOCK).alias("up")).agg(F.sort_array(F.collect_list(own)).alias("parts"))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = []
            for parts in b.column("parts").to_pylist():
                for s in parts:
                    s["cells"] = tuple(c and (c["cost"], c["audit"]) for c in s["cells"])
                spans.append(_join_spans(parts))
            yield _spans_to_arrow(b.column("conv_id"), b.column("up"), spans)

    return groups.mapInArrow(parse, _CELLS.format(id=spans.schema["conv_id"].dataType.simpleString()))


def parsed(rows: DataFrame) -> DataFrame:
    """One row per conversation that has rows: conv_id, its counts, cost and audit."""
    top = rows.agg(F.max("pos")).first()[0] or 0
    spans = spans_of_rows(rows)
    while top >= BLOCK:
        top //= BLOCK
        spans = join_blocks(stored(spans, "spans"))
    whole = F.array_min(F.filter(F.array(*[F.col("cells")[q] for q in ACCEPTED]), lambda c: c.isNotNull()))  # N(0, q)
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0))
    return spans.withColumn("whole", whole).select(
        "conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", F.col("whole.cost").alias("cost"),
        F.col("whole.audit").alias("audit"))


def repaired_lines(rows: DataFrame, repairs: DataFrame, piece: int = 1 << 16) -> DataFrame:
    """(conv_id, place, line): the lines ``role:text`` of every repaired conversation. The audit alone tells the roles:
    an odd number of turns starts with the kept system turn, then user and assistant alternate."""
    id_type = rows.schema["conv_id"].dataType.simpleString()

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, audit in enumerate(b.column("audit").to_pylist()):
                place = pos = 0
                first = (len(audit) - audit.count("D")) % 2
                for lo in range(0, len(audit), piece):
                    out = []
                    for edit in audit[lo:lo + piece]:
                        if edit != "D":
                            role = "user" if (place - first) % 2 == 0 else "assistant"
                            out.append((None if edit == "I" else pos, place, None if edit == "K" else role))
                        place, pos = place + (edit != "D"), pos + (edit != "I")
                    at, places, roles = zip(*out, strict=True) if out else ((), (), ())
                    ids = b.column("conv_id").slice(k, 1).take(pa.array([0] * len(out), pa.int64()))
                    yield pa.record_batch({"of": ids, "at": pa.array(at, pa.int64()), "place": pa.array(places, pa.int64()),
                                           "new_role": pa.array(roles, pa.string())})

    steps = repairs.select("conv_id", "audit").mapInArrow(edits, f"of {id_type}, at long, place long, new_role string")
    kept = steps.where("at is not null").join(rows, _same_conversation(F.col("of"), F.col("conv_id")) & (F.col("at") == F.col("pos")))
    lines = kept.select("of", "place", F.concat(F.coalesce("new_role", "role"), F.lit(":"), "text").alias("line"))
    added = steps.where("at is null").select("of", "place", F.concat("new_role", F.lit(":")).alias("line"))
    return lines.unionByName(added).withColumnRenamed("of", "conv_id")


def hashed(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of each conversation's lines, joined by newlines, as they stream by."""
    id_type = lines.schema["conv_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, at = None, None
        for b in batches:
            done = []
            for conv_id, line in zip(b.column("conv_id").to_pylist(), b.column("line").to_pylist(), strict=True):
                if state is None or conv_id != at:
                    if state is not None:
                        done.append((at, state.hexdigest()))
                    state, at = hashlib.sha256(line.encode()), conv_id
                else:
                    state.update(b"\n" + line.encode())
            kind = b.schema.field("conv_id").type
            yield pa.record_batch({"of": pa.array([d[0] for d in done], kind), "repaired_sha256": pa.array([d[1] for d in done], pa.string())})
        if state is not None:
            yield pa.record_batch({"of": pa.array([at], kind), "repaired_sha256": pa.array([state.hexdigest()])})

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(digest, f"of {id_type}, repaired_sha256 string")


def repair(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows`` (conv_id, turn, role, text, copy; as from :func:`damage`): counts of gaps and
    faults, cost, audit and the hash of the repaired conversation."""
    placed = stored(positioned(rows), "faults")
    found = stored(parsed(placed), "repairs")
    sums = hashed(repaired_lines(placed, found))
    return found.join(sums, _same_conversation(F.col("conv_id"), F.col("of")), "left").drop("of")


def damage_and_repair(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                      text_col: str = "text") -> DataFrame:
    """One row per conv_id of ``df``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    rows = pick(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    every = rows.select("conv_id").distinct()
    fixed = repair(damage(rows)).withColumnRenamed("conv_id", "fixed_id")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.join(fixed, _same_conversation(F.col("conv_id"), F.col("fixed_id")), "left").select(
        "conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
