"""Best-fit packing by length-histogram planning (operator 6).

1. every document becomes token ids and an end id; documents over ``capacity`` are cut, others never;
2. pieces are counted by length (``capacity`` rows at most, read by the driver), and best-fit
   decreasing runs over these counts: all pieces of a length are placed at once into the fullest
   sequences that still take them, ranges of sequences instead of single ones. The plan says, for
   each length, which ranks go to which range of sequences, at what offset. Its size follows the
   number of lengths, not of documents;
3. pieces take their slot by their rank within the length. Ranks come from counts by (task, length)
   and each piece's number within them, so a length that a third of all pieces share needs no task
   of its own.

Defined cases: a null or empty text is the end id alone; every row gives its pieces, null and repeated ids
included; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, stored, utf8
from .tokens import WordCodec

CAPACITY, END_ID = 4096, 1


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, nth): nth counts the pieces of a length in a task."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], dtype="<u4").tobytes()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, seen, task = WordCodec(vocabulary), Counter(), TaskContext.get().partitionId()
        for b in batches:
            rows, out = [], []
            for i, text in enumerate(utf8(b.column("text"))):
                ids = codec.encode(text) + end
                for k, lo in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[lo:lo + 4 * capacity]
                    n = len(part) // 4
                    rows.append(i)
                    out.append((k, lo // 4, n, zlib.crc32(part), task, seen[n]))
                    seen[n] += 1
            if rows:
                c = list(zip(*out, strict=True))
                yield pa.record_batch({
                    "doc_id": b.column("doc_id").take(pa.array(rows)), "piece": pa.array(c[0], pa.int32()),
                    "start": pa.array(c[1], pa.int64()), "length": pa.array(c[2], pa.int64()),
                    "ids_crc32": pa.array(c[3], pa.int64()), "task": pa.array(c[4], pa.int32()),
                    "nth": pa.array(c[5], pa.int64())})

    return docs.mapInArrow(scan, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, task int, nth long")


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts. Rows (length, first rank, first sequence, offset, count):
    ranks [first, first + count) of a length take consecutive sequences at the offset."""
    room: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free tokens -> ranges of sequences
    free: list[int] = []  # its keys, sorted
    out, sequences = [], 0

    def add(left: int, first: int, count: int) -> None:
        if left:
            if not room[left]:
                bisect.insort(free, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        while todo:
            i = bisect.bisect_left(free, length)
            if i < len(free):
                left = free[i]
                first, count = room[left].pop()
                if not room[left]:
                    free.pop(i)
            else:
                left, first, count = capacity, sequences, -(-todo // max(1, capacity // length))
                sequences += count
            take = min(todo, count)
            out.append((length, rank, first, capacity - left, take))
            add(left - length, first, take)
            if count > take:
                add(left, first + take, count - take)
            rank += take
            todo -= take
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    parts = stored(pieces(pick(df, doc_id=id_col, text=text_col), vocabulary, capacity, end_id), "pieces")
    counts = parts.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(
        Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))).select(
        "length", "task", F.coalesce("before", F.lit(0)).alias("before"))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(histogram, capacity)
    slots = slots[np.lexsort((slots[:, 1], slots[:, 0]))]
    key = slots[:, 0] * (1 << 48) + slots[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("nth").to_numpy() + b.column("before").to_numpy()
            at = np.searchsorted(key, length * (1 << 48) + rank, side="right") - 1
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.record_batch({**{c: b.column(c) for c in keep},
                                   "sequence_id": slots[at, 2] + rank - slots[at, 1], "offset": slots[at, 3]})

    id_type = parts.schema["doc_id"].dataType.simpleString()
    return parts.join(before, ["length", "task"]).mapInArrow(
        place, f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
