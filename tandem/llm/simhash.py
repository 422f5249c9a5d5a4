"""SimHash near-dedup with pivot distance tables (operator 5).

Fingerprints: the text with A-Z lower-cased, its words, shingles of ``shingle_words`` words joined by
one space (repeats included; fewer words: all of them; none: fingerprint 0), XXH64 with seed 42, and
a bit is 1 if it is set in over half of the hashes.

Links (``max_bits`` differing bits or fewer), exact:

1. equal fingerprints are one class; only distinct fingerprints go on;
2. a table holds each distinct fingerprint's Hamming distances to ``PIVOTS`` reference fingerprints, computed once and
   stored packed in one long;
3. fingerprints meet in the buckets of all choices of 2 of 5 bit blocks: two fingerprints that differ in 3
   bits agree on two blocks at least, so every link has a bucket (the pivots alone would leave a constant share of all
   pairs). Buckets over ``bucket_rows`` rows are cut into chunks, and each pair of chunks is a group of its own.
   Inside a group candidates are the ranges of its most selective pivot: rows sorted by that distance are
   compared only up to ``max_bits`` further on (triangle inequality), the second pivot discards half of the rest, and
   survivors are verified on the fingerprints. Pairs stay in arrays; a group emits a
   spanning forest of its links, so rows out grow with fingerprints, not with pairs;
4. connected components by alternating large-star and small-star rounds (minimum, then join), each
   round checkpointed.

Defined cases: null and blank texts have fingerprint 0 and link like any other; rows with a null id
are returned with the component of their fingerprint's class (null if all ids of the component are null);
repeated rows repeat in the result; different texts of one id are documents of their own
(``common.document_key``: null and empty are one text), of which at most one stands for a component; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tandem.functions.groups import whole_groups

from .common import document_key, mix, pick, stored, utf8
from .native_spans import fresh

SHINGLE_WORDS, MAX_BITS, BUCKET_ROWS = 3, 3, 4096
PIVOTS = mix(np.arange(1, 9, dtype=np.uint64))  # reference fingerprints: any fixed random values do
BLOCKS = (13, 13, 13, 13, 12)


def fingerprint(text: bytes, shingle_words: int = SHINGLE_WORDS) -> int:
    """64-bit SimHash of a UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return xxhash.xxh64_intdigest(joined, 42)
    gap = np.flatnonzero(np.frombuffer(joined, dtype=np.uint8) == 32)
    starts = [0, *(gap[: len(words) - shingle_words] + 1).tolist()]
    ends = [*gap[shingle_words - 1:].tolist(), len(joined)]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[a:b], 42) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(hashes), 1 << 16):
        part = hashes[lo:lo + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp) for each row; fp is the fingerprint as a signed long."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, shingle_words) for t in utf8(b.column("text"))], dtype=np.uint64)
            yield pa.record_batch({"doc_id": b.column("doc_id"), "fp": fp.view(np.int64)})

    return docs.mapInArrow(scan, f"doc_id {id_type}, fp long")


def block_masks(max_bits: int = MAX_BITS) -> list[int]:
    """Masks of all choices of ``len(BLOCKS) - max_bits`` blocks."""
    ends = np.cumsum(BLOCKS)
    masks = [((1 << w) - 1) << int(e - w) for w, e in zip(BLOCKS, ends, strict=True)]
    return [sum(c) for c in combinations(masks, len(BLOCKS) - max_bits)]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (a[i], b[i]) as (node, root) pairs with the same components; the root is the least."""
    nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = inverse[: len(a)], inverse[len(a):]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            break
        root = new
    own = root != np.arange(len(nodes))
    return nodes[own], nodes[root[own]]


def pivot_table() -> Column:
    """The distances of ``fp`` to the pivots, eight bits each."""
    parts = [F.shiftleft(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))).cast("long"), 8 * k)
             for k, p in enumerate(PIVOTS.view(np.int64).tolist())]
    out = parts[0]
    for part in parts[1:]:
        out = out.bitwiseOR(part)
    return out


def _links_of(key: np.ndarray, side: np.ndarray, fp: np.ndarray, table: np.ndarray, rep: np.ndarray,
              max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows (sorted by key) with equal keys; where a key has two sides, across them. ``table``: the
    distances of each row to the pivots."""
    if not len(key):
        return rep[:0], rep[:0]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    wide = table.astype(np.float64)
    spread = np.add.reduceat(wide * wide, start) / size[:, None] - (np.add.reduceat(wide, start) / size[:, None]) ** 2
    best = np.argsort(-spread, axis=1)
    group, rows = np.repeat(np.arange(len(start)), size), np.arange(len(key))
    first, second = (table[rows, best[group, k]].astype(np.int16) for k in (0, 1))
    order = np.lexsort((first, group))
    side, fp, rep, first, second = (x[order] for x in (side, fp, rep, first, second))
    place = group * 128 + first  # distances are below 128
    reach = np.searchsorted(place, place + max_bits, "right") - rows  # of each row, itself included
    at, step, out_a, out_b, held = np.flatnonzero(reach > 1), 1, [], [], 0
    while len(at):
        near = at[(side[at] < 0) | (side[at] != side[at + step])]
        near = near[np.abs(second[near] - second[near + step]) <= max_bits]
        near = near[np.bitwise_count(fp[near] ^ fp[near + step]) <= max_bits]
        out_a.append(rep[near])
        out_b.append(rep[near + step])
        held += len(near)
        if held > 1 << 20:  # keep the array of links small: a forest has the same components
            a, b = forest(np.concatenate(out_a), np.concatenate(out_b))
            out_a, out_b, held = [a], [b], len(a)
        step += 1
        at = at[reach[at] > step]
    if not out_a:
        return rep[:0], rep[:0]
    return forest(np.concatenate(out_a), np.concatenate(out_b))


def links(classes: DataFrame, max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): links between classes (fp, pivots, rep) as spanning forests of their groups; reps of any type."""
    rep_type = classes.schema["rep"].dataType.simpleString()
    keys = F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m if m < 1 << 63 else m - (1 << 64))))
                     for i, m in enumerate(block_masks(max_bits))])
    rows = classes.select(F.explode(keys).alias("bucket"), "fp", "pivots", "rep")
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1")
    rows = rows.join(sizes, "bucket").withColumn("g", F.ceil(F.col("n") / bucket_rows).cast("int"))
    own = F.pmod(F.xxhash64("rep"), F.col("g")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("g") - 1), lambda j: F.struct(
        F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    rows = rows.withColumn("own", own).withColumn("p", F.explode(pairs)).select(
        F.xxhash64("bucket", "p.lo", "p.hi").alias("task"),
        F.when(F.col("p.lo") == F.col("p.hi"), -1).otherwise(F.col("own")).alias("side"), "fp", "pivots", "rep")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["task"]):
            key, side, fp, pivots = (t.column(c).to_numpy() for c in ("task", "side", "fp", "pivots"))
            table = np.ascontiguousarray(pivots).view(np.int8).reshape(len(pivots), -1)
            rep = t.column("rep").combine_chunks()
            _, at, node = np.unique(fp, return_index=True, return_inverse=True)
            a, b = _links_of(key, side, fp.view(np.uint64), table, node, max_bits)
            yield pa.record_batch({"a": rep.take(pa.array(at[a])), "b": rep.take(pa.array(at[b]))})

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(compare, f"a {rep_type}, b {rep_type}")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of (a, b) edges but the roots; the root is the least node."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges, before = edges.checkpoint(), None
    for _ in range(max_rounds):
        mark = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = mark
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        large = large.distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = small.unionByName(low.select("a", F.col("m").alias("b"))).distinct().checkpoint()
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _near(df: DataFrame, key: Column, text_col: str = "text", shingle_words: int = SHINGLE_WORDS,
          max_bits: int = MAX_BITS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of near_duplicates; doc_id and component_id are document keys."""
    docs = stored(fingerprints(pick(df, doc_id=key, text=text_col), shingle_words), "fingerprints")
    classes = docs.groupBy("fp").agg(F.min("doc_id").alias("rep")).where("rep is not null")
    classes = stored(classes.withColumn("pivots", pivot_table()), "pivot_table")
    comp = components(links(classes, max_bits, bucket_rows)).withColumnRenamed("node", "rep")
    named = classes.join(comp, "rep", "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return docs.join(named, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("is_kept"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``df``: doc_id, fingerprint (16 hex digits), component_id (the least id
    reachable over links), is_kept (the document stands for its component)."""
    near = _near(df, document_key(id_col, text_col), text_col, **options)
    return near.select(F.col("doc_id.doc_id").alias("doc_id"), "fingerprint",
                       F.col("component_id.doc_id").alias("component_id"), "is_kept")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Rows of ``df`` whose document stands for its group of near duplicates (the least id). Null texts and
    texts without a word hold nothing to compare: they all stay. So do rows with a null id, which no other row can name."""
    key = document_key(id_col, text_col)
    worded = df.where(F.regexp_like(F.col(f"`{text_col}`"), F.lit(r"[^\x20\x09-\x0D]")))
    gone = _near(worded, key, text_col, **options).where("not is_kept and doc_id is not null")
    name = fresh(df, "gone")
    gone = gone.select(F.col("doc_id").alias(name)).distinct()
    return df.join(gone, key == F.col(name), "left_anti")
