"""Ranked lexical search with shared sub-expressions of many queries (operator 13).

Terms are maximal runs of ASCII letters and digits and of all characters above 0x7F, with A-Z lower-cased. A document's
score for an item sums, over the item's terms with repeats, ``w * ((10**9 * tf) div (1000 * tf + 8 * m))``, all in
64-bit integers but ``w = floor(1000 * ln((2 N + 2) / (2 df + 1)))``; ``m = 25 + (75 n N) div L`` is the document's
length against the mean. N: documents with a term; L: all their terms; n: one document's; df: documents with the term.

The items are the stated query set, taken in blocks of bounded bytes; each block runs against all documents:

1. *Shared term sets.* An item is the sequence of its leaves (term, repeats), those that most items hold first.
   Neighbouring pairs that several items hold become a node, again and again, until no pair repeats: a directed
   acyclic graph in which an inner node is a term set that items (and greater sets) share.
2. *Postings.* One pass over the texts keeps of every document its length and the counts of the block's terms, stored;
   a second, over the stored rows, counts N, L and df as partial sums per task.
3. *Accumulators.* For a run of documents a leaf's accumulator is the vector of its term's contributions. Every node is
   the sum of its two parts, computed once; an item's scores are the sum of the few nodes left of it.
4. Each task keeps its best documents per item; a window over these rows gives the ranks.

Defined cases: null and term-less texts hold no term and are not counted in N; an item without terms, or whose terms no
document holds, has no rows; equal rows of the items are one item, different texts of one id are items of their own;
every row of the documents is a document, equal ids tie in any order; null ids rank last among ties; empty tables
give no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, byte_class, pick, slices, stored, utf8

TOP = 10
ITEM_BYTES = 256 << 10  # text of the items of one block, about
ACCUMULATOR_BYTES = 32 << 20  # of one run of documents

GAP = byte_class(*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80))


def terms_of(texts: list[bytes]) -> WordTable:
    """The terms of the texts, lower-cased."""
    return WordTable([t.lower() for t in texts], hashed=False, gap=GAP)


class QueryPlan:
    """The items of a block as a graph of shared sums. ``terms``: distinct terms; ``leaves``: (place of a term,
    repeats); ``nodes``: pairs of earlier entries, numbered after the leaves; ``items``: entries to sum per item."""

    def __init__(self, texts: list[bytes]):
        counts = []
        for t in texts:
            words, code = terms_of([t]).distinct()
            counts.append(Counter(words[c] for c in code))
        self.terms = sorted({t for c in counts for t in c})
        place = {t: i for i, t in enumerate(self.terms)}
        held = Counter((place[t], n) for c in counts for t, n in c.items())
        order = sorted(held, key=lambda leaf: (-held[leaf], leaf))
        self.leaves = np.array(order, dtype=np.int64).reshape(-1, 2)
        number = {leaf: i for i, leaf in enumerate(order)}
        self.items = [sorted(number[place[t], n] for t, n in c.items()) for c in counts]
        self.nodes: list[tuple[int, int]] = []
        while self._join_pairs():
            pass

    def _join_pairs(self) -> bool:
        """Make nodes of the neighbouring pairs that several items hold; False if there is none."""
        held = Counter(p for s in self.items for p in zip(s, s[1:], strict=False))
        number: dict[tuple[int, int], int] = {}
        for k, s in enumerate(self.items):
            often = [held[p] for p in zip(s, s[1:], strict=False)] + [0, 0]
            out, i = [], 0
            while i < len(s):
                if often[i] > 1 and often[i] >= often[i + 1]:  # else the next pair is shared by more
                    pair = s[i], s[i + 1]
                    if pair not in number:
                        number[pair] = len(self.leaves) + len(self.nodes)
                        self.nodes.append(pair)
                    out.append(number[pair])
                    i += 2
                else:
                    out.append(s[i])
                    i += 1
            self.items[k] = out
        return bool(number)

    def scores(self, part: np.ndarray) -> Iterator[np.ndarray]:
        """Each item's scores, for ``part[term, document]``, the contribution of a single occurrence of the term."""
        acc = np.empty((len(self.leaves) + len(self.nodes), part.shape[1]), dtype=np.int64)
        np.multiply(part[self.leaves[:, 0]], self.leaves[:, 1:], out=acc[: len(self.leaves)])
        for k, (a, b) in enumerate(self.nodes, len(self.leaves)):
            np.add(acc[a], acc[b], out=acc[k])
        for entries in self.items:
            yield acc[entries].sum(axis=0)


def postings(docs: DataFrame, plan: QueryPlan) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document with a term: its length, and the plan's terms in it with their counts."""
    id_type = docs.schema["doc_id"].dataType.simpleString()
    known = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(plan.terms)})  # bounded: one block

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for lo, hi in slices(texts):
                t = terms_of(texts[lo:hi])
                words, code = t.distinct()
                place = np.array([known.value.get(w, -1) for w in words], dtype=np.int64)[code]
                n, found = np.diff(t.first), place >= 0
                width = len(known.value) + 1
                key, tf = np.unique(t.text_of_word()[found] * width + place[found], return_counts=True)
                ends = np.searchsorted(key, np.arange(hi - lo + 1) * width).astype(np.int32)
                rows = pa.record_batch({
                    "doc_id": b.column("doc_id").slice(lo, hi - lo), "n": n.astype(np.int64),
                    "terms": pa.ListArray.from_arrays(ends, (key % width).astype(np.int32)),
                    "tfs": pa.ListArray.from_arrays(ends, tf.astype(np.int64))})
                yield rows.filter(pa.array(n > 0))

    return docs.mapInArrow(scan, f"doc_id {id_type}, n long, terms array<int>, tfs array<bigint>")


def corpus_counts(rows: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """N, L and df of each of the plan's terms: partial sums per task, one row per term collected."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_terms + 2, dtype=np.int64)
        for b in batches:
            total[:n_terms] += np.bincount(b.column("terms").flatten().to_numpy(), minlength=n_terms)
            total[n_terms:] += b.num_rows, b.column("n").to_numpy().sum()
        at = np.flatnonzero(total)
        yield pa.record_batch({"slot": at.astype(np.int32), "k": total[at]})

    out = np.zeros(n_terms + 2, dtype=np.int64)
    for r in rows.select("n", "terms").mapInArrow(count, "slot int, k long").groupBy("slot").agg(F.sum("k").alias("k")).collect():
        out[r["slot"]] = r["k"]
    return int(out[-2]), int(out[-1]), out[:n_terms]


class Best:
    """The ``top`` best documents of each item: greatest score, then least id (null ids last)."""

    def __init__(self, n_items: int, top: int):
        self.top, self.rows, self.least = top, [[] for _ in range(n_items)], np.ones(n_items, dtype=np.int64)

    def add(self, item: int, scores: np.ndarray, ids: pa.Array) -> None:
        at = np.flatnonzero(scores >= self.least[item])
        if len(at) > self.top:
            at = at[scores[at] >= np.partition(scores[at], -self.top)[-self.top]]
        if len(at):
            new = zip((-scores[at]).tolist(), ids.take(pa.array(at)).to_pylist(), strict=True)
            rows = sorted([*self.rows[item], *((s, i is None, i) for s, i in new)], key=lambda r: r[:2] if r[1] else r)
            self.rows[item] = rows[: self.top]
            if len(rows) >= self.top:
                self.least[item] = -self.rows[item][-1][0]


def _ranked(rows: DataFrame, plan: QueryPlan, top: int) -> DataFrame:
    """(item, doc_id, score): every task's best documents of each item."""
    n_docs, n_terms, df = corpus_counts(rows, len(plan.terms))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(k) + 1))) for k in df], dtype=np.int64)
    shared = rows.sparkSession.sparkContext.broadcast((plan, weight))  # bounded: one block
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, weight = shared.value
        step = max(16, ACCUMULATOR_BYTES // (8 * (2 * len(plan.leaves) + len(plan.nodes))))
        best = Best(len(plan.items), top)
        ids = None
        for batch in batches:
            for lo in range(0, batch.num_rows, step):
                b = batch.slice(lo, step)
                ids, terms, tfs = b.column("doc_id"), b.column("terms"), b.column("tfs").flatten().to_numpy()
                doc = np.repeat(np.arange(b.num_rows), terms.value_lengths().to_numpy())
                term = terms.flatten().to_numpy()
                m = 25 + (75 * b.column("n").to_numpy() * n_docs) // n_terms
                part = np.zeros((len(weight), b.num_rows), dtype=np.int64)
                part[term, doc] = weight[term] * ((10 ** 9 * tfs) // (1000 * tfs + 8 * m[doc]))
                for item, scores in enumerate(plan.scores(part)):
                    best.add(item, scores, ids)
        if ids is not None:
            found = [(k, r[2], -r[0]) for k, rows in enumerate(best.rows) for r in rows]
            item, doc_id, score = zip(*found, strict=True) if found else ((), (), ())
            yield pa.record_batch({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc_id, ids.type),
                                   "score": pa.array(score, pa.int64())})

    return rows.mapInArrow(search, f"item int, doc_id {id_type}, score long")


def search(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``top`` documents of each item with a score above 0, best first."""
    docs = pick(df, doc_id=id_col, text=text_col).where("text is not null")
    asked = pick(items, item_id=item_col, text=item_text_col).where("text is not null").distinct()
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / item_bytes))
    spark, out = df.sparkSession, []
    item_type = asked.schema["item_id"].dataType.simpleString()
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about item_bytes
        plan = QueryPlan([r["text"].encode() for r in own])
        if not plan.terms:
            continue
        rows = stored(postings(docs, plan), "postings")
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(own)], f"item int, item_id {item_type}")
        place = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
        ranked = _ranked(rows, plan, top).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= top)
        out.append(ranked.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    if not out:
        id_type = docs.schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"item_id {item_type}, rank int, doc_id {id_type}, score long")
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]
