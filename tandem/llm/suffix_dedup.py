"""Dedup of passages at sparse, content-selected places (operator 1).

A passage repeats if its word sequence, ``min_words`` or longer, stands at two places of the corpus.

The sparse suffix array that this operator is named for retains suffixes at *minimisers*, sorts them, compares
neighbours and extends matches both ways. Retention is as there: word positions whose ``anchor_words``-gram hash is the
least of a window, so that every run of ``min_words`` words holds one, and equal passages retain equal suffixes. But
**nothing is sorted here and no neighbours are compared**, because that misses repeats: a suffix's neighbour in the
order of following words is the one with the longest match to the right, which may have none to the left, while the
partner of a passage that lies mostly to the left of its anchor stands further off (tests/llm/test_neighbours.py has
such a case). Instead:

1. the retained suffixes are grouped by the hash of their first words; those with no equal go;
2. each one left is extended to the left and right, to the stretch of all runs of ``min_words`` words whose
   least suffix it is. Equal stretches form a class (by the hash of their runs), and go on once; then equal
   runs of the classes meet by hash, and runs met nowhere else go;
3. runs that overlap in a document are joined to maximal spans.

The result is exact but for collisions of 64-bit hashes: a word is in a span if and only if one of the
``min_words``-word runs over it stands at another place. All joins are on hashes with partial counts before them, so a
passage that a third of the documents hold is one row on one side and splits on the other.

Defined cases: a null text or one with fewer than ``min_words`` words has no spans; rows with a null
id cannot be named and take no part; rows that share id and text are one document (the same row twice is
no repeat of itself), different texts of one id are documents of their own, all joins being on the
document key (``common.document_key``), mapped to the id in the result; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordTable, document_key, pick, range_hash, slices, sliding, stored, utf8
from .native_spans import fresh

MIN_WORDS, ANCHOR_WORDS = 50, 20
STRETCH = 62  # runs in a stretch at most: one bit each in a long
_NONE = np.iinfo(np.uint64).max


def _anchors(words: WordTable, min_words: int, anchor_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ``anchor_words`` words from each word on, whether a suffix is retained there, and the
    least such hash in the run of ``min_words`` words from each word on (0 where no whole run starts)."""
    n, w = len(words.hash), min_words - anchor_words + 1
    last = np.repeat(words.first[1:], np.diff(words.first))  # end of the text of each word
    at = np.arange(n)
    gram = np.full(n, _NONE, dtype=np.uint64)
    fits = at + anchor_words <= last
    gram[fits] = range_hash(words.hash, at[fits], at[fits] + anchor_words)
    keep, least = np.zeros(n, dtype=bool), np.zeros(0, dtype=np.uint64)
    if n >= w:
        least = sliding(gram, w, np.minimum)
        least[at[: len(least)] + min_words > last[: len(least)]] = 0  # no whole run starts there
        pad = np.zeros(w - 1, dtype=np.uint64)
        keep = (sliding(np.concatenate([pad, least, pad]), w, np.maximum)[:n] == gram) & fits
    return gram, keep, least


def retained_suffixes(docs: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(h, doc_id, pos): the retained suffixes; h is the hash of their first words."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids = utf8(b.column("text")), b.column("doc_id")
            for lo, hi in slices(texts):
                t = WordTable(texts[lo:hi])
                gram, keep, _ = _anchors(t, min_words, anchor_words)
                at = np.flatnonzero(keep)
                row = t.text_of_word()[at]
                yield pa.record_batch({"h": gram[at].view(np.int64), "doc_id": ids.take(pa.array(row + lo)),
                                       "pos": (at - t.first[row]).astype(np.int32)})

    return docs.where("doc_id is not null").mapInArrow(scan, f"h long, doc_id {id_type}, pos int")


def _stretches(docs_hits: DataFrame, min_words: int, anchor_words: int) -> DataFrame:
    """(cls, doc_id, start, runs, own, again): the runs of ``min_words`` words whose least retained suffix has
    an equal, as stretches of at most ``STRETCH`` consecutive runs with one least suffix; cls is the hash of
    their run hashes. Bit i of own: the text holds run i at another place too; of again: at an earlier one."""
    id_type = docs_hits.schema["doc_id"].dataType.simpleString()

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, ids, hits = utf8(b.column("text")), b.column("doc_id"), b.column("hits").to_pylist()
            for lo, hi in slices(texts):
                t = WordTable(texts[lo:hi])
                gram, keep, least = _anchors(t, min_words, anchor_words)
                if not len(least):
                    continue
                equal = np.zeros(len(keep), dtype=np.int64)
                for i in range(lo, hi):
                    if len(hits[i]):
                        equal[np.asarray(hits[i]) + t.first[i - lo]] = 1
                at = np.flatnonzero(least)  # starts of whole runs
                met = sliding(np.where(equal == 1, gram, _NONE), min_words - anchor_words + 1, np.minimum)
                at = at[met[at] == least[at]]
                if not len(at):
                    continue
                row = t.text_of_word()[at]
                run = range_hash(t.hash, at, at + min_words)
                order = np.lexsort((at, run, row))
                same = (row[order][1:] == row[order][:-1]) & (run[order][1:] == run[order][:-1])
                again, own = np.zeros(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
                again[order[1:]] = same
                own[order[1:]] = same
                own[order[:-1]] |= same
                fresh = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])
                                        | (least[at[1:]] != least[at[:-1]])])
                head = np.flatnonzero(fresh)
                nth = np.arange(len(at)) - np.repeat(head, np.diff(np.append(head, len(at))))
                head = np.flatnonzero(nth % STRETCH == 0)
                bit = np.int64(1) << (nth % STRETCH)
                ends = np.append(head[1:], len(at))
                row, at = row[head], at[head]
                yield pa.record_batch({
                    "cls": range_hash(run, head, ends).view(np.int64), "doc_id": ids.take(pa.array(row + lo)),
                    "start": (at - t.first[row]).astype(np.int32),
                    "runs": pa.ListArray.from_arrays(np.append(head, ends[-1]).astype(np.int32), run.view(np.int64)),
                    "own": np.bitwise_or.reduceat(np.where(own, bit, 0), head),
                    "again": np.bitwise_or.reduceat(np.where(again, bit, 0), head)})

    return docs_hits.mapInArrow(
        extend, f"cls long, doc_id {id_type}, start int, runs array<bigint>, own long, again long")


def _bit(mask: str, i: Column) -> Column:
    return F.col(mask).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0


def repeated_stretches(df: DataFrame, key: Column, text_col: str = "text", min_words: int = MIN_WORDS,
                       anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """doc_id, first_doc and last_doc are document keys here. (doc_id, start, n, again, first_doc, last_doc, mask): bit i of mask is set where the run of ``min_words``
    words from word start + i also stands elsewhere, ``first_doc`` and ``last_doc`` being the least and greatest
    id of the documents that hold it (one row for each such pair of ids); n bounds i; again: see _stretches."""
    docs = pick(df, doc_id=key, text=text_col).where("doc_id is not null and text is not null")
    suffixes = retained_suffixes(docs, min_words, anchor_words)
    # what the joins below meet on is stored, so that they can split a hot key
    met = stored(suffixes.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "met")
    hits = suffixes.join(met, "h", "left_semi").groupBy("doc_id").agg(F.collect_set("pos").alias("hits"))
    found = stored(_stretches(docs.join(hits, "doc_id"), min_words, anchor_words), "stretches")
    classes = stored(found.groupBy("cls").agg(
        F.first("runs").alias("runs"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"),
        F.bit_or("own").alias("own")), "classes")
    runs = classes.select("cls", "first_doc", "last_doc", "own", F.posexplode("runs").alias("i", "run"))
    places = (runs.groupBy("run").agg(F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"),
                                      F.max(_bit("own", F.col("i"))).alias("own"))
              .where("first_doc < last_doc or own").drop("own"))
    places = stored(places, "places")
    marks = (runs.select("cls", "i", "run").join(places, "run").groupBy("cls", "first_doc", "last_doc")
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("i"))).alias("mask")))
    marks = stored(marks, "marks")
    return found.select("cls", "doc_id", "start", F.size("runs").alias("n"), "again").join(marks, "cls").drop("cls")


def _islands(stretches: DataFrame, min_words: int, *aggs) -> DataFrame:
    """Maximal spans of words under the runs in ``mask``: doc_id, start_word, end_word and ``aggs``."""
    def edges(step: int) -> Column:  # places of the mask with no neighbour on one side
        return F.filter(F.sequence(F.lit(0), F.col("n") - 1),
                        lambda i: _bit("mask", i) & ~((i + step).between(0, F.col("n") - 1) & _bit("mask", i + step)))

    parts = (stretches.where("mask <> 0").withColumn("part", F.explode(F.arrays_zip(edges(-1).alias("lo"), edges(1).alias("hi"))))
             .withColumns({"lo": F.col("start") + F.col("part.lo"), "hi": F.col("start") + F.col("part.hi")}))
    by_doc = Window.partitionBy("doc_id").orderBy("lo", "hi")
    reached = F.max("hi").over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (F.col("lo") > F.coalesce(reached, F.lit(-min_words - 1)) + min_words).cast("int")
    return (parts.withColumn("fresh", fresh).withColumn("island", F.sum("fresh").over(
                by_doc.rowsBetween(Window.unboundedPreceding, 0)))
            .groupBy("doc_id", "island")
            .agg(F.min("lo").alias("start_word"), (F.max("hi") + min_words).alias("end_word"), *aggs)
            .drop("island"))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                   anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """One row per maximal span of repeated words: doc_id, start_word, end_word (exclusive), n_words,
    first_doc and last_doc (least and greatest id of the documents that share a run of it)."""
    stretches = repeated_stretches(df, document_key(id_col, text_col), text_col, min_words, anchor_words)
    spans = _islands(stretches, min_words, F.min("first_doc").alias("first_doc"), F.max("last_doc").alias("last_doc"))
    named = {c: F.col(f"{c}.doc_id").alias(c) for c in ("doc_id", "first_doc", "last_doc")}
    return spans.select(named["doc_id"], "start_word", "end_word", (F.col("end_word") - F.col("start_word")).alias("n_words"),
                        named["first_doc"], named["last_doc"])


def cut_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
                anchor_words: int = ANCHOR_WORDS) -> DataFrame:
    """``df`` with each repeated run cut from every place but its first (least id, then the text's hash where
    an id has several texts, then position). Texts without one stay byte for byte; rows whose id or text is
    null pass unchanged."""
    key = document_key(id_col, text_col)
    stretches = repeated_stretches(df, key, text_col, min_words, anchor_words)
    cut_id, cuts_col = fresh(df, "cut_id"), fresh(df, "cut_spans")
    later = stretches.withColumn("mask", F.when(F.col("doc_id") != F.col("first_doc"), F.col("mask")).otherwise(
        F.col("mask").bitwiseAND(F.col("again"))))
    cuts = (_islands(later, min_words).groupBy("doc_id")
            .agg(F.sort_array(F.collect_list(F.struct("start_word", "end_word"))).alias("cuts"))
            .select(F.col("doc_id").alias(cut_id), F.col("cuts").alias(cuts_col)))

    @F.pandas_udf("string")
    def without(text, spans):
        return text.combine(spans, _without)

    joined = df.join(cuts, key == F.col(cut_id), "left")
    text = F.when(F.col(cuts_col).isNotNull(), without(F.col(f"`{text_col}`"), F.col(cuts_col)))
    return joined.select(*[(F.coalesce(text, F.col(f"`{c}`")) if c == text_col else F.col(f"`{c}`")).alias(c)
                           for c in df.columns])


def _without(text: str | None, spans) -> str | None:
    """The text without the words of the spans, each with the space that follows it."""
    if text is None or spans is None:
        return text
    raw = text.encode()
    t = WordTable([raw], hashed=False)
    begin = np.append(t.start, len(raw))
    out, at = [], 0
    for s in spans:
        out.append(raw[at:begin[s["start_word"]]])
        at = begin[s["end_word"]]
    return b"".join([*out, raw[at:]]).decode()
