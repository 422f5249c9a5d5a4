"""Toxicity by compression distance (operator 4).

Two zstandard dictionaries: one trained on ordinary text; the toxic one is that dictionary with a list of marked
words after it. It is *not* trained on toxic text, a swap of the method: trained forms were worse (README).
A window of ``window_words`` words is compressed with each; it looks toxic by as many bytes as the
toxic dictionary saves. A text's windows give a few features (mean saving, mean of its largest
twentieth, shares above thresholds, number of windows), and a logistic fit on the training texts
turns them into a score: the thresholds are calibrated, not set by hand.

The words are chosen by contrast, because most of a toxic text is ordinary: words that follow significantly more *different* words in toxic than in ordinary texts (a G-test on
distinct contexts, which copies of one text cannot raise). Both dictionaries share the content
trained on ordinary text, so equal content saves equal bytes. Toxic texts that show only in phrases of common
words, or in words under these gates, save nothing and are missed.

The fit reads a bounded sample: at most ``fit_toxic`` and ``fit_ordinary`` labelled texts, those with the least hash of
their id, whole and of any length, as long as a class has no more than ``fit_chars`` characters together (a text that
does not fit in what is left is passed over); it runs in one task. Ids, labels and lengths alone are shuffled to
choose it; the chosen ids, bounded by the same parameters, are broadcast to the texts. Every text is
scored whole, all its windows, by one pass without a shuffle. The caps change the sample's class ratio; the fit
therefore counts each sampled text for as many labels of its class as it stands for in the whole table, so the odds
that a score means do not depend on the size of the table. The ordinary dictionary is trained on at most
``FIT_WINDOWS`` windows, evenly spread over the sample.

Defined cases: a null or empty text has no windows, hence a score like any other; labels null or unknown are not used,
of several labels of one id the toxic one counts, and of several texts of one id the least one is learned from;
without texts of both classes all scores are the share of toxic labels (0 if there are none);
every row gives one row, null and repeated ids included; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordTable, mix, pick, slices, utf8

WINDOW_WORDS, ORDINARY_DICT_BYTES, TOXIC_DICT_BYTES, LEVEL = 8, 32768, 16384, 3
FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 2500, 6000, 40_000_000
FIT_WINDOWS = 60_000
FOLDS = 5
MIN_CONTEXTS, MIN_G, MIN_RATIO = 4, 18.0, 2.0
THRESHOLDS = (2, 3, 4, 5, 6, 7)
PREDICT_AT = 0.7


def windows(text: bytes, size: int = WINDOW_WORDS) -> list[bytes]:
    words = text.lower().split()
    return [b" " + b" ".join(words[i:i + size]) + b" " for i in range(0, len(words), size)]


def _contexts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and the number of different words that each follows."""
    pairs, words = [], []
    for lo, hi in slices(texts):
        t = WordTable([x.lower() for x in texts[lo:hi]])
        before = np.concatenate([[0], t.hash[:-1]]).astype(np.uint64)
        before[t.first[:-1][t.first[:-1] < len(before)]] = 0
        pairs.append(mix(before) ^ t.hash)
        words.append(t.hash)
    _, first = np.unique(np.concatenate(pairs), return_index=True) if pairs else (None, np.zeros(0, dtype=int))
    return np.unique(np.concatenate(words)[first], return_counts=True) if pairs else (first, first)


def marked_words(toxic: list[bytes], ordinary: list[bytes]) -> list[bytes]:
    """Words that stand in significantly more contexts in toxic text, rarest first."""
    (words, a), (other, b) = _contexts(toxic), _contexts(ordinary)
    if not len(words) or not len(other):
        return []
    na, nb = a.sum(), b.sum()
    at = np.minimum(np.searchsorted(other, words), len(other) - 1)
    y = np.where(other[at] == words, b[at], 0)
    both = (a + y) / (na + nb)
    g = 2 * (a * np.log(a / (both * na)) + y * np.log(np.maximum(y, 1) / (both * nb)))
    keep = (a >= MIN_CONTEXTS) & (g >= MIN_G) & ((a + 0.5) / na > np.exp(MIN_RATIO) * (y + 0.5) / nb)
    wanted, out = dict(zip(words[keep].tolist(), a[keep].tolist(), strict=True)), {}
    for lo, hi in slices(toxic):
        t = WordTable([x.lower() for x in toxic[lo:hi]])
        for i in np.flatnonzero(np.isin(t.hash, words[keep])):
            out[t.buf[t.start[i]:t.end[i]].tobytes()] = wanted[int(t.hash[i])]
    return sorted(out, key=lambda w: (out[w], w))


def train_dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """(ordinary, toxic) dictionary contents."""
    samples = [w for t in ordinary for w in windows(t)]
    samples = samples[:: max(1, -(-len(samples) // FIT_WINDOWS))]
    try:
        base = zstandard.train_dictionary(ORDINARY_DICT_BYTES, samples, k=64, d=8, threads=1).as_bytes()
    except zstandard.ZstdError:  # too little text to choose from: it is the dictionary
        base = b"".join(samples)[:ORDINARY_DICT_BYTES]
    marked = b"".join(b" " + w + b" " for w in marked_words(toxic, ordinary))
    return base or b"the and of", (base or b"the and of") + marked[-TOXIC_DICT_BYTES:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    parameters = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, dict_size=len(content), source_size=128, write_content_size=False, write_checksum=False,
        write_dict_id=False)
    d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    d.precompute_compress(compression_params=parameters)
    return zstandard.ZstdCompressor(compression_params=parameters, dict_data=d)


class Scorer:
    """Scores texts with a fitted model: dictionaries, feature scaling and logistic weights."""

    def __init__(self, model: dict):
        self.model = model
        if "toxic" in model:
            self.ordinary, self.toxic = compressor(model["ordinary"]).compress, compressor(model["toxic"]).compress

    def features(self, text: bytes) -> list[float]:
        saved = np.array([len(self.ordinary(w)) - len(self.toxic(w)) for w in windows(text)] or [0], dtype=np.float64)
        n = len(saved)
        top = np.sort(saved)[-max(1, n // 20):].mean()
        return [saved.mean(), top, saved.max(), *[(saved >= t).mean() for t in THRESHOLDS],
                *[np.log1p((saved >= t).sum()) for t in THRESHOLDS], np.log(n)]

    def score(self, texts: list[bytes]) -> np.ndarray:
        m = self.model
        if "toxic" not in m:
            return np.full(len(texts), m["share"])
        x = np.array([self.features(t) for t in texts]).reshape(len(texts), len(m["mean"]))
        z = ((x - m["mean"]) / m["scale"]) @ m["weights"] + m["bias"]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit(texts: list[bytes], labels: np.ndarray, totals: tuple[int, int] | None = None) -> dict:
    """Model from labelled texts. Features for the calibration come from dictionaries trained on the other
    folds, so no text calibrates on itself; the final dictionaries are trained on all. ``totals``: ordinary and
    toxic labels in the whole table (by default those given); each text counts for as many as it stands for."""
    sampled = np.bincount(labels, minlength=2)
    totals = np.asarray(sampled if totals is None else totals, dtype=np.float64)
    if not sampled.all():
        return {"share": float(totals[1] / totals.sum()) if totals.sum() else 0.0}
    stands_for = totals / sampled * (len(labels) / totals.sum())
    fold = np.arange(len(texts)) % FOLDS
    x, y = [], []
    for own in range(FOLDS):
        part = [i for i in range(len(texts)) if fold[i] != own]
        d = train_dictionaries([texts[i] for i in part if labels[i]], [texts[i] for i in part if not labels[i]])
        s = Scorer({"ordinary": d[0], "toxic": d[1]})
        held = [i for i in range(len(texts)) if fold[i] == own]
        x += [s.features(texts[i]) for i in held]
        y += [labels[i] for i in held]
    x, y = np.array(x), np.array(y, dtype=np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.c_[(x - mean) / scale, np.ones(len(x))]
    counts = stands_for[y.astype(np.int64)]
    w, ridge = np.zeros(a.shape[1]), np.eye(a.shape[1]) * 1.0
    ridge[-1, -1] = 0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        step = np.linalg.solve((a * (counts * p * (1 - p))[:, None]).T @ a + ridge + 1e-9 * np.eye(len(w)),
                               a.T @ (counts * (p - y)) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    d = train_dictionaries([t for t, v in zip(texts, labels, strict=True) if v],
                           [t for t, v in zip(texts, labels, strict=True) if not v])
    return {"ordinary": d[0], "toxic": d[1], "mean": mean, "scale": scale, "weights": w[:-1], "bias": w[-1]}


def fit_model(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              label_col: str = "toxic", fit_toxic: int = FIT_TOXIC, fit_ordinary: int = FIT_ORDINARY,
              fit_chars: int = FIT_CHARS) -> dict:
    """Fit on a bounded sample of the labelled texts (see the module's text); ``labels`` names the rows
    that may be learned from."""
    known = (pick(labels, id=id_col, y=F.col(f"`{label_col}`").cast("int")).where("y in (0, 1)")
             .groupBy("id").agg(F.max("y").alias("y")))
    rows = pick(df, id=id_col, text=text_col).where("text is not null")
    labelled = known.join(rows.select("id"), "id", "left_semi")
    by_class = {r["y"]: r["n"] for r in labelled.groupBy("y").agg(F.count("*").alias("n")).collect()}
    totals = (by_class.get(0, 0), by_class.get(1, 0))
    sizes = rows.groupBy("id").agg(F.max(F.length("text")).alias("n"))
    usable = known.join(sizes, "id").withColumn("h", F.xxhash64("id"))
    some, left = [], {0: fit_chars, 1: fit_chars}
    for y, n in ((1, fit_toxic), (0, fit_ordinary)):
        for r in usable.where(F.col("y") == y).orderBy("h", "id").limit(n).collect():  # ids and lengths of the sample
            if r["n"] <= left[y]:
                left[y] -= r["n"]
                some.append((r["id"], r["y"], r["h"]))
    picked = df.sparkSession.createDataFrame(some, T.StructType([rows.schema["id"], T.StructField("y", T.IntegerType()),
                                                                  T.StructField("h", T.LongType())]))
    chosen = rows.join(F.broadcast(picked), "id").groupBy("id", "y", "h").agg(F.min("text").alias("text"))

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = pd.concat([pd.DataFrame({"text": pd.Series(dtype=str), "y": pd.Series(dtype=int), "h": pd.Series(dtype=int)}),
                         *batches]).sort_values(["h", "text"], kind="stable")
        model = fit([t.encode() for t in got["text"]], got["y"].to_numpy(dtype=np.int64), totals)
        yield pd.DataFrame({"model": [pickle.dumps(model)]})

    one = chosen.select("text", "y", "h").repartition(1).mapInPandas(learn, "model binary")
    return pickle.loads(bytes(one.first()["model"]))


def score(df: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``df``: doc_id, score, predicted."""
    rows = pick(df, doc_id=id_col, text=text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for b in batches:
            s = scorer.score(utf8(b.column("text")))
            yield pa.record_batch({"doc_id": b.column("doc_id"), "score": s, "predicted": (s >= PREDICT_AT).astype(np.int32)})

    return rows.mapInArrow(scan, f"doc_id {id_type}, score double, predicted int")


def reject_toxic(df: DataFrame, model: dict, text_col: str = "text") -> DataFrame:
    """Rows of ``df`` whose text is not predicted toxic, all columns."""

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = Scorer(model)
        for t in texts:
            yield pd.Series(scorer.score([(x or "").encode() for x in t]))

    return df.where(of(F.col(f"`{text_col}`")) < PREDICT_AT)
