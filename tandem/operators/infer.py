"""Distributed batch scoring with a model loaded once per Python worker.

``batch_generate`` runs a predictor over Arrow batches inside
``mapInPandas``; each batch is cut into model batches of ``batch_size``
rows. The predictor factory is called once per worker process and call of
``batch_generate`` (or per ``name``, if given), never per row, and results stay distributed: nothing is collected.
"""

from __future__ import annotations

import uuid
from bisect import bisect_left
from collections.abc import Callable, Sequence
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.text import EOS_TOKEN, PAD_TOKEN, clean_generated, word_tokens
from tandem.operators.ordering import sequence_index
from tandem.session import scratch_path, stored

Predictor = Callable[[list[str]], list[str]]

_LOADED: dict[str, Predictor] = {}


def _predictor(name: str, factory: Callable[[], Predictor]) -> Predictor:
    if name not in _LOADED:
        _LOADED.clear()  # one model per worker: the last call's is not kept beside the new one
        _LOADED[name] = factory()
    return _LOADED[name]


def batch_generate(df: DataFrame, factory: Callable[[], Predictor], input_col: str,
                   keep: Sequence[str], batch_size: int = 8, output_col: str = "generated",
                   name: str | None = None, clean: bool = True) -> DataFrame:
    """``keep`` columns plus the generated text (raw) and, with ``clean``,
    ``{output_col}_clean`` with special tokens removed (P4)."""
    if batch_size < 1:
        raise ValueError("batch_size must be positive")
    # A fresh key per call: two factories made by one function are two models.
    key = name or uuid.uuid4().hex
    fields = [df.schema[c] for c in keep] + [T.StructField(output_col, T.StringType())]
    src = df.select(*dict.fromkeys([*keep, input_col]))

    def run(batches):
        model = _predictor(key, factory)
        for pdf in batches:
            outs: list[str] = []
            texts = pdf[input_col].tolist()
            for start in range(0, len(texts), batch_size):
                chunk = ["" if t is None else t for t in texts[start:start + batch_size]]
                outs.extend(model(chunk))
            res = pdf[list(keep)].copy()
            res[output_col] = pd.Series(outs, index=pdf.index, dtype=object)
            yield res

    out = src.mapInPandas(run, T.StructType(fields))
    if clean:
        out = out.withColumn(f"{output_col}_clean", clean_generated(F.col(output_col)))
    return out


def spaceless_echo_factory() -> Predictor:
    """Deterministic stand-in model: echoes the input without spaces,
    wrapped in pad/eos tokens as a decoder would emit them."""
    def predict(batch: list[str]) -> list[str]:
        return ["<pad>" + t.replace(" ", "") + "</s>" for t in batch]
    return predict


# --- a trained model as an artefact --------------------------------------------------

def train_next_words(texts: DataFrame, text_col: str) -> DataFrame:
    """A greedy bigram model of ``texts``: (word, next), the word that follows each word most often (the least such
    word among equals). Pairs are counted by partial sums, then reduced per word."""
    pairs = texts.select(word_tokens(text_col).alias("w")).select(F.explode(F.arrays_zip(
        F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("word"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("next"))).alias("p"))
    counts = pairs.groupBy("p.word", "p.next").agg(F.count("*").alias("n"))
    return counts.groupBy("word").agg(F.min_by("next", F.struct(-F.col("n"), "next")).alias("next"))


def publish_model(model: DataFrame) -> str:
    """Write a model table under the shared folder and have every executor fetch its part files (a cluster does not
    take a folder); returns the artefact's name. Words are numbered in their order (as bytes) and stand there once; a
    row holds its word, its number and the number of the next word, so a worker needs no table of strings by string."""
    spark = model.sparkSession
    model = stored(model, "next-words")
    path = scratch_path(spark, "model")
    words = model.select("word").union(model.select("next")).distinct()
    numbered = sequence_index(words, ["word"], name="number")
    of_next = numbered.select(F.col("word").alias("next"), F.col("number").alias("next_number"))
    rows = numbered.join(model.join(of_next, "next").select("word", "next_number"), "word", "left")
    rows.repartitionByRange("number").sortWithinPartitions("number").write.parquet(path)
    name = path.rsplit("/", 1)[1]
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted(str(p) for p in (s.getPath().toString() for s in fs.listStatus(folder)) if p.endswith(".parquet"))
    for k, part in enumerate(parts):  # named after the artefact, in order
        file = f"{path}/{name}-{k:05d}.parquet"
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(part), spark._jvm.org.apache.hadoop.fs.Path(file)):
            raise OSError(f"cannot name {file}")
        spark.sparkContext.addFile(file)
    return name


class NextWords:
    """A published model in a worker: the bytes of all words in one buffer, in order, and as arrays where each begins
    and the number of its next word (-1: none). A string is looked up by bisection."""

    def __init__(self, artefact: str):
        files = [pq.ParquetFile(f) for f in sorted(Path(SparkFiles.getRootDirectory()).glob(f"{artefact}-*.parquet"))]
        rows = sum(f.metadata.num_rows for f in files)
        self.begin, self.following, self.text = np.zeros(rows + 1, dtype=np.int64), np.empty(rows, dtype=np.int32), bytearray()
        at = 0
        for file in files:
            with file:
                for batch in file.iter_batches(columns=["word", "next_number"]):
                    word, end = batch.column("word").cast(pa.large_binary()), at + batch.num_rows
                    self.begin[at + 1:end + 1] = len(self.text) + np.cumsum(pc.binary_length(word).to_numpy())
                    self.following[at:end] = pc.fill_null(batch.column("next_number"), -1).to_numpy()
                    self.text += b"".join(word.to_pylist())
                    at = end

    def word(self, number: int) -> bytes:
        return bytes(self.text[self.begin[number]:self.begin[number + 1]])

    def after(self, word: str, most: int) -> list[str]:
        """Up to ``most`` words that follow ``word``, one after the other."""
        wanted = word.encode()
        at, made = bisect_left(range(len(self.following)), wanted, key=self.word), []
        if at == len(self.following) or self.word(at) != wanted:
            return made
        while len(made) < most and (at := int(self.following[at])) >= 0:
            made.append(self.word(at).decode())
        return made


def next_word_factory(artefact: str, max_new_words: int = 8) -> Callable[[], Predictor]:
    """A predictor over a published :func:`train_next_words` model: from an input's last word on, the next word again
    and again, until none is known or ``max_new_words`` are made; framed as a decoder emits it."""
    def load() -> Predictor:
        model = NextWords(artefact)

        def predict(batch: list[str]) -> list[str]:
            last = (text.rstrip(" ").rsplit(" ", 1)[-1] for text in batch)
            return [f"{PAD_TOKEN}{' '.join(model.after(word, max_new_words))}{EOS_TOKEN}" for word in last]
        return predict
    return load
