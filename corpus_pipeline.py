"""Corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; ``run`` writes every
stage's rows as Parquet under the shared folder and reads them again, so a lost executor costs one
stage at most. All stages but the last return the columns of ``documents``; where a stage changes a text,
``n_chars`` follows.

1. toxicity: documents predicted toxic go (dictionaries and calibration are fitted on the labelled
   documents among the input whose labels may be learned from);
2. SimHash near-dedup: of each group of near copies the document with the least id stays; texts without a word are no
   copies of anything and all stay;
3. suffix-array dedup: passages of 50 words or more stay at their first place only;
4. secret scans: secrets are replaced by ``[SECRET]``;
5. best-fit packing: one row per piece, with its sequence and offset.

Null texts pass the first four stages unchanged and are packed as the end id alone; null ids are kept;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.llm import packing, secrets_scan, simhash, suffix_dedup, toxicity
from tandem.llm.common import stored
from tandem.llm.queries import toxicity_model, vocabulary
from tandem.session import shared_dir, ship_package
from tandem.sources.tables import read_table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    shared_dir(spark)
    ship_package(spark)
    return docs


def _counted(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of the input, with ``n_chars`` of the text as it is now."""
    return docs.select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    docs = _ready(spark, docs)
    return toxicity.reject_toxic(docs, toxicity_model(spark, docs, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(_ready(spark, docs))


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(suffix_dedup.cut_repeats(_ready(spark, docs)), docs.columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(secrets_scan.mask_secrets(_ready(spark, docs)), docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(_ready(spark, docs), vocabulary("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("simhash_near_dedup", drop_near_copies),
          ("suffix_array_dedup", cut_repeated_passages), ("secret_scan", mask_secrets), ("best_fit_packing", pack_sequences)]

ORACLE_SQL = None  # compression lengths, tokenizers and XXH64 are beyond SQL: tests/llm hold a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _ready(spark, read_table(spark, sf_dir, "documents", *COLUMNS))
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
