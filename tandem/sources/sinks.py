"""Result sinks: evaluation TSV, predictions CSV and the metrics JSON.

Writers are distributed (one part file per task); readers use explicit
schemas. Paths are caller-chosen; the registered queries write under the
shared checkpoint folder and read the files back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: file headers ---
EVAL_TSV_HEADER = ("description", "ground truth", "output", "gt_selfies", "output_selfies")
PREDICTIONS_CSV_HEADER = ("caption", "gt_selfie", "gt_smiles", "pred_selfie", "pred_smiles")
METRICS = ("bleu_smi", "bleu_self", "exact_match", "levenshtein_smi", "validity",
           "maccs_sims", "rdk_sims", "morgan_sims")
# --- end of fixed values ---

_NO_QUOTE = "\u0000"


def _flat(c):
    """TSV fields cannot hold tab, CR or LF (the format has no quoting)."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), "[\t\r\n]", " ")


def write_eval_tsv(prepared: DataFrame, path: str, caption: str = "caption") -> None:
    """S3: kept pairs only: description, canonical reference, canonical
    output, raw reference, raw output; header line, no quoting."""
    kept = prepared.where(F.col("status") == "kept")
    cols = [_flat(F.col(caption)), _flat(F.col("gt_can")), _flat(F.col("pred_can")),
            _flat(F.col("gt_self")), _flat(F.col("pred_self"))]
    out = kept.select(*[c.alias(n) for c, n in zip(cols, EVAL_TSV_HEADER)])
    (out.write.mode("overwrite").option("sep", "\t").option("header", True)
     .option("quote", _NO_QUOTE).option("escape", _NO_QUOTE).option("emptyValue", "")
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_eval_tsv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in EVAL_TSV_HEADER])
    df = (spark.read.schema(schema).option("sep", "\t").option("header", True)
          .option("quote", _NO_QUOTE).option("escape", _NO_QUOTE).csv(path))
    return df.select(*[F.coalesce(F.col(f"`{n}`"), F.lit("")).alias(n) for n in EVAL_TSV_HEADER])


def write_predictions_csv(rows: DataFrame, path: str) -> None:
    """Every pair: caption, reference raw/decoded, prediction raw/decoded;
    header, RFC 4180 quoting (captions may hold newlines and quotes)."""
    out = rows.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in PREDICTIONS_CSV_HEADER])
    (out.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("quoteAll", True).option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def read_predictions_csv(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.StringType()) for n in PREDICTIONS_CSV_HEADER])
    df = (spark.read.schema(schema).option("header", True).option("multiLine", True)
          .option("quote", '"').option("escape", '"').csv(path))
    return df.select(*[F.coalesce(F.col(n), F.lit("")).alias(n) for n in PREDICTIONS_CSV_HEADER])


def write_metrics_json(report: DataFrame, path: str) -> None:
    """The one-row report as one JSON object (one part file)."""
    report.select(*METRICS).coalesce(1).write.mode("overwrite").json(path)


def read_metrics_json(spark: SparkSession, path: str) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in METRICS])
    return spark.read.schema(schema).json(path)
