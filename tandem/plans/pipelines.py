"""End-to-end plans for the two jobs users run: preparing training data and
evaluating generated output. Each is one DataFrame plan composed of the operators.
Small jobs run while it is built (row counts, vocabulary size, unique keys);
no rows of the data come to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import clean_generated, non_empty, render_prompt
from tandem.operators import codec, evaluate, ordering, prep
from tandem.sources import sinks


def prepare_training_data(spark: SparkSession, dataset: str, split: str, reader: prep.Reader, vocab: DataFrame,
                          seed: int = 0, epoch: int = 0, batch_size: int = 8, grad_accum: int = 1,
                          world: int | None = None, variants: DataFrame | None = None,
                          add_instruction: bool = True, max_length: int = prep.MAX_LENGTH) -> DataFrame:
    """load -> filter -> normalise -> (augment, train only) -> prompt -> encode
    -> epoch order -> batches (-> shards when ``world`` is given).

    Output per example: id, input_ids, input_ids_mask, labels, labels_mask,
    target, caption, pos, batch_id, opt_step (and rank, rank_index)."""
    family = prep.resolve(dataset).family
    df = prep.load_split(spark, dataset, split, reader)
    df = prep.normalise_columns(prep.filter_nonempty_target(df, family), family)
    if variants is not None and split == "train":
        df = codec.augment_variants(df, variants, seed, epoch)
    df = df.withColumn("prompt", render_prompt("caption", add_instruction))
    enc = prep.encode(df, "id", {"prompt": "input_ids", "target": "labels"}, vocab, max_length)
    ordered = ordering.epoch_order(enc, "id", seed=seed, epoch=epoch)
    out = ordering.make_batches(ordered, ["order_key", "id"], batch_size, grad_accum).drop("prompt")
    if world:
        out = ordering.shard_rows(out, world, total=df.count())
    return out


@dataclass
class Evaluation:
    prepared: DataFrame   # one row per reference: forms, canonical forms, status
    report: DataFrame     # one row: the eight metrics and counts
    unmatched: DataFrame  # predictions or references without a partner


def evaluate_predictions(preds: DataFrame, refs: DataFrame, key: str = "pair_id", codebook: DataFrame | None = None,
                         canonicalise=None, is_valid=non_empty, out_dir: str | None = None,
                         identity_keys: DataFrame | None = None) -> Evaluation:
    """Pair predictions (``key``, ``pred_raw``) with references (``key``,
    ``caption``, ``gt_raw``) on the key; clean the generated text; decode both
    sides through ``codebook`` (a failed decode is ''); canonicalise; classify;
    one aggregate for the report. Every reference is scored: one without a
    prediction counts with an empty output. Keys must be unique on both sides
    (checked by one count each). With ``identity_keys`` (raw, canonical_key) a
    match is by key, and a pair without one on either side raises (counts as
    bad). With ``out_dir`` the TSV of kept pairs, the
    CSV of all pairs and the metrics JSON are written there."""
    for side in (preds, refs):
        if side.groupBy(key).count().where("count > 1").limit(1).count():
            raise ValueError(f"{key} is not unique")
    paired = codec.pair_predictions(preds, refs, key).withColumnRenamed(key, "pair_id")
    matched = paired.where(F.col("match") != "missing_reference").withColumn(
        "pred_self", F.coalesce(clean_generated("pred_raw"), F.lit("")))
    if codebook is not None:
        decoded = codec.decode_by_codebook(matched, codebook, {"gt_raw": "gt_dec", "pred_self": "pred_dec"})
        dec_cols: dict[str, str | None] = {"gt_decoded": "gt_dec", "pred_decoded": "pred_dec"}
    else:
        decoded = matched
        dec_cols = {"gt_decoded": None, "pred_decoded": None}
    identity = None
    if identity_keys is not None:
        raw = dec_cols["gt_decoded"] or "gt_raw", dec_cols["pred_decoded"] or "pred_self"
        decoded = codec.canonical_match(decoded, identity_keys, *raw)
        identity = ("gt_key", "pred_key")
    prepared = evaluate.prepare_pairs(decoded, canonicalise, is_valid, keep=("pair_id", "caption"), gt_col="gt_raw",
                                      pred_col="pred_self", clean=False, identity=identity, **dec_cols)
    report = evaluate.eval_report(prepared)
    if out_dir:
        sinks.write_eval_tsv(prepared, f"{out_dir}/eval_tsv")
        rows = decoded.select("caption", F.col("gt_raw").alias("gt_selfie"),
                              _or_empty(dec_cols["gt_decoded"], "gt_raw").alias("gt_smiles"),
                              F.col("pred_self").alias("pred_selfie"),
                              _or_empty(dec_cols["pred_decoded"], "pred_self").alias("pred_smiles"))
        sinks.write_predictions_csv(rows, f"{out_dir}/predictions_csv")
        sinks.write_metrics_json(report, f"{out_dir}/metrics_json")
    return Evaluation(prepared.withColumnRenamed("pair_id", key), report,
                      paired.where(F.col("match") != "matched").withColumnRenamed("pair_id", key))


def _or_empty(decoded: str | None, raw: str) -> Column:
    return F.coalesce(F.col(decoded), F.lit("")) if decoded else F.col(raw)
