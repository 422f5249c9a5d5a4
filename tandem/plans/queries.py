"""The registered query set: one ``(spark, sf_dir) -> DataFrame`` per operator
of the inventory, each over the fixtures derived from the given tables.

Column names and rounding here are the contract with ``tandem.plans.oracles``
(the DuckDB twin of each query).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.text import clean_generated, letters_canonical, render_prompt, word_tokens
from tandem.operators import align, codec, evaluate, infer, ordering, prep, telemetry
from tandem.session import scratch_path, ship_package
from tandem.sources import fixtures as fx
from tandem.sources import sinks
from tandem.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

BATCH_SIZE, GRAD_ACCUM, WORLD = 8, 4, 4
SEEDS = (0, 1, 2, 3, 4)
VAL_INTERVAL = 5
PROJECTOR_DIMS = (64, 8, 4)


# --- shared building blocks ------------------------------------------------------

def prepared_pairs(spark: SparkSession, sf: str, keep=("pair_id", "variant", "caption")) -> DataFrame:
    """Pairs cleaned, canonicalised (letters rule) and classified."""
    return evaluate.prepare_pairs(fx.pairs(spark, sf), canonicalise=letters_canonical, keep=keep)


def _fixture_reader(sf: str):
    def read(spark: SparkSession, path: str) -> DataFrame:
        if path.startswith("lpm-24"):
            return fx.samples_a(spark, sf)
        if path.startswith("chebi-20"):
            return fx.samples_b(spark, sf)
        raise ValueError(path)
    return read


def normalised(spark: SparkSession, sf: str) -> DataFrame:
    a = prep.filter_nonempty_target(fx.samples_a(spark, sf), "A")
    b = prep.filter_nonempty_target(fx.samples_b(spark, sf), "B")
    return prep.normalise_columns(a, "A").unionByName(prep.normalise_columns(b, "B"))


def _ids_text(c) -> F.Column:
    return F.array_join(F.col(c) if isinstance(c, str) else c, " ")


def _corpus_vocab(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c = fx.corpus(spark, sf).withColumn("prompt", render_prompt("caption"))
    return c, prep.build_vocab(c, ["text", "prompt"])


def _r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


# --- S: sources and sinks ------------------------------------------------------------

def q_load_split(spark, sf):
    return prep.load_split(spark, "lpm-24", "train", _fixture_reader(sf))


def q_run_catalog(spark, sf):
    return telemetry.run_catalog(fx.run_paths(spark, sf), "lpm24", ["aligner", "base"], SEEDS)


def q_sink_eval_tsv(spark, sf):
    path = scratch_path(spark, "eval-tsv")
    sinks.write_eval_tsv(prepared_pairs(spark, sf), path)
    return sinks.read_eval_tsv(spark, path)


def _predictions_rows(spark, sf):
    book = fx.codebook(spark, sf)
    p = fx.pairs(spark, sf).select("pair_id", "caption", F.col("gt_raw").alias("gt_selfie"),
                                   clean_generated("pred_raw").alias("pred_selfie"))
    return codec.decode_by_codebook(p, book, {"gt_selfie": "gt_smiles", "pred_selfie": "pred_smiles"})


def q_sink_predictions_csv(spark, sf):
    path = scratch_path(spark, "pred-csv")
    sinks.write_predictions_csv(_predictions_rows(spark, sf), path)
    return sinks.read_predictions_csv(spark, path)


def q_sink_metrics_json(spark, sf):
    path = scratch_path(spark, "metrics-json")
    sinks.write_metrics_json(evaluate.eval_report(prepared_pairs(spark, sf)), path)
    return sinks.read_metrics_json(spark, path)


# --- P: projections and filters ------------------------------------------------------

def q_filter_nonempty_target(spark, sf):
    return prep.filter_nonempty_target(fx.samples_a(spark, sf), "A")


def q_normalise_columns(spark, sf):
    return normalised(spark, sf)


def q_render_prompt(spark, sf):
    return normalised(spark, sf).select("id", "family", render_prompt("caption").alias("prompt"))


def q_clean_generated(spark, sf):
    return fx.pairs(spark, sf).select("pair_id", clean_generated("pred_raw").alias("pred_self"))


def q_pair_status(spark, sf):
    return evaluate.status_counts(prepared_pairs(spark, sf))


# --- J: joins ---------------------------------------------------------------------------

def _turn_sides(spark, sf):
    conv = fx.read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    preds = conv.where(F.col("role") == "user").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
        F.concat(F.lit("<pad>"), F.replace("text", F.lit(" "), F.lit("")), F.lit("</s>")).alias("pred_raw"))
    refs = conv.where(F.col("role") == "assistant").select(
        (F.col("conv_id") * 1000 + F.col("turn") - 1).alias("pair_id"),
        F.regexp_replace("text", "[^ -~]", "?").alias("gt_raw"))
    return preds, refs


def q_pair_predictions(spark, sf):
    preds, refs = _turn_sides(spark, sf)
    return codec.pair_predictions(preds, refs)


def q_decode_by_codebook(spark, sf):
    p = fx.pairs(spark, sf).select("pair_id", "gt_raw", clean_generated("pred_raw").alias("pred_self"))
    out = codec.decode_by_codebook(p, fx.codebook(spark, sf), {"gt_raw": "gt_dec", "pred_self": "pred_dec"})
    return out.select("pair_id", "gt_dec", "pred_dec")


def q_canonical_match(spark, sf):
    p = fx.pairs(spark, sf).select("pair_id", "gt_raw", clean_generated("pred_raw").alias("pred_self"))
    out = codec.canonical_match(p, fx.canonical_keys(spark, sf), "gt_raw", "pred_self")
    return out.select("pair_id", "gt_key", "pred_key", "is_match")


def q_augment_variants(spark, sf):
    a = prep.normalise_columns(prep.load_split(spark, "lpm-24", "train", _fixture_reader(sf)), "A")
    out = codec.augment_variants(a, fx.variants(spark, sf), seed=0, epoch=0)
    return out.select("id", "target", "augmented")


# --- T: tokens and sequences -------------------------------------------------------------

def q_char_tokens(spark, sf):
    from tandem.functions.text import char_tokens
    t = char_tokens(F.col("text"))
    return fx.corpus(spark, sf).select("doc_id", F.size(t).alias("n_tokens"),
                                       F.size(F.array_distinct(t)).alias("n_distinct"))


def q_build_vocab(spark, sf):
    _, v = _corpus_vocab(spark, sf)
    return v


def q_encode_padded(spark, sf):
    c, v = _corpus_vocab(spark, sf)
    enc = prep.encode(c, "doc_id", {"prompt": "input_ids", "text": "labels"}, v)
    return enc.select("doc_id", _ids_text("input_ids").alias("input_ids"),
                      F.aggregate("input_ids_mask", F.lit(0), lambda a, x: a + x).alias("n_input"),
                      _ids_text("labels").alias("labels"),
                      F.aggregate("labels_mask", F.lit(0), lambda a, x: a + x).alias("n_labels"))


def q_encode_unpadded(spark, sf):
    c, v = _corpus_vocab(spark, sf)
    enc = prep.encode(c, "doc_id", {"text": "labels"}, v, max_length=None)
    return enc.select("doc_id", _ids_text("labels").alias("labels"), F.size("labels").alias("n_labels"))


def _padded_labels(spark, sf):
    c, v = _corpus_vocab(spark, sf)
    return prep.encode(c, "doc_id", {"text": "labels"}, v)


def q_mask_labels(spark, sf):
    enc = _padded_labels(spark, sf)
    masked, dmask = prep.mask_labels(F.col("labels"))
    return enc.select("doc_id", _ids_text(masked).alias("masked_labels"),
                      F.aggregate(dmask, F.lit(0), lambda a, x: a + x).alias("n_decoder_mask"))


def q_shift_right(spark, sf):
    enc = _padded_labels(spark, sf)
    masked, _ = prep.mask_labels(F.col("labels"))
    return enc.select("doc_id", _ids_text(prep.shift_right(masked)).alias("decoder_input_ids"))


def q_decode_ids(spark, sf):
    c, v = _corpus_vocab(spark, sf)
    enc = prep.encode(c, "doc_id", {"text": "ids"}, v, max_length=None)
    return prep.decode_ids(enc, "doc_id", "ids", v, "decoded").select("doc_id", "decoded")


def _word_vocab(spark, sf):
    c = fx.corpus(spark, sf)
    return c, prep.build_vocab(c.where(F.pmod("doc_id", F.lit(2)) == 0), ["text"], word_tokens)


def q_encode_words(spark, sf):
    """A vocabulary of words of half of the documents; the others hold unknown words."""
    c, v = _word_vocab(spark, sf)
    enc = prep.encode(c, "doc_id", {"text": "labels", "caption": "source_ids"}, v, tokenizer=word_tokens)
    return enc.select("doc_id", _ids_text("labels").alias("labels"), _ids_text("source_ids").alias("source_ids"),
                      F.aggregate("labels_mask", F.lit(0), lambda a, x: a + x).alias("n_labels"))


def q_decode_words(spark, sf):
    c, v = _word_vocab(spark, sf)
    c, rows = c.select("doc_id", "text"), c.count()
    enc = prep.encode(c, "doc_id", {"text": "ids"}, v, max_length=None, tokenizer=word_tokens, rows=rows)
    return prep.decode_ids(enc.select("doc_id", "ids"), "doc_id", "ids", v, "decoded", word_tokens, " ", rows).select("doc_id", "decoded")


# --- B: order, batches, shards, seeds --------------------------------------------------------

def _train_rows(spark, sf):
    return prep.normalise_columns(prep.load_split(spark, "lpm-24", "train", _fixture_reader(sf)), "A")


def q_epoch_shuffle(spark, sf):
    n = prep.normalise_columns(fx.samples_a(spark, sf), "A")
    return ordering.epoch_order(n, "id", seed=0, epoch=0).select("id", "split", "order_key")


def _batches(spark, sf):
    t = ordering.epoch_order(_train_rows(spark, sf), "id", seed=0, epoch=0)
    return ordering.make_batches(t, ["order_key", "id"], BATCH_SIZE, GRAD_ACCUM)


def q_make_batches(spark, sf):
    return _batches(spark, sf).select("id", "pos", "batch_id", "opt_step")


def q_shard_rows(spark, sf):
    total = _train_rows(spark, sf).count()
    return ordering.shard_rows(_batches(spark, sf).select("id", "pos"), WORLD, total).select(
        "id", "pos", "rank", "rank_index")


def q_seed_replicas(spark, sf):
    reps = ordering.seed_replicas(_train_rows(spark, sf).select("id"), SEEDS)
    keyed = reps.withColumn("order_key", ordering.shuffle_key(F.col("seed"), 0, "id"))
    b = ordering.make_batches(keyed, ["order_key", "id"], BATCH_SIZE, GRAD_ACCUM, partition_by=["seed"])
    return b.select("seed", "id", "pos", "batch_id")


# --- E: evaluation -----------------------------------------------------------------------------

def q_validity(spark, sf):
    return evaluate.validity(prepared_pairs(spark, sf))


def q_bleu_canonical(spark, sf):
    return evaluate.corpus_bleu(prepared_pairs(spark, sf), "pred_can", "gt_can", "bleu_smi")


def q_bleu_raw(spark, sf):
    return evaluate.corpus_bleu(prepared_pairs(spark, sf), "pred_self", "gt_self", "bleu_self")


def q_exact_match(spark, sf):
    return evaluate.exact_match(prepared_pairs(spark, sf))


def q_levenshtein_mean(spark, sf):
    return evaluate.levenshtein_mean(prepared_pairs(spark, sf))


def q_tanimoto_bits(spark, sf):
    return evaluate.tanimoto_bits(prepared_pairs(spark, sf))


def q_tanimoto_counts(spark, sf):
    return evaluate.tanimoto_counts(prepared_pairs(spark, sf))


def q_eval_report(spark, sf):
    return evaluate.eval_report(prepared_pairs(spark, sf))


def q_eval_report_by_group(spark, sf):
    return evaluate.eval_report_by_group(prepared_pairs(spark, sf), "variant")


def _keyed_pairs(spark, sf):
    """Prepared pairs with J3's identity keys; outputs the key table does not know raise."""
    p = fx.pairs(spark, sf).select("pair_id", "variant", "gt_raw", clean_generated("pred_raw").alias("pred_self"))
    keyed = codec.canonical_match(p, fx.canonical_keys(spark, sf), "gt_raw", "pred_self")
    return evaluate.prepare_pairs(keyed, letters_canonical, keep=("pair_id", "variant"), pred_col="pred_self", clean=False,
                                  identity=("gt_key", "pred_key"))


def q_exact_match_by_key(spark, sf):
    return evaluate.exact_match(_keyed_pairs(spark, sf))


def q_eval_report_by_key(spark, sf):
    return evaluate.eval_report_by_group(_keyed_pairs(spark, sf), "variant")


# --- A: embeddings and losses ---------------------------------------------------------------------

def q_masked_mean_pool(spark, sf):
    return align.masked_mean_pool(fx.hidden_states(spark, sf)).withColumn("value", _r6("value"))


def q_mean_pool(spark, sf):
    return align.mean_pool(fx.hidden_states(spark, sf)).withColumn("value", _r6("value"))


def q_project_embeddings(spark, sf):
    e = fx.read_table(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    out = align.project_embeddings(e, "vec", align.closed_form_projector(PROJECTOR_DIMS), activation="relu")
    return out.select("vec_id", F.posexplode("proj").alias("out_dim", "value")).withColumn("value", _r6("value"))


def q_project_embeddings_gelu(spark, sf):
    e = fx.read_table(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    out = align.project_embeddings(e, "vec", align.closed_form_projector(PROJECTOR_DIMS))  # gelu is the default
    return out.select("vec_id", F.posexplode("proj").alias("out_dim", "value")).withColumn("value", _r6("value"))


def q_batch_standardise(spark, sf):
    e = fx.read_table(spark, sf, "embeddings", "vec_id", "embedding").select(
        "vec_id", F.transform("embedding", lambda v: v.cast("double")).alias("vec"))
    return align.batch_standardise(e, "vec_id", "vec").withColumn("value", _r6("value"))


def q_vicreg(spark, sf):
    return align.vicreg(fx.vec_pairs(spark, sf))


def q_clip_loss(spark, sf):
    return align.clip_loss(fx.vec_pairs(spark, sf))


def q_neg_cosine(spark, sf):
    return align.neg_cosine(fx.vec_pairs(spark, sf))


def q_token_cross_entropy(spark, sf):
    return align.token_cross_entropy(fx.logits(spark, sf))


def q_total_loss(spark, sf):
    # components unrounded; one rounding of the total
    return align.total_loss(align.token_cross_entropy(fx.logits(spark, sf), digits=None),
                            align.vicreg(fx.vec_pairs(spark, sf), digits=None))


def q_vicreg_by_shard(spark, sf):
    return align.vicreg(fx.vec_pairs(spark, sf), shard="shard", by_shard=True)


# --- O: telemetry -----------------------------------------------------------------------------------

def q_topk_checkpoints(spark, sf):
    return telemetry.topk_checkpoints(fx.metric_log(spark, sf)).select("run", "metric", "step", "value", "rank")


def q_early_stop(spark, sf):
    return telemetry.early_stop(fx.metric_log(spark, sf))


def q_lr_one_cycle(spark, sf):
    return telemetry.lr_schedule(fx.metric_log(spark, sf)).withColumn("lr", F.round("lr", 15))


def q_lr_warmup(spark, sf):
    out = telemetry.lr_warmup(fx.metric_log(spark, sf))
    return out.withColumn("cosine_mult", F.round("cosine_mult", 9)).withColumn(
        "constant_mult", F.round("constant_mult", 9))


def q_grad_norm(spark, sf):
    return telemetry.grad_norm(fx.gradients(spark, sf))


def q_validation_plan(spark, sf):
    return telemetry.validation_plan(fx.metric_log(spark, sf), VAL_INTERVAL)


def q_metric_log_summary(spark, sf):
    return telemetry.metric_log_summary(fx.metric_log(spark, sf))


# --- U: Python surface and streaming ---------------------------------------------------------------

def q_batch_generate(spark, sf):
    ship_package(spark)
    p = fx.pairs(spark, sf)
    return infer.batch_generate(p, infer.spaceless_echo_factory, "caption", ["pair_id"], batch_size=BATCH_SIZE)


def q_generate_from_model(spark, sf):
    """A model trained on the references, published, loaded once per worker, and run over the captions."""
    ship_package(spark)
    p = fx.pairs(spark, sf)
    artefact = infer.publish_model(infer.train_next_words(p.select("gt_raw"), "gt_raw"))
    return infer.batch_generate(p, infer.next_word_factory(artefact), "caption", ["pair_id"], batch_size=BATCH_SIZE, name=artefact)


def ascii_only(s: str) -> str:
    """Stand-in for a per-row codec that fails on some inputs."""
    return s.encode("ascii").decode("ascii")


def q_safe_apply(spark, sf):
    ship_package(spark)
    p = fx.pairs(spark, sf).select("pair_id", "caption")
    return codec.safe_apply(p, ascii_only, "caption", "value").select("pair_id", "value", "value_error")


PAIRS_SCHEMA = T.StructType([T.StructField("pair_id", T.LongType()), T.StructField("variant", T.IntegerType()),
                             T.StructField("caption", T.StringType()), T.StructField("gt_raw", T.StringType()),
                             T.StructField("pred_raw", T.StringType())])
LOG_SCHEMA = T.StructType([T.StructField("run", T.LongType()), T.StructField("step", T.LongType()),
                           T.StructField("metric", T.StringType()), T.StructField("value", T.DoubleType()),
                           T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType())])


def q_streaming_eval(spark, sf):
    ship_package(spark)
    src = scratch_path(spark, "u3-in")
    streams.write_stream_input(fx.pairs(spark, sf), src, 4, "pair_id")
    return streams.streaming_eval(spark, src, PAIRS_SCHEMA, canonicalise=letters_canonical)


def q_streaming_early_stop(spark, sf):
    ship_package(spark)
    src = scratch_path(spark, "u4-in")
    streams.write_stream_input(fx.metric_log(spark, sf), src, 4, "step", by=("run", "metric"))
    return streams.streaming_early_stop(spark, src, LOG_SCHEMA)


def q_streaming_metric_windows(spark, sf):
    ship_package(spark)
    src = scratch_path(spark, "u5-in")
    streams.write_stream_input(fx.metric_log(spark, sf), src, 4, "ts")
    return streams.streaming_metric_windows(spark, src, LOG_SCHEMA)


QUERIES: dict[str, Query] = {
    "load_split": q_load_split, "run_catalog": q_run_catalog, "sink_eval_tsv": q_sink_eval_tsv,
    "sink_predictions_csv": q_sink_predictions_csv, "sink_metrics_json": q_sink_metrics_json,
    "filter_nonempty_target": q_filter_nonempty_target, "normalise_columns": q_normalise_columns,
    "render_prompt": q_render_prompt, "clean_generated": q_clean_generated, "pair_status": q_pair_status,
    "pair_predictions": q_pair_predictions, "decode_by_codebook": q_decode_by_codebook,
    "canonical_match": q_canonical_match, "augment_variants": q_augment_variants,
    "char_tokens": q_char_tokens, "build_vocab": q_build_vocab, "encode_padded": q_encode_padded,
    "encode_unpadded": q_encode_unpadded, "mask_labels": q_mask_labels, "shift_right": q_shift_right,
    "decode_ids": q_decode_ids, "encode_words": q_encode_words, "decode_words": q_decode_words,
    "epoch_shuffle": q_epoch_shuffle, "make_batches": q_make_batches, "shard_rows": q_shard_rows,
    "seed_replicas": q_seed_replicas,
    "validity": q_validity, "bleu_canonical": q_bleu_canonical, "bleu_raw": q_bleu_raw,
    "exact_match": q_exact_match, "levenshtein_mean": q_levenshtein_mean, "tanimoto_bits": q_tanimoto_bits,
    "tanimoto_counts": q_tanimoto_counts, "eval_report": q_eval_report,
    "eval_report_by_group": q_eval_report_by_group,
    "exact_match_by_key": q_exact_match_by_key, "eval_report_by_key": q_eval_report_by_key,
    "masked_mean_pool": q_masked_mean_pool, "mean_pool": q_mean_pool,
    "project_embeddings": q_project_embeddings, "project_embeddings_gelu": q_project_embeddings_gelu,
    "batch_standardise": q_batch_standardise,
    "vicreg": q_vicreg, "clip_loss": q_clip_loss, "neg_cosine": q_neg_cosine,
    "token_cross_entropy": q_token_cross_entropy, "total_loss": q_total_loss,
    "vicreg_by_shard": q_vicreg_by_shard,
    "topk_checkpoints": q_topk_checkpoints, "early_stop": q_early_stop, "lr_one_cycle": q_lr_one_cycle,
    "lr_warmup": q_lr_warmup, "grad_norm": q_grad_norm, "validation_plan": q_validation_plan,
    "metric_log_summary": q_metric_log_summary,
    "batch_generate": q_batch_generate, "generate_from_model": q_generate_from_model,
    "safe_apply": q_safe_apply, "streaming_eval": q_streaming_eval,
    "streaming_early_stop": q_streaming_early_stop, "streaming_metric_windows": q_streaming_metric_windows,
}
