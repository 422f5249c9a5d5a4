"""Stand-in inputs derived from the test tables (see FIXTURES.md).

Every fixture is a lazy DataFrame over the given parquet tables, so its size
grows with them; texts are used whole. The DuckDB twins of these definitions
live in ``tandem.oracle_sql`` and must stay in step with this file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tandem.functions.text import clean_generated, letters_canonical
from tandem.sources.tables import read_table

# Rule-based "model output" variants of a reference (pairs fixture).
PAIR_VARIANTS = 6


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user turn, next assistant turn) pairs with simulated model output.

    Columns: pair_id, variant, caption, gt_raw, pred_raw. The reference text
    has every character outside printable ASCII replaced by '?'.
    """
    conv = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    user = conv.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("caption"))
    reply = conv.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"),
        F.regexp_replace("text", "[^ -~]", "?").alias("gt"))
    p = (user.join(reply, ["conv_id", "turn"])
         .select((F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"),
                 F.pmod(F.col("conv_id") + F.col("turn"), F.lit(PAIR_VARIANTS)).cast("int").alias("variant"),
                 "caption", "gt"))
    gt = F.col("gt")
    v = F.col("variant")
    pred = (F.when(v == 0, gt)                                                   # exact
            .when(v == 1, F.concat(F.lit("<pad>"), gt, F.lit("</s><pad>")))      # special tokens
            .when(v == 2, F.regexp_replace(gt, "[aeiou]", ""))                   # shorter output
            .when(v == 3, F.translate(gt, "aeo", "eoa"))                         # edits
            .when(v == 4, F.lit("<p<unk>ad></s>"))                               # nested token -> empty
            .otherwise(F.replace(gt, F.lit(" "), F.lit(""))))                    # other edits
    gt_raw = F.when((v == 5) & (F.pmod(F.col("pair_id"), F.lit(2)) == 0), F.lit("")).otherwise(gt)
    return p.select("pair_id", "variant", "caption", gt_raw.alias("gt_raw"), pred.alias("pred_raw"))


def _split_of(doc_id) -> F.Column:
    r = F.pmod(doc_id, F.lit(10))
    return F.when(r == 0, "test").when(r == 1, "validation").otherwise("train")


def _sample_target(doc_id, text) -> F.Column:
    return (F.when(F.pmod(doc_id, F.lit(11)) == 0, F.lit(None).cast("string"))
            .when(F.pmod(doc_id, F.lit(7)) == 0, F.lit(""))
            .otherwise(text))


def samples_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family A layout (selfies, caption, smiles) over all documents."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return d.select(
        "doc_id", _split_of(F.col("doc_id")).alias("split"),
        _sample_target(F.col("doc_id"), F.col("text")).alias("selfies"),
        F.col("source").alias("caption"),
        F.when(F.pmod("doc_id", F.lit(3)) != 0, F.col("text")).otherwise(F.lit("")).alias("smiles"))


def samples_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Family B layout (SELFIES, description; no smiles column) over all documents."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text", "source")
    return d.select(
        "doc_id", _split_of(F.col("doc_id")).alias("split"),
        _sample_target(F.col("doc_id"), F.col("text")).alias("SELFIES"),
        F.col("source").alias("description"))


def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equivalent rewrites of every document: (doc_id, variant_no, text):
    words reversed, spaces as underscores, runs of spaces/newlines squeezed.
    (A sample only takes one when it has a source string.)"""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    forms = F.array(
        F.struct(F.lit(0).alias("variant_no"),
                 F.array_join(F.reverse(F.split("text", " ")), " ").alias("text")),
        F.struct(F.lit(1).alias("variant_no"), F.replace("text", F.lit(" "), F.lit("_")).alias("text")),
        F.struct(F.lit(2).alias("variant_no"), F.regexp_replace("text", "[ \n]+", " ").alias("text")))
    return d.select("doc_id", F.inline(forms))


def _book_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pairs(spark, sf_dir)
    gts = p.select(F.col("gt_raw").alias("raw"))
    preds = p.where(F.col("variant") != 3).select(clean_generated("pred_raw").alias("raw"))
    return gts.union(preds).distinct()


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """encoded -> decoded table (decoding = upper case); variant-3 outputs are absent."""
    return _book_strings(spark, sf_dir).select(
        F.col("raw").alias("encoded"), F.upper("raw").alias("decoded"))


def canonical_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """raw -> canonical key table; an empty canonical form has no key (NULL)."""
    canon = letters_canonical(F.col("raw"))
    return _book_strings(spark, sf_dir).select(
        "raw", F.when(F.length(canon) > 0, canon).alias("canonical_key"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts for tokenisation: doc_id, caption (source), text (whole)."""
    return read_table(spark, sf_dir, "documents", "doc_id", "source", "text").select(
        "doc_id", F.col("source").alias("caption"), "text")


def vec_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired embeddings: x = even vec_id, y = the next one (arrays of double)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    dbl = F.transform("embedding", lambda v: v.cast("double"))
    xs = e.where(F.pmod("vec_id", F.lit(2)) == 0).select(
        F.floor(F.col("vec_id") / 2).alias("id"), dbl.alias("x"))
    ys = e.where(F.pmod("vec_id", F.lit(2)) == 1).select(
        F.floor((F.col("vec_id") - 1) / 2).alias("id"), dbl.alias("y"))
    return xs.join(ys, "id").select(
        "id", F.pmod("id", F.lit(4)).alias("shard"), F.floor(F.col("id") / 8).alias("batch_id"), "x", "y")


def hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token states in long form: seq_id, pos, mask, vec."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.col("label").cast("long").alias("seq_id"), F.col("vec_id").alias("pos"),
        F.when(F.pmod("vec_id", F.lit(3)) != 0, 1).otherwise(0).alias("mask"),
        F.transform("embedding", lambda v: v.cast("double")).alias("vec"))


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per token: row_id, logits (64 classes), label (-100 = ignored)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.col("vec_id").alias("row_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("logits"),
        F.when(F.col("label") == 0, -100).otherwise(F.col("label")).alias("label"))


def gradients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per-parameter gradients: step, param_id, grad."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    return e.select(
        F.col("label").cast("long").alias("step"), F.col("vec_id").alias("param_id"),
        F.transform("embedding", lambda v: v.cast("double")).alias("grad"))


def metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log: run, step (1-based per run, by ts then event_id), metric, value, ts, event_id."""
    from tandem.operators.ordering import sequence_index

    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value")
    e = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                 F.col("user_id").alias("run"), F.col("event_type").alias("metric"), "value")
    return (sequence_index(e, ["ts", "event_id"], partition_by=["run"], name="step", start=1)
            .select("run", "step", "metric", "value", "ts", "event_id"))


def run_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoint file paths as the training job would have written them.

    Folder ``{project}_{method}_seed{seed}_{yyyymmdd_hhmmss}``; files
    ``ckpt_epoch={e}_val_seq2seq_loss={l:.4f}.ckpt``; folders of flagged
    runs keep their files one level down only.
    """
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    seed = F.pmod("doc_id", F.lit(5))
    method = F.when(F.col("quality") == 1, "aligner").otherwise("base")
    ts = F.format_string("202401%02d_1200%02d", seed + 1, F.col("toxic"))
    folder = F.format_string("lpm24_%s_seed%d_%s", method, seed, ts)
    loss = F.format_string("%.4f", F.pmod(F.col("doc_id") * 37, F.lit(1000)) / F.lit(1000.0))
    fname = F.format_string("ckpt_epoch=%d_val_seq2seq_loss=%s.ckpt", F.floor(F.col("doc_id") / 5), loss)
    sub = F.when(F.col("toxic") == 1, F.lit("checkpoints/")).otherwise(F.lit(""))
    return lab.select(F.concat(F.lit("runs/"), folder, F.lit("/"), sub, fname).alias("path"))
