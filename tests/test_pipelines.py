"""The two end-to-end plans against the operator-level results."""
from sample_tables import SF001
from pyspark.sql import functions as F

from tandem.functions.text import letters_canonical, render_prompt
from tandem.operators import evaluate as ev
from tandem.operators import prep
from tandem.plans.pipelines import evaluate_predictions, prepare_training_data
from tandem.plans.queries import _fixture_reader, prepared_pairs
from tandem.session import scratch_path
from tandem.sources import fixtures as fx
from tandem.sources import sinks


def test_evaluate_predictions_equals_report(spark):
    p = fx.pairs(spark, SF001)
    preds = p.select("pair_id", "pred_raw")
    refs = p.select("pair_id", "caption", "gt_raw").unionByName(
        p.limit(1).select((F.col("pair_id") + 7).alias("pair_id"), "caption", "gt_raw"))  # one orphan reference
    out = evaluate_predictions(preds, refs, canonicalise=letters_canonical)
    whole = evaluate_predictions(preds, p.select("pair_id", "caption", "gt_raw"), canonicalise=letters_canonical)
    assert whole.report.first() == ev.eval_report(prepared_pairs(spark, SF001)).first()
    assert out.report.first()["n_total"] == whole.report.first()["n_total"] + 1  # the orphan counts
    assert out.unmatched.count() == 1


def test_evaluate_predictions_with_codebook_and_sinks(spark):
    p = fx.pairs(spark, SF001)
    out_dir = scratch_path(spark, "eval-job")
    res = evaluate_predictions(p.select("pair_id", "pred_raw"), p.select("pair_id", "caption", "gt_raw"),
                               codebook=fx.codebook(spark, SF001), canonicalise=letters_canonical, out_dir=out_dir)
    r = res.report.first()
    base = ev.eval_report(prepared_pairs(spark, SF001)).first()
    # variant-3 outputs are missing from the code book: they decode to '' and count as bad
    n3 = p.where("variant = 3").count()
    assert r.n_bad == base.n_bad + n3 and r.n_total == base.n_total
    assert sinks.read_metrics_json(spark, f"{out_dir}/metrics_json").first().validity == r.validity
    assert sinks.read_eval_tsv(spark, f"{out_dir}/eval_tsv").count() == r.n_kept
    assert sinks.read_predictions_csv(spark, f"{out_dir}/predictions_csv").count() == r.n_total


def test_prepare_training_data(spark):
    c = fx.corpus(spark, SF001).withColumn("prompt", render_prompt("caption"))
    vocab = prep.build_vocab(c, ["text", "prompt"])
    out = prepare_training_data(spark, "lpm-24", "train", _fixture_reader(SF001), vocab, seed=1, batch_size=4,
                                grad_accum=2, world=4, variants=fx.variants(spark, SF001))
    rows = out.collect()
    expected = prep.filter_nonempty_target(fx.samples_a(spark, SF001), "A").where("split = 'train'").count()
    assert len(rows) == expected + (-expected) % 4
    assert all(len(r.input_ids) == 512 for r in rows)
    assert all((r.labels is None and r.labels_mask is None) if r.target is None else len(r.labels_mask) == 512
               for r in rows)
    assert any(r.target is None for r in rows)  # NULL targets pass the non-empty filter
    assert sorted({r.pos for r in rows if r.pos < expected}) == list(range(expected))
    assert {r.batch_id for r in rows} == set(range(-(-expected // 4)))
