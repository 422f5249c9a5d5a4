"""Codecs, Python surface and streaming against their batch forms."""
import math
import os
import tempfile

import pytest
from sample_tables import SF001
from pyspark.sql import functions as F

from tandem.functions.text import letters_canonical
from tandem.operators import codec, evaluate as ev, infer, telemetry as tm
from tandem.plans.queries import LOG_SCHEMA, PAIRS_SCHEMA, ascii_only
from tandem.session import ship_package
from tandem.sources import fixtures as fx
from tandem.streaming import streams


@pytest.mark.parametrize("threshold", ["10485760", "-1"])  # broadcast and shuffle joins
def test_lookups_keep_rows_when_keys_repeat(spark, threshold):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = spark.createDataFrame([(1, "x", "y"), (2, "", "x"), (3, None, "w"), (4, "y", "y")], "id long, a string, b string")
        book = spark.createDataFrame([("x", "X2"), ("x", "X1"), ("y", "Y"), ("x", None), (None, "N")], "encoded string, decoded string")
        got = codec.decode_by_codebook(df, book, {"a": "a_dec", "b": "b_dec"}).orderBy("id").collect()
        assert [tuple(r) for r in got] == [(1, "x", "y", "X1", "Y"), (2, "", "x", "", "X1"), (3, None, "w", "", ""), (4, "y", "y", "Y", "Y")]
        keys = book.toDF("raw", "canonical_key")
        hits = codec.canonical_match(df, keys, "a", "b").orderBy("id").collect()
        assert [(r.gt_key, r.pred_key, r.is_match) for r in hits] == [("X1", "Y", False), (None, "X1", False), (None, None, False), ("Y", "Y", True)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_safe_apply(spark):
    ship_package(spark)
    df = spark.createDataFrame([(1, "ok"), (2, "café"), (3, None)], "id long, s string")
    got = {r.id: (r.v, r.v_error) for r in codec.safe_apply(df, ascii_only, "s", "v").collect()}
    assert got == {1: ("ok", None), 2: (None, "UnicodeEncodeError"), 3: (None, None)}


def test_augment_is_deterministic(spark):
    s = spark.createDataFrame([(1, "t1", "src"), (2, "t2", ""), (3, "t3", "src")], "id long, target string, source string")
    v = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "z")],
                              "doc_id long, variant_no int, text string")
    a = {r.id: r.target for r in codec.augment_variants(s, v, seed=0, epoch=0).collect()}
    b = {r.id: r.target for r in codec.augment_variants(s.repartition(3), v.repartition(2), seed=0, epoch=0).collect()}
    assert a == b and a[2] == "t2" and a[3] == "t3" and a[1] in "abc"
    picks = {codec.augment_variants(s, v, seed=0, epoch=e).where("id = 1").first().target for e in range(12)}
    assert len(picks) > 1  # the choice changes with the epoch
    assert codec.augment_variants(s, v, 0, 0, enabled=False).collect() == s.collect()


def test_pair_predictions_reports_both_sides(spark):
    p = spark.createDataFrame([(1, "a"), (2, "b")], "pair_id long, pred string")
    r = spark.createDataFrame([(2, "B"), (3, "C")], "pair_id long, gt string")
    got = {x.pair_id: x.match for x in codec.pair_predictions(p, r).collect()}
    assert got == {1: "missing_reference", 2: "matched", 3: "missing_prediction"}


def test_batch_generate_chunks(spark):
    ship_package(spark)
    calls = spark.sparkContext.accumulator(0)

    def factory():
        def predict(batch):
            calls.add(1)
            assert len(batch) <= 3
            return [t.upper() + "</s>" for t in batch]
        return predict
    df = spark.createDataFrame([(i, f"x{i}") for i in range(10)], "id long, t string").coalesce(1)
    out = infer.batch_generate(df, factory, "t", ["id"], batch_size=3, name="upper-test").collect()
    assert {r.id: r.generated_clean for r in out} == {i: f"X{i}" for i in range(10)}
    assert calls.value == 4


def test_streaming_eval_equals_batch(spark):
    ship_package(spark)
    src = tempfile.mkdtemp(prefix="u3-")
    os.rmdir(src)
    pairs = fx.pairs(spark, SF001)
    streams.write_stream_input(pairs, src, 3, "pair_id")
    got = streams.streaming_eval(spark, src, PAIRS_SCHEMA, canonicalise=letters_canonical).first()
    want = ev.eval_report(ev.prepare_pairs(pairs, canonicalise=letters_canonical)).first()
    assert got == want


def test_streaming_early_stop_keeps_state_and_counts_late_rows(spark):
    ship_package(spark)
    log = fx.metric_log(spark, SF001)
    src, out = tempfile.mkdtemp(prefix="u4-in-"), tempfile.mkdtemp(prefix="u4-out-")
    os.rmdir(src)
    os.rmdir(out)
    log.where("step <= 30").write.parquet(src)
    streams.streaming_early_stop(spark, src, LOG_SCHEMA, out_dir=out)
    # second drop: the rest, plus a replay of old rows that must be ignored as late (or as repeated, while they wait)
    log.where("step > 30").unionByName(log.where("step <= 3")).write.mode("append").parquet(src)
    got = {(r.run, r.metric): r for r in streams.streaming_early_stop(spark, src, LOG_SCHEMA, out_dir=out).collect()}
    want = {(r.run, r.metric): r for r in tm.early_stop(log).collect()}
    assert set(got) == set(want)
    for k, w in want.items():
        g = got[k]
        assert (g.stop_step, g.best_value, g.best_step, g.n_checks) == (w.stop_step, w.best_value, w.best_step,
                                                                         w.n_checks)
    late = sum(r.late_rows for r in got.values())
    assert late == log.where("step <= 3").count()


@pytest.mark.parametrize(("rows", "want"), [
    ([(1, math.nan), (2, 3.0), (3, 2.0)], (1, None, None, 3)),
    ([(1, 3.0), (2, 2.0), (3, -math.inf), (4, 1.0)], (3, 2.0, 2, 4)),
    ([(1, 3.0), (2, None), (3, 1.0)], (2, 3.0, 1, 3)),
    ([(1, 3.0), (2, 2.0), (2, math.nan), (2, 1.0), (2, 2.5), (2, 2.5), (2, 2.5), (3, 0.5)], (None, 0.5, 3, 3))])
def test_early_stop_of_values_not_finite_and_repeated_steps(spark, rows, want):
    ship_package(spark)
    log = spark.createDataFrame([(1, s, "loss", v) for s, v in rows], "run long, step long, metric string, value double")
    log = log.withColumn("ts", F.timestamp_seconds("step"))
    src = f"{tempfile.mkdtemp(prefix='u4-in-')}/rows"
    log.coalesce(1).write.parquet(src)
    columns = ("stop_step", "best_value", "best_step", "n_checks")
    batch = tm.early_stop(log).select(*columns).first()
    stream = streams.streaming_early_stop(spark, src, log.schema).select(*columns).first()
    assert tuple(batch) == want and tuple(stream) == want


def test_streaming_windows_emit_closed_windows_only(spark):
    ship_package(spark)
    log = fx.metric_log(spark, SF001)
    src = tempfile.mkdtemp(prefix="u5-")
    os.rmdir(src)
    streams.write_stream_input(log, src, 2, "ts")
    got = streams.streaming_metric_windows(spark, src, LOG_SCHEMA, window="1 day", delay="1 day")
    max_ts = log.agg(F.max("ts")).first()[0]
    ends = [r.window_end for r in got.collect()]
    assert ends and max(ends) <= str(max_ts)
    assert got.agg(F.sum("n")).first()[0] < log.count()


def test_streaming_early_stop_orders_rows_within_the_delay(spark):
    """Rows arrive shuffled, steps of a run over several drops: with a delay that covers the shuffle the stream equals
    the batch form; a run far behind the others loses nothing; waiting rows are settled once the watermark has passed."""
    ship_package(spark)
    import random

    rng = random.Random(6)
    rows = [(run, "loss", step, round(rng.uniform(0, 9), 2)) for run in range(4) for step in range(1, 61)]
    rows = [(*r, r[0] * 10 ** 6 + 60 * r[2]) for r in rows]  # run 0 is weeks behind run 3
    rng.shuffle(rows)
    chunks = [rows[i::3] for i in range(3)]
    columns = "run long, metric string, step long, value double, ts long"
    src, out = f"{tempfile.mkdtemp(prefix='u4-in-')}/rows", tempfile.mkdtemp(prefix="u4-out-")
    frames = [spark.createDataFrame(c, columns).withColumn("ts", F.timestamp_seconds("ts")) for c in chunks]
    for f in frames:
        f.coalesce(1).write.mode("append").parquet(src)
    every = spark.read.parquet(src)
    got = {r.run: r for r in streams.streaming_early_stop(spark, src, every.schema, out_dir=out, delay="2 hours").collect()}
    want = {r.run: r for r in tm.early_stop(every).collect()}
    assert set(got) == set(range(4))
    for k, w in want.items():
        assert (got[k].stop_step, got[k].best_value, got[k].best_step, got[k].n_checks, got[k].late_rows) == (
            w.stop_step, w.best_value, w.best_step, w.n_checks, 0)
    # a much later row settles the rest; a row before it comes too late and is counted
    more = spark.createDataFrame([(0, "loss", 100, 5.0, 10 ** 5), (0, "loss", 7, 0.0, 10 ** 5)], columns)
    more.withColumn("ts", F.timestamp_seconds("ts")).coalesce(1).write.mode("append").parquet(src)
    last = {r.run: r for r in streams.streaming_early_stop(spark, src, every.schema, out_dir=out, delay="2 hours").collect()}
    assert last[0].late_rows == 1 and last[0].n_checks == 61 and last[1] == got[1]


def test_epoch_sinks_survive_a_kill(spark):
    """A half-written epoch is not read, and an earlier one stays readable."""
    table = f"{tempfile.mkdtemp(prefix='u3-sums-')}/sums"
    rows = lambda k: spark.createDataFrame([(k,)], "x long")
    assert streams.read_epochs(spark, table, rows(0).schema, latest=True).count() == 0
    sink = streams.epoch_sink(table, keep=2)
    for k in range(4):
        sink(rows(k), k)
    assert streams.finished_epochs(spark, table) == [2, 3]
    rows(9).write.parquet(f"{table}/epoch=4")
    os.remove(f"{table}/epoch=4/_SUCCESS")  # as if killed before the commit
    assert [r.x for r in streams.read_epochs(spark, table, rows(0).schema, latest=True).collect()] == [3]
    sink(rows(4), 4)  # the retry
    assert [r.x for r in streams.read_epochs(spark, table, rows(0).schema, latest=True).collect()] == [4]
    assert sorted(r.x for r in streams.read_epochs(spark, table, rows(0).schema).collect()) == [3, 4]


def test_stream_input_keeps_rows_without_an_order(spark):
    path = f"{tempfile.mkdtemp(prefix='drops-')}/in"
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i) for i in range(20)], "id int, k int")
    streams.write_stream_input(df, path, 3, "k")
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(20))
    none = f"{tempfile.mkdtemp(prefix='drops-')}/in"
    streams.write_stream_input(df.where("k is null"), none, 3, "k")
    assert spark.read.parquet(none).count() == 4


def test_windows_of_no_input_are_empty(spark):
    ship_package(spark)
    log = fx.metric_log(spark, SF001).limit(3)
    src = f"{tempfile.mkdtemp(prefix='u5-')}/in"
    log.write.parquet(src)
    out = streams.streaming_metric_windows(spark, src, LOG_SCHEMA, window="3000 days", delay="3000 days")
    assert out.count() == 0 and out.columns[:3] == ["window_start", "window_end", "metric"]


def test_published_model_is_loaded_in_workers(spark):
    ship_package(spark)
    texts = spark.createDataFrame([("a b c a b d",), ("b c",), ("x",), ("",), (None,), ("c z",)], "t string")
    model = infer.train_next_words(texts, "t")
    assert {(r.word, r.next) for r in model.collect()} == {("a", "b"), ("b", "c"), ("c", "a")}
    name = infer.publish_model(model)
    df = spark.createDataFrame([(1, "say a"), (2, "z"), (3, None), (4, "b  ")], "id long, t string")
    out = infer.batch_generate(df, infer.next_word_factory(name, 4), "t", ["id"], batch_size=2).collect()
    assert {r.id: r.generated_clean for r in out} == {1: "b c a b", 2: "", 3: "", 4: "c a b c"}


def test_model_is_published_as_files(spark, monkeypatch):
    """A cluster refuses folders: every fetched path is a file. Words of any script keep their order as bytes."""
    texts = spark.createDataFrame([("é 漢 é 漢 é 😀",), ("zz é",), ("",), (None,)], "t string")
    added, add = [], type(spark.sparkContext).addFile
    monkeypatch.setattr(type(spark.sparkContext), "addFile", lambda self, path, *a, **k: (added.append(path), add(self, path, *a, **k)))
    name = infer.publish_model(infer.train_next_words(texts, "t"))
    assert added and all(os.path.isfile(p.removeprefix("file:")) for p in added)
    df = spark.createDataFrame([(1, "zz"), (2, "a 😀"), (3, "\uffff"), (4, "")], "id long, t string")
    out = infer.batch_generate(df, infer.next_word_factory(name, 3), "t", ["id"]).collect()
    assert {r.id: r.generated_clean for r in out} == {1: "é 漢 é", 2: "", 3: "", 4: ""}


def test_empty_model(spark):
    name = infer.publish_model(infer.train_next_words(spark.createDataFrame([("one",)], "t string"), "t"))
    out = infer.batch_generate(spark.createDataFrame([(1, "one")], "id long, t string"), infer.next_word_factory(name), "t", ["id"])
    assert [r.generated for r in out.collect()] == ["<pad></s>"]


def test_triggers_take_a_file_per_core(spark):
    """Many small files are not as many micro-batches, and the drops' rows are computed once."""
    ship_package(spark)
    cores = spark.sparkContext.defaultParallelism
    src, out = f"{tempfile.mkdtemp(prefix='u3-in-')}/in", tempfile.mkdtemp(prefix="u3-out-")
    pairs = fx.pairs(spark, SF001)
    pairs.repartition(2 * cores).write.parquet(src)
    got = streams.streaming_eval(spark, src, PAIRS_SCHEMA, canonicalise=letters_canonical, out_dir=out).first()
    assert got == ev.eval_report(ev.prepare_pairs(pairs, letters_canonical)).first()
    assert streams.finished_epochs(spark, f"{out}/sums")[-1] + 1 <= 3


def test_drops_are_computed_once(spark):
    calls = spark.sparkContext.accumulator(0)
    df = spark.range(50).rdd.map(lambda r: (calls.add(1), (r.id,))[1]).toDF("k long")
    src = f"{tempfile.mkdtemp(prefix='once-')}/in"
    streams.write_stream_input(df, src, 4, "k")
    assert calls.value == 50 and sorted(r.k for r in spark.read.parquet(src).collect()) == list(range(50))
