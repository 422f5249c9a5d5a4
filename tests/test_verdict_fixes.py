"""Cases that gave wrong answers once."""
import pytest
from pyspark.sql import functions as F

from tandem.functions.text import strip_space
from tandem.operators import align, infer, ordering, telemetry
from tandem.plans.pipelines import evaluate_predictions


def test_two_factories_of_one_function_are_two_models(spark):
    def make(mark):
        return lambda: (lambda batch: [mark + t for t in batch])

    df = spark.createDataFrame([("x",)], "t string").coalesce(1)
    got = [infer.batch_generate(df, make(m), "t", ["t"], clean=False).first()["generated"] for m in "AB"]
    assert got == ["Ax", "Bx"]


@pytest.mark.parametrize(("total", "world"), [(1, 4), (3, 8), (5, 4), (8, 4), (0, 3)])
def test_every_rank_gets_rows(spark, total, world):
    rows = spark.range(total).select(F.col("id").alias("pos"), F.col("id").alias("item"))
    got = sorted((r["rank"], r["rank_index"], r["item"]) for r in ordering.shard_rows(rows, world, total).collect())
    size = -(-total // world) * world
    assert got == sorted((i % world, i // world, i % total) for i in range(size))


def test_one_cycle_of_ten_steps(spark):
    log = spark.createDataFrame([("r", s) for s in range(1, 11)], "run string, step long")
    rows = telemetry.lr_schedule(log).where("param_group = 'language_proj'").orderBy("step").collect()
    assert rows[0]["lr"] == pytest.approx(5e-4) and rows[-1]["lr"] == pytest.approx(5e-4 / 25 / 1e4)


def test_vicreg_of_no_rows_and_of_one_row_shards(spark):
    schema = "shard long, x array<double>, y array<double>"
    assert align.vicreg(spark.createDataFrame([], schema)).count() == 0
    df = spark.createDataFrame([(0, [1.0, 2.0], [1.0, 3.0]), (1, [2.0, 1.0], [0.0, 1.0]), (1, [3.0, 5.0], [2.0, 2.0])], schema)
    rows = {r["shard"]: r for r in align.vicreg(df, shard="shard", by_shard=True).collect()}
    assert rows[0]["vicreg"] is None and rows[0]["n_rows"] == 1 and rows[1]["vicreg"] is not None


def test_strip_takes_separators(spark):
    df = spark.createDataFrame([("\x1c ab\x1f",)], "t string")
    assert df.select(strip_space("t").alias("t")).first()["t"] == "ab"


def test_references_without_prediction_count(spark):
    refs = spark.createDataFrame([(i, "c", "ab") for i in range(4)], "item long, caption string, gt_raw string")
    preds = spark.createDataFrame([(0, "ab")], "item long, pred_raw string")
    res = evaluate_predictions(preds, refs, key="item")
    row = res.report.first()
    assert row["n_total"] == 4 and row["validity"] == pytest.approx(0.25)
    assert "item" in res.prepared.columns
    with pytest.raises(ValueError):
        evaluate_predictions(preds.union(preds), refs, key="item")


def test_lookup_with_hot_and_missing_strings(spark):
    """One read of the table for all columns; hot strings are salted; equal rows, NULLs and repeated keys."""
    from tandem.operators import codec

    rows = [(i, "" if i % 3 else f"s{i % 20}", None if i % 5 == 0 else "" if i % 2 else "s1") for i in range(400)] * 2
    df = spark.createDataFrame(rows, "id int, a string, b string")
    book = spark.createDataFrame([("", "E"), ("s1", "z"), ("s1", "x"), ("s3", None), (None, "n"), ("s6", "y"), ("s6", None)],
                                 "raw string, val string")
    known = {"": "E", "s1": "x", "s6": "y"}
    want = sorted(((i, a, b, known.get(a), known.get(b)) for i, a, b in rows), key=str)
    for hot_rows in (100_000, 7):
        out = codec.lookup(df, book, {"a": "va", "b": "vb"}, "raw", "val", hot_rows)
        assert out.columns == ["id", "a", "b", "va", "vb"]
        assert sorted(map(tuple, out.collect()), key=str) == want
    # salted: the empty string's rows go to many partitions
    asked = codec.lookup(df.where("a = ''"), book, {"a": "va"}, "raw", "val", 7)._jdf.queryExecution().executedPlan().toString()
    assert "salt" in asked
    plan = codec.lookup(df, spark.read.parquet(_table(spark, book)), {"a": "va", "b": "vb"}, "raw", "val")
    assert plan._jdf.queryExecution().optimizedPlan().collectLeaves().toString().count("raw#") == 1


def _table(spark, df):
    from tandem.session import scratch_path

    path = scratch_path(spark, "book")
    df.write.parquet(path)
    return path
