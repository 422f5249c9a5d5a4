"""Distributed positions: equal to row_number, independent of partitioning,
hot groups split over many buckets."""
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tandem.operators import ordering


@pytest.fixture
def many_buckets(spark):
    """Keep all range partitions: the same path as ever, but small inputs are not coalesced."""
    keys = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    yield 24
    for k, v in old.items():
        spark.conf.set(k, v)


def _buckets(df, keys, **kw):
    got = ordering.sequence_index(df, keys, name="pos", keep_bucket="b", **kw)
    sizes = [r["count"] for r in got.groupBy("b").count().collect()]
    return got, sizes


def _rows(spark):
    # one hot group holding most rows, plus many small groups; ties on ts broken by id
    data = [(0 if i % 3 else i % 17, (i * 7919) % 1000, i) for i in range(3000)]
    return spark.createDataFrame(data, "grp long, ts long, id long")


@pytest.mark.parametrize("parts", [1, 7])
def test_grouped_index_equals_row_number(spark, many_buckets, parts):
    df = _rows(spark).repartition(parts)
    got = ordering.sequence_index(df, ["ts", "id"], partition_by=["grp"], name="pos", start=1)
    ref = df.withColumn("pos", F.row_number().over(Window.partitionBy("grp").orderBy("ts", "id")))
    assert got.exceptAll(ref).count() == 0 and ref.exceptAll(got).count() == 0


def test_global_index_descending_string(spark, many_buckets):
    df = spark.createDataFrame([(f"t{i % 37}", i % 11, i) for i in range(800)], "tok string, n long, id long")
    got = ordering.sequence_index(df, [("n", False), ("tok", True), ("id", True)], name="pos")
    ref = df.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("n"), "tok", "id")) - 1)
    assert got.exceptAll(ref).count() == 0 and got.count() == 800


def test_hot_group_uses_many_buckets(spark, many_buckets):
    _, sizes = _buckets(_rows(spark).where("grp = 0"), ["ts", "id"], partition_by=["grp"])
    assert len(sizes) > 10 and max(sizes) < 4 * sum(sizes) / many_buckets


@pytest.mark.parametrize("of", [
    lambda i: f"runs/project_aligner_seed1/{i:06d}.ckpt",  # a long common prefix
    lambda i: f"{i:020d}",  # padded ids
    lambda i: "same",  # the unique last key splits ties
])
def test_common_prefixes_and_ties_spread(spark, many_buckets, of):
    df = spark.createDataFrame([(of(i), i) for i in range(3000)], "k string, id long").repartition(5)
    got, sizes = _buckets(df, ["k", "id"])
    assert len(sizes) > 10 and max(sizes) < 4 * sum(sizes) / many_buckets
    assert got.where("pos <> id").count() == 0


def test_missing_keys_and_groups_stand_where_a_sort_puts_them(spark, many_buckets):
    nan = float("nan")
    rows = [(g, v, i) for i, (g, v) in enumerate([(g, v) for g in (1, None, 2) for v in (nan, 2.0, None, -1.0, nan)] * 20)]
    df = spark.createDataFrame(rows, "g long, v double, id long").repartition(4)
    for asc in (True, False):
        order = [F.col("v").asc() if asc else F.col("v").desc(), F.col("id")]
        ref = {r.id: r.n for r in df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy(*order))).collect()}
        got = ordering.sequence_index(df, [("v", asc), "id"], partition_by=["g"], name="n", start=1).collect()
        assert {r.id: r.n for r in got} == ref and len(got) == len(rows)


def test_positions_move_no_rows_to_one_partition(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 7)
    plan = ordering.sequence_index(df, ["k", "id"])._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("SinglePartition"):] if "SinglePartition" in plan else ""
    assert "_bucket" in below or not below  # only the table of counts is summed in one task
    assert ordering.sequence_index(df.where("id < 0"), ["k", "id"]).count() == 0


def test_long_ids_keep_their_order_key(spark):
    ids = ["x" * 25 + str(i) for i in range(5)] + ["7"]
    df = spark.createDataFrame([(i, "test") for i in ids], "id string, split string")
    keys = [r.order_key for r in ordering.epoch_order(df, "id").collect()]
    assert keys == [*ids[:5], "0" * 19 + "7"]


def test_batches_and_shards(spark):
    df = spark.createDataFrame([(i, f"k{(i * 37) % 101:03d}") for i in range(101)], "id long, key string")
    b = ordering.make_batches(df, ["key", "id"], batch_size=8, grad_accum=4)
    rows = {r.id: r for r in b.collect()}
    assert max(r.batch_id for r in rows.values()) == 12  # 101 rows -> 13 batches, the last one short
    assert {r.opt_step for r in rows.values()} == {0, 1, 2, 3}
    sh = ordering.shard_rows(b.select("id", "pos"), world=4, total=101).collect()
    assert len(sh) == 104  # padded by wrapping to a multiple of 4
    per_rank = {}
    for r in sh:
        per_rank.setdefault(r.rank, []).append(r.pos)
    assert all(len(v) == 26 for v in per_rank.values())
    assert sorted(r.pos for r in sh if r.pos >= 101) == [101, 102, 103]
    co = ordering.shard_rows(b.select("id", "pos"), world=4, total=101, colocate=True)
    parts = co.rdd.glom().map(lambda rows: sorted({r.rank for r in rows})).collect()
    assert sorted(p[0] for p in parts if p) == [0, 1, 2, 3] and all(len(p) <= 1 for p in parts)


def test_seed_replicas_are_reproducible(spark):
    df = spark.createDataFrame([(i,) for i in range(50)], "id long")
    reps = ordering.seed_replicas(df, [0, 1])
    keyed = reps.withColumn("k", ordering.shuffle_key(F.col("seed"), 0, "id"))
    a = ordering.make_batches(keyed, ["k", "id"], 8, partition_by=["seed"]).select("seed", "id", "pos")
    b = ordering.make_batches(keyed.repartition(5), ["k", "id"], 8, partition_by=["seed"]).select("seed", "id", "pos")
    assert a.exceptAll(b).count() == 0 and a.count() == 100
    orders = {s: [r.id for r in a.where(F.col("seed") == s).orderBy("pos").collect()] for s in (0, 1)}
    assert orders[0] != orders[1] and sorted(orders[0]) == list(range(50))


def test_ensure_parallelism_only_spreads_narrow_inputs(spark):
    one = spark.range(100).coalesce(1)
    assert ordering.ensure_parallelism(one).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(100).repartition(spark.sparkContext.defaultParallelism + 3)
    assert ordering.ensure_parallelism(wide) is wide
