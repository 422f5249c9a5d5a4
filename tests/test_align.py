"""Alignment statistics against numpy."""
import numpy as np
import pytest

from tandem.operators import align


def _vec_df(spark, n=64, d=6, seed=0, shards=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(2.0, 1.0, (n, d))  # non-zero mean: covariance must be centred
    y = x * 0.5 + rng.normal(0, 0.3, (n, d))
    rows = [(i, i % shards, i // 8, x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "id long, shard long, batch_id long, x array<double>, y array<double>"), x, y


def _np_vicreg(x, y):
    b, d = x.shape
    sim = ((x - y) ** 2).mean()
    std = np.maximum(0, 1 - np.sqrt(x.var(0, ddof=1) + 1e-4)).mean() + np.maximum(
        0, 1 - np.sqrt(y.var(0, ddof=1) + 1e-4)).mean()
    cx = np.cov(x, rowvar=False)
    cy = np.cov(y, rowvar=False)
    cov = ((cx ** 2).sum() - (np.diag(cx) ** 2).sum() + (cy ** 2).sum() - (np.diag(cy) ** 2).sum()) / d
    return sim, std, cov, 25 * sim + 25 * std + cov


def test_vicreg_global_and_per_shard(spark):
    df, x, y = _vec_df(spark)
    rows = {r.shard: r for r in align.vicreg(df.repartition(5), shard="shard", by_shard=True).collect()}
    for key, sel in [(None, slice(None))] + [(s, np.arange(len(x)) % 3 == s) for s in range(3)]:
        sim, std, cov, v = _np_vicreg(x[sel], y[sel])
        r = rows[key]
        assert (r.sim, r.std, r.cov, r.vicreg) == pytest.approx((sim, std, cov, v), abs=2e-6)


def test_clip_loss(spark):
    df, x, y = _vec_df(spark, n=20, d=4)
    got = {r.batch_id: r.clip_loss for r in align.clip_loss(df, logit_scale=2.0).collect()}
    for b in range(3):
        xs, ys = x[b * 8:(b + 1) * 8], y[b * 8:(b + 1) * 8]
        lg = xs @ ys.T * 2.0
        ce = (np.log(np.exp(lg - lg.max(1, keepdims=True)).sum(1)) + lg.max(1) - np.diag(lg)).mean()
        assert got[b] == pytest.approx(ce, abs=1e-6)


@pytest.mark.parametrize("act", ["relu", "gelu", "tanh", "sigmoid", "leaky_relu"])
def test_projector_matches_numpy(spark, act):
    import math
    df, x, _ = _vec_df(spark, n=10, d=6)
    w = align.closed_form_projector((6, 5, 5, 3))
    got = {r.id: r.proj for r in align.project_embeddings(df, "x", w, activation=act).collect()}
    fns = {"relu": lambda z: np.maximum(z, 0), "tanh": np.tanh, "sigmoid": lambda z: 1 / (1 + np.exp(-z)),
           "leaky_relu": lambda z: np.where(z >= 0, z, 0.01 * z),
           "gelu": np.vectorize(lambda z: 0.5 * z * (1 + math.erf(z / math.sqrt(2))))}
    h = x
    for k, (wk, bk) in enumerate(w.linears):
        h = h @ wk + bk
        if k < len(w.linears) - 1:
            bn = w.norms[k]
            h = fns[act]((h - bn["mean"]) / np.sqrt(bn["var"] + 1e-5))
    for i in range(10):
        assert got[i] == pytest.approx(h[i].tolist(), abs=1e-9)


def test_projector_rejects_bad_config(spark):
    df, _, _ = _vec_df(spark, n=4, d=3)
    with pytest.raises(ValueError):
        align.project_embeddings(df, "x", align.closed_form_projector((3, 2)), activation="swish")
    with pytest.raises(ValueError):
        align.project_embeddings(df, "x", align.ProjectorWeights([]), activation="relu")


def test_pooling(spark):
    rows = [(1, 0, 1, [1.0, 2.0]), (1, 1, 0, [5.0, 5.0]), (1, 2, 1, [3.0, 4.0]), (2, 0, 0, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "seq_id long, pos long, mask int, vec array<double>")
    masked = {(r.seq_id, r.dim): r.value for r in align.masked_mean_pool(df).collect()}
    assert masked == {(1, 0): 2.0, (1, 1): 3.0, (2, 0): 0.0, (2, 1): 0.0}  # all-masked -> 0 / 1e-9 floor
    plain = {(r.seq_id, r.dim): r.value for r in align.mean_pool(df).collect()}
    assert plain[(1, 0)] == 3.0 and plain[(2, 1)] == 9.0


def test_token_ce_all_ignored_is_nan(spark):
    df = spark.createDataFrame([([0.0, 1.0], -100)], "logits array<double>, label int")
    import math
    assert math.isnan(align.token_cross_entropy(df).first().cross_entropy)
    df2 = spark.createDataFrame([([0.0, 1.0], 1), ([2.0, 0.0], 0), ([5.0, 5.0], -100)], "logits array<double>, label int")
    ce = np.mean([np.log(np.exp(0) + np.exp(1)) - 1, np.log(np.exp(2) + 1) - 2])
    assert align.token_cross_entropy(df2).first().cross_entropy == round(ce, 6)


def test_total_loss_methods(spark):
    ce = spark.createDataFrame([(2.0,)], "cross_entropy double")
    vic = spark.createDataFrame([(10.0,)], "vicreg double")
    assert align.total_loss(ce, vic).first().total_loss == 7.0
    assert align.total_loss(ce, vic, method="base").first().total_loss == 2.0


@pytest.mark.parametrize("tile_rows", [4096, 3, 1])
def test_clip_of_tiles(spark, tile_rows):
    rng = np.random.default_rng(3)
    sizes = {0: 1, 1: 40, 2: 7, None: 5}
    rows, want, at = [], {}, 0
    for b, n in sizes.items():
        x, y = rng.normal(size=(n, 5)), rng.normal(size=(n, 5)) * 30  # far from each other: sums must be shifted
        rows += [(at + i, b, x[i].tolist(), y[i].tolist()) for i in range(n)]
        at += n
        lg = x @ y.T * 1.5
        want[b] = (n, (np.log(np.exp(lg - lg.max(1, keepdims=True)).sum(1)) + lg.max(1) - np.diag(lg)).mean())
    df = spark.createDataFrame(rows, "id long, batch_id long, x array<double>, y array<double>").repartition(5)
    got = {r.batch_id: (r.n_rows, r.clip_loss) for r in align.clip_loss(df, logit_scale=1.5, tile_rows=tile_rows).collect()}
    assert got.keys() == want.keys()
    for b, (n, loss) in want.items():
        assert got[b][0] == n and got[b][1] == pytest.approx(loss, abs=1e-6)


def test_large_clip_batch_in_tiles(spark):
    """One batch of many rows of model width: no task sees more than a tile."""
    from pyspark.sql import functions as F

    df = spark.range(6000).select("id", F.lit(0).alias("batch_id"), F.transform(
        F.sequence(F.lit(1), F.lit(64)), lambda k: F.sin(F.col("id") * k * 0.001)).alias("x")).withColumn("y", F.col("x"))
    x = np.sin(np.arange(6000)[:, None] * np.arange(1, 65) * 0.001)
    lg = x @ x.T
    want = (np.log(np.exp(lg - lg.max(1, keepdims=True)).sum(1)) + lg.max(1) - np.diag(lg)).mean()
    r = align.clip_loss(df, tile_rows=1000).first()
    assert r.n_rows == 6000 and r.clip_loss == pytest.approx(want, abs=2e-6)


def test_erf_of_arrays():
    import math

    z = np.concatenate([np.linspace(-9, 9, 40001), [0.0, -0.0, 1e-300, np.inf, -np.inf, 1 / 128, -3 / 128]])
    assert np.abs(align.erf(z) - np.array([math.erf(v) for v in z])).max() < 2e-15
    assert np.isnan(align.erf(np.array([np.nan]))).all()


def test_wide_vectors_are_aggregated_whole(spark):
    """Model width, a key with a third of all rows, null and all-masked rows; nothing is exploded before the aggregate."""
    rng = np.random.default_rng(4)
    v = rng.normal(3.0, 1.0, (90, 768))
    keys, mask = [0 if i % 3 == 0 else i % 7 for i in range(90)], [i % 4 != 1 and i % 7 != 5 for i in range(90)]
    rows = [(keys[i], int(mask[i]), v[i].tolist()) for i in range(90)] + [(0, 1, None), (9, 0, v[0].tolist())]
    df = spark.createDataFrame(rows, "seq_id long, mask int, vec array<double>").repartition(4)
    got = {}
    for r in align.masked_mean_pool(df).collect():
        got.setdefault(r.seq_id, {})[r.dim] = r.value
    for k in set(keys):
        at = [i for i in range(90) if keys[i] == k]
        w = np.array([mask[i] for i in at], dtype=float)
        want = (v[at] * w[:, None]).sum(0) / max(w.sum(), 1e-9)
        assert [got[k][d] for d in range(768)] == pytest.approx(want.tolist(), abs=1e-9)
    assert set(got[9].values()) == {0.0}
    std = {}
    for r in align.batch_standardise(df.where("seq_id <> 9"), "seq_id", "vec").collect():
        std.setdefault(r.dim, []).append(r.value)
    assert len(std) == 768 and all(abs(np.mean(x)) < 1e-9 and abs(np.var(x) - 1) < 1e-3 for x in std.values())
    plan = align.masked_mean_pool(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate")  # the plan is printed from its end
