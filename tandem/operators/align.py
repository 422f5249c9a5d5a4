"""Alignment statistics over paired embeddings and token scores (A1-A10).

* Pooling and standardisation aggregate whole vectors (``Summarizer``): the
  shuffle carries one vector per key and partition, and rows are spread into
  the long output ``(key, dim, value)`` only after the aggregate.
* VICReg needs D x D covariances. Each partition folds its rows into Gram
  partials with numpy (``mapInPandas``); partials are merged by
  ``Summarizer.sum`` (vector sums, partial aggregation), and the loss terms
  are finished with native array expressions. Data moved is D^2 per shard
  and partition, never per row, and no row set is gathered in one place.
* The CLIP loss needs every x of a batch against every y of the same batch.
  Batches of any size are cut into blocks; a (row block, column block) tile is
  one matrix product in one task, which leaves a partial log-sum-exp per row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.groups import group_starts, whole_groups
from tandem.functions.vectors import dot, logsumexp, norm

# --- Fixed values of the modelled losses ---
VICREG_WEIGHTS = (25.0, 25.0, 1.0)   # invariance, variance, covariance
VICREG_VAR_EPS = 1e-4                # inside the std's square root
POOL_MASK_FLOOR = 1e-9               # floor of the mask sum in masked pooling
BATCH_NORM_EPS = 1e-5
COSINE_EPS = 1e-8
IGNORE_INDEX = -100
LEAKY_SLOPE = 0.01
SEQ2SEQ_LAMBDA, ALIGNMENT_LAMBDA = 1.0, 0.5
# --- end of fixed values ---

ACTIVATIONS = ("relu", "gelu", "tanh", "sigmoid", "leaky_relu")


# --- A1 / A2 ----------------------------------------------------------------------

def masked_mean_pool(states: DataFrame, key: str = "seq_id", vec: str = "vec",
                     mask: str | None = "mask") -> DataFrame:
    """A1 (``mask`` given): sum(h * mask) / max(sum(mask), 1e-9) per key and
    dimension. A2 (``mask=None``): the plain mean. Long output (key, dim, value)."""
    w = F.coalesce(F.col(mask).cast("double"), F.lit(0.0)) if mask else F.lit(1.0)
    rows = states.where(F.col(vec).isNotNull()).select(F.col(key), w.alias("_w"), F.transform(
        vec, lambda v: F.coalesce(v * w, F.lit(0.0))).alias("_h"))
    agg = rows.groupBy(key).agg(vector_to_array(Summarizer.sum(array_to_vector("_h"))).alias("_s"), F.sum("_w").alias("_m"))
    denom = F.greatest(F.col("_m"), F.lit(POOL_MASK_FLOOR)) if mask else F.col("_m")
    return agg.select(key, denom.alias("_m"), F.posexplode("_s").alias("dim", "_v")).select(
        key, "dim", (F.col("_v") / F.col("_m")).alias("value"))


def mean_pool(states: DataFrame, key: str = "seq_id", vec: str = "vec") -> DataFrame:
    """A2: unmasked mean over positions (pad positions included)."""
    return masked_mean_pool(states, key, vec, mask=None)


# --- A3 ---------------------------------------------------------------------------

@dataclass
class ProjectorWeights:
    """Linear layers ``(W[in, out], b[out])`` and, for every layer but the
    last, batch-norm inference statistics."""
    linears: list[tuple[np.ndarray, np.ndarray]]
    norms: list[dict[str, np.ndarray]] = field(default_factory=list)

    def validate(self) -> None:
        if len(self.linears) < 1:
            raise ValueError("a projector needs a linear layer")
        if len(self.norms) != len(self.linears) - 1:
            raise ValueError("one batch-norm per hidden layer")


ERF_STEP, ERF_END, ERF_TERMS = 1 / 64, 6.0, 8


@cache
def _erf_table() -> np.ndarray:
    """Taylor coefficients of erf around each grid point: the k-th derivative is 2/sqrt(pi) exp(-x^2) times
    (-1)^(k-1) H_(k-1)(x), with the Hermite polynomials H by their recursion."""
    x = np.arange(0, ERF_END + ERF_STEP, ERF_STEP)
    rows = [np.array([math.erf(v) for v in x])]
    slope, h0, h1 = 2 / math.sqrt(math.pi) * np.exp(-x * x), np.zeros_like(x), np.ones_like(x)
    for k in range(1, ERF_TERMS):
        rows.append(slope * h1 * (-1) ** (k - 1) / math.factorial(k))
        h0, h1 = h1, 2 * x * h1 - 2 * (k - 1) * h0
    return np.stack(rows)


def erf(z: np.ndarray) -> np.ndarray:
    """The error function of whole arrays, to about 1e-15: a Taylor step from the nearest grid point."""
    table, size = _erf_table(), np.minimum(np.abs(z), ERF_END)
    at = np.rint(np.nan_to_num(size) / ERF_STEP).astype(np.int64)
    step = size - at * ERF_STEP
    out = table[-1][at]
    for row in table[-2::-1]:
        out = out * step + row[at]
    return np.copysign(out, z)


def _activate(z: np.ndarray, activation: str) -> np.ndarray:
    if activation == "relu":
        return np.maximum(z, 0.0)
    if activation == "gelu":
        return 0.5 * z * (1.0 + erf(z / math.sqrt(2.0)))
    if activation == "tanh":
        return np.tanh(z)
    if activation == "sigmoid":
        return 1.0 / (1.0 + np.exp(-z))
    if activation == "leaky_relu":
        return np.where(z >= 0, z, LEAKY_SLOPE * z)
    raise ValueError(f"no activation is called {activation!r}")


def project_matrix(x: np.ndarray, weights: ProjectorWeights, activation: str) -> np.ndarray:
    """Inference forward pass: (linear, batch norm, activation, dropout off)
    for each hidden layer, then the output linear."""
    h = x
    for k, (w, b) in enumerate(weights.linears):
        h = h @ w + b
        if k < len(weights.linears) - 1:
            bn = weights.norms[k]
            h = (h - bn["mean"]) / np.sqrt(bn["var"] + BATCH_NORM_EPS) * bn["gamma"] + bn["beta"]
            h = _activate(h, activation)
    return h


def project_embeddings(df: DataFrame, vec: str, weights: ProjectorWeights, activation: str = "gelu",
                       out: str = "proj") -> DataFrame:
    """A3: apply the projector per Arrow batch (numpy matmul); weights travel
    once per executor as a broadcast variable."""
    activation = activation.lower()
    if activation not in ACTIVATIONS:
        raise ValueError(f"no activation is called {activation!r}; there are {', '.join(ACTIVATIONS)}")
    weights.validate()
    bc = df.sparkSession.sparkContext.broadcast(weights)
    fields = list(df.schema.fields) + [T.StructField(out, T.ArrayType(T.DoubleType()))]
    names = [f.name for f in df.schema.fields]

    def run(batches):
        w = bc.value
        for pdf in batches:
            res = pdf[names].copy()
            if len(pdf):
                x = np.stack([np.asarray(v, dtype=np.float64) for v in pdf[vec]])
                y = project_matrix(x, w, activation)
                res[out] = list(y)
            else:
                res[out] = []
            yield res

    return df.mapInPandas(run, T.StructType(fields))


def closed_form_projector(dims: Sequence[int], bias: bool = True) -> ProjectorWeights:
    """Deterministic test weights: w[i][j] = ((7i + 3j) mod 11 - 5) / 10,
    b[j] = (j mod 3 - 1) / 10; batch norm mean j/100, var 1 + j/10, gamma 1, beta 0."""
    linears, norms = [], []
    for k in range(len(dims) - 1):
        i = np.arange(dims[k])[:, None]
        j = np.arange(dims[k + 1])[None, :]
        w = (((i * 7 + j * 3) % 11) - 5) / 10.0
        b = ((np.arange(dims[k + 1]) % 3) - 1) / 10.0 if bias else np.zeros(dims[k + 1])
        linears.append((w.astype(np.float64), b.astype(np.float64)))
        if k < len(dims) - 2:
            jj = np.arange(dims[k + 1], dtype=np.float64)
            norms.append({"mean": jj / 100.0, "var": 1.0 + jj / 10.0,
                          "gamma": np.ones_like(jj), "beta": np.zeros_like(jj)})
    return ProjectorWeights(linears, norms)


# --- A4 ---------------------------------------------------------------------------

def batch_standardise(df: DataFrame, key: str, vec: str) -> DataFrame:
    """A4: (x - mean) / sqrt(biased var + 1e-5) per dimension; long output.
    The statistics are one row of two vectors (the model width), which the plan reads as a scalar subquery."""
    rows = df.where(F.col(vec).isNotNull())
    moments = rows.agg(Summarizer.metrics("mean", "variance").summary(array_to_vector(vec)).alias("m"), F.count("*").alias("n"))
    biased = F.transform(vector_to_array("m.variance"), lambda v: v * (F.col("n") - 1) / F.col("n"))
    stats = moments.select(F.struct(vector_to_array("m.mean").alias("mu"), biased.alias("var")).alias("s"))
    one = rows.select(key, F.col(vec).alias("_x"), stats.scalar().alias("_s"))
    centred = F.zip_with("_x", "_s.mu", lambda x, mu: x - mu)
    value = F.zip_with(centred, "_s.var", lambda x, var: x / F.sqrt(var + BATCH_NORM_EPS))
    return one.select(key, F.posexplode(value).alias("dim", "value"))


# --- A5 / A10 ---------------------------------------------------------------------

def _shard_means(df: DataFrame, x: str, y: str, shard: str | None) -> dict:
    """Per-shard means of x and y and counts (one row per shard: bounded by
    the number of devices)."""
    keys = [F.col(shard)] if shard else [F.lit(0).alias("_s")]
    g = df.groupBy(*keys).agg(
        Summarizer.mean(array_to_vector(F.col(x))).alias("mx"),
        Summarizer.mean(array_to_vector(F.col(y))).alias("my"),
        F.count(F.lit(1)).alias("n"))
    rows = g.collect()
    return {r[0]: (np.asarray(r["mx"].toArray()), np.asarray(r["my"].toArray()), int(r["n"])) for r in rows}


def vicreg_partials(df: DataFrame, x: str = "x", y: str = "y", shard: str | None = None,
                    by_shard: bool = False, means: dict | None = None) -> tuple[DataFrame, dict[int, int]]:
    """Merged VICReg sufficient statistics.

    Rows ``(shard, kind, i, g)``: kind 'xg'/'yg' hold row i of sum (v - m)(v - m)^T
    centred on the global mean (shard -1 after merging), 'xs'/'ys' the same
    centred on the shard's own mean (only with ``by_shard``), 'n' holds
    [sum |x - y|^2] per shard. Centring on the exact mean makes the
    covariance simply G / (n - 1). Also returns the row count per shard."""
    means = means or _shard_means(df, x, y, shard)
    total = sum(n for _, _, n in means.values())
    gx = sum(mx * n for mx, _, n in means.values()) / total
    gy = sum(my * n for _, my, n in means.values()) / total
    local = {int(k): (mx, my) for k, (mx, my, _) in means.items()} if by_shard else {}
    bc = df.sparkSession.sparkContext.broadcast((gx, gy, local))
    shard_col = F.col(shard).cast("long") if shard else F.lit(0).cast("long")
    src = df.select(shard_col.alias("shard"), F.col(x).alias("x"), F.col(y).alias("y"))
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("kind", T.StringType()),
                           T.StructField("i", T.IntegerType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def fold(batches):
        mx, my, loc = bc.value
        acc: dict[int, dict] = {}
        for pdf in batches:
            if not len(pdf):
                continue
            for sh, part in pdf.groupby("shard", sort=False):
                xs = np.stack([np.asarray(v, dtype=np.float64) for v in part["x"]])
                ys = np.stack([np.asarray(v, dtype=np.float64) for v in part["y"]])
                a = acc.setdefault(int(sh), {"sq": 0.0})
                a["sq"] += float(((xs - ys) ** 2).sum())
                centred = [("xg", xs - mx), ("yg", ys - my)]
                if loc:
                    lx, ly = loc[int(sh)]
                    centred += [("xs", xs - lx), ("ys", ys - ly)]
                for kind, c in centred:
                    a[kind] = a.get(kind, 0) + c.T @ c
        for sh, a in acc.items():
            rows = [(sh, "n", -1, [a["sq"]])]
            for kind, gram in a.items():
                if kind != "sq":
                    rows += [(sh, kind, i, gram[i].tolist()) for i in range(gram.shape[0])]
            yield pd.DataFrame(rows, columns=["shard", "kind", "i", "g"])

    parts = src.mapInPandas(fold, schema)
    merged = parts.groupBy("shard", "kind", "i").agg(
        vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
    if by_shard:
        # Small (kinds x D rows of D values per shard) and read by both the
        # global and the per-shard finish: write it once to the shared folder.
        merged = merged.checkpoint(eager=True)
    counts = {int(k): n for k, (_, _, n) in means.items()}
    return merged, counts


VICREG_ROW = "shard long, n_rows long, sim double, std double, cov double, vicreg double"


def vicreg(df: DataFrame, x: str = "x", y: str = "y", shard: str | None = None,
           by_shard: bool = False, digits: int | None = 6) -> DataFrame:
    """A5: VICReg = 25 sim + 25 std + 1 cov with statistics over all rows.
    A10 (``by_shard``): also one row per shard with device-local statistics;
    the global row has shard NULL. Same partial sums, no join: each result
    row is one aggregate over the merged Gram rows. No rows give none; with a
    single row the covariance terms, and the loss, are NULL."""
    counted = _shard_means(df, x, y, shard)
    if not counted:
        return df.sparkSession.createDataFrame([], VICREG_ROW)
    merged, counts = vicreg_partials(df, x, y, shard, by_shard, counted)
    total = sum(counts.values())
    glob = (merged.where(F.col("kind").isin("xg", "yg", "n"))
            .groupBy("kind", "i").agg(vector_to_array(Summarizer.sum(array_to_vector("g"))).alias("g"))
            .withColumn("shard", F.lit(None).cast("long")))
    out = _vicreg_rows(glob, {None: total}, ("xg", "yg"), digits)
    if by_shard:
        local = merged.where(F.col("kind").isin("xs", "ys", "n"))
        out = out.unionByName(_vicreg_rows(local, counts, ("xs", "ys"), digits))
    return out


def _vicreg_rows(merged: DataFrame, counts: dict, kinds: tuple[str, str], digits: int | None) -> DataFrame:
    """Loss per shard value from Gram rows centred on the matching mean. Row
    counts are known from the mean pass (a handful of shards) and enter as
    literals."""
    lam, mu, nu = VICREG_WEIGHTS
    n_expr = F.lit(None).cast("double")
    for k, n in counts.items():
        cond = F.col("shard").isNull() if k is None else (F.col("shard") == k)
        n_expr = F.when(cond, F.lit(float(n))).otherwise(n_expr)
    m = merged.withColumn("_n", n_expr)
    is_vec = F.col("kind").isin(*kinds)
    cov_row = F.transform("g", lambda v: v / F.nullif(F.col("_n") - 1, F.lit(0.0)))
    cov_ii = F.element_at(cov_row, F.col("i") + 1)
    off = F.aggregate(cov_row, F.lit(0.0), lambda acc, v: acc + v * v) - cov_ii * cov_ii
    stdterm = F.greatest(F.lit(0.0), 1 - F.sqrt(cov_ii + VICREG_VAR_EPS))
    per = m.groupBy("shard").agg(
        F.first("_n").alias("n"),
        F.sum(F.when(is_vec, off)).alias("off"),
        F.sum(F.when(is_vec, stdterm)).alias("std_sum"),
        F.max(F.when(is_vec, F.size("g"))).alias("d"),
        F.sum(F.when(F.col("kind") == "n", F.col("g")[0])).alias("sq"))
    sim = F.col("sq") / (F.col("n") * F.col("d"))
    std = F.col("std_sum") / F.col("d")
    cov = F.col("off") / F.col("d")

    def rnd(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c
    return per.select("shard", F.col("n").cast("long").alias("n_rows"), rnd(sim).alias("sim"),
                      rnd(std).alias("std"), rnd(cov).alias("cov"), rnd(lam * sim + mu * std + nu * cov).alias("vicreg"))


# --- A6 / A7 / A8 / A9 --------------------------------------------------------------

CLIP_TILE_ROWS, CLIP_STEP_ROWS = 4096, 512


def _clip_tile(x: np.ndarray, y: np.ndarray, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Per row of x the greatest logit against the rows of y, and the sum of exponentials shifted by it."""
    top, total = np.empty(len(x)), np.empty(len(x))
    for lo in range(0, len(x), CLIP_STEP_ROWS):
        logits = x[lo:lo + CLIP_STEP_ROWS] @ y.T * scale
        top[lo:lo + CLIP_STEP_ROWS] = logits.max(axis=1)
        total[lo:lo + CLIP_STEP_ROWS] = np.exp(logits - top[lo:lo + CLIP_STEP_ROWS, None]).sum(axis=1)
    return top, total


def clip_loss(df: DataFrame, batch: str = "batch_id", key: str = "id", x: str = "x", y: str = "y",
              logit_scale: float = 1.0, tile_rows: int = CLIP_TILE_ROWS) -> DataFrame:
    """Per batch, mean over rows of cross entropy of (x_i . y_j) * scale
    against the row's own index (one direction, inputs not normalised). ``key`` is unique within a batch.

    A batch of n rows is cut into g = ceil(n / tile_rows) blocks; x goes to the g tiles of its row block and y to those
    of its column block. A task multiplies a tile a few rows at a time, and emits one (maximum, sum) per row; these
    merge per row by the shifted sums (g small rows). Memory is that of a tile, whatever the batch."""
    sizes = df.groupBy(batch).agg(F.ceil(F.count("*") / tile_rows).cast("int").alias("_g")).withColumnRenamed(batch, "_b")
    own = dot(F.col(x), F.col(y)) * F.lit(float(logit_scale))
    rows = df.select(F.col(batch).alias("_batch"), F.col(key).alias("_key"), F.col(x).alias("_x"), F.col(y).alias("_y"), own.alias("_own"))
    rows = rows.join(sizes, F.col("_batch").eqNullSafe(F.col("_b"))).withColumn("_block", F.pmod(F.xxhash64("_key"), "_g").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_g") - 1))
    left = rows.withColumn("_o", other).select("_batch", "_key", F.col("_x").alias("_v"), "_own", F.lit(0).alias("_side"),
                                               F.col("_block").alias("_i"), F.col("_o").alias("_j"))
    right = rows.withColumn("_o", other).select("_batch", "_key", F.col("_y").alias("_v"), F.lit(None).cast("double").alias("_own"),
                                                F.lit(1).alias("_side"), F.col("_o").alias("_i"), F.col("_block").alias("_j"))
    tile = [F.col("_batch"), F.col("_i"), F.col("_j")]
    both = left.unionByName(right).select("_batch", "_key", "_v", "_own", "_side", F.xxhash64(*tile).alias("_t1"),
                                          F.xxhash64(F.lit(1), *tile).alias("_t2"))
    fields = [T.StructField(c, both.schema[c].dataType) for c in ("_batch", "_key", "_own")]
    schema = T.StructType([*fields, T.StructField("_m", T.DoubleType()), T.StructField("_s", T.DoubleType())])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["_t1", "_t2"]):
            side, vec = t.column("_side").to_numpy(), t.column("_v").combine_chunks()
            values = vec.flatten().to_numpy().reshape(len(vec), -1)
            starts = group_starts(t, ["_t1", "_t2"])
            ends, top, total = np.append(starts[1:], len(vec)), np.zeros(len(vec)), np.zeros(len(vec))
            for lo, hi in zip(starts.tolist(), ends.tolist(), strict=True):
                cut = lo + int(np.searchsorted(side[lo:hi], 1))
                if lo < cut < hi:
                    top[lo:cut], total[lo:cut] = _clip_tile(values[lo:cut], values[cut:hi], logit_scale)
            keep = pa.array(side == 0)
            out = t.select(["_batch", "_key", "_own"]).append_column("_m", pa.array(top)).append_column("_s", pa.array(total))
            yield from out.filter(keep).to_batches()

    parts = both.repartition("_t1", "_t2").sortWithinPartitions("_t1", "_t2", "_side").mapInArrow(multiply, schema)
    merged = parts.where("_s > 0").groupBy("_batch", "_key").agg(
        F.max("_own").alias("_own"), F.max("_m").alias("_top"), F.collect_list(F.struct("_m", "_s")).alias("_parts"))
    total = F.aggregate("_parts", F.lit(0.0), lambda acc, p: acc + p["_s"] * F.exp(p["_m"] - F.col("_top")))
    per_row = merged.select("_batch", (F.col("_top") + F.log(total) - F.col("_own")).alias("_ce"))
    return per_row.groupBy(F.col("_batch").alias(batch)).agg(F.count(F.lit(1)).alias("n_rows"), F.round(F.avg("_ce"), 6).alias("clip_loss"))


def neg_cosine(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Minus the mean cosine similarity, denominator floored at 1e-8."""
    cos = dot(F.col(x), F.col(y)) / F.greatest(norm(F.col(x)) * norm(F.col(y)), F.lit(COSINE_EPS))
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.round(-F.avg(cos), 6).alias("neg_cosine"))


def token_ce_rows(df: DataFrame, logits: str = "logits", label: str = "label") -> DataFrame:
    kept = df.where(F.col(label) != IGNORE_INDEX)
    ce = logsumexp(F.col(logits)) - F.element_at(F.col(logits), F.col(label) + 1)
    return kept.select(ce.alias("_ce"))


def token_cross_entropy(df: DataFrame, logits: str = "logits", label: str = "label",
                        digits: int | None = 6) -> DataFrame:
    """Mean over rows whose label is not -100 of logsumexp(logits) -
    logits[label]; NaN when every row is ignored."""
    rows = token_ce_rows(df, logits, label)
    ce = F.coalesce(F.avg("_ce"), F.lit(float("nan")))
    return rows.agg(F.count(F.lit(1)).alias("n_rows"),
                    (F.round(ce, digits) if digits is not None else ce).alias("cross_entropy"))


def total_loss(ce: DataFrame, vic: DataFrame, method: str = "aligner",
               seq2seq_lambda: float = SEQ2SEQ_LAMBDA, alignment_lambda: float = ALIGNMENT_LAMBDA,
               digits: int | None = 6) -> DataFrame:
    """seq2seq_lambda * CE + alignment_lambda * VICReg; the base method is CE only.
    Both inputs are one-row frames; they are combined by a union and one
    aggregate (no join)."""
    parts = ce.select(F.col("cross_entropy").alias("ce"), F.lit(None).cast("double").alias("vic")).unionByName(
        vic.select(F.lit(None).cast("double").alias("ce"), F.col("vicreg").alias("vic")))
    one = parts.agg(F.max("ce").alias("cross_entropy"), F.max("vic").alias("vicreg"))
    align = F.lit(float(alignment_lambda)) * F.col("vicreg") if method == "aligner" else F.lit(0.0)
    total = F.lit(float(seq2seq_lambda)) * F.col("cross_entropy") + align

    def rnd(c: Column) -> Column:
        return F.round(c, digits) if digits is not None else c
    return one.select(rnd(F.col("cross_entropy")).alias("cross_entropy"), rnd(F.col("vicreg")).alias("vicreg"),
                      rnd(total).alias("total_loss"))
