"""Run telemetry as tables (O1-O7) and the checkpoint catalog.

A metric log is ``(run, step, metric, value)``. Per-run windows are the
natural form, but one run may hold a large share of all rows, so nothing here
sorts a whole run in one task:

* top-k uses ``row_number() <= k``, which Spark plans as a per-partition
  group limit before the shuffle;
* running minima use a blocked prefix scan: windows only over blocks of
  ``block`` consecutive steps and over one summary row per block;
* per-run totals are small grouped aggregates joined back.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.operators.ordering import sequence_index
from tandem.session import stored

# --- Fixed values of the modelled training run ---
TOP_K = 3                      # checkpoints kept
PATIENCE = 5                   # early-stopping patience (validation checks)
MAX_LRS = (("backbone", 1e-4), ("language_proj", 5e-4), ("molecule_proj", 5e-4))
MAX_LRS_BASE = (("backbone", 3e-5),)   # the method without projectors
PCT_START = 0.1                # share of steps spent warming up
DIV_FACTOR = 25.0              # initial lr = max lr / 25
FINAL_DIV_FACTOR = 1e4         # final lr = initial lr / 1e4
CLIP_MAX_NORM = 1.0
CLIP_EPS = 1e-6
# --- end of fixed values ---

SCAN_BLOCK = 1 << 16


# --- blocked prefix scan -------------------------------------------------------

def prefix_scan(df: DataFrame, groups: Sequence[str], pos: str, value: str, how: str, out: str,
                inclusive: bool, block: int = SCAN_BLOCK, block_col: str | None = None) -> DataFrame:
    """Running ``min``/``max`` of ``value`` (any orderable type, structs too)
    over rows ordered by the dense position ``pos`` within ``groups``,
    exclusive or inclusive of the row.

    Windows run over (group, block) - bounded - and over one summary row per
    block, so a hot group is spread over many tasks. ``block_col`` reuses an
    existing block column whose blocks are consecutive position ranges (e.g.
    the bucket kept by ``sequence_index``); otherwise blocks are ``floor(pos / block)``."""
    agg = {"min": F.min, "max": F.max}[how]
    g = list(groups)
    end = 0 if inclusive else -1
    blk = block_col or "_blk"
    b = df if block_col else df.withColumn("_blk", F.floor(F.col(pos) / block))
    summary = b.groupBy(*g, blk).agg(agg(value).alias("_bv"))
    before_blocks = Window.partitionBy(*g).orderBy(blk).rowsBetween(Window.unboundedPreceding, -1)
    carry = summary.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate([*g, blk])], agg("_bv").over(before_blocks).alias("_carry"))
    in_block = Window.partitionBy(*g, blk).orderBy(pos).rowsBetween(Window.unboundedPreceding, end)
    scanned = b.withColumn("_local", agg(value).over(in_block))
    same = F.lit(True)
    for i, c in enumerate([*g, blk]):  # a NULL group is a group
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    j = scanned.join(carry, same, "left").drop(*[f"_g{i}" for i in range(len(g) + 1)])
    # least/greatest skip NULLs, as the running aggregate does
    comb = {"min": F.least, "max": F.greatest}[how]
    j = j.withColumn(out, comb(F.col("_local"), F.col("_carry"))).drop("_local", "_carry")
    return j if block_col else j.drop("_blk")


# --- O1 -------------------------------------------------------------------------------

def topk_checkpoints(log: DataFrame, k: int = TOP_K, groups: Sequence[str] = ("run", "metric"),
                     value: str = "value", step: str = "step") -> DataFrame:
    """O1: the k smallest values per group (ties by earlier step), with rank."""
    w = Window.partitionBy(*groups).orderBy(F.col(value).asc(), F.col(step).asc())
    return log.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


# --- O2 -------------------------------------------------------------------------------

def early_stop(log: DataFrame, patience: int = PATIENCE, groups: Sequence[str] = ("run", "metric"),
               value: str = "value", step: str = "step") -> DataFrame:
    """O2: mode 'min', min_delta 0. A check improves when its value is
    strictly below every earlier value of the group (the first check always
    improves); training stops at the first check where ``patience`` checks in
    a row have not improved, or whose value is not finite. Rows of one step are
    one check with their least value; NULL counts as NaN, and NaN as the largest.
    One row per group: stop_step (NULL = never), best_value and best_step at
    the stop (or at the end; NULL if no check was finite), n_checks.

    Plan: one aggregate per step, dense positions (rows partitioned once by
    group and bucket), two prefix scans on that partitioning (exclusive running
    minimum, then the latest improvement carried as a struct), one partial aggregate."""
    g = list(groups)
    checks = log.groupBy(*g, step).agg(F.min(F.coalesce(F.col(value).cast("double"), F.lit(math.nan))).alias("_v"))
    pos = sequence_index(checks, [step], partition_by=g, name="_pos", keep_bucket="_bucket")
    finite = ~F.isnan("_v") & (F.abs("_v") < math.inf)
    pos = pos.withColumn("_fin", F.when(finite, F.col("_v")))
    prev = prefix_scan(pos, g, "_pos", "_fin", "min", "_prev_min", inclusive=False, block_col="_bucket")
    improved = finite & (F.col("_prev_min").isNull() | (F.col("_fin") < F.col("_prev_min")))
    marked = prev.withColumn("_imp", F.when(improved, F.struct(
        F.col("_pos").alias("p"), F.col(step).alias("s"), F.col("_fin").alias("v"))))
    last = prefix_scan(marked, g, "_pos", "_imp", "max", "_last", inclusive=True, block_col="_bucket")
    stopping = ~finite | ((F.col("_pos") - F.col("_last.p")) >= patience)
    agg = last.groupBy(*g).agg(
        F.min_by(F.when(stopping, F.struct(F.col(step).alias("stop_step"), F.col("_last").alias("best"))),
                 F.when(stopping, F.col("_pos"))).alias("_stop"),
        F.max("_imp").alias("_final"),
        F.count(F.lit(1)).alias("n_checks"))
    best = F.when(F.col("_stop").isNotNull(), F.col("_stop.best")).otherwise(F.col("_final"))
    return agg.select(*g, F.col("_stop.stop_step").alias("stop_step"), best["v"].alias("best_value"),
                      best["s"].alias("best_step"), "n_checks")


# --- O3 / O4 ----------------------------------------------------------------------------

def _cos_anneal(start: Column, end: Column, pct: Column) -> Column:
    return end + (start - end) / 2.0 * (F.cos(F.lit(math.pi) * pct) + 1)


def one_cycle_lr(step: Column, total: Column, max_lr: Column, pct_start: float = PCT_START,
                 div_factor: float = DIV_FACTOR, final_div_factor: float = FINAL_DIV_FACTOR) -> Column:
    """O3: cosine one-cycle learning rate at 0-based ``step`` of ``total``:
    from max/div up to max at pct_start*total - 1, then down to
    (max/div)/final_div at total - 1. A span of no length is at its end."""
    initial = max_lr / div_factor
    minimum = initial / final_div_factor
    up_end = F.lit(pct_start) * total - 1
    down_end = total - 1
    s = step.cast("double")
    warm = _cos_anneal(initial, max_lr, F.coalesce(F.try_divide(s, up_end), F.lit(1.0)))
    cool = _cos_anneal(max_lr, minimum, F.coalesce(F.try_divide(s - up_end, down_end - up_end), F.lit(1.0)))
    return F.when(s <= up_end, warm).otherwise(cool)


def warmup_cosine(step: Column, total: Column, warmup: Column) -> Column:
    """Linear warm-up, then half cosine, floored at 0 (multiplier)."""
    s = step.cast("double")
    progress = (s - warmup) / F.greatest(F.lit(1), total - warmup)
    return F.when(s < warmup, s / F.greatest(F.lit(1), warmup)).otherwise(
        F.greatest(F.lit(0.0), 0.5 * (1.0 + F.cos(F.lit(math.pi) * progress))))


def warmup_constant(step: Column, warmup: Column) -> Column:
    """Linear warm-up, then 1.0."""
    s = step.cast("double")
    return F.when(s < warmup, s / F.greatest(F.lit(1), warmup)).otherwise(F.lit(1.0))


def run_totals(log: DataFrame, run: str = "run", step: str = "step") -> DataFrame:
    """Steps per run (grouped aggregate: one row per run)."""
    return log.groupBy(run).agg(F.max(step).alias("total_steps"))


def lr_schedule(log: DataFrame, groups=MAX_LRS, pct_start: float = PCT_START, run: str = "run",
                step: str = "step") -> DataFrame:
    """O3 over logged steps: lr per (run, step, parameter group); total steps
    of a run = its last logged step; step 1 is scheduler step 0."""
    steps = log.select(run, step).distinct()
    j = steps.join(run_totals(log, run, step), run)
    grp = F.inline(F.array(*[F.struct(F.lit(n).alias("param_group"), F.lit(float(v)).alias("max_lr"))
                             for n, v in groups]))
    j = j.select(run, step, "total_steps", grp)
    lr = one_cycle_lr(F.col(step) - 1, F.col("total_steps"), F.col("max_lr"), pct_start)
    return j.select(run, step, "param_group", lr.alias("lr"))


def lr_warmup(log: DataFrame, warmup_ratio: float = PCT_START, run: str = "run", step: str = "step") -> DataFrame:
    """O4 over logged steps: both warm-up multipliers per (run, step)."""
    steps = log.select(run, step).distinct()
    j = steps.join(run_totals(log, run, step), run)
    warm = F.floor(F.col("total_steps") * warmup_ratio)
    cur = F.col(step) - 1
    return j.select(run, step, warm.alias("warmup_steps"),
                    warmup_cosine(cur, F.col("total_steps"), warm).alias("cosine_mult"),
                    warmup_constant(cur, warm).alias("constant_mult"))


# --- O5 -------------------------------------------------------------------------------

def grad_norm(grads: DataFrame, step: str = "step", grad: str = "grad",
              max_norm: float = CLIP_MAX_NORM) -> DataFrame:
    """Global L2 norm per step over all parameter gradients, and the
    clip coefficient min(1, max_norm / (norm + 1e-6))."""
    sq = F.aggregate(F.col(grad), F.lit(0.0), lambda acc, v: acc + v * v)
    per = grads.groupBy(step).agg(F.sqrt(F.sum(sq)).alias("_norm"), F.count(F.lit(1)).alias("n_params"))
    return per.select(step, "n_params", F.round("_norm", 6).alias("grad_norm"),
                      F.round(F.least(F.lit(1.0), F.lit(max_norm) / (F.col("_norm") + CLIP_EPS)), 6).alias("clip_coef"))


# --- O6 -------------------------------------------------------------------------------

def validation_plan(log: DataFrame, interval: int, warmup_ratio: float = PCT_START, run: str = "run",
                    step: str = "step", block: int = SCAN_BLOCK) -> DataFrame:
    """Validation steps (every ``interval`` up to the run's last step) and,
    for each, the latest logged row at or before it (as-of), plus whether it
    falls in the warm-up share.

    As-of without a range join: a row at step s is first visible at check
    ceil(s / interval); the last row per (run, check) is a grouped max_by;
    checks with no new row carry the previous one. A run's checks are made per
    block of ``block`` check numbers, the blocks spread over the tasks, and the
    carry is a prefix scan over blocks: no task holds a whole run."""
    k = F.ceil(F.col(step) / interval).cast("long")
    last_per_check = log.groupBy(run, k.alias("check")).agg(
        F.max_by(F.struct(F.col(step).alias("asof_step"), "metric", "value"), F.col(step)).alias("_row"))
    n_checks = F.floor(F.col("total_steps") / interval).cast("long")
    blocks = run_totals(log, run, step).withColumn("_n", n_checks).where("_n >= 1").withColumn(
        "_blk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_n") - 1) / block)))).repartition(run, "_blk")
    first = F.col("_blk") * block + 1
    checks = blocks.select(run, "total_steps", "_blk", F.explode(F.sequence(
        first, F.least(F.col("_n"), first + block - 1))).alias("check"))
    rows = last_per_check.withColumn("_blk", F.floor((F.col("check") - 1) / block))
    j = checks.join(rows, [run, "_blk", "check"], "left")
    seen = j.withColumn("_seen", F.when(F.col("_row").isNotNull(), F.struct("check", "_row")))  # the latest is the greatest
    carried = prefix_scan(seen, [run], "check", "_seen", "max", "_last", inclusive=True, block_col="_blk").withColumn(
        "_row", F.col("_last._row"))
    warm = F.floor(F.col("total_steps") * warmup_ratio)
    return carried.select(run, (F.col("check") * interval).alias("val_step"),
                          F.col("_row.asof_step").alias("asof_step"), F.col("_row.metric").alias("metric"),
                          F.col("_row.value").alias("value"),
                          ((F.col("check") * interval) <= warm).alias("in_warmup"))


# --- O7 -------------------------------------------------------------------------------

def metric_log_summary(log: DataFrame, groups: Sequence[str] = ("run", "metric"), value: str = "value",
                       step: str = "step") -> DataFrame:
    """Latest, mean, best (min) value, count and last step per group."""
    return log.groupBy(*groups).agg(
        F.max_by(value, step).alias("latest"), F.round(F.avg(value), 6).alias("mean"),
        F.min(value).alias("best"), F.count(F.lit(1)).alias("n"), F.max(step).alias("last_step"))


# --- S2 -------------------------------------------------------------------------------

RUN_FOLDER = r"^(.*/)?([^/]+)_([A-Za-z0-9-]+)_seed([0-9]+)_([0-9]{8}_[0-9]{6})$"
CKPT_FILE = r"epoch=([0-9]+)[-_]val_seq2seq_loss=([0-9.]+?)(-v[0-9]+)?\.ckpt$"


def run_catalog(paths: DataFrame, project: str, methods: Sequence[str], seeds: Sequence[int],
                root: str = "runs", path_col: str = "path") -> DataFrame:
    """Checkpoint files of the run folders ``{project}_{method}_seed{seed}*``
    (glob prefix semantics, so seed 1 also matches seed 10); top-level
    ``*.ckpt`` files of a folder, or, for a folder with none, every ``*.ckpt``
    below it. Folder and file fields parsed; ranks follow sorted names."""
    prefix = root.rstrip("/") + "/"
    rel = F.substring(F.col(path_col), len(prefix) + 1, 1 << 30)
    p = paths.where(F.col(path_col).startswith(prefix) & F.col(path_col).endswith(".ckpt")).select(
        F.col(path_col).alias("path"), F.split(rel, "/").alias("_parts"))
    p = p.select("path", F.element_at("_parts", 1).alias("folder"), (F.size("_parts") == 2).alias("top_level"))
    wanted = None
    for m in methods:
        for s in seeds:
            cond = F.col("folder").startswith(f"{project}_{m}_seed{s}")
            wanted = cond if wanted is None else (wanted | cond)
    p = p.where(wanted)
    has_top = p.where("top_level").select("folder").distinct()
    top = p.where("top_level")
    nested = p.where(~F.col("top_level")).join(has_top, "folder", "left_anti")
    files = top.unionByName(nested)
    parsed = files.select(
        "folder", "path", "top_level",
        F.regexp_extract("folder", RUN_FOLDER, 2).alias("project"),
        F.regexp_extract("folder", RUN_FOLDER, 3).alias("method"),
        F.regexp_extract("folder", RUN_FOLDER, 4).cast("int").alias("seed"),
        F.regexp_extract("folder", RUN_FOLDER, 5).alias("ts"),
        F.regexp_extract("path", CKPT_FILE, 1).cast("int").alias("epoch"),
        F.regexp_extract("path", CKPT_FILE, 2).cast("double").alias("val_loss"))
    # The catalog is read by both rankings below: written once to the shared folder.
    parsed = stored(parsed, "catalog")
    ranked = sequence_index(parsed, ["path"], partition_by=["folder"], name="file_rank", start=1)
    folders = parsed.select("folder").distinct()
    folder_rank = sequence_index(folders, ["folder"], name="folder_rank", start=1)
    return ranked.join(folder_rank, "folder")
