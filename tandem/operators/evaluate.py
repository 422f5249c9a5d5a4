"""Corpus evaluation of predictions against references.

Every metric is reduced to additive per-pair statistics; a corpus (or group)
report is one aggregation of those sums followed by a one-row projection.
The partial/final hash aggregate does the combining, so nothing but a row of
sums per group and partition crosses the network, and the same statistics
serve batch, per-group (rollup) and streaming reports.

Per-pair statistics:
* status (bad / gt_dropped / kept), exact match: native expressions;
* clipped n-gram matches, fingerprints and edit distance: array kernels over
  slices of whole Arrow batches (both strings are on the row, so no shuffle).

A kept pair whose comparison raises (``raised``: with identity keys, one of the
two has no key) counts as bad for validity, stays in the exact-match and
edit-distance means, and leaves the means of the three similarities.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.groups import pieces
from tandem.functions.ngrams import edit_distances, gram_bits, pair_counts, set_tanimoto
from tandem.functions.text import clean_generated, non_empty

# --- Fixed values of the metric definitions ---
BLEU_MAX_N = 4                      # corpus BLEU over 1..4-grams, equal weights
BLEU_ZERO_PRECISION = sys.float_info.min   # replaces a zero n>1 precision (no smoothing)
BITS_SMALL = (167, (1, 2))          # short fingerprint: width, n-gram sizes
BITS_LARGE = (2048, (1, 2, 3, 4, 5, 6, 7))  # long fingerprint
COUNT_GRAMS_MAX_N = 3               # count fingerprint: unfolded 1..3-gram counts
# --- end of fixed values ---

REPORT_COLUMNS = ("bleu_smi", "bleu_self", "exact_match", "levenshtein_smi",
                  "validity", "maccs_sims", "rdk_sims", "morgan_sims")

Canon = Callable[[Column], Column]


def _identity(c: Column) -> Column:
    return c


# --- P5 ---------------------------------------------------------------------

def pair_status(gt_canon: Column, pred_canon: Column) -> Column:
    """P5: an invalid prediction is 'bad' (tested first); else an invalid
    reference is 'gt_dropped'; else 'kept'."""
    return (F.when(pred_canon.isNull(), F.lit("bad"))
            .when(gt_canon.isNull(), F.lit("gt_dropped"))
            .otherwise(F.lit("kept")))


def prepare_pairs(pairs: DataFrame, canonicalise: Canon | None = None,
                  is_valid: Canon = non_empty, keep: Sequence[str] = ("pair_id",),
                  gt_col: str = "gt_raw", pred_col: str = "pred_raw",
                  gt_decoded: str | None = None, pred_decoded: str | None = None,
                  clean: bool = True, identity: tuple[str, str] | None = None) -> DataFrame:
    """Clean the prediction, canonicalise both decoded forms, classify the pair.

    Output: ``keep`` columns, gt_self, pred_self (raw forms), gt_can,
    pred_can (canonical or NULL when invalid), status. With ``identity =
    (gt_key, pred_key)``, the columns of the identity keys (from
    ``codec.canonical_match``, or a guarded function of ``codec.safe_apply``,
    whose failures are NULL): also ``same`` (both keys there and equal) and
    ``raised`` (a kept pair that cannot be compared, as a key is missing).
    """
    canon = canonicalise or _identity
    pred_self = clean_generated(F.col(pred_col)) if clean else F.col(pred_col)
    gt_self = F.coalesce(F.col(gt_col), F.lit(""))
    gt_dec = F.coalesce(F.col(gt_decoded), F.lit("")) if gt_decoded else F.col("gt_self")
    pred_dec = F.coalesce(F.col(pred_decoded), F.lit("")) if pred_decoded else F.col("pred_self")
    also = dict.fromkeys([*([gt_decoded] if gt_decoded else []), *([pred_decoded] if pred_decoded else []), *(identity or ())])
    base = pairs.select(*keep, gt_self.alias("gt_self"), pred_self.alias("pred_self"), *[c for c in also if c not in keep])
    g = canon(gt_dec)
    p = canon(pred_dec)
    out = base.select(*keep, "gt_self", "pred_self",
                      F.when(is_valid(g), g).alias("gt_can"),
                      F.when(is_valid(p), p).alias("pred_can"),
                      *[c for c in identity or () if c not in keep])
    out = out.withColumn("status", pair_status(F.col("gt_can"), F.col("pred_can")))
    if identity is None:
        return out
    gt_key, pred_key = map(F.col, identity)
    out = out.withColumns({
        "same": F.coalesce(gt_key == pred_key, F.lit(False)),
        "raised": (F.col("status") == "kept") & (gt_key.isNull() | pred_key.isNull())})
    return out.drop(*[c for c in identity if c not in keep])


def status_counts(prepared: DataFrame) -> DataFrame:
    """P5 as a query: pairs per status."""
    return prepared.groupBy("status").agg(F.count(F.lit(1)).alias("n_pairs"))


# --- per-pair statistics ------------------------------------------------------

SLICE_CHARS, SLICE_ROWS = 1 << 16, 1 << 11  # of one pass of the n-gram kernels (whose arrays then fit caches); a pair over it passes alone
PIECE_BYTES = 8 << 20  # of strings that leave an Arrow batch together; edit distances pass over a piece at once


def _pieces(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """The batch cut at about ``PIECE_BYTES`` of the named strings, so that memory is not that of the whole batch."""
    size = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    return pieces(batch, size, PIECE_BYTES)


def _pair_slices(left: Sequence[str], right: Sequence[str]) -> Iterator[tuple[int, int]]:
    """Ranges of rows with bounded characters and rows."""
    size = np.cumsum([len(a) + len(b) for a, b in zip(left, right, strict=True)])
    lo = 0
    while lo < len(size):
        used = int(size[lo - 1]) if lo else 0
        hi = max(lo + 1, min(int(np.searchsorted(size, used + SLICE_CHARS, "right")), lo + SLICE_ROWS))
        yield lo, hi
        lo = hi


def with_clipped_matches(df: DataFrame, specs: Sequence[tuple[str, str, str]],
                         use_col: str | None = None, max_n: int = BLEU_MAX_N,
                         drop: Sequence[str] = (), bits: tuple[str, str] | None = None,
                         empty_value: float = 0.0, lev: tuple[str, str] | None = None) -> DataFrame:
    """Append ``{prefix}_m1..m{max_n}`` clipped n-gram matches for each
    (prefix, hyp_col, ref_col) spec; with ``bits = (pred_col, gt_col)`` also
    ``bits_small`` / ``bits_large`` (hashed n-gram fingerprint Tanimoto); with
    ``lev = (hyp_col, ref_col)`` also ``lev`` (edit distance). Rows whose
    ``use_col`` is false or that miss a string get zeros. Each pair of columns
    goes through the kernels once, a slice of rows at a time.
    ``drop`` columns are not passed back."""
    keep_fields = [f for f in df.schema.fields if f.name not in set(drop)]
    new_fields = [T.StructField(f"{p}_m{n}", T.LongType(), False) for p, _, _ in specs for n in range(1, max_n + 1)]
    if bits:
        new_fields += [T.StructField("bits_small", T.DoubleType(), False),
                       T.StructField("bits_large", T.DoubleType(), False)]
    if lev:
        new_fields += [T.StructField("lev", T.LongType(), False)]
    keep_names = [f.name for f in keep_fields]
    widths = {BITS_SMALL[0]: BITS_SMALL[1], BITS_LARGE[0]: BITS_LARGE[1]}
    tables = {(h, r): [p for p, a, b in specs if (a, b) == (h, r)] for _, h, r in specs}
    if bits:
        tables.setdefault(tuple(bits), [])
    if lev:
        tables.setdefault(tuple(lev), [])

    def count(batch: pa.RecordBatch, out: dict[str, np.ndarray], columns: tuple[str, str], prefixes: list[str]) -> None:
        hyp, ref = (batch.column(c) for c in columns)
        use = hyp.is_valid().to_numpy(zero_copy_only=False) & ref.is_valid().to_numpy(zero_copy_only=False)
        if use_col:
            use &= batch.column(use_col).to_numpy(zero_copy_only=False)
        at = np.flatnonzero(use)
        hyp, ref = (c.take(pa.array(at)).to_pylist() for c in (hyp, ref))
        own_bits = widths if bits and columns == tuple(bits) else None
        for lo, hi in _pair_slices(hyp, ref):
            rows = at[lo:hi]
            if prefixes or own_bits:
                matches, tanimoto = pair_counts(hyp[lo:hi], ref[lo:hi], max_n if prefixes else 0, own_bits, empty_value)
                for prefix in prefixes:
                    for n in range(1, max_n + 1):
                        out[f"{prefix}_m{n}"][rows] = matches[n - 1]
                if own_bits:
                    out["bits_small"][rows], out["bits_large"][rows] = tanimoto[BITS_SMALL[0]], tanimoto[BITS_LARGE[0]]
        if lev and columns == tuple(lev):
            out["lev"][at] = edit_distances(hyp, ref)

    strings = sorted({c for pair in tables for c in pair})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (piece for whole in batches for piece in _pieces(whole, strings)):
            out = {f.name: np.zeros(batch.num_rows, dtype=np.int64 if f.dataType == T.LongType() else np.float64) for f in new_fields}
            for columns, prefixes in tables.items():
                count(batch, out, columns, prefixes)
            yield pa.record_batch({**{c: batch.column(c) for c in keep_names}, **out})

    return df.mapInArrow(run, T.StructType(keep_fields + new_fields))


TASK_BYTES = 4 << 20  # of input files whose rows one scoring task gets, about


def _input_bytes(df: DataFrame) -> int:
    """Bytes of the tables and files a plan reads, as the planner knows them; one that is read again (the same size)
    counts once, and one of unknown size (which the planner takes for endless) not at all."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = {int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())}
    return sum(n for n in sizes if n < 1 << 60)


def spread(df: DataFrame, key: str, partitions: int | None = None) -> DataFrame:
    """Rows in enough partitions for CPU-heavy work. Pair rows are small in bytes but costly to score, and a shuffle
    packs them by bytes, so they are dealt by ``key`` to tasks of about ``TASK_BYTES`` of input: with the input grow
    the tasks, not the time of the longest. ``partitions`` forces a count; 0: the rows are dealt already."""
    if partitions == 0:
        return df
    spark = df.sparkSession
    least = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(partitions or max(least, -(-_input_bytes(df) // TASK_BYTES)), key)


def with_bit_tanimoto(df: DataFrame, use: Column, empty_value: float = 0.0) -> DataFrame:
    """Append ``bits_small`` / ``bits_large``: set Tanimoto of the hashed
    n-gram fingerprints of ``gt_can`` and ``pred_can`` (0.0 where not ``use``).
    The fingerprints are built once as columns, then compared."""
    gc, pc = F.col("gt_can"), F.col("pred_can")
    out = df
    names = []
    for (w, ns), name in ((BITS_SMALL, "bits_small"), (BITS_LARGE, "bits_large")):
        out = out.withColumn(f"_g_{name}", F.when(use, gram_bits(gc, ns, w))).withColumn(
            f"_p_{name}", F.when(use, gram_bits(pc, ns, w)))
        names.append(name)
    for name in names:
        out = out.withColumn(name, F.when(use, set_tanimoto(F.col(f"_g_{name}"), F.col(f"_p_{name}"), empty_value))
                             .otherwise(0.0))
    return out.drop(*[f"_{s}_{n}" for n in names for s in ("g", "p")])


def pair_stats(prepared: DataFrame, group_cols: Sequence[str] = (), empty_value: float = 0.0,
               partitions: int | None = None) -> DataFrame:
    """Per-pair additive statistics for the full report."""
    kept = F.col("status") == "kept"
    gc, pc = F.col("gt_can"), F.col("pred_can")
    base = spread(prepared, "pair_id", partitions)
    keyed = "raised" in prepared.columns
    raised = F.col("raised") if keyed else F.lit(False)
    native = base.select(
        "pair_id", *group_cols, "status", "gt_self", "pred_self", "gt_can", "pred_can",
        F.when(kept, (F.col("same") if keyed else gc == pc).cast("long")).otherwise(0).alias("exact"),
        raised.alias("raised"), kept.alias("_use"),
    )
    counted = with_clipped_matches(
        native, [("c", "pred_can", "gt_can"), ("s", "pred_self", "gt_self")], use_col="_use",
        bits=("pred_can", "gt_can"), empty_value=empty_value, lev=("pred_can", "gt_can"))
    h_c = F.coalesce(F.length("pred_can"), F.lit(0))
    r_c = F.coalesce(F.length("gt_can"), F.lit(0))
    h_s = F.length("pred_self")
    r_s = F.length("gt_self")
    cols = [F.col("pair_id"), *[F.col(g) for g in group_cols], F.col("status"),
            F.col("exact"), F.col("lev"), F.col("raised"),
            *[F.when(F.col("raised"), 0.0).otherwise(F.col(c)).alias(c) for c in ("bits_small", "bits_large")]]
    for prefix, h, r in (("c", h_c, r_c), ("s", h_s, r_s)):
        cols.append(F.when(kept, h).otherwise(0).cast("long").alias(f"{prefix}_hyp"))
        cols.append(F.when(kept, r).otherwise(0).cast("long").alias(f"{prefix}_ref"))
        for n in range(1, BLEU_MAX_N + 1):
            cols.append(F.col(f"{prefix}_m{n}"))
            cols.append(F.when(kept, F.greatest(F.lit(1), h - n + 1)).otherwise(0).cast("long")
                        .alias(f"{prefix}_d{n}"))
    # Count Tanimoto over 1..3-grams of the canonical forms.
    inter = sum((F.col(f"c_m{n}") for n in range(1, COUNT_GRAMS_MAX_N + 1)), F.lit(0))
    tot_a = sum((F.greatest(F.lit(0), r_c - n + 1) for n in range(1, COUNT_GRAMS_MAX_N + 1)), F.lit(0))
    tot_b = sum((F.greatest(F.lit(0), h_c - n + 1) for n in range(1, COUNT_GRAMS_MAX_N + 1)), F.lit(0))
    denom = tot_a + tot_b - inter
    cols.append(F.when(kept & ~F.col("raised"), F.when(denom == 0, F.lit(float(empty_value))).otherwise(inter / denom))
                .otherwise(0.0).alias("counts_tan"))
    return counted.select(*cols)


def sum_stats(grouped, extra: Sequence[Column] = ()) -> DataFrame:
    """The additive sums behind every report column, over a grouping
    (``stats.groupBy(...)``, ``stats.rollup(...)`` or the whole frame)."""
    aggs = [*extra, F.count(F.lit(1)).alias("n_total"),
            F.count_if(F.col("status") == "bad").alias("n_bad"),
            F.count_if(F.col("status") == "kept").alias("n_kept"),
            F.count_if("raised").alias("n_raised"),
            F.sum("exact").alias("sum_exact"), F.sum("lev").alias("sum_lev"),
            F.sum("bits_small").alias("sum_bits_small"), F.sum("bits_large").alias("sum_bits_large"),
            F.sum("counts_tan").alias("sum_counts_tan")]
    for prefix in ("c", "s"):
        aggs += [F.sum(f"{prefix}_hyp").alias(f"{prefix}_hyp"), F.sum(f"{prefix}_ref").alias(f"{prefix}_ref")]
        for n in range(1, BLEU_MAX_N + 1):
            aggs += [F.sum(f"{prefix}_m{n}").alias(f"{prefix}_m{n}"), F.sum(f"{prefix}_d{n}").alias(f"{prefix}_d{n}")]
    return grouped.agg(*aggs)


def bleu_from_sums(prefix: str, max_n: int = BLEU_MAX_N) -> Column:
    """Corpus BLEU from summed clipped matches, denominators and lengths:
    brevity penalty from total lengths; 0 when no unigram matches; a zero
    higher-order precision becomes the smallest positive float."""
    hyp = F.col(f"{prefix}_hyp").cast("double")
    ref = F.col(f"{prefix}_ref").cast("double")
    bp = F.when(hyp > ref, F.lit(1.0)).when(hyp == 0, F.lit(0.0)).otherwise(F.exp(1 - ref / hyp))
    logs = []
    for n in range(1, max_n + 1):
        m = F.col(f"{prefix}_m{n}").cast("double")
        d = F.col(f"{prefix}_d{n}").cast("double")
        logs.append(F.log(F.when(m > 0, m / d).otherwise(F.lit(BLEU_ZERO_PRECISION))))
    mean_log = sum(logs[1:], logs[0]) / max_n
    return F.when(F.col(f"{prefix}_m1") == 0, F.lit(0.0)).otherwise(bp * F.exp(mean_log))


def report_from_sums(sums: DataFrame, group_cols: Sequence[str] = (), digits: int | None = 6,
                     with_raised: bool = False) -> DataFrame:
    """E8 final projection; with nothing kept every metric but validity is 0.0, and so are the similarities when
    every kept pair raised."""
    kept = F.col("n_kept").cast("double")
    compared = F.col("n_kept") - F.col("n_raised")
    any_kept = F.col("n_kept") > 0

    def guard(c: Column) -> Column:
        return F.when(any_kept, c).otherwise(F.lit(0.0))

    def similarity(total: str) -> Column:
        return F.when(compared > 0, F.col(total) / compared).otherwise(F.lit(0.0))

    validity = F.when(F.col("n_total") > 0, 1 - (F.col("n_bad") + F.col("n_raised")) / F.col("n_total")).otherwise(F.lit(0.0))
    cols = {
        "bleu_smi": guard(bleu_from_sums("c")),
        "bleu_self": guard(bleu_from_sums("s")),
        "exact_match": guard(F.col("sum_exact") / kept),
        "levenshtein_smi": guard(F.col("sum_lev") / kept),
        "validity": validity,
        "maccs_sims": similarity("sum_bits_small"),
        "rdk_sims": similarity("sum_bits_large"),
        "morgan_sims": similarity("sum_counts_tan"),
    }
    rnd = (lambda c: F.round(c.cast("double"), digits)) if digits is not None else (lambda c: c.cast("double"))
    return sums.select(*group_cols, F.col("n_total"), F.col("n_bad"), F.col("n_kept"), *(["n_raised"] if with_raised else []),
                       *[rnd(c).alias(k) for k, c in cols.items()])


def eval_report(prepared: DataFrame, empty_value: float = 0.0) -> DataFrame:
    """The whole report as one row; of pairs with identity keys, with ``n_raised``."""
    stats = pair_stats(prepared, empty_value=empty_value)
    return report_from_sums(sum_stats(stats), with_raised="raised" in prepared.columns)


def eval_report_by_group(prepared: DataFrame, group_col: str, empty_value: float = 0.0) -> DataFrame:
    """The report per group value plus the overall row (``is_total`` = 1,
    group NULL), from one rollup over the same additive statistics."""
    stats = pair_stats(prepared, group_cols=[group_col], empty_value=empty_value)
    sums = sum_stats(stats.rollup(group_col), extra=[F.grouping_id().cast("int").alias("is_total")])
    return report_from_sums(sums, group_cols=[group_col, "is_total"], with_raised="raised" in prepared.columns)


# --- single-metric queries (each a narrower plan over the same pieces) --------

def validity(prepared: DataFrame) -> DataFrame:
    """1 - bad / all pairs; 0.0 for no pairs."""
    agg = prepared.agg(F.count(F.lit(1)).alias("n_total"),
                       F.count_if(F.col("status") == "bad").alias("n_bad"))
    return agg.select("n_total", "n_bad", F.round(
        F.when(F.col("n_total") > 0, 1 - F.col("n_bad") / F.col("n_total")).otherwise(0.0), 6).alias("validity"))


def corpus_bleu(prepared: DataFrame, hyp_col: str, ref_col: str, name: str) -> DataFrame:
    """Corpus BLEU of the kept pairs over one pair of forms."""
    kept = spread(prepared.where(F.col("status") == "kept"), "pair_id").select(hyp_col, ref_col)
    counted = with_clipped_matches(kept, [("x", hyp_col, ref_col)])
    h = F.length(hyp_col)
    aggs = [F.sum(h).alias("x_hyp"), F.sum(F.length(ref_col)).alias("x_ref")]
    for n in range(1, BLEU_MAX_N + 1):
        aggs += [F.sum(f"x_m{n}").alias(f"x_m{n}"),
                 F.sum(F.greatest(F.lit(1), h - n + 1)).alias(f"x_d{n}")]
    sums = counted.agg(F.count(F.lit(1)).alias("n_kept"), *aggs)
    return sums.select("n_kept", F.round(F.when(F.col("n_kept") > 0, bleu_from_sums("x")).otherwise(0.0), 6)
                       .alias(name))


def exact_match(prepared: DataFrame) -> DataFrame:
    """Share of kept pairs that are the same: by their canonical forms or, where they have them, by their identity
    keys. A pair whose comparison raises stays in the denominator and matches nothing."""
    kept = prepared.where(F.col("status") == "kept")
    keyed = "raised" in prepared.columns
    same = F.col("same") if keyed else F.col("gt_can") == F.col("pred_can")
    return kept.agg(F.count(F.lit(1)).alias("n_kept"), *([F.count_if("raised").alias("n_raised")] if keyed else []),
                    F.round(F.coalesce(F.avg(same.cast("double")), F.lit(0.0)), 6).alias("exact_match"))


def levenshtein_mean(prepared: DataFrame) -> DataFrame:
    """E5: mean edit distance (code points) between canonical forms of kept pairs."""
    kept = spread(prepared.where(F.col("status") == "kept"), "pair_id")
    return kept.agg(F.count(F.lit(1)).alias("n_kept"),
                    F.round(F.coalesce(F.avg(F.levenshtein("pred_can", "gt_can").cast("double")), F.lit(0.0)), 6)
                    .alias("levenshtein_smi"))


def tanimoto_bits(prepared: DataFrame, empty_value: float = 0.0) -> DataFrame:
    """Mean set Tanimoto of hashed n-gram bits, short and long fingerprint."""
    kept = spread(prepared.where(F.col("status") == "kept"), "pair_id")
    scored = with_clipped_matches(kept.select("gt_can", "pred_can"), [], bits=("pred_can", "gt_can"),
                                  empty_value=empty_value)
    return scored.agg(F.count(F.lit(1)).alias("n_kept"),
                      F.round(F.coalesce(F.avg("bits_small"), F.lit(0.0)), 6).alias("bits_167"),
                      F.round(F.coalesce(F.avg("bits_large"), F.lit(0.0)), 6).alias("bits_2048"))


def tanimoto_counts(prepared: DataFrame, empty_value: float = 0.0) -> DataFrame:
    """Mean count Tanimoto over unfolded 1..3-gram counts of canonical forms."""
    kept = spread(prepared.where(F.col("status") == "kept"), "pair_id").select("gt_can", "pred_can")
    counted = with_clipped_matches(kept, [("c", "pred_can", "gt_can")], max_n=COUNT_GRAMS_MAX_N)
    h, r = F.length("pred_can"), F.length("gt_can")
    inter = sum((F.col(f"c_m{n}") for n in range(1, COUNT_GRAMS_MAX_N + 1)), F.lit(0))
    tot = sum((F.greatest(F.lit(0), r - n + 1) + F.greatest(F.lit(0), h - n + 1)
               for n in range(1, COUNT_GRAMS_MAX_N + 1)), F.lit(0))
    denom = tot - inter
    t = F.when(denom == 0, F.lit(float(empty_value))).otherwise(inter / denom)
    return counted.agg(F.count(F.lit(1)).alias("n_kept"),
                       F.round(F.coalesce(F.avg(t), F.lit(0.0)), 6).alias("counts_tanimoto"))


def clipped_matches_native(df: DataFrame, key: str, hyp_col: str, ref_col: str, prefix: str = "x",
                           max_n: int = BLEU_MAX_N) -> DataFrame:
    """Catalyst-only form of the clipped n-gram counts: every n-gram of both
    sides becomes a row, counted per (key, n, gram) and clipped with ``least``.

    ``df`` must be hash-partitioned by ``key`` (``spread``): explode keeps that
    partitioning, so both aggregates run without another exchange. Returns
    ``key`` and ``{prefix}_m1..m{max_n}``; keys without any match are absent."""
    from tandem.functions.ngrams import char_ngrams

    def tagger(tag: str, n: int):
        return lambda g: F.struct(F.lit(tag).alias("side"), F.lit(n).alias("n"), g.alias("gram"))

    def side(col: str, tag: str):
        return [F.transform(char_ngrams(F.col(col), n), tagger(tag, n)) for n in range(1, max_n + 1)]

    grams = F.flatten(F.array(*side(hyp_col, "h"), *side(ref_col, "r")))
    ex = df.select(F.col(key), F.inline(grams))
    per_gram = ex.groupBy(key, "n", "gram").agg(
        F.least(F.count_if(F.col("side") == "h"), F.count_if(F.col("side") == "r")).alias("m"))
    return per_gram.groupBy(key).agg(
        *[F.sum(F.when(F.col("n") == n, F.col("m")).otherwise(0)).alias(f"{prefix}_m{n}") for n in range(1, max_n + 1)])
