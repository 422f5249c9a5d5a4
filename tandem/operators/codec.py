"""Pairing, decoding, canonical identity and augmentation.

Per-row codecs of the modelled job (string decoder, canonicaliser, random
rewrite) are re-expressed as lookups into tables of known mappings: one
equi-join for all columns (``lookup``), in which a string that many rows share
(e.g. the empty string of failed outputs) is salted.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.operators.ordering import shuffle_key


HOT_ROWS = 100_000  # rows that one string may bring to one task of a lookup, about


def lookup(df: DataFrame, table: DataFrame, columns: dict[str, str], key: str, value: str,
           hot_rows: int = HOT_ROWS) -> DataFrame:
    """``df`` with, for each ``src -> dst`` of ``columns``, the value that ``table`` holds for the string in ``src``
    (its least, if a key repeats; NULL where it has none). The table is read once for all columns:

    1. every row becomes one narrow row per column; the row itself travels with the first;
    2. strings are counted by their hash (partial sums of longs); those over ``hot_rows`` get several salts, on both
       sides of the join, and NULLs, which match nothing, are spread;
    3. after the join the parts meet again by a 128-bit hash of their row; equal rows are counted and repeated."""
    names, srcs = list(df.columns), list(columns)
    rows = df.select(F.struct(*names).alias("row"), F.xxhash64(*names).alias("h1"), F.xxhash64(F.lit(1), *names).alias("h2"),
                     F.array(*[F.col(c).cast("string") for c in srcs]).alias("strings"))
    parts = rows.select("h1", "h2", "row", F.posexplode("strings").alias("k", "s")).select(
        "h1", "h2", "k", "s", F.xxhash64("s").alias("hs"), F.when(F.col("k") == 0, F.col("row")).alias("row"))
    salts = F.ceil(F.col("n") / hot_rows).cast("int").alias("salts")
    heavy = parts.where("s is not null").groupBy("hs").agg(F.count("*").alias("n")).where(F.col("n") > hot_rows).select("hs", salts)
    one = F.coalesce("salts", F.lit(1))
    asked = parts.join(heavy, "hs", "left").withColumn(
        "salt", F.when(F.col("s").isNull(), F.pmod("h1", F.lit(1024))).otherwise(F.pmod("h1", one)).cast("int"))
    book = table.select(F.col(key).alias("s"), F.col(value).alias("value")).where("s is not null").groupBy("s").agg(
        F.min("value").alias("value")).withColumn("hs", F.xxhash64("s"))
    book = book.join(heavy, "hs", "left").select("s", "value", F.explode(F.sequence(F.lit(0), one - 1)).alias("salt"))
    found = asked.join(book, ["s", "salt"], "left")
    values = [F.max(F.when(F.col("k") == i, F.col("value"))).alias(f"v{i}") for i in range(len(srcs))]
    whole = found.groupBy("h1", "h2").agg(F.first("row", ignorenulls=True).alias("row"), F.count("row").alias("n"), *values)
    out = whole.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "n")))
    kept = [c for c in names if c not in columns.values()]
    return out.select(*[F.col("row")[c].alias(c) for c in kept], *[F.col(f"v{i}").alias(dst) for i, dst in enumerate(columns.values())])


def pair_predictions(preds: DataFrame, refs: DataFrame, key: str = "pair_id") -> DataFrame:
    """Pair predictions with references on a key (not on arrival order)
    and label each row 'matched', 'missing_reference' or 'missing_prediction'."""
    p = preds.withColumn("_has_pred", F.lit(True))
    r = refs.withColumn("_has_ref", F.lit(True))
    j = p.join(r, key, "full_outer")
    match = (F.when(F.col("_has_pred").isNull(), "missing_prediction")
             .when(F.col("_has_ref").isNull(), "missing_reference").otherwise("matched"))
    return j.withColumn("match", match).drop("_has_pred", "_has_ref")


def decode_by_codebook(df: DataFrame, book: DataFrame, columns: dict[str, str],
                       encoded: str = "encoded", decoded: str = "decoded") -> DataFrame:
    """Decode each ``src -> dst`` column through the code book, read once; a string
    with no entry decodes to '' (failure), as the evaluation job records it."""
    out = lookup(df, book, columns, encoded, decoded)
    return out.withColumns({dst: F.coalesce(dst, F.lit("")) for dst in columns.values()})


def canonical_match(df: DataFrame, keys: DataFrame, gt_col: str, pred_col: str,
                    raw: str = "raw", canonical: str = "canonical_key") -> DataFrame:
    """Identity by canonical key rather than by text: both sides are
    looked up; a match needs both keys present and equal."""
    out = lookup(df, keys, {gt_col: "gt_key", pred_col: "pred_key"}, raw, canonical)
    is_match = F.coalesce(F.col("gt_key") == F.col("pred_key"), F.lit(False))
    return out.withColumn("is_match", is_match)


def augment_variants(samples: DataFrame, variants: DataFrame, seed: int, epoch: int,
                     id_col: str = "id", target_col: str = "target", source_col: str = "source",
                     enabled: bool = True) -> DataFrame:
    """With augmentation on, a sample that has a source string takes one
    of its equivalent rewrites, chosen by md5(seed:epoch:id:variant_no) (same
    choice for any partitioning); no rewrite available keeps the original.

    Variants are reduced to one row per id (partial aggregate) before the join,
    and both sides meet on the id partitioning."""
    if not enabled:
        return samples
    pick = variants.groupBy(F.col("doc_id").alias("_vid")).agg(
        F.min_by("text", F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)),
                                           F.col("doc_id").cast("string"),
                                           F.col("variant_no").cast("string")))).alias("_variant"))
    has_source = F.coalesce(F.length(F.col(source_col)) > 0, F.lit(False))
    j = samples.join(pick, samples[id_col] == pick["_vid"], "left")
    return (j.withColumn(target_col, F.when(has_source & F.col("_variant").isNotNull(), F.col("_variant"))
                         .otherwise(F.col(target_col)))
            .withColumn("augmented", has_source & F.col("_variant").isNotNull())
            .drop("_vid", "_variant"))


def safe_apply(df: DataFrame, func: Callable[[str], str], input_col: str, output_col: str) -> DataFrame:
    """Apply a Python string function per element over Arrow batches; an
    exception gives a NULL value and the exception's class name in
    ``{output_col}_error``; a NULL input gives NULL without error."""
    result = T.StructType([T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

    @F.pandas_udf(result)
    def guarded(s: pd.Series) -> pd.DataFrame:
        vals, errs = [], []
        for x in s:
            if x is None:
                vals.append(None)
                errs.append(None)
                continue
            try:
                vals.append(func(x))
                errs.append(None)
            except Exception as exc:  # noqa: BLE001 - the point is to catch anything
                vals.append(None)
                errs.append(type(exc).__name__)
        return pd.DataFrame({"value": vals, "error": errs})

    tmp = f"_{output_col}_struct"
    return (df.withColumn(tmp, guarded(F.col(input_col)))
            .withColumn(output_col, F.col(f"{tmp}.value"))
            .withColumn(f"{output_col}_error", F.col(f"{tmp}.error"))
            .drop(tmp))


__all__ = ["pair_predictions", "decode_by_codebook", "canonical_match", "augment_variants",
           "safe_apply", "shuffle_key"]
