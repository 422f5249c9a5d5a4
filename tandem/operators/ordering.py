"""Ordering, positions, shuffling, batching and sharding.

Dense positions (``row_number`` within a group) are computed without a
single-partition window and without sorting one group in one task, by one path
at every size:

1. rows are range-partitioned and sorted by (group, whole sort key), so a hot
   group or a hot leading key is spread over as many partitions as its share;
   each row's partition and its place in it are columns of a table written once
   to the shared folder: Spark samples range bounds anew for every execution, so
   only stored places are the same for every reader;
2. rows are counted per (group, partition) - a partial aggregate - and offsets
   are a running sum over that small table;
3. position = place + offset, by a join on (group, partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandem.session import stored

OrderSpec = str | tuple[str, bool]


def ensure_parallelism(df: DataFrame, key: str | None = None) -> DataFrame:
    """Repartition only when the plan would run on fewer partitions than the
    cluster's default parallelism (e.g. one large row group). Large inputs
    arrive in many splits and are left alone, so this costs no shuffle at scale."""
    spark = df.sparkSession
    want = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= want:
        return df
    n = max(want, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, key) if key else df.repartition(n)


def _spec(o: OrderSpec) -> tuple[str, bool]:
    return (o, True) if isinstance(o, str) else (o[0], bool(o[1]))


def sequence_index(df: DataFrame, order_by: Sequence[OrderSpec], partition_by: Sequence[str] = (),
                   name: str = "pos", start: int = 0, keep_bucket: str | None = None) -> DataFrame:
    """Dense index of each row in ``order_by`` within ``partition_by`` groups:
    ``row_number() over (partition by ... order by ...) - 1 + start``.

    ``order_by`` items are column names (ascending) or ``(name, ascending)``;
    they must form a total order (end with a unique key), which makes the
    result independent of partitioning and stable on recomputation. NULL and
    NaN stand where Spark's sort puts them. ``keep_bucket`` names an output
    column with the bucket: consecutive positions of a group, about one range
    partition of rows. Runs one job: it writes the ordered rows to the
    shared folder; the counts read only the group, place and bucket of that table."""
    groups = list(partition_by)
    keys = [F.col(c) for c in groups] + [F.col(c).asc() if asc else F.col(c).desc() for c, asc in map(_spec, order_by)]
    ranked = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_seq", F.monotonically_increasing_id()).withColumn("_bucket", F.spark_partition_id()), "ranked")
    sizes = ranked.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"), F.min("_seq").alias("_first"))
    before = Window.partitionBy(*groups).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(*[F.col(g).alias(f"_group{i}") for i, g in enumerate(groups)], F.col("_bucket").alias("_of"), (
        F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first") + start).alias("_shift"))
    same = F.col("_bucket") == F.col("_of")
    for i, g in enumerate(groups):  # a NULL group is a group
        same = same & F.col(g).eqNullSafe(F.col(f"_group{i}"))
    out = ranked.join(shifts, same).withColumn(name, (F.col("_seq") + F.col("_shift")).cast("long"))
    return out.select(*[F.col(c) for c in df.columns if c not in (name, keep_bucket)], name,
                      *([F.col("_bucket").alias(keep_bucket)] if keep_bucket else []))


# --- B1 ---------------------------------------------------------------------

def shuffle_key(seed, epoch, id_col) -> Column:
    """Reproducible per-epoch order key: md5 of 'seed:epoch:id'."""
    def c(x):
        return F.col(x) if isinstance(x, str) else (x if isinstance(x, Column) else F.lit(x))
    return F.md5(F.concat_ws(":", c(seed).cast("string"), c(epoch).cast("string"), c(id_col).cast("string")))


def epoch_order(df: DataFrame, id_col: str, split_col: str = "split", seed=0, epoch=0,
                name: str = "order_key") -> DataFrame:
    """B1: train rows are ordered by the seeded hash, other splits keep id order (ids
    are padded to 20 characters, longer ones stay whole)."""
    own = F.col(id_col).cast("string")
    key = F.when(F.col(split_col) == "train", shuffle_key(seed, epoch, id_col)).otherwise(
        F.lpad(own, F.greatest(F.lit(20), F.length(own)), F.lit("0")))
    return df.withColumn(name, key)


# --- B2 ---------------------------------------------------------------------

def make_batches(df: DataFrame, order_by: Sequence[OrderSpec], batch_size: int, grad_accum: int = 1,
                 partition_by: Sequence[str] = ()) -> DataFrame:
    """B2: consecutive batches of ``batch_size`` rows (last short batch kept) and
    the optimiser step each batch belongs to."""
    if batch_size < 1 or grad_accum < 1:
        raise ValueError("batch_size and grad_accum must be positive")
    pos = sequence_index(df, order_by, partition_by, name="pos")
    return (pos.withColumn("batch_id", F.floor(F.col("pos") / batch_size))
            .withColumn("opt_step", F.floor(F.col("batch_id") / grad_accum)))


# --- B3 ---------------------------------------------------------------------

def shard_rows(positioned: DataFrame, world: int, total: int, pos_col: str = "pos",
               colocate: bool = False) -> DataFrame:
    """Data-parallel assignment. The index list is padded by wrapping to a
    multiple of ``world``; padded position i goes to rank ``i % world``.

    ``positioned`` carries a dense 0-based ``pos`` over ``total`` rows (count
    the un-positioned input: a pruned scan). With fewer rows than ranks the list
    repeats until every rank has one; no rows give none.
    ``colocate`` puts each rank's rows in its own partition (one shuffle), the
    layout a per-rank reader wants.
    """
    if world < 1:
        raise ValueError("world must be positive")
    total = int(total)
    end = total + (-total) % world
    # Row p also stands at p + total, p + 2 total, ... below the padded end.
    turns = F.floor((F.lit(end - 1) - F.col(pos_col)) / F.lit(max(1, total)))
    allrows = positioned.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), turns))).withColumn(
        pos_col, F.col(pos_col) + F.col("_turn") * F.lit(total)).drop("_turn")
    out = (allrows.withColumn("rank", F.pmod(F.col(pos_col), F.lit(world)).cast("int"))
           .withColumn("rank_index", F.floor(F.col(pos_col) / world)))
    return out.repartitionByRange(world, "rank") if colocate else out


# --- B4 ---------------------------------------------------------------------

def seed_replicas(df: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """One copy of each row per seed, generated in place (no join)."""
    if not seeds:
        raise ValueError("at least one seed")
    return df.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
