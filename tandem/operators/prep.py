"""Dataset preparation: split loading, column families, filtering, prompts,
vocabulary and sequence encoding (S1, P1-P3, T1-T7).

Character tokens are looked up in a table indexed by code point: its size is
that of Unicode, whatever the data, so it travels to the tasks, and whole Arrow
batches are encoded by one gather. Tokens of any other tokenizer meet the
vocabulary in a join: each chunk of rows asks once for each of its tokens, and
the answers come back to the chunk as its own small dictionary.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.groups import pieces
from tandem.functions.text import EOS_ID, EOS_TOKEN, PAD_ID, PAD_TOKEN, UNK_ID, UNK_TOKEN, char_tokens
from tandem.operators.ordering import ensure_parallelism, sequence_index
from tandem.session import stored

CODE_POINTS = 0x110000  # of Unicode: the bound of a character vocabulary
CHUNK_ROWS = 4096  # rows that share one dictionary in a lookup
PIECE_SIZE = 1 << 20  # bytes of text, or ids, that one step of a character codec turns over

# --- Fixed values: dataset registry and column families ---
# Family A (caption sets): target 'selfies', caption 'caption', source 'smiles'.
# Family B (description sets): target 'SELFIES', caption 'description', source 'smiles'.
FAMILY_COLUMNS = {
    "A": ("selfies", "caption", "smiles"),
    "B": ("SELFIES", "description", "smiles"),
}
# Label id that the loss ignores.
IGNORE_INDEX = -100
# Sequence length for inputs and targets.
MAX_LENGTH = 512
# --- end of fixed values ---


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    family: str
    train_path: str
    eval_path: str
    eval_split: str
    id_col: str = "doc_id"


# Training names each have their own data; both caption-set names share one
# evaluation set, read from its 'validation' split; the description set is
# evaluated on its 'test' split.
DATASETS = {
    "lpm-24": DatasetSpec("lpm-24", "A", "lpm-24", "lpm-24-eval", "validation"),
    "lpm-24-extra": DatasetSpec("lpm-24-extra", "A", "lpm-24-extra", "lpm-24-eval", "validation"),
    "chebi-20": DatasetSpec("chebi-20", "B", "chebi-20", "chebi-20", "test"),
}

Reader = Callable[[SparkSession, str], DataFrame]


def split_schema(spec: DatasetSpec, id_type: T.DataType | None = None) -> T.StructType:
    """The declared schema of a dataset's rows: its id, split, target and caption; the source column is optional."""
    target, caption, _ = FAMILY_COLUMNS[spec.family]
    return T.StructType([T.StructField(spec.id_col, id_type or T.LongType()), T.StructField("split", T.StringType()),
                         T.StructField(target, T.StringType()), T.StructField(caption, T.StringType())])


def check_schema(df: DataFrame, spec: DatasetSpec, path: str) -> None:
    """Raise one clear error that names every missing column and every column of a wrong type. Only the schema is
    read. An id may be any whole number or string."""
    wrong = []
    optional = T.StructField(FAMILY_COLUMNS[spec.family][2], T.StringType())
    have = {f.name: f.dataType for f in df.schema.fields}
    for f in [*split_schema(spec).fields, *([optional] if optional.name in have else [])]:
        if f.name not in have:
            near = [c for c in have if c.lower() == f.name.lower()]
            wrong.append(f"{f.name}: missing" + (f" (there is {near[0]})" if near else ""))
        elif f.name == spec.id_col:
            if not isinstance(have[f.name], (T.IntegralType, T.StringType)):
                wrong.append(f"{f.name}: {have[f.name].simpleString()}, not a whole number or string")
        elif have[f.name] != f.dataType:
            wrong.append(f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
    if wrong:
        raise ValueError(f"dataset {spec.name!r} at {path!r} does not have its declared schema: " + "; ".join(wrong))


def parquet_reader(root: str) -> Reader:
    """Datasets stored as ``{root}/{path}/split=.../*.parquet``: the split
    filter prunes partitions, the select prunes columns."""
    def read(spark: SparkSession, path: str) -> DataFrame:
        return spark.read.parquet(f"{root.rstrip('/')}/{path}")
    return read


def resolve(dataset: str) -> DatasetSpec:
    try:
        return DATASETS[dataset]
    except KeyError:
        raise ValueError(f"unknown dataset {dataset!r}; choose one of {sorted(DATASETS)}") from None


def load_split(spark: SparkSession, dataset: str, split: str, reader: Reader,
               purpose: str = "train") -> DataFrame:
    """Rows of one split in the dataset's own column family, whose schema is checked first.

    ``purpose='eval'`` reads the evaluation set and its fixed split (the
    ``split`` argument is then ignored, as in the evaluation job)."""
    spec = resolve(dataset)
    if purpose == "eval":
        path, split = spec.eval_path, spec.eval_split
    elif purpose == "train":
        path = spec.train_path
    else:
        raise ValueError("purpose must be 'train' or 'eval'")
    df = reader(spark, path)
    check_schema(df, spec, path)
    source = FAMILY_COLUMNS[spec.family][2]
    cols = split_schema(spec).names + ([source] if source in df.columns else [])
    return df.where(F.col("split") == split).select(*cols)


# --- P1 / P2 / P3 -------------------------------------------------------------

def filter_nonempty_target(df: DataFrame, family: str) -> DataFrame:
    """Family A drops rows whose target is exactly ''; NULL targets stay
    (a missing value is not equal to ''). Family B is not filtered."""
    if family != "A":
        return df
    target = FAMILY_COLUMNS["A"][0]
    return df.where(~F.col(target).eqNullSafe(""))


def normalise_columns(df: DataFrame, family: str, id_col: str = "doc_id") -> DataFrame:
    """Family columns to (id, family, split, target, caption, source);
    a missing source column becomes ''."""
    target, caption, source = FAMILY_COLUMNS[family]
    src = F.col(source) if source in df.columns else F.lit("")
    extra = ["split"] if "split" in df.columns else []
    return df.select(F.col(id_col).alias("id"), F.lit(family).alias("family"), *extra,
                     F.col(target).alias("target"), F.col(caption).alias("caption"), src.alias("source"))


# --- T2 vocabulary -------------------------------------------------------------

def build_vocab(texts: DataFrame, text_cols: list[str], tokenizer: Callable[[Column], Column] = char_tokens) -> DataFrame:
    """(token, n, id): ids 0/1/2 are pad/eos/unk, then tokens by count
    desc, token asc. Counting is a partial aggregate; ids come from a range
    sort with per-partition offsets, not a single-partition window."""
    toks = None
    texts = ensure_parallelism(texts.select(*text_cols))
    for c in text_cols:
        part = texts.select(F.explode(tokenizer(F.col(c))).alias("token"))
        toks = part if toks is None else toks.unionByName(part)
    counts = stored(toks.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "tokens")
    learned = sequence_index(counts, [("n", False), ("token", True)], name="id", start=3)
    spark = texts.sparkSession
    specials = spark.createDataFrame(
        [(PAD_TOKEN, 0, PAD_ID), (EOS_TOKEN, 0, EOS_ID), (UNK_TOKEN, 0, UNK_ID)], "token string, n long, id long")
    return stored(specials.unionByName(learned.select("token", "n", "id")), "vocabulary")


def lookup_sequences(df: DataFrame, id_col: str, seqs: dict[str, str], vocab: DataFrame, key: str,
                     value: str, default, chunk_rows: int = CHUNK_ROWS, rows: int | None = None,
                     made: dict[str, Column] | None = None) -> DataFrame:
    """Map every element of each array column ``seq -> out`` through a
    vocabulary of any size, keeping element order; elements without an entry
    get ``default``. NULL arrays give NULL, empty arrays give empty arrays.

    Rows are dealt to chunks of about ``chunk_rows`` by the hash of ``id_col``
    (unique), in the one shuffle that carries them; the columns ``made`` (e.g.
    the tokens of a text) are computed after it. Each chunk names its distinct
    elements where it lies, these are joined with the vocabulary, so a frequent
    element is one row per chunk; chunk and dictionary then meet, and whole
    columns are mapped by one take. ``rows``: how many there are, if known;
    else they are counted, which computes ``df`` once more."""
    chunks = max(1, -(-(df.count() if rows is None else rows) // chunk_rows))
    base = df.withColumn("_chunk", F.pmod(F.xxhash64(id_col), F.lit(chunks)).cast("int")).repartition("_chunk").sortWithinPartitions("_chunk")
    base = base.withColumns(made or {})
    element = base.schema[next(iter(seqs))].dataType.elementType

    def name(t: pa.Table) -> pa.Table:
        parts = [part.flatten() for c in seqs for part in t.column(c).chunks]
        there = pc.unique(pa.chunked_array(parts, parts[0].type)).drop_null()
        return pa.table({"_chunk": pa.array([t.column("_chunk")[0].as_py()] * len(there), pa.int32()), "_k": there})

    # The digest takes all columns, so that both readers of the rows need the same shuffle and share it.
    lists = base.select("_chunk", *seqs, F.xxhash64(*[c for c in df.columns if c not in seqs]).alias("_rest"))
    asked = lists.groupBy("_chunk").applyInArrow(name, T.StructType([T.StructField("_chunk", T.IntegerType()), T.StructField("_k", element)]))
    side = vocab.select(F.col(key).alias("_k"), F.col(value).alias("_v")).where("_v is not null")
    found = asked.join(side, "_k").select(F.col("_chunk").alias("_of"), "_k", "_v")
    kept = [f for f in base.schema.fields if f.name != "_chunk" and f.name not in (made or {})]
    names = [*[f.name for f in kept], *seqs.values()]
    of_value = vocab.schema[value].dataType
    schema = T.StructType([*kept, *[T.StructField(out, T.ArrayType(of_value)) for out in seqs.values()]])

    def fill(rows: pa.Table, words: pa.Table) -> pa.Table:
        keys, values = (words.column(c).combine_chunks() for c in ("_k", "_v"))
        for src, out in seqs.items():
            col = rows.column(src).combine_chunks()
            flat = col.flatten()  # elements of the lists that are there
            at = pc.index_in(flat, keys.cast(flat.type)) if len(flat) else pa.array([], pa.int32())
            mapped = pc.fill_null(values.take(at), pa.scalar(default, values.type)) if len(keys) else pa.array([default] * len(flat), values.type)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(col), 0).to_numpy())]).astype(np.int32)
            rows = rows.append_column(out, pa.ListArray.from_arrays(pa.array(ends), mapped, mask=col.is_null()))
        return rows.select(names)

    return base.groupBy("_chunk").cogroup(found.groupBy("_of")).applyInArrow(fill, schema)


# --- T3 - T7 ---------------------------------------------------------------------

def finish_ids(ids: Column, max_length: int | None = MAX_LENGTH, pad: bool = True) -> Column:
    """Append eos; with ``max_length`` truncate so that eos stays last, then
    right-pad with the pad id."""
    if max_length is None:
        return F.concat(ids, F.array(F.lit(EOS_ID).cast("long")))
    body = F.slice(ids, 1, max_length - 1)
    full = F.concat(body, F.array(F.lit(EOS_ID).cast("long")))
    if not pad:
        return full
    fill = F.greatest(F.lit(0), F.lit(max_length) - F.size(full))
    return F.concat(full, F.array_repeat(F.lit(PAD_ID).cast("long"), fill))


def attention_mask(n_real: Column, max_length: int) -> Column:
    """1 for the real tokens (including eos), 0 for padding."""
    return F.concat(F.array_repeat(F.lit(1), n_real),
                    F.array_repeat(F.lit(0), F.greatest(F.lit(0), F.lit(max_length) - n_real)))


def _code_points(vocab: DataFrame, wanted: str) -> Broadcast:
    """The vocabulary of a character tokenizer as an array: ``wanted = 'id'``: id by code point (unknown where none);
    ``'token'``: token by id. It has one entry per code point at most (and the special tokens), which bounds it."""
    if wanted == "id":
        got = vocab.where(F.length("token") == 1).select("id", "token").toPandas()
        table = np.full(CODE_POINTS, UNK_ID, dtype=np.int32)
        table[[ord(t) for t in got["token"]]] = got["id"]
    else:
        got = vocab.select("id", "token").sort("id").toPandas()
        table = got["token"].to_numpy()
        if len(table) > CODE_POINTS + UNK_ID + 1 or (got["id"].to_numpy() != np.arange(len(got))).any():
            raise ValueError("not the vocabulary of a character tokenizer")
    return vocab.sparkSession.sparkContext.broadcast(table)


def _in_pieces(df: DataFrame, columns: dict[str, str], of: T.DataType, load: Callable[[], Callable[[pa.Array], pa.Array]],
               size: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """``df`` with a column ``out`` for each ``src -> out``, made by the function that ``load`` gives once per task. A
    batch is passed on in pieces of about ``PIECE_SIZE`` elements of the sources: what is made of it is many times its
    size."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = load()
        for batch in batches:
            sizes = sum(pc.fill_null(size(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
            for piece in pieces(batch, sizes, PIECE_SIZE):
                yield pa.record_batch({**{c: piece.column(c) for c in names}, **{out: made(piece.column(c)) for c, out in columns.items()}})

    return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(out, of) for out in columns.values()]]))


def _char_ids(df: DataFrame, columns: dict[str, str], table: Broadcast) -> DataFrame:
    def load():
        def ids(texts: pa.Array) -> pa.Array:
            there = pc.fill_null(texts, "")
            points = np.frombuffer("".join(there.to_pylist()).encode("utf-32-le"), dtype=np.uint32)
            ends = np.concatenate([[0], np.cumsum(pc.utf8_length(there).to_numpy())]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(ends), pa.array(table.value[points]), mask=texts.is_null())
        return ids
    return _in_pieces(df, columns, T.ArrayType(T.IntegerType()), load, pc.binary_length)


def _ids_chars(df: DataFrame, columns: dict[str, str], table: Broadcast) -> DataFrame:
    def load():
        tokens = pa.array(table.value, pa.string())

        def text(ids: pa.Array) -> pa.Array:
            at = ids.flatten().to_numpy(zero_copy_only=False)
            at = np.where((at >= 0) & (at < len(tokens)), at, UNK_ID).astype(np.int64)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy())]).astype(np.int32)
            return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends), tokens.take(pa.array(at)), mask=ids.is_null()), "")
        return text
    return _in_pieces(df, columns, T.StringType(), load, pc.list_value_length)


def encode(df: DataFrame, id_col: str, text_cols: dict[str, str], vocab: DataFrame,
           max_length: int | None = MAX_LENGTH, tokenizer: Callable[[Column], Column] = char_tokens,
           rows: int | None = None) -> DataFrame:
    """T3 (``max_length`` set: truncate with eos last, pad, mask) / T4
    (``max_length=None``: ids + eos only). For each ``text_col -> out_col``
    adds ``out_col`` and ``out_col + '_mask'``.

    Character tokens: a gather by code point in each Arrow batch (no shuffle).
    Tokens of another tokenizer: one lookup for all columns (``rows``: how many rows ``df`` has, if known)."""
    if tokenizer is char_tokens and max_length is not None:
        # One id per character: what truncation drops needs no lookup.
        whole = [f"_whole{k}" for k in range(len(text_cols))]
        df = df.select("*", *[F.col(c).alias(w) for c, w in zip(text_cols, whole, strict=True)]).withColumns(
            {c: F.substring(c, 1, max_length - 1) for c in text_cols})
    else:
        whole = []
    if tokenizer is char_tokens:
        # CPU-bound per-row work: spread rows if the input arrives in few splits.
        out = _char_ids(ensure_parallelism(df, id_col), {c: f"_ids{k}" for k, c in enumerate(text_cols)}, _code_points(vocab, "id"))
    else:
        toks = {f"_toks{k}": tokenizer(F.col(c)) for k, c in enumerate(text_cols)}
        out = lookup_sequences(df, id_col, {t: f"_ids{k}" for k, t in enumerate(toks)}, vocab, "token", "id",
                               UNK_ID, rows=rows, made=toks)
    for k, (text_col, out_col) in enumerate(text_cols.items()):
        raw = F.col(f"_ids{k}").cast("array<long>")
        out = out.withColumn(out_col, finish_ids(raw, max_length))
        if max_length is None:
            mask = F.array_repeat(F.lit(1), F.size(raw) + 1)
        else:
            mask = attention_mask(F.least(F.size(raw) + 1, F.lit(max_length)), max_length)
        # a missing text has no ids and no mask (not an all-padding row)
        out = out.withColumn(out_col + "_mask", F.when(raw.isNotNull(), mask))
    if whole:
        out = out.withColumns({c: F.col(w) for c, w in zip(text_cols, whole, strict=True)}).drop(*whole)
    return out.drop(*[f"_ids{k}" for k in range(len(text_cols))])


def mask_labels(labels: Column, pad_id: int = PAD_ID) -> tuple[Column, Column]:
    """T5: (masked labels with pad -> -100, decoder mask taken before masking)."""
    masked = F.transform(labels, lambda x: F.when(x == pad_id, F.lit(IGNORE_INDEX)).otherwise(x))
    dmask = F.transform(labels, lambda x: F.when(x != pad_id, 1).otherwise(0))
    return masked, dmask


def shift_right(labels: Column, start_id: int = PAD_ID, pad_id: int = PAD_ID) -> Column:
    """Decoder inputs = [start] + labels[:-1], with -100 replaced by pad."""
    shifted = F.concat(F.array(F.lit(start_id).cast("long")),
                       F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))))
    return F.transform(shifted, lambda x: F.when(x == IGNORE_INDEX, F.lit(pad_id).cast("long")).otherwise(x))


def decode_ids(df: DataFrame, id_col: str, ids_col: str, vocab: DataFrame, out_col: str,
               tokenizer: Callable[[Column], Column] = char_tokens, separator: str = "", rows: int | None = None) -> DataFrame:
    """Ids back to text with special tokens kept (clean with P4 after),
    tokens joined by ``separator``. By the way of ``encode`` for the tokenizer."""
    if tokenizer is char_tokens and not separator:
        return _ids_chars(ensure_parallelism(df, id_col).drop(out_col), {ids_col: out_col}, _code_points(vocab, "token"))
    looked = lookup_sequences(df, id_col, {ids_col: "_toks"}, vocab, "id", "token", UNK_TOKEN, rows=rows)
    return looked.withColumn(out_col, F.array_join("_toks", separator)).drop("_toks")
