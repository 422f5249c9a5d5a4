"""Dataset preparation: registry, filters, prompts, vocabulary and encoding."""
from types import SimpleNamespace

import numpy as np
import pytest
from sample_tables import SF001
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tandem.functions.text import render_prompt
from tandem.operators import prep
from tandem.sources import fixtures as fx


def test_unknown_dataset_raises(spark):
    with pytest.raises(ValueError):
        prep.load_split(spark, "zinc-250", "train", lambda s, p: None)


def test_eval_purpose_uses_fixed_split(spark):
    reader = lambda s, p: fx.samples_a(s, SF001) if p.startswith("lpm") else fx.samples_b(s, SF001)
    lpm = prep.load_split(spark, "lpm-24-extra", "train", reader, purpose="eval")
    assert {r.split for r in lpm.select("split").distinct().collect()} == {"validation"}
    chebi = prep.load_split(spark, "chebi-20", "whatever", reader, purpose="eval")
    assert {r.split for r in chebi.select("split").distinct().collect()} == {"test"}
    assert "SELFIES" in chebi.columns and "smiles" not in chebi.columns


def test_filter_keeps_nulls_and_only_family_a(spark):
    df = spark.createDataFrame([(1, ""), (2, None), (3, "x")], "doc_id long, selfies string")
    assert sorted(r.doc_id for r in prep.filter_nonempty_target(df, "A").collect()) == [2, 3]
    assert prep.filter_nonempty_target(df, "B").count() == 3


def test_prompt_template(spark):
    df = spark.createDataFrame([("a cat",), (None,)], "c string")
    got = [r[0] for r in df.select(render_prompt("c")).collect()]
    assert got[0] == "Task: Translate description to SELFIES representation.\nInput: a cat\nOutput:"
    assert got[1].endswith("Input: \nOutput:")
    assert [r[0] for r in df.select(render_prompt("c", add_instruction=False)).collect()] == ["a cat", ""]


def _small(spark):
    df = spark.createDataFrame([(1, "abca"), (2, ""), (3, "x" * 600), (4, "zé")], "doc_id long, text string")
    return df, prep.build_vocab(df, ["text"])


def test_vocab_ids(spark):
    _, v = _small(spark)
    ids = {r.token: (r.n, r.id) for r in v.collect()}
    assert ids["<pad>"][1] == 0 and ids["</s>"][1] == 1 and ids["<unk>"][1] == 2
    assert ids["x"] == (600, 3) and ids["a"] == (2, 4)  # count desc, then token asc
    assert ids["b"][1] < ids["c"][1] < ids["z"][1] < ids["é"][1]


def test_encode_truncate_pad_mask_and_round_trip(spark):
    df, v = _small(spark)
    enc = {r.doc_id: r for r in prep.encode(df, "doc_id", {"text": "labels"}, v, max_length=8).collect()}
    a = enc[1]
    assert len(a.labels) == 8 and a.labels[4] == 1 and a.labels[5:] == [0, 0, 0]
    assert a.labels_mask == [1, 1, 1, 1, 1, 0, 0, 0]
    x = enc[3]
    assert x.labels == [3] * 7 + [1] and x.labels_mask == [1] * 8  # truncated, eos kept last
    assert enc[2].labels == [1] + [0] * 7
    un = prep.encode(df, "doc_id", {"text": "ids"}, v, max_length=None)
    back = {r.doc_id: r.back for r in prep.decode_ids(un, "doc_id", "ids", v, "back").collect()}
    assert back == {1: "abca</s>", 2: "</s>", 3: "x" * 600 + "</s>", 4: "zé</s>"}


def test_unknown_token_and_masks(spark):
    _, v = _small(spark)
    df = spark.createDataFrame([(9, "aq")], "doc_id long, text string")
    r = prep.encode(df, "doc_id", {"text": "labels"}, v, max_length=5).first()
    assert r.labels == [4, 2, 1, 0, 0]
    masked, dmask = prep.mask_labels(F.col("labels"))
    row = df.sparkSession.createDataFrame([([4, 2, 1, 0, 0],)], "labels array<long>").select(
        masked.alias("m"), dmask.alias("d"), prep.shift_right(masked).alias("s")).first()
    assert row.m == [4, 2, 1, -100, -100] and row.d == [1, 1, 1, 0, 0] and row.s == [0, 4, 2, 1, 0]


def test_parquet_reader_prunes_split_partitions(spark, tmp_path):
    root = str(tmp_path / "datasets")
    fx.samples_a(spark, SF001).write.partitionBy("split").parquet(f"{root}/lpm-24-eval")
    df = prep.load_split(spark, "lpm-24", "ignored", prep.parquet_reader(root), purpose="eval")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(split" in plan and "validation" in plan
    assert {r.split for r in df.select("split").distinct().collect()} == {"validation"}
    assert df.count() == fx.samples_a(spark, SF001).where("split = 'validation'").count()


def test_missing_text_has_no_ids_or_mask(spark):
    _, v = _small(spark)
    df = spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")
    rows = {r.doc_id: r for r in prep.encode(df, "doc_id", {"text": "labels"}, v, max_length=6).collect()}
    assert rows[1].labels is None and rows[1].labels_mask is None
    assert rows[2].labels_mask == [1, 1, 1, 0, 0, 0]


def test_lookup_of_any_tokenizer_in_chunks(spark):
    """The lookup for tokens that are no characters: chunks of rows, unknown tokens, NULL and empty texts, and a token
    that every row holds; equal to the character table where both apply."""
    from tandem.functions.text import char_tokens, word_tokens

    words = [f"w{i}" for i in range(30)]
    data = [(i, " ".join(["all", *(words[(i * k) % 30] for k in range(1, 1 + i % 6)), "zz" * (i % 2)])) for i in range(70)]
    data += [(100, None), (101, ""), (102, "  "), (103, "unknown all")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    v = prep.build_vocab(df.where("doc_id < 70"), ["text"], word_tokens)
    ids = {r.token: r.id for r in v.collect()}
    toks = {i: None if t is None else [w for w in t.split(" ") if w] for i, t in data}
    cols = df.select("*", word_tokens("text").alias("toks"))
    for chunk_rows in (4096, 5):
        got = {r.doc_id: r.ids for r in prep.lookup_sequences(cols, "doc_id", {"toks": "ids"}, v, "token", "id", 2, chunk_rows).collect()}
        assert got == {i: None if t is None else [ids.get(w, 2) for w in t] for i, t in toks.items()}
    enc = prep.encode(df, "doc_id", {"text": "ids"}, v, max_length=None, tokenizer=word_tokens)
    back = {r.doc_id: r.back for r in prep.decode_ids(enc, "doc_id", "ids", v, "back", word_tokens, " ").collect()}
    assert back[103] == "<unk> all </s>" and back[100] is None and back[101] == back[102] == "</s>"
    chars = prep.build_vocab(df, ["text"])
    by_table = {r.doc_id: r.x for r in prep.encode(df, "doc_id", {"text": "x"}, chars, max_length=9).collect()}
    other = lambda c: char_tokens(c)  # noqa: E731 - not the character tokenizer itself: goes through the join
    by_join = {r.doc_id: r.x for r in prep.encode(df, "doc_id", {"text": "x"}, chars, max_length=9, tokenizer=other).collect()}
    assert by_table == by_join


def test_ids_outside_the_vocabulary(spark):
    _, v = _small(spark)
    df = spark.createDataFrame([(1, [4, 99, -5, 1]), (2, None), (3, [])], "doc_id long, ids array<long>")
    assert {r.doc_id: r.t for r in prep.decode_ids(df, "doc_id", "ids", v, "t").collect()} == {1: "a<unk><unk></s>", 2: None, 3: ""}


def test_declared_schema_is_checked_at_load(spark, tmp_path):
    good = fx.samples_a(spark, SF001)
    load = lambda df, name="lpm-24": prep.load_split(spark, name, "train", lambda s, p: df)
    assert load(good).columns == ["doc_id", "split", "selfies", "caption", "smiles"]
    assert load(good.drop("smiles").withColumn("more", F.lit(1))).columns == ["doc_id", "split", "selfies", "caption"]
    bad = good.drop("caption").withColumn("selfies", F.lit(1)).withColumn("doc_id", F.lit(1.5)).withColumn("smiles", F.array(F.lit("x")))
    with pytest.raises(ValueError) as err:
        load(bad)
    text = str(err.value)
    assert "'lpm-24'" in text and "caption: missing" in text and "selfies: int, not string" in text
    assert "doc_id: double" in text and "smiles: array<string>" in text
    with pytest.raises(ValueError, match=r"SELFIES: missing \(there is selfies\)"):
        load(good, "chebi-20")
    # a typed id of a stored dataset, with the split pruned as a partition
    root = str(tmp_path / "typed")
    good.withColumn("doc_id", F.col("doc_id").cast("string")).write.partitionBy("split").parquet(f"{root}/lpm-24")
    df = prep.load_split(spark, "lpm-24", "test", prep.parquet_reader(root))
    assert dict(df.dtypes)["doc_id"] == "string" and "PartitionFilters: [isnotnull(split" in df._jdf.queryExecution().executedPlan().toString()


def test_character_codecs_pass_batches_on_in_pieces(spark, monkeypatch):
    """What is made of a batch is many times its size, so it leaves in pieces, whatever the batch."""
    import pyarrow as pa

    sizes = []

    class Rows:
        columns, schema = ["t"], T.StructType([T.StructField("t", T.StringType())])

        def mapInArrow(self, run, schema):
            self.schema = schema
            sizes.extend(b.num_rows for b in run([pa.record_batch({"t": ["é" * 1000, None, "", "b" * 4000] * 25})]))
            return self

    table = np.full(prep.CODE_POINTS, 2, dtype=np.int32)
    monkeypatch.setattr(prep, "PIECE_SIZE", 10_000)
    prep._char_ids(Rows(), {"t": "ids"}, SimpleNamespace(value=table))
    assert sum(sizes) == 100 and max(sizes) < 10


def test_lookup_moves_its_rows_once(spark):
    """The rows go through one shuffle, which both the chunks' questions and their answers read."""
    df = spark.createDataFrame([(i, None if i == 7 else "a b" * (i % 3)) for i in range(20)], "id long, text string")
    v = spark.createDataFrame([("a", 3), ("b", 4), ("ba", 5)], "token string, id long")
    out = prep.encode(df, "id", {"text": "ids"}, v, max_length=None, tokenizer=lambda c: F.filter(F.split(c, " "), lambda w: w != ""))
    got = {r.id: r.ids for r in out.collect()}
    assert got == {i: None if i == 7 else [[1], [3, 4, 1], [3, 5, 4, 1]][i % 3] for i in range(20)}
    assert "ReusedExchange" in out._jdf.queryExecution().executedPlan().toString()
