"""Metric properties, partition independence, streaming = batch, edge rows."""
import random

import pytest
from sample_tables import SF001
from pyspark.sql import functions as F

from tandem.functions.ngrams import edit_distances, pair_counts
from tandem.functions.text import letters_canonical
from tandem.operators import evaluate as ev
from tandem.plans.queries import prepared_pairs

SCHEMA = "pair_id long, variant int, caption string, gt_raw string, pred_raw string"


def _report(spark, rows, canon=None):
    df = spark.createDataFrame(rows, SCHEMA)
    return ev.eval_report(ev.prepare_pairs(df, canonicalise=canon, keep=("pair_id", "variant"))).first()


def test_bleu_of_identical_corpus_is_one(spark):
    rows = [(i, 0, "c", t, t) for i, t in enumerate(["hello world", "a longer sentence here", "xyz w"])]
    r = _report(spark, rows)
    assert r.bleu_smi == 1.0 and r.bleu_self == 1.0 and r.exact_match == 1.0 and r.levenshtein_smi == 0.0
    assert r.maccs_sims == 1.0 and r.rdk_sims == 1.0 and r.morgan_sims == 1.0 and r.validity == 1.0


def test_edge_rows(spark):
    rows = [
        (1, 0, "c", "abc", "<p<unk>ad></s>"),        # nested special token -> '' -> bad
        (2, 0, "c", "", "something"),                # reference invalid only -> gt_dropped
        (3, 0, "c", "ab", "ab"),                     # shorter than 4 characters
        (4, 0, "c", "café \U0001F600", "<pad>café \U0001F600</s>"),  # accents and emoji
        (5, 0, None, None, None),                    # nulls everywhere
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    prep = ev.prepare_pairs(df, keep=("pair_id",))
    status = {r.pair_id: r.status for r in prep.collect()}
    assert status == {1: "bad", 2: "gt_dropped", 3: "kept", 4: "kept", 5: "bad"}
    r = ev.eval_report(prep).first()
    assert r.n_total == 5 and r.n_bad == 2 and r.validity == 0.6 and r.exact_match == 1.0
    # 'ab' has no 3- or 4-grams but still adds 1 to those denominators
    assert r.bleu_smi == round(brute_bleu([("ab", "ab"), ("café \U0001F600", "café \U0001F600")]), 6)


def test_nothing_kept_reports_zero_but_validity(spark):
    r = _report(spark, [(1, 0, "c", "abc", "<pad>"), (2, 0, "c", "", "x")])
    assert r.n_kept == 0 and r.validity == 0.5
    assert (r.bleu_smi, r.bleu_self, r.exact_match, r.levenshtein_smi, r.maccs_sims, r.rdk_sims,
            r.morgan_sims) == (0.0,) * 7


def test_unicode_strip_and_nested_tokens(spark):
    df = spark.createDataFrame([("  <pad>x</s>\t\n",), ("<p<unk>ad>",), ("<<pad>unk>",)], "s string")
    from tandem.functions.text import clean_generated
    got = [r[0] for r in df.select(clean_generated("s")).collect()]
    assert got == ["x", "", "<unk>"]  # '<unk>' is removed before '<pad>', as the sequence demands


def test_partition_independence(spark):
    p = prepared_pairs(spark, SF001)
    base = ev.eval_report(p).first()
    for n in (1, 17):
        assert ev.eval_report(p.repartition(n)).first() == base


def test_tanimoto_symmetric_and_python_native_agree(spark):
    random.seed(3)
    words = ["an", "the", "tion", "x", "été"]
    pairs = [(" ".join(random.choices(words, k=random.randint(0, 12))),
              " ".join(random.choices(words, k=random.randint(0, 12)))) for _ in range(40)]
    widths = {167: (1, 2), 2048: (1, 2, 3, 4, 5, 6, 7)}
    left, right = zip(*pairs)
    _, fps = pair_counts(left, right, 0, widths)
    _, back = pair_counts(right, left, 0, widths)
    assert all((fps[w] == back[w]).all() for w in widths)
    df = spark.createDataFrame(pairs, "gt_can string, pred_can string")
    native = ev.with_bit_tanimoto(df, F.lit(True)).collect()
    for k, row in enumerate(native):
        assert row.bits_small == pytest.approx(fps[167][k]) and row.bits_large == pytest.approx(fps[2048][k])


def brute_bleu(pairs):
    """Corpus BLEU, 1..4-grams, one reference, no smoothing (independent form)."""
    import math
    num, den, hl, rl = [0] * 4, [0] * 4, 0, 0
    for hyp, ref in pairs:
        hl, rl = hl + len(hyp), rl + len(ref)
        for n in range(1, 5):
            hg = [hyp[i:i + n] for i in range(len(hyp) - n + 1)]
            rg = [ref[i:i + n] for i in range(len(ref) - n + 1)]
            num[n - 1] += sum(min(hg.count(g), rg.count(g)) for g in set(hg))
            den[n - 1] += max(1, len(hg))
    if num[0] == 0:
        return 0.0
    bp = 1.0 if hl > rl else (0.0 if hl == 0 else math.exp(1 - rl / hl))
    ps = [(a / b) if a else 2.2250738585072014e-308 for a, b in zip(num, den)]
    return bp * math.exp(sum(math.log(p) for p in ps) / 4)


def test_bleu_against_brute_force(spark):
    random.seed(5)
    words = ["ab", "c", "tion", "de", "fgh"]
    rows, pairs = [], []
    for i in range(60):
        ref = " ".join(random.choices(words, k=random.randint(1, 8)))
        hyp = " ".join(random.choices(words, k=random.randint(1, 8)))
        rows.append((i, 0, "c", ref, hyp))
        pairs.append((hyp, ref))
    assert _report(spark, rows).bleu_self == round(brute_bleu(pairs), 6)


def _dp(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i] + [0] * len(b)
        for j, cb in enumerate(b, 1):
            cur[j] = min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb))
        prev = cur
    return prev[-1]


def test_edit_distance_matches_dp_and_spark(spark):
    random.seed(7)
    cases = [("".join(random.choices("abé\U0001F600 c", k=random.randint(0, 40))),
              "".join(random.choices("abé\U0001F600 c", k=random.randint(0, 90)))) for _ in range(300)]
    cases += [("a" * 300, "a" * 299 + "b"), ("x" * 64, "x" * 65), ("", "y" * 200), ("ab" * 100, "ba" * 100), ("", "")]
    left, right = zip(*cases)
    want = [_dp(a, b) for a, b in cases]
    for words in (1 << 13, 3):  # one group, and groups of few pairs
        assert edit_distances(left, right, words).tolist() == want
    df = spark.createDataFrame(cases, "a string, b string")
    assert [r[0] for r in df.select(F.levenshtein("a", "b")).collect()] == want


def test_clipped_matches_brute_force():
    random.seed(11)
    text = lambda: "".join(random.choices("abcé\U0001F600", k=random.randint(0, 12)))
    hyps, refs = [text() for _ in range(200)], [text() for _ in range(200)]
    matches, _ = pair_counts(hyps, refs, 4)
    for k, (h, r) in enumerate(zip(hyps, refs)):
        for n in range(1, 5):
            hg = [h[i:i + n] for i in range(len(h) - n + 1)]
            rg = [r[i:i + n] for i in range(len(r) - n + 1)]
            assert matches[n - 1, k] == sum(min(hg.count(g), rg.count(g)) for g in set(hg))


def test_slices_of_pairs_do_not_change_counts(spark, monkeypatch):
    p = prepared_pairs(spark, SF001)
    want = ev.eval_report(p).first()
    monkeypatch.setattr(ev, "SLICE_ROWS", 3)
    assert ev.eval_report(p).first() == want


def _keyed(spark):
    """Pairs with identity keys: equal keys of different texts, different keys of equal texts, missing keys, and
    pairs that are bad or dropped whatever their keys."""
    rows = [(1, "one text", "one  text", "k1", "k1"), (2, "same", "same", "k2", "k3"), (3, "abc", "abd", None, "k4"),
            (4, "abc", "abc", "k5", None), (5, "abcdef", "abcxef", "k6", "k7"), (6, "x", "", "k8", None), (7, "", "y", None, "k9"),
            (8, "abc", "abc", None, None)]
    df = spark.createDataFrame([(i, "c", g, p, a, b, i % 2) for i, g, p, a, b in rows],
                               "pair_id long, caption string, gt_raw string, pred_raw string, gk string, pk string, side int")
    return ev.prepare_pairs(df, keep=("pair_id", "side"), identity=("gk", "pk"))


def test_pairs_that_raise(spark):
    p = _keyed(spark)
    assert {r.pair_id: (r.status, r.same, r.raised) for r in p.collect()} == {
        1: ("kept", True, False), 2: ("kept", False, False), 3: ("kept", False, True), 4: ("kept", False, True),
        5: ("kept", False, False), 6: ("bad", False, False), 7: ("gt_dropped", False, False), 8: ("kept", False, True)}
    r = ev.eval_report(p).first()
    assert (r.n_total, r.n_bad, r.n_kept, r.n_raised) == (8, 1, 6, 3)
    assert r.validity == round(1 - 4 / 8, 6) and r.exact_match == round(1 / 6, 6)
    assert r.levenshtein_smi == round((1 + 0 + 1 + 0 + 1 + 0) / 6, 6)
    _, fps = pair_counts(["one  text", "same", "abcxef"], ["one text", "same", "abcdef"], 0, {167: (1, 2), 2048: (1, 2, 3, 4, 5, 6, 7)})
    assert r.maccs_sims == round(fps[167].mean(), 6) and r.rdk_sims == round(fps[2048].mean(), 6)
    e = ev.exact_match(p).first()
    assert (e.n_kept, e.n_raised, e.exact_match) == (6, 3, r.exact_match)
    by = {g.side: g for g in ev.eval_report_by_group(p, "side").collect()}
    assert (by[None].n_raised, by[0].n_raised, by[1].n_raised) == (3, 2, 1) and by[None].validity == r.validity
    only = ev.eval_report(p.where("raised")).first()
    assert (only.maccs_sims, only.morgan_sims, only.validity) == (0.0, 0.0, 0.0) and only.levenshtein_smi == round(1 / 3, 6)


def test_group_report_total_equals_overall(spark):
    p = prepared_pairs(spark, SF001)
    by = {r.variant: r for r in ev.eval_report_by_group(p, "variant").collect()}
    total = by[None]
    assert total.is_total == 1
    overall = ev.eval_report(p).first()
    for k in ("bleu_smi", "bleu_self", "exact_match", "levenshtein_smi", "validity", "maccs_sims",
              "rdk_sims", "morgan_sims"):
        assert total[k] == overall[k]
    assert sum(r.n_total for v, r in by.items() if v is not None) == overall.n_total




def test_letters_canonical_spark(spark):
    df = spark.createDataFrame([("  Hello,  WORLD 42 ",), ("123",)], "s string")
    assert [r[0] for r in df.select(letters_canonical(F.col("s"))).collect()] == ["hello world", ""]


def test_native_and_arrow_ngram_counts_agree(spark):
    p = ev.spread(prepared_pairs(spark, SF001).where("status = 'kept'"), "pair_id").select(
        "pair_id", "pred_self", "gt_self")
    nat = {r.pair_id: tuple(r[1:]) for r in ev.clipped_matches_native(p, "pair_id", "pred_self", "gt_self").collect()}
    arrow = ev.with_clipped_matches(p, [("x", "pred_self", "gt_self")]).collect()
    assert arrow and all(nat.get(r.pair_id, (0, 0, 0, 0)) == (r.x_m1, r.x_m2, r.x_m3, r.x_m4) for r in arrow)


def test_gram_hashes_are_md5_and_are_not_kept():
    """The digests by arrays are md5's for any script and length; nothing stays in a worker after a slice."""
    import hashlib
    import tracemalloc

    import numpy as np

    from tandem.functions import ngrams

    text = "aé漢😀" * 20 + "plain text"
    for n in (1, 2, 7, 13, 30):
        at = np.arange(len(text) - n + 1)
        assert ngrams.GramHashes(text)(at, n).tolist() == [int(hashlib.md5(text[i:i + n].encode()).hexdigest()[:7], 16) for i in at]
    rng = random.Random(1)
    slices = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=5000))] for _ in range(4)]
    tracemalloc.start()
    for one in slices:
        pair_counts(one, one, 0, {2048: (5, 6, 7)})
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held < 1_000_000


def test_batches_leave_in_pieces():
    import pyarrow as pa

    batch = pa.record_batch({"a": ["x" * (ev.PIECE_BYTES // 2)] * 4 + [None], "b": ["y"] * 5})
    cut = list(ev._pieces(batch, ["a", "b"]))
    assert [p.num_rows for p in cut] == [1, 1, 1, 2]
    assert pa.Table.from_batches(cut).equals(pa.Table.from_batches([batch]))


def test_scoring_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """However large the input, a task gets about TASK_BYTES of it; one that is joined with itself counts once."""
    path = str(tmp_path / "t")
    spark.range(200_000).selectExpr("id AS pair_id", "md5(string(id)) AS t").write.parquet(path)
    monkeypatch.setattr(ev, "SPREAD_BYTES", 1, raising=False)
    monkeypatch.setattr(ev, "TASK_BYTES", 1 << 16, raising=False)
    df = spark.read.parquet(path)
    size = sum(f.stat().st_size for f in (tmp_path / "t").glob("*.parquet"))
    for frame in (df, df.join(df.withColumnRenamed("t", "u"), "pair_id")):
        assert ev.spread(frame, "pair_id").rdd.getNumPartitions() == -(-size // (1 << 16))
