"""Search, archives, the pipeline, and edge cases that all operators share."""
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from cases import brute_base_secrets, brute_components, brute_cut, brute_fingerprint, brute_repeats, docs_frame, words

import corpus_pipeline
from tandem.llm import bpe, hnsw, packing, pii, quality, secrets_scan, simhash, suffix_dedup, toxicity, warc
from tandem.llm.queries import ORACLE_SQL, QUERIES
from tandem.session import scratch_path

SMALL = "/root/testdata/sf0.001"


def brute_nearest(vectors, queries, k):
    out = {}
    for qid, q in queries:
        best = []
        for i, v in vectors:
            if i != qid:
                s = float(np.dot(v, q) / (math.sqrt(np.dot(v, v)) * math.sqrt(np.dot(q, q))))
                best.append((-s, i))
        out[qid] = [i for _, i in sorted(best)[:k]]
    return out


@pytest.mark.parametrize("shard_rows", [8192, 150])
def test_search_recall_and_scores(spark, shard_rows):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[100:140] = x[7]  # one vector many times: ties go to the least ids
    data = [(int(i), [float(a) for a in v], 1, 2.0) for i, v in enumerate(x)]
    odd = [(2000, None, 1, 2.0), (2050, [0.0] * 24, 1, 2.0), (2100, [float("nan")] + [1.0] * 23, 1, 2.0), (2150, [], 1, 2.0),
           (2200, [None] * 24, 1, 2.0), (None, [1.0] * 24, 1, 2.0), (2250, [1.0], 1, 2.0)]
    frame = spark.createDataFrame(data + odd + data[:50], "vec_id long, embedding array<float>, shard int, score double")
    rows = hnsw.nearest(frame, frame.where("vec_id % 50 = 0"), shard_rows=shard_rows).collect()
    full = [(i, x[i].astype(np.float64)) for i in range(900)]
    want = brute_nearest(full, full[::50], 5)
    got = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append(r["vec_id"])
        a, b = x[r["query_id"]].astype(float), x[r["vec_id"]].astype(float)
        assert abs(r["score"] - a @ b / math.sqrt(a @ a) / math.sqrt(b @ b)) < 1e-12
    assert set(got) == set(want) and all(len(set(v)) == 5 for v in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
    assert got[100] == [7, 101, 102, 103, 104]


def test_search_few_and_no_rows(spark):
    schema = "vec_id long, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert hnsw.nearest(empty, empty).count() == 0
    two = spark.createDataFrame([(0, [1.0, 0.0]), (50, [1.0, 1.0])], schema)
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in hnsw.nearest(two, two).collect()) == [(0, 1, 50), (50, 1, 0)]


def test_search_lengths_and_large_components(spark):
    """Each length is searched among its own; components near the end of the range do not overflow."""
    rng = np.random.default_rng(8)
    rows = [(50 * i, (rng.normal(size=4) * 1e200).tolist()) for i in range(8)] + [(50 * i + 1, (rng.normal(size=3) * 1e-170).tolist()) for i in range(8)]
    rows += [(50 * i + 2, rng.normal(size=4).tolist()) for i in range(8)] + [(5000, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = hnsw.nearest(frame, frame.where("vec_id % 50 = 0")).collect()
    unit = {i: np.array(v) / max(map(abs, v)) / np.linalg.norm(np.array(v) / max(map(abs, v))) for i, v in rows}
    for q in {i for i, _ in rows if i % 50 == 0}:
        want = sorted(((-float(unit[q] @ u), i) for i, u in unit.items() if i != q and len(u) == len(unit[q])))[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [i for _, i, _ in mine] == [i for _, i in want]
        assert all(abs(s + w) < 1e-12 for (_, _, s), (w, _) in zip(mine, want, strict=True))


@pytest.mark.parametrize("shard_rows", [8192, 500])
def test_recall_on_the_embeddings_table(spark, shard_rows):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], np.array(r["embedding"], dtype=np.float64)) for r in table.collect()]
    want = brute_nearest(rows, [r for r in rows if r[0] % 50 == 0], 5)
    got = {}
    for r in hnsw.nearest(table, table.where("vec_id % 50 = 0"), shard_rows=shard_rows).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = sum(len(got[q] & set(w)) for q, w in want.items()) / (5 * len(want))
    print(f"recall@5 with shards of {shard_rows}: {recall:.3f}")
    assert recall >= 0.9


def test_insertion_recall_in_one_graph():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 32))
    x[2000:] = x[:2000] + 0.1 * rng.normal(size=(2000, 32))
    members, layers = hnsw.build_graph(np.arange(4000), x)
    unit = hnsw._unit(x)
    found = hnsw.search_graph(unit, members, layers, unit[:200])
    sim = unit[:200] @ unit.T
    want = np.argsort(-sim, axis=1)[:, :6]
    assert np.mean([len(set(w) & set(f)) / 6 for w, f in zip(want, found, strict=True)]) > 0.95
    assert len(layers) > 1 and all((a < len(m)).all() for a, m in zip(layers, members, strict=True))


def pages(spark):
    big, other = "<p>" + "é" * 700 + "</p>", "x" * 1000
    data = [(1, "http://a/1", big), (2, "http://a/2", big), (9, "http://a/\r\nX: y", big), (3, None, None), (4, "http://b", ""),
            (5, "http://b/é ü", "small"), (6, "u", "small"), (7, "u", other), (7, "u", other), (8, "u", other + "y"),
            (None, "u", other), (None, "n", "z" * 2000), (11, "u", "line\r\n\r\nWARC/1.1\r\n\r\n" * 100)]
    return spark.createDataFrame([(*r, "d", 1) for r in data], "page_id long, url string, html string, digest string, size int")


def test_warc_round_trip(spark):
    frame = pages(spark)
    got = sorted(warc.archive_and_read(frame).collect(), key=repr)
    rows = [(r["page_id"], (r["html"] or "").encode()) for r in frame.collect()]
    best = {}
    for i, p in rows:
        best[p] = max([x for x in (best.get(p), i) if x is not None], default=None)
    want = []
    for i, p in rows:
        again = len(p) >= 1000 and i != best[p]
        want.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", best[p] if again else None))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_warc_selected_records(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(pages(spark), folder)
    rows = warc.read_records(index.where("url = 'http://b/é ü' or page_id = '11'"), folder).collect()
    assert {r["page_id"]: bytes(r["payload"]).decode() for r in rows} == {"5": "small", "11": "line\r\n\r\nWARC/1.1\r\n\r\n" * 100}
    assert {r["url"] for r in rows} == {"http://b/é%20ü", "u"}


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracles(spark, duck, name):
    got = QUERIES[name](spark, SMALL)
    want = duck(SMALL).execute(ORACLE_SQL[name])
    cols = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(cols)
    assert sorted(map(tuple, got.select(*cols).collect()), key=repr) == sorted(want.fetchall(), key=repr)


def operators(vocab):
    model = {"share": 0.25}
    word, byte = vocab("word_bpe_49k.json"), vocab("byte_bpe_50k.json")
    return {"spans": suffix_dedup.repeated_spans, "cut": suffix_dedup.cut_repeats, "quality": quality.repetition,
            "secrets": secrets_scan.secret_report, "mask": secrets_scan.mask_secrets, "toxic": lambda d: toxicity.score(d, model),
            "reject": lambda d: toxicity.reject_toxic(d, model), "simhash": simhash.near_duplicates, "keep": simhash.keep_one,
            "pack": lambda d: packing.pack(d, word), "bpe": lambda d: bpe.round_trip(d, byte), "pii": pii.personal_report}


NAMES = ["spans", "cut", "quality", "secrets", "mask", "toxic", "reject", "simhash", "keep", "pack", "bpe", "pii"]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, vocab, name):
    assert operators(vocab)[name](docs_frame(spark, [])).count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_null_and_repeated_rows(spark, vocab, name):
    data = [(None, None), (None, "some words"), (1, None), (1, ""), (2, "same text here"), (2, "same text here"), (3, "same text here")]
    got = operators(vocab)[name](docs_frame(spark, data)).collect()
    if name == "spans":
        assert not got
    elif name == "keep":  # 1: no word; 2: the least of its group, twice; null ids cannot be dropped by id
        assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == [
            (False, 1), (False, 1), (False, 2), (False, 2), (True, 0), (True, 0)]
    else:
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in data)


def test_pipeline_stages(spark, tmp_path, rows, vocab):
    """Every stage against brute force on what the stage before it kept."""
    bad = " vileword grossname nastycall"
    rng = random.Random(3)
    filler = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(filler) for _ in range(k))
    data = rows + [(500 + i, prose(60) + (bad * 3 if i % 4 == 0 else "")) for i in range(160)]
    data += [(900, f"{prose(30)} password=hunter2secret")]
    docs_frame(spark, data, extra=False).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(500 + i, int(i % 4 == 0)) for i in range(160)] + [(i, 0) for i, _ in rows]
    spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id long, quality int, toxic int").write.parquet(
        f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        path = f"{tmp_path}/{name}"
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(path)
        if name != "best_fit_packing":
            assert out.columns == list(corpus_pipeline.COLUMNS)
            docs = spark.read.parquet(path)
            got = {r["doc_id"]: r["text"] for r in docs.collect()}
            assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in docs.collect())
        kept[name] = (before, got)
    before, got = kept["toxicity"]
    toxic = {i for i, t in labels if t}
    assert not toxic & set(got) and len(set(before) - toxic - set(got)) <= 2
    before, got = kept["simhash_near_dedup"]
    worded = {i: brute_fingerprint(t) for i, t in before.items() if words(t)}
    assert len(before) - len(worded) >= 3 and set(got) == set(before) - set(worded) | set(brute_components(worded).values())
    before, got = kept["suffix_array_dedup"]
    _, later = brute_repeats(list(before.items()), 50)
    assert got == {i: brute_cut(t, later.get(i, set())) for i, t in before.items()}
    before, got = kept["secret_scan"]
    assert got[900].endswith("[SECRET]") and {i for i in got if got[i] != before[i]} == {
        i for i, t in before.items() if brute_base_secrets(t)}
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(vocab("word_bpe_49k.json"))
    packed = spark.read.parquet(f"{tmp_path}/best_fit_packing").collect()
    assert {r["doc_id"] for r in packed} == set(got)
    for r in packed:
        ids = np.array([*tk.encode(got[r["doc_id"]] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"]:r["start"] + r["length"]].tobytes())
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, packed))
