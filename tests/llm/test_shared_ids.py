"""One id with several texts: each text is a document of its own."""
import random

from cases import brute_cut, brute_repeats, docs_frame

from tandem.llm import simhash, suffix_dedup


def _prose(seed, k):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(k))


def test_dedup_of_one_id_with_two_texts(spark):
    passage, own = _prose(1, 64), _prose(2, 70)
    long = f"{_prose(3, 300)} {passage} {_prose(4, 20)}"
    data = [(1, f"{passage} {_prose(5, 30)}"), (7, long), (7, "only a few words"), (7, own), (7, "only a few words"),
            (9, f"{own} {_prose(6, 10)}"), (None, long)]
    frame = docs_frame(spark, data)
    spans = {(r["doc_id"], r["start_word"], r["end_word"], r["first_doc"], r["last_doc"])
             for r in suffix_dedup.repeated_spans(frame).collect()}
    assert spans == {(1, 0, 64, 1, 7), (7, 300, 364, 1, 7), (7, 0, 70, 7, 9), (9, 0, 70, 7, 9)}
    texts = {i: t for i, (_, t) in enumerate(data[:-1])}  # documents in the order of ids
    _, later = brute_repeats([x for x in texts.items() if x[0] != 4], 50)
    want = [(d, brute_cut(t, later[i])) for i, (d, t) in enumerate(data[:-1])] + [(None, long)]
    got = [(r["doc_id"], r["text"]) for r in suffix_dedup.cut_repeats(frame).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_passage_shared_by_two_texts_of_one_id_stays_once(spark):
    passage = _prose(1, 64)
    frame = docs_frame(spark, [(3, f"{_prose(2, 9)} {passage}"), (3, f"{passage} {_prose(3, 9)}")])
    assert suffix_dedup.repeated_spans(frame).count() == 2
    got = [r["text"] for r in suffix_dedup.cut_repeats(frame).collect()]
    assert sum(passage in t for t in got) == 1


def test_near_copies_of_one_id_with_two_texts(spark):
    a, b, c = _prose(1, 90), _prose(2, 90), _prose(3, 90)
    frame = docs_frame(spark, [(1, a), (5, a), (5, b), (8, b), (9, c), (9, c), (None, c)])
    got = {(r["doc_id"], r["fingerprint"]): (r["component_id"], r["is_kept"]) for r in simhash.near_duplicates(frame).collect()}
    fa, fb, fc = (f"{simhash.fingerprint(t.encode()):016x}" for t in (a, b, c))
    assert got == {(1, fa): (1, True), (5, fa): (1, False), (5, fb): (5, True), (8, fb): (5, False), (9, fc): (9, True),
                   (None, fc): (9, False)}
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_one(frame).collect()), key=str)
    assert kept == sorted([(1, a), (5, b), (9, c), (9, c), (None, c)], key=str)
