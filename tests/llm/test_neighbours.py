"""Why op1 meets runs by hash: neighbours in the order of following words miss a repeat that runs by hash find."""
from cases import brute_repeats, docs_frame, words

from tandem.llm import suffix_dedup


def test_neighbour_comparison_misses_a_left_match(spark):
    """A and B share 25 words left and 25 right of an anchor; A and C share the anchor and 60 words right of it, and
    nothing left. In the order of following words A's neighbours are C and its copy C2: B is no neighbour of A."""
    left, anchor = [f"l{i}" for i in range(25)], [f"m{i}" for i in range(5)]
    right = [f"r{i}" for i in range(60)]
    a = ["a0"] + left + anchor + right + ["z1"]
    b = ["b0"] + left + anchor + right[:20] + ["b1"]
    c, c2 = ["c0"] + anchor + right + ["a1"], ["c1"] + anchor + right + ["zz"]
    docs = dict(enumerate([a, b, c, c2]))
    at = {i: w.index("m0") for i, w in docs.items()}
    order = sorted(docs, key=lambda i: docs[i][at[i]:])
    place = order.index(0)
    assert 1 not in order[max(0, place - 1):place + 2]  # no neighbour of A
    rows = [(i, " ".join(w)) for i, w in docs.items()]
    got = {}
    for r in suffix_dedup.repeated_spans(docs_frame(spark, rows), min_words=50, anchor_words=5).collect():
        got.setdefault(r["doc_id"], set()).update(range(r["start_word"], r["end_word"]))
    every, _ = brute_repeats(rows, 50)
    assert got == dict(every) and set(range(1, 51)) <= got[0] and got[1] == set(range(1, 51))
    assert [words(t)[1] for _, t in rows[:2]] == ["l0", "l0"]
