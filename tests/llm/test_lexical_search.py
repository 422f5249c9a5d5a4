"""Ranked search against brute force."""
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from cases import docs_frame

from tandem.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        best = []
        for doc, c in held:
            m = 25 + 75 * sum(c.values()) * n_docs // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10 ** 9 * c[t] // (1000 * c[t] + 8 * m))
                        for t in terms(text) if t in c)
            if score:
                best.append((-score, doc is None, doc or 0, doc))
        out += [(item, k + 1, r[3], -r[0]) for k, r in enumerate(sorted(best)[:top])]
    return sorted(out, key=str)


def items_frame(spark, items):
    return spark.createDataFrame([(*r, 1, 2) for r in items], "item_id long, text string, item int, doc_id int")


@pytest.mark.parametrize("item_bytes", [1 << 18, 400])
def test_ranks_and_scores(spark, rows, item_bytes):
    rng = random.Random(2)
    vocab = sorted({t for _, text in rows for t in terms(text)})
    shared = rng.sample(vocab, 8)
    items = [(i, " ".join(rng.sample(shared, 5) + rng.choices(vocab, k=rng.randint(0, 12)))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "!? --"), (93, "nowhere0"), (94, "THE the, The"), (95, "é́ 12345 ½"), (96, items[3][1]),
              (3, "the same"), (3, "the same"), (None, "same word"), (97, "日本語 a\x7fb")]
    docs = rows + [(500 + i % 7, "the same words again") for i in range(40)] + [(None, "the same words again"), (None, "word")]
    got = lexical_search.search(docs_frame(spark, docs), items_frame(spark, items), item_bytes=item_bytes).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)


def test_long_text_and_no_rows(spark):
    docs = [(1, "alpha " * 300000 + "beta"), (2, "alpha beta"), (3, "gamma"), (4, None)]
    items = [(1, "beta alpha"), (2, "gamma " * 20000)]
    got = lexical_search.search(docs_frame(spark, docs), items_frame(spark, items)).collect()
    assert sorted(map(tuple, got), key=str) == brute(docs, items)
    for d, i in ((docs, []), ([], items), ([(1, "...")], items), (docs, [(1, None)])):
        out = lexical_search.search(docs_frame(spark, d), items_frame(spark, i))
        assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0


def test_shared_sets_are_summed_once():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(rng.sample(words[:12], 9) + rng.sample(words, 6)) for _ in range(50)]
    plan = lexical_search.QueryPlan([t.encode() for t in texts])
    part = np.array([[rng.randrange(1000) for _ in range(7)] for _ in plan.terms], dtype=np.int64)
    place = {t.decode(): i for i, t in enumerate(plan.terms)}
    for text, scores in zip(texts, plan.scores(part), strict=True):
        assert scores.tolist() == sum(part[place[w]] for w in text.split()).tolist()
    assert len(plan.nodes) + sum(map(len, plan.items)) < 0.8 * sum(len(set(t.split())) for t in texts)
