"""Jaccard join against brute force."""
import random

import numpy as np
import pytest
from cases import docs_frame, words

from tandem.llm import jaccard_join


def shingles(text, width=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    return {" ".join(w[i:i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute(rows, width=5, percent=80):
    """[(doc_id, set size, least id reachable)] for each row."""
    sets = [shingles(t, width) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            n = len(a & sets[j])
            if a and sets[j] and 100 * n >= percent * (len(a) + len(sets[j]) - n):
                root[find(i)] = find(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)] = min(least.get(find(i), doc_id), doc_id)
    return sorted(((d, len(s), least.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def got(frame, **options):
    return sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.similar(frame, **options).collect()), key=str)


def edits(base, rng, k):
    w = list(base)
    for _ in range(k):
        w[rng.randrange(len(w))] = f"x{rng.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize(("tile_rows", "percent"), [(2048, 80), (4, 80), (2048, 60)])
def test_links_are_exact(spark, rows, tile_rows, percent):
    rng = random.Random(5)
    base = [f"b{i}" for i in range(150)]
    near = [(1000 + i, edits(base, rng, rng.randint(0, 9))) for i in range(40)]
    drift = list(base[:100])  # a chain: each links to the next, its ends share little
    chain = []
    for i in range(30):
        drift[(4 * i) % 100] = f"c{i}"
        chain.append((2000 + i, " ".join(drift)))
    sizes = [(3000 + k, " ".join(f"s{i}" for i in range(k))) for k in range(1, 60)]
    passage = " ".join(f"p{i}" for i in range(64))
    shared = [(4000 + i, f"{edits(base, rng, 150)} {passage} {edits(base[:30], rng, 60)}") for i in range(30)]
    data = rows + near + chain + sizes + shared
    rng.shuffle(data)
    assert got(docs_frame(spark, data), tile_rows=tile_rows, percent=percent) == brute(data, percent=percent)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 700}-{i // 1400}" for i in range(60000))
    data = [(None, None), (1, None), (2, ""), (2, " \n"), (3, "One two"), (4, "one\ttwo"), (5, "one two three four five"),
            (6, "ONE two three four five"), (6, "other words stand here today"), (None, "one two"), (None, "only here"),
            (None, "Only here"), (3, "One two"), (8, long), (9, long + " end"), (7, "é É é É é"), (10, "é é é é é")]
    assert got(docs_frame(spark, data)) == brute(data)
    assert jaccard_join.similar(docs_frame(spark, [])).count() == 0


def test_bounds():
    starts = jaccard_join.band_starts(80, 5000)
    band = lambda n: int(np.searchsorted(starts, n, "right"))
    for n in range(1, 3000):
        assert band(n * 100 // 80) - band(n) <= 1
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 1 << 63, 600, dtype=np.uint64)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 500))) for _ in "ab")
        b = np.unique(np.concatenate([a[: rng.integers(0, len(a) + 1)], b[: rng.integers(0, 60)], a[:1]]))
        apart = jaccard_join.differing(jaccard_join.bitmap(a), jaccard_join.bitmap(b))
        n = len(np.intersect1d(a, b))
        link = 100 * n >= 80 * (len(a) + len(b) - n)
        assert jaccard_join.linked(a, b, 80) == link
        assert not link or jaccard_join.may_link(apart, len(a), len(b), 80)
