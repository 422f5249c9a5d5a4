"""Small fixtures: texts with edge cases, and brute-force versions of the operators."""
import hashlib
import random
import re
from collections import Counter, defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def make_texts(seed=7, n=60):
    """Ids with texts: random prose, copies, near copies, shared passages, odd and empty texts."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice(["ba", "ér", "to", "mi", "ka", "ß", "lo"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, short = prose(64), prose(49)
    out = []
    for i in range(n):
        kind = i % 10
        text = prose(rng.randint(30, 200))
        if kind == 1 and out:
            text = out[-1][1]
        elif kind == 2 and out:
            w = out[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        elif kind == 3:
            text = f"{prose(rng.randint(0, 20))} {passage}\n{prose(rng.randint(0, 20))}"
        elif kind == 4:
            text = f"{prose(5)}\t{short} {prose(5)}"
        elif kind == 5:
            line = prose(9)
            text = "\n".join([line] * 6 + [prose(12)])
        elif kind == 6:
            text = "the same " * rng.randint(1, 90)
        out.append((i, text))
    odd = [None, "", "   \n\t ", "x", "word " * 3, " nbsp　wide a b", "a\x1cb \x1c c  d   e", "é́ ́x  y",
           "<|endoftext|> a<|endoftext|>b <|startoftext|>", "don't we'll THEY'RE  I'm", " lead  and   trail  ", "日本語 テキスト 12345 ½",
           "emoji 👩‍👩‍👧 ​ zero", "\r\nline\r\n\r\nline\r\n", "ΑΣ ὈΔΥΣΣΕΎΣ İstanbul ﬁ", "z" * 5000 + " " + "9" * 500]
    return out + [(n + i, t) for i, t in enumerate(odd)]


def docs_frame(spark, rows, extra=True):
    """A documents table with columns whose names operators use inside, as clashes."""
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    data = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
    if extra:
        schema += ", h long, pos int, rep long, fp long, length long, task int, found string, text_ string, cuts string, score double"
        data = [(*r, 1, 2, 3, 4, 5, 6, "f", "t", "c", 0.5) for r in data]
    return spark.createDataFrame(data, schema)


def brute_repeats(rows, least):
    """{doc_id: set of word positions that lie in a run of ``least`` words standing elsewhere too}, and
    the same without each run's first place."""
    places = defaultdict(set)
    for i, t in rows:
        w = words(t)
        for s in range(len(w) - least + 1):
            places[tuple(w[s:s + least])].add((i, s))
    every, later = defaultdict(set), defaultdict(set)
    for group in places.values():
        if len(group) > 1:
            first = min(group)
            for i, s in group:
                every[i].update(range(s, s + least))
                if (i, s) != first:
                    later[i].update(range(s, s + least))
    return every, later


def brute_cut(text, gone):
    """The text without the words at ``gone``, each with the white space after it."""
    if text is None or not gone:
        return text
    spans = [m.span() for m in WORD.finditer(text)]
    out, at = "", 0
    for k, (a, _) in enumerate(spans):
        end = spans[k + 1][0] if k + 1 < len(spans) else len(text)
        out += text[at:a]
        out += "" if k in gone else text[a:end]
        at = end
    return out + text[at:]


def brute_quality(text):
    w = words(text)
    seen = Counter(tuple(w[s:s + 8]) for s in range(len(w) - 7))
    rep = {k for s in range(len(w) - 7) if seen[tuple(w[s:s + 8])] > 1 for k in range(s, s + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text or "")),
            "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(rep),
            "base_failed": len(w) < 20 or 100 * len(rep) > 30 * len(w), "covered_words": len(rep)}


def brute_longest(text, least=8):
    """Longest word run found twice in a text (0 below ``least``)."""
    w, best = words(text), 0
    for a in range(len(w)):
        for b in range(a + 1, len(w)):
            n = 0
            while b + n < len(w) and w[a + n] == w[b + n]:
                n += 1
            best = max(best, n)
    return best if best >= least else 0


def brute_fingerprint(text):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(low)
    if not w:
        return 0
    shingles = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, bits=3):
    """{id: least id reachable} over links of ``bits`` or fewer differing bits."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= bits:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_base_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, "assign", m.end()))
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(out)]


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0


def brute_base_pii(text):
    text = text or ""
    count = lambda s: sum(c in "0123456789" for c in s)
    out = [(0, m.start(), "email", m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, m.start(), "ip", m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(2, m.start(), "card", m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text)
            if 13 <= count(m[0]) <= 19 and luhn(m[0])]
    out += [(3, m.start(), "phone", m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= count(m[0]) <= 15]
    return [f"{k}:{a}:{b}" for _, a, k, b in sorted(out)]
